"""Plain versions of the operators' results, to hold them against."""

import collections
import hashlib
import re

SPACE = r"[^\x20\x09-\x0D]+"

TEXTS = [
    "The quick brown fox jumps over the lazy dog. " * 12,
    "The quick brown fox jumps over the lazy dog. " * 12,
    "the QUICK brown fox jumps over the lazy dog. " * 12,
    "one two three",
    "One two three",
    "",
    None,
    "   \n\t ",
    "Übergrößenträger naïve café 日本語 😀 " * 5,
    "mail me at a.b@example.com or 12.197.240.125, card 4418452524842581, call +1 (784) 555-8120.",
    "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 4111-1111 1111 1111 +12345678 +123",
    "x" * 3000,
    "line one\nline one\nline two\n\nline one " + "w " * 60,
    "word" + " word" * 400,
    "A sentence that is shared by more than one of these texts, and which is long enough to be found as a repeat of one hundred bytes. End A.",
    "Some start. A sentence that is shared by more than one of these texts, and which is long enough to be found as a repeat of one hundred bytes.",
]

ROWS = [(i, t, "en", f"src{i % 4}" if i % 5 else None, -i) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, row long"


def pii(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def jaccard(rows, width=5, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    return sorted((doc_id, len(sets[i]), min(least[find(i)])) for i, (doc_id, _) in enumerate(rows))


def repeats(rows, length=100):
    seen, out = set(), {}
    for doc_id, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def quality(t):
    t = t or ""
    w = re.findall(SPACE, t)
    triples = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked))
