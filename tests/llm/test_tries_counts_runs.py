"""Prefix tries, token counts and periodic runs against brute force, with odd rows and hot keys."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from ridgeline.llm import conversations, counts, runs


@pytest.fixture(scope="module")
def P():
    return pytest.importorskip("public_tokenizers")


def trie(rows, family=None):
    """Nodes of the trie of conversations; family: as crossed() rebuilds them."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    if family:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: own.get(c - c % family, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = collections.defaultdict(list)
    for c, path in own.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if len(own[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted((*(x if x is not None else -1 for x in r[:-1]), r[-1]) for r in df.collect())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["é", "a", "b c", None])) for c in range(60) for t in range(rng.randint(1, 12)) if c % 7]
    rows += [(None, 0, "user", "x"), (3, None, "user", "first"), (3, None, "user", "first"), (4, 5, "a", "z"), (4, 5, "a", "y"), (9, 0, "user", "a"), (9, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA + ", part int, owner string").repartition(5)
    got = conversations.nodes(conversations.crossed(df))
    assert got.columns == COLUMNS and found(got) == trie(rows, 5)
    assert found(conversations.nodes(conversations.paths(df))) == trie(rows)
    assert conversations.nodes(conversations.crossed(df.limit(0))).count() == 0


def test_trie_splits_copies_and_long_conversations(spark, monkeypatch):
    """A third of the conversations are copies, one holds a third of the turns; blocks and bands of heavy nodes are small."""
    monkeypatch.setattr(conversations, "BLOCK", 64)
    monkeypatch.setattr(conversations, "SHARD", 200)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 300, 3) for t in range(4)]
    rows += [(c, t, "user", f"t{t}" if t < 2 else f"{c}") for c in range(1, 300, 3) for t in range(3)]
    rows += [(1000, t, "user", f"t{t}") for t in range(400)]
    got = conversations.nodes(conversations.paths(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    assert found(got) == trie(rows)


def test_slots_are_minimal_and_know_strangers():
    rng = np.random.default_rng(1)
    high, low = (rng.integers(-(1 << 63), (1 << 63) - 1, 5000) for _ in range(2))
    slots = conversations.Slots(high, low)
    assert sorted(slots.of) == list(range(5000)) and (slots.find(high, low) == slots.of).all()
    assert (slots.find(low, high) == -1).all()
    with pytest.raises(ValueError):
        conversations.Slots(high[[0, 0]], low[[0, 0]])


TEXTS = ["", None, "a<|endoftext|>b  <|endoftext|> c", "It's  they'll \n\n x", "é́ 中文 １２ ⅷ\x85\x1c　 ​", "\U0001f600\U00010400 \U0001d7d8 \U000e0001", "x" * 5000, "word " * 30_000, "<|endoftext|>" * 3, " \t", "\x00 a\x00"]


def test_token_counts_equal_the_library(spark, P, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    made = ["".join(rng.choice("ab '.,\n\t 1é中sLt") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    rows = [(k if k % 5 else None, t, k) for k, t in enumerate([*TEXTS, *TEXTS, *made])]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3)

    def whole():
        return sorted(tuple(r) for r in counts.token_counts(df.na.fill(-1, ["doc_id"]), path).collect())

    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in rows)
    assert whole() == want
    monkeypatch.setattr(counts, "COMMON", 5)  # nearly all by the join
    monkeypatch.setattr(counts, "HELD", 3)
    assert whole() == want
    assert counts.token_counts(df.limit(0), path).count() == 0
    assert counts.token_counts(df, path).where("doc_id is null").count() == sum(i is None for i, _, _ in rows)
    with pytest.raises(ValueError):
        counts.pre_token_patterns(P.path("word_bpe_49k.json"))


def periods(w):
    """(start, length, least period) of all runs, by looking at every period."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            b = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > b and i + q - b >= max(24, 3 * q):
                out.setdefault((b, i + q - b), q)
            i += i == b
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = periods(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    text = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *row, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_runs_equal_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(300):
        w = [rng.choice("abc \x1cé") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(len(w) + 1), rng.randint(1, 14)
            for i in range(a, min(len(w), a + rng.randint(5, 90))):
                w[i] = w[a + (i - a) % p]
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(w))
    texts += [None, "", " \n", "a " * 24, "a " * 23, "a b " * 2000, ("x y z " * 9 + "q ") * 9]
    rows = [(k if k % 9 else None, t, "s", 1) for k, t in enumerate(texts)] + [(5, texts[5], "s", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, length int").repartition(3)
    got = runs.collapse(df, planted=True)
    key = lambda r: (r[0] is None, str(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((collapsed(i, t) for i, t, _, _ in rows), key=key)
    assert runs.collapse(df.limit(0)).count() == 0
    words = [[rng.randrange(3) for _ in range(60)] * 4 for _ in range(20)]
    for w, r in zip(words, runs.find_runs([np.array(w) for w in words]), strict=True):
        assert list(map(tuple, r.tolist())) == periods(w)


def test_grammar_extends_both_ways():
    rng = np.random.default_rng(3)
    s = np.concatenate([[9], rng.integers(0, 2, 300), np.tile([0, 1, 1], 40), [8], np.zeros(50, np.int64), [7]])
    g, n = runs.Grammar(s), len(s)
    i, j = rng.integers(1, n - 1, (2, 3000))
    i, j = i[i != j], j[i != j]
    ahead, back = g.agree(i, j), g.agree(i, j, forward=False)
    for a, b, f, r in zip(i, j, ahead, back, strict=True):
        assert f == next(k for k in range(n) if max(a, b) + k == n or s[a + k] != s[b + k])
        assert r == next(k for k in range(n) if min(a, b) - k < 0 or s[a - k] != s[b - k])
