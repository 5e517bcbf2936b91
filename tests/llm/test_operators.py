import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import ROWS, SCHEMA, TEXTS, jaccard, pii, quality, repeats

from ridgeline.llm import bpe, dac, jaccard as join, mixing, pii as private, quality as rules, suffix, topk, toxicity, urls


@pytest.fixture(scope="module")
def P():
    return pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(saved):
    return saved(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(saved):
    return saved([], SCHEMA, 1)


def test_quality_counts_and_verdicts(spark, docs, empty):
    trusted = spark.createDataFrame([(0,), (0,), (9,)], "doc_id long")
    got = {r.doc_id: r for r in rules.judge(docs, trusted).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.judge(empty, trusted).count() == 0
    assert rules.judge(docs, trusted.limit(0)).count() == len(TEXTS)


def test_quality_keeps_prose_and_drops_symbols(spark, saved, monkeypatch):
    monkeypatch.setattr(rules, "PRIOR", 0.001)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    good = [(i, " ".join(rng.choices(words, k=120)), "en", "s", 0) for i in range(60)]
    bad = [(9000 + i, " ".join(w + "###" for w in rng.choices(words, k=120)), "en", "s", 0) for i in range(10)]
    kept = {r.doc_id for r in rules.judge(saved(good + bad, SCHEMA), spark.createDataFrame([(i,) for i in range(60)], "doc_id long")).where("kept").collect()}
    assert kept == set(range(60))


@pytest.mark.parametrize("size", [20, 200])
def test_quality_rejects_bad_documents_at_every_size(spark, saved, size):
    """With the parameters of production; a fifth of the clean documents isn't among the trusted ones."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=120)), "en", "s", 0) for i in range(size)]
    rows += [(9000 + i, " ".join(w + "###" for w in rng.choices(words, k=120)), "en", "s", 0) for i in range(size // 4)]
    trusted = spark.createDataFrame([(i,) for i in range(size) if i % 5], "doc_id long")
    got = {r.doc_id: r for r in rules.judge(saved(rows, SCHEMA), trusted).collect()}
    assert {i for i, r in got.items() if r.kept and i >= 9000} == set()
    assert sum(not got[i].kept for i in range(size)) <= size // 20
    # A trusted document scores like one that isn't.
    means = [np.mean([got[i].llr for i in range(size) if bool(i % 5) == seen]) for seen in (True, False)]
    assert abs(means[0] - means[1]) < 0.05


def test_codes_read_back_any_id():
    ids = np.random.default_rng(2).choice([3, 255, 256, 49407, 70000, 2**31], 3000).astype(np.uint32)
    reader = dac.Reader(dac.pack(ids))
    assert (reader.all() == ids).all()
    assert all(reader.get(i) == ids[i] for i in range(0, 3000, 7))
    assert len(dac.Reader(dac.pack(ids[:0]))) == 0
    with pytest.raises(IndexError):
        reader.get(3000)


def test_codes_of_documents(spark, docs, empty, P):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in dac.round_trip(docs, path, 2).collect()}
    for i, t in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert dac.round_trip(empty, path, 2).count() == 0


def test_automaton_is_the_edit_distance():
    terms = ["moron", "stupid", "scum", "idiot"]
    automaton = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(word))
            word[k : k + 1] = rng.choice([[], [rng.choice("abmnotrs")], [word[k], rng.choice("abmn")]])
            word = word or ["a"]
        word = "".join(word)
        fits = sorted((distance(word, t), n) for n, t in enumerate(terms) if distance(word, t) <= (len(t) >= toxicity.EDIT_LENGTH))
        assert automaton.match(word) == ((fits[0][1], fits[0][0]) if fits else None)


def test_toxicity_tells_abuse_from_quotation(spark, saved, empty):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "se", "to", "vu", "za")]
    text = lambda: " ".join(rng.choices(words, k=40))
    rows = [(i, text() + (" you blockhead " if i % 4 == 0 else " ") + text(), "en", "s", 0) for i in range(200)]
    rows += [(900, text() + " you blockhed " + text(), "en", "s", 0), (901, text() + ' he said "you blockhead" and left ' + text(), "en", "s", 0), (902, None, "en", "s", 0)]
    docs, labels = saved(rows, SCHEMA), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert sorted(model.terms) == ["blockhead", "you"]  # both stand in toxic texts only
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((score[i] >= 0.5) == (i % 4 == 0) for i in range(200))
    assert score[900] >= 0.5 > score[901] and score[902] < 0.5
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 152
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)).terms == []


def test_toxicity_learns_and_finds_words_with_digits_symbols_and_marks(spark, saved):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "se", "to", "vu", "za")]
    text = lambda: " ".join(rng.choices(words, k=40))
    hindi = "\u092e\u0942\u0930\u094d\u0916\u094b\u0902"  # letters and combining marks
    terms = ["blockhead", hindi, "numbskull"]
    # The last term is in 5 of 505 toxic texts.
    rows = [(i, f"{text()} {terms[0] if i < 250 else hindi if i < 500 else terms[2]} {text()}", "en", "s", 0) for i in range(505)]
    rows += [(1000 + i, f"{text()} {text()}", "en", "s", 0) for i in range(900)]
    spelled = ["bl0ckhead", "block_head", "bl*ckhead", "bl0ckh3ad", "blockhead_22", hindi, "numbskull"]
    rows += [(5000 + i, f"{text()} {w} {text()}", "en", "s", 0) for i, w in enumerate([*spelled, "ka_ra", "555"])]
    docs = saved(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in rows if r[0] < 5000], "doc_id long, toxic int"))
    assert set(model.terms) == set(terms)
    find = toxicity.featurizer(model)
    assert [find(f"ka {w} lo")[0] > 0 for w in spelled] == [True] * len(spelled)
    assert [find(f"ka {w} lo")[0] for w in ("ka_ra", "555", "blockers")] == [0, 0, 0]


def test_private_spans(docs, empty):
    got = {r.doc_id: r for r in private.report(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = pii(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in private.KINDS] == [sum(w[0] == k for w in want) for k in private.KINDS]
    assert private.report(empty).count() == 0
    red = {r.doc_id: r.text for r in private.redact(docs).collect()}
    assert red[9] == "mail me at <email> or <ip>, card <card>, call <phone>." and red[3] == "one two three" and red[6] is None


def test_private_patterns_find_unseen_identifiers(saved):
    rows = [(i, f"Please write to mailbox user{i}@mail.example.org today", "en", "s", 0) for i in range(30)]
    rows += [(100, "Please write to mailbox user77(at)example today", "en", "s", 0), (101, "the number 1234567 stands alone", "en", "s", 0)]
    got = {r.doc_id: r for r in private.report(saved(rows, SCHEMA)).collect()}
    assert got[100].spans == "email:24:41" and got[100].n_email == 0
    assert got[101].spans == ""


def test_private_patterns_find_any_shape(saved):
    """Identifiers without digits, of several tokens and beyond a block of tokens; common words aren't taken for them."""
    rows = [(i, f"Please write to mailbox user{i}@mail.example.org today, or ring desk +49 30 {1000000 + 7 * i} now", "en", "s", 0) for i in range(40)]
    filler = " ".join(["lorem"] * 150)
    rows += [
        (100, "Please write to mailbox anna(at)example.", "en", "s", 0),
        (101, "or ring desk 030 555 1234 now", "en", "s", 0),
        (102, f"{filler}  write to mailbox\tbob-at-home, {filler}", "en", "s", 0),
        (103, "Please write to mailbox today, it is today and not tomorrow; today", "en", "s", 0),
        (104, "mailbox", "en", "s", 0),
        (105, "anna writes 030 books", "en", "s", 0),
    ]
    docs = saved(rows, SCHEMA)
    got = {r.doc_id: r.spans for r in private.report(docs).collect()}
    assert got[100] == "email:24:39" and got[101] == "phone:13:25"
    assert got[102] == f"email:{len(filler) + 19}:{len(filler) + 30}"
    assert got[103] == got[104] == got[105] == ""
    red = {r.doc_id: r.text for r in private.redact(docs).collect()}
    assert red[101] == "or ring desk <phone> now" and red[100] == "Please write to mailbox <email>."


def test_url_rules(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    cases = {
        "http://a.example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://A.Example.NET/EN/1": ("a.example.net", "/EN/1", "net/", "block"),
        "https://example.com/de/?x": ("example.com", "/de/", "example.com/de/", "block"),
        "https://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "http://x.org/fr/a://b": ("x.org", "/fr/a://b", "org/fr/", "allow"),
        "http://x.net": ("x.net", "", None, "allow"),
        "x.net/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "://net/#f": ("net", "/", "net/", "block"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "h")], "page_id long, url string, host string")
    got = urls.judge_urls(pages, rules).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert urls.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(cases) + 1


def test_jaccard_classes(docs, empty, saved):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.classes(docs).collect())
    assert got == jaccard([(r[0], r[1]) for r in ROWS])
    assert join.classes(empty).count() == 0
    kept = join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, n, c in got if n} | {d for d, n, _ in got if not n})


def test_jaccard_in_large_groups_of_near_copies(saved):
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(2000)], []
    base = rng.choices(words, k=100)
    for _ in range(90):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(100)] = rng.choice(words)
        rows.append((len(rows), " ".join(text)))
    passage = " ".join(rng.choices(words, k=60))
    rows += [(len(rows) + k, " ".join(rng.choices(words, k=10)) + " " + passage) for k in range(40)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.classes(saved(rows, "doc_id long, text string")).collect())
    assert got == jaccard(rows)


def test_mix_meets_its_targets(saved, empty):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(3000)] + [(5, "w w", "en", "a", 0)] * 3
    docs = saved(rows, SCHEMA)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in got)
    for target in {r.target for r in got}:
        group = [r for r in got if r.target == target]
        assert sum(r.size for r in group) == group[0].source_size and target <= 2 * group[0].source_size
        assert abs(sum(r.taken for r in group) - target) <= 2 * 60
    key = lambda rs: sorted((r.doc_id, r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.plan(docs).collect())
    assert mixing.mix(docs).count() == sum(r.copies for r in got)
    assert mixing.plan(empty).count() == 0


def test_targets_share_what_is_above_the_limit(spark):
    out = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size long")).collect()}
    # a stops at 20; of the other 2995 words b, of weight 2, gets two thirds.
    assert out["a"] == 20 and sum(out.values()) == pytest.approx(1.5 * 2010) and out["b"] == pytest.approx(2995 * 2 / 3)
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_bpe_is_that_of_the_library(docs, empty, P):
    tiktoken = pytest.importorskip("tiktoken")
    vocabulary = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(vocabulary), special_tokens={})
    for limit in (5, bpe.FREQUENT):
        got = {r.doc_id: r for r in bpe.round_trip(docs, P.PATTERN, vocabulary, limit=limit).collect()}
        for i, t in enumerate(TEXTS):
            ids = library.encode_ordinary(t or "")
            assert got[i].n_tokens == len(ids)
            assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(empty, P.PATTERN, vocabulary).count() == 0


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 8).round(2)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(2000, None), (2001, [float("nan")] * 8), (2002, [None] * 8), (2003, [float("inf")] * 8), (None, rows[0][1]), (2050, [0.1] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    usable = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and i < 2000}
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in usable if i % 50 == 0}
    for q, found in got.items():
        want = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:5]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_blind_trie_and_shallow_sort_give_the_order():
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"ab\0", k=rng.randrange(1, 40))) for _ in range(200)] + [b"a" * 39] * 3
    width = 48
    matrix, lengths = np.zeros((len(texts), width), np.uint8), np.array([len(t) for t in texts])
    for k, t in enumerate(texts):
        matrix[k, : len(t)] = list(t)
    group = np.array([k % 3 for k in range(len(texts))])
    order, common = suffix.deep_shallow(matrix, lengths, group)
    padded = [(group[k], texts[k]) for k in order]
    assert sorted(order) == list(range(len(texts)))
    for (g, a), (h, b), c in zip(padded, padded[1:], common[1:]):
        shared = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert c == (-1 if g != h else shared)


def test_repeats_are_removed(docs, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}
    assert got == repeats([(r[0], r[1]) for r in ROWS])
    assert suffix.remove_repeats(empty).count() == 0


def test_pipeline_follows_its_stages(spark, tmp_path, saved, P):
    import corpus_pipeline

    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "se", "to", "vu", "za")]
    text = lambda: " ".join(rng.choices(words, k=60))
    rows = [(i, text() + (" you blockhead " if i % 5 == 0 else " write to a.b@example.com ") + text(), "en", f"s{i % 3}", 0) for i in range(100)]
    rows += [(200 + i, rows[i + 1][1], "en", "s0", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = {i: t for i, t, *_ in rows if i < 100 and i % 5}
    assert {r.doc_id for r in got} <= set(clean)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].replace("a.b@example.com", "<email>").encode()).hexdigest()
    sizes = {i: len(t.split()) for i, t in clean.items()}
    assert abs(sum(sizes[r.doc_id] for r in got) - 1.5 * sum(sizes.values())) <= 3 * 130
