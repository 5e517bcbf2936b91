"""Cases of every operator: nulls, ties, repeated rows, clashing names, very long texts, and whole results by brute force."""

import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from brute import jaccard, quality, repeats

from ridgeline.llm import bpe, dac, jaccard as join, mixing, pii as private, quality as rules, suffix, topk, toxicity, urls


@pytest.fixture(scope="module")
def P():
    return pytest.importorskip("public_tokenizers")


#: Null and repeated ids, null and empty texts, equal rows, a very long text, and columns with names of our own.
ODD = [
    (None, "a text without an id", None, 1),
    (None, "a text without an id", None, 1),
    (7, None, "s", 1),
    (7, "", "s", 2),
    (7, "one two three four five six seven", "s", 3),
    (7, "one two three four five six seven", "s", 3),
    (8, "word and more " * 20_000, "t", 4),
    (9, "x" * 2000, "t", 5),
]
ODD_SCHEMA = "doc_id long, text string, source string, row long"


@pytest.fixture(scope="module")
def odd(spark, saved):
    from pyspark.sql import functions as F

    path = saved([(*r, "c", 1, 2) for r in ODD], ODD_SCHEMA + ", _rl_row string, size int, label int")
    return path.withColumn("key", F.lit(1))  # a projection of a stored table


def test_every_operator_takes_odd_rows(spark, odd, P):
    n = len(ODD)
    trusted = spark.createDataFrame([(7,), (None,)], "doc_id long")
    assert rules.judge(odd, trusted).count() == n
    assert dac.round_trip(odd, P.path("word_bpe_49k.json"), 2).count() == n
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == n
    assert private.report(odd).count() == n and private.redact(odd).columns == odd.columns
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in join.classes(odd).collect()) == [(-1, 1, -1), (-1, 1, -1), (7, 0, 7), (7, 0, 7), (7, 3, 7), (7, 3, 7), (8, 3, 8), (9, 1, 9)]
    assert join.keep_one(odd).count() == 6 and mixing.mix(odd).columns == odd.columns
    got = mixing.plan(odd).collect()
    assert len(got) == n and all(0 <= r.taken <= 2 * r.size for r in got)
    vocabulary = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    assert bpe.round_trip(odd, P.PATTERN, vocabulary).count() == n
    assert suffix.remove_repeats(odd).count() == n


def test_removed_bytes_of_odd_rows(odd):
    want = repeats([(8, ODD[6][1]), (9, ODD[7][1])])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(odd).where("doc_id >= 8").collect()}
    assert got == want


def test_places_need_a_stored_table(spark, odd):
    with pytest.raises(ValueError, match="no place"):
        join.classes(odd.orderBy("doc_id"))


def test_ratio_by_brute_force(spark, saved):
    """With the parameters of production."""
    import xxhash

    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words[:120] if i < 40 else words, k=80)), "s", i) for i in range(60)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def grams(text):
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in text.split()]
        long = lambda v, seed: xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return collections.Counter(x % rules.BUCKETS for x in h + [signed(long(b, long(a, 42))) for a, b in zip(h, h[1:])])

    trusted = set(range(0, 40, 2))
    own = {i: grams(t) for i, t, *_ in rows}
    raw, target = sum(own.values(), collections.Counter()), sum((own[i] for i in trusted), collections.Counter())
    means = {}
    for i, g in own.items():
        n, mine = sum(g.values()), i in trusted
        share = (sum(target.values()) - n * mine) / (sum(raw.values()) - n)
        total = sum(round(1e6 * math.log((target[b] - k * mine + rules.PRIOR) / ((raw[b] - k) * share + rules.PRIOR))) * k for b, k in g.items())
        means[i] = total / n
    reached = sorted(math.floor(means[i]) for i in trusted if quality(rows[i][1])[0] >= 50 and 2 * quality(rows[i][1])[4] <= quality(rows[i][1])[0])
    asked = min(rules.LEAST * 1e6, reached[max(0, math.ceil(rules.MISSED * len(reached)) - 1)])
    for r in rules.judge(saved(rows, ODD_SCHEMA), spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect():
        assert r.llr * 1e6 == pytest.approx(means[r.doc_id], abs=1.5)
        assert r.kept == (not r.base_failed and means[r.doc_id] >= asked)


def test_codes_follow_the_library_with_added_tokens(spark, saved, P):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer, rng, start = Tokenizer.from_file(path), random.Random(12), 0
    parts = ["<|endoftext|>", "<|startoftext|>", " the", "Word.", " ", "\n", "\u0130", "H\u0331", "\u03a3", "\u00a0", "don't", ",", "12", "\u65e5\u672c"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(12))), "s", 0) for i in range(300)]
    flat = []
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/codes-{rng.random()}"
    dac.write(saved(rows, ODD_SCHEMA), folder, path, 2)
    got = {r.doc_id: r for r in dac.documents(spark, folder).collect()}
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].middle_id) == (start, len(ids), zlib.crc32(ids.tobytes()), ids[len(ids) // 2])
        start += len(ids)
        flat += ids.tolist()
    places = spark.createDataFrame([(k,) for k in (0, 17, len(flat) - 1, len(flat), -1, None)], "place long")
    assert {r.place: r.id for r in dac.token_at(spark, folder, places).collect()} == {k: flat[k] for k in (0, 17, len(flat) - 1)}


def test_codes_with_another_tokenizer(saved, P):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rows = [(0, "Two words,\nand  blanks", "s", 0), (1, None, "s", 0)]
    got = {r.doc_id: r for r in dac.round_trip(saved(rows, ODD_SCHEMA), path, 2).collect()}
    assert got[0].n_tokens == len(Tokenizer.from_file(path).encode(rows[0][1], add_special_tokens=False).ids) + 1 and got[1].n_tokens == 1


def test_bpe_of_all_scripts(spark, P):
    tiktoken = pytest.importorskip("tiktoken")
    vocabulary = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(vocabulary), special_tokens={})
    rng = random.Random(13)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x370, 0x600), range(0xE00, 0xE80), range(0x1C80, 0x1C90), range(0xA7C0, 0xA800), range(0x4E00, 0x9FFF), range(0x10D40, 0x10D90), [9, 10, 32, 0xA0, 0x85, 0x2003]]
    rows = [(i, "".join(chr(rng.choice(rng.choice(pools))) if rng.random() < 0.7 else rng.choice(["'s", " the", "ing", "  "]) for _ in range(rng.randrange(40)))) for i in range(800)]
    rows += [(9000, "".join(chr(rng.choice(range(0x4E00, 0x9FFF))) for _ in range(600)))]  # one run of many letters
    got = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), P.PATTERN, vocabulary).collect()}
    assert [i for i, t in rows if got[i] != hashlib.sha256(",".join(map(str, library.encode_ordinary(t))).encode()).hexdigest()] == []


def test_a_chain_of_near_copies_is_one_class(saved):
    rng = random.Random(14)
    words = [f"{rng.randrange(10**9)}" for _ in range(100 + 250 * 9)]
    ids = rng.sample(range(250), 250)
    rows = sorted((ids[i], " ".join(words[9 * i : 9 * i + 100])) for i in range(250))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.classes(saved(rows, "doc_id long, text string")).collect())
    assert got == jaccard(rows) and {c for *_, c in got} == {0}


def test_components_of_a_long_path(spark):
    rng = random.Random(15)
    names = rng.sample(range(20_000), 5000)
    edges = spark.createDataFrame(list(zip(names, names[1:])) + [(30_000, 30_001)], "a long, b long")
    got = {r.row: r.label for r in join.components(edges).collect()}
    assert got == {n: min(names) for n in names} | {30_000: 30_000, 30_001: 30_000}


def test_blocks_of_long_lists(saved, monkeypatch):
    monkeypatch.setattr(join, "BLOCK", 8)
    monkeypatch.setattr(join, "SHORT", 4)
    rng = random.Random(16)
    words, rows = [f"w{i}" for i in range(2000)], []
    base = [rng.choices(words, k=100) for _ in range(2)]
    for i in range(80):
        text = list(base[i % 2])
        for _ in range(rng.randrange(5)):
            text[rng.randrange(100)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    passage = " ".join(rng.choices(words, k=60))
    rows += [(200 + k, " ".join(rng.choices(words, k=rng.randrange(5, 14))) + " " + passage) for k in range(40)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.classes(saved(rows, "doc_id long, text string")).collect())
    assert got == jaccard(rows)


def test_mix_is_the_same_however_files_are_split(saved, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 64)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(17)
    rows = [(i if i % 7 else None, "w " * rng.randrange(60), rng.choice("aabc"), 0) for i in range(1500)] + [(5, "w w w", "a", 0)] * 40
    key = lambda df: sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.plan(df).collect())
    assert key(saved(rows, ODD_SCHEMA, 1)) == key(saved(rows, ODD_SCHEMA, 8))


def test_repeats_with_zero_bytes(saved):
    rng = random.Random(18)
    core = "".join(rng.choices("ab\0", k=130))
    rows = [(i, "".join(rng.choices("a\0", k=rng.randrange(260)))) for i in range(30)]
    rows += [(100 + i, "".join(rng.choices("\0a", k=rng.randrange(14))) + core[rng.randrange(20) : rng.randrange(110, 130)]) for i in range(30)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(saved(rows, "doc_id long, text string")).collect()}
    assert got == repeats(rows)


def test_vectors_beyond_exact_scores_are_refused(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(df, df).collect()
    clash = spark.createDataFrame([(50, [0.5], 1), (51, [0.25], 2), (52, [], 3)], "vec_id long, embedding array<double>, id int")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(clash, clash.where("vec_id % 50 = 0")).collect()] == [(50, 51, 128 * 64)]


def test_url_rules_of_long_hosts_and_of_too_many_shapes(spark, monkeypatch):
    host = ".".join(["a" * 60] * 40) + ".net"
    rules = spark.createDataFrame([("net", "/", "block"), (host, "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, f"http://x.{host}/"), (2, f"http://{host[1:]}/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, rules).collect()} == {1: "allow", 2: "block"}
    monkeypatch.setattr(urls, "SHAPES", 1)
    with pytest.raises(ValueError, match="shapes"):
        urls.judge_urls(pages, rules)


def test_further_links_join_classes(spark):
    rng = random.Random(19)
    edges = [tuple(rng.sample(range(400), 2)) for _ in range(300)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    labels = join.components(frame(edges[:120]))
    for k in (120, 130, 250):
        labels = join._with_links(labels, frame(edges[k : {120: 130, 130: 250, 250: 300}[k]]))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, join.components(frame(edges)).collect()))


def test_bpe_of_long_runs(spark, P):
    """Runs that the pattern doesn't split: cut where no piece spans, then merged by all places of a rank."""
    tiktoken = pytest.importorskip("tiktoken")

    vocabulary = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(vocabulary), special_tokens={})
    rng = random.Random(7)
    alphabets = ["ab", "aaab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "=-", "éèab", "日本語中文的"]
    parts = ["the", "and", "ing", "tion", "er", "on", "re", "ab", "in", "th"]
    texts = ["".join(rng.choices(a, k=rng.randint(100, 1500))) for a in alphabets for _ in range(6)]
    texts += ["".join(rng.choices(parts, k=rng.randint(40, 700))) for _ in range(30)]
    texts += [c * k for c in ("a", "=", "ab") for k in (127, 511, 512, 513, 1100)]
    texts += ["".join(rng.choices(alphabets[3], k=100_000)), "a" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(df, P.PATTERN, vocabulary).collect()}
    for n, text in enumerate(texts):
        assert got[n] == hashlib.sha256(",".join(map(str, library.encode_ordinary(text))).encode()).hexdigest(), text[:80]
