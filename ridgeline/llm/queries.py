"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.llm import bpe, conversations, counts, dac, jaccard, mixing, pii, quality, runs, suffix, topk, toxicity, urls
from ridgeline.llm._common import table

#: The filter rules of the query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_ratio(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op2_token_codes(spark, sf_dir):
    return dac.round_trip(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2)


def held_out(doc_id):
    """Rows that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op3_toxic_lexicon(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_contextual_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op5_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_jaccard_classes(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_source_mix(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    vocabulary = bpe.read_ranks(_vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.PATTERN, vocabulary)


def op9_bit_sliced_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op10_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_prefix_trie(spark, sf_dir):
    return conversations.nodes(conversations.crossed(table(spark, sf_dir, "conversations")))


def op12_token_counts(spark, sf_dir):
    return counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), limit=512)


def op13_periodic_runs(spark, sf_dir):
    return runs.collapse(table(spark, sf_dir, "documents"), planted=True)


QUERIES = {f.__name__: f for f in (op1_quality_ratio, op2_token_codes, op3_toxic_lexicon, op4_contextual_pii, op5_url_rules, op6_jaccard_classes, op7_source_mix, op8_byte_bpe, op9_bit_sliced_topk, op10_suffix_dedup, op11_prefix_trie, op12_token_counts, op13_periodic_runs)}

#: SQL for crc32 of a string of ASCII characters: eight steps for each, of which the first takes it in.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length({0}) + 1), lambda i: [CAST(ascii({0}[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295)"""

ORACLES = {
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t GROUP BY conv_id),
f AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
p AS (SELECT conv_id, 0 AS d, '' AS role, '' AS text FROM f
      UNION ALL SELECT f.conv_id, k, role, text FROM f JOIN t ON t.conv_id = f.base AND k <= h
      UNION ALL SELECT f.conv_id, k - h + m, role, text FROM f JOIN t ON t.conv_id = f.conv_id AND k > h),
x AS (SELECT conv_id, d, text, max(d) OVER (PARTITION BY conv_id) AS size,
             list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS prefix FROM p),
g AS (SELECT d, prefix, min(conv_id) AS owner, count(*) AS n_convs, any_value(strlen(text)) AS bytes,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = size), '')) AS ends_sha256 FROM x GROUP BY d, prefix),
m AS (SELECT x.conv_id, x.d, g.owner FROM x JOIN g ON x.d = g.d AND x.prefix = g.prefix),
o AS (SELECT g.*, m.owner AS above FROM g LEFT JOIN m ON m.conv_id = g.owner AND m.d = g.d - 1),
k AS (SELECT above AS owner, d - 1 AS d, count(*) AS n_children FROM o WHERE d > 0 GROUP BY ALL),
v AS (SELECT o.owner, o.d, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM o LEFT JOIN k ON k.owner = o.owner AND k.d = o.d),
s AS (SELECT DISTINCT a.owner, a.d, b.owner AS low, b.d AS low_d FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
u AS (SELECT s.owner, s.d, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum(v.saved) AS saved_tokens FROM s JOIN v ON v.owner = s.low AND v.d = s.low_d GROUP BY ALL)
SELECT o.owner AS conv_id, CAST(o.d AS BIGINT) AS depth, above AS parent_conv_id, n_convs, v.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM o JOIN v ON v.owner = o.owner AND v.d = o.d JOIN u ON u.owner = o.owner AND u.d = o.d
""",
    "op13_periodic_runs": rf"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
b AS (SELECT r, doc_id, w, len(w) AS n, coalesce(h % 10 = 0 AND len(w) > 0, false) AS planted, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM a),
c AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM b),
i AS (SELECT r, n, w, planted, a, p, unnest(range(n)) AS i FROM c),
x AS MATERIALIZED (SELECT r, n, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM i),
m AS (SELECT y.r, z.i - y.i AS q, y.i FROM x y JOIN x z ON y.r = z.r AND y.word = z.word AND z.i > y.i AND 3 * (z.i - y.i) <= y.n),
k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM m),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY r, q, part HAVING count(*) + q >= greatest(24, 3 * q)),
t AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length),
o AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM t GROUP BY r),
e AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM t),
d AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM t),
l AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN d ON x.r = d.r AND x.i = d.i GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, e.start, e.length, e.period, 1000 * e.length // e.period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM c LEFT JOIN o ON o.r = c.r LEFT JOIN e ON e.r = c.r AND e.k = 1 LEFT JOIN l ON l.r = c.r
""",
    "op5_url_rules": """
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, h || p AS rule, v,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op9_bit_sliced_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
""",
}
