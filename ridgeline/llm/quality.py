"""Quality rules: surface rules, then a hashed n-gram log-likelihood ratio.

Single words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets, one of a
trusted target and one of the whole corpus, give each bucket a log ratio; a document's score is the mean over its
n-grams. A document never speaks for itself: its own n-grams are taken out of both counts before it is judged, so
trusted and unseen documents score alike. Where the target is too small for its own documents to reach the least mean,
the mean that nearly all of them reach is asked for instead. Ratios are whole millionths, so sums are exact and every
document is judged alike on each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm._common import SPACE, stored, words

#: Buckets; least mean log ratio kept; n-grams that each bucket is taken to have besides, seen and expected alike; share
#: of the trusted documents that may fall below the mean that is asked for.
BUCKETS, LEAST, PRIOR, MISSED = 1 << 14, -0.04, 0.3, 0.01
#: Trusted ids that are sent to all tasks at most; more of them meet the documents by a shuffle.
SENT = 1 << 20
UNIT = 1_000_000
SYMBOLS = "#*$%&|<>"


def _grams(hashes: Column) -> Column:
    """Buckets of all words and neighbouring pairs."""
    pairs = F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def _counted(df: DataFrame) -> DataFrame:
    """by_bucket from grams: each bucket of the document once, with how many of its n-grams are in it."""
    df = df.withColumn("sorted", F.sort_array("grams"))
    df = df.withColumn("ends", F.array_compact(F.transform("sorted", lambda b, i: F.when(~b.eqNullSafe(F.get("sorted", i + 1)), F.struct(b.alias("bucket"), i.alias("i"))))))
    return df.withColumn("by_bucket", F.transform("ends", lambda e, k: F.struct(e["bucket"].alias("bucket"), (e["i"] - F.coalesce(F.get("ends", k - 1)["i"], F.lit(-1))).alias("own"))))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("w", words(F.col("text"))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from h: words in windows of three that occur twice or more."""
    n = F.size("h")
    df = df.withColumn("win", F.transform(F.slice("h", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("h", i + 1), F.get("h", i + 2))))
    df = df.withColumn("again", F.size(F.array_distinct("win")) < F.size("win"))
    df = df.withColumn("placed", F.when(F.col("again"), F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("placed", k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("places", F.sort_array(F.array_compact(F.transform("placed", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])))))
    covered = F.aggregate(F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def target_ids(trusted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """id, is_target: all trusted ids, each once."""
    ids = trusted.select(F.col(doc_id).cast("long").alias("id")).where("id is not null").distinct()
    return stored(ids.withColumn("is_target", F.lit(1)), "target")


def _sent(ids: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= limit else ids


def fit(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, raw, target: n-grams of all documents, and of those of the target."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    grams = _hashed(narrow).join(ids, "id", "left").select("is_target", F.explode(_grams(F.col("h"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.coalesce(F.sum("is_target"), F.lit(0)).alias("target"))
    return stored(counts, "ngrams")  # BUCKETS rows


def judge(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, sent: int = SENT) -> DataFrame:
    """Counts, rule verdict and log-likelihood ratio of every document.

    trusted: rows whose doc_id names a document of the target. A null text has no words, fails the rules (under 50
    words) and has ratio 0; repeated rows and null ids are judged like others; without trusted ids all ratios are 0.
    The mean asked for is `least`, or less if more than MISSED of the target's own documents would fall below it.
    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.
    """
    ids = _sent(target_ids(trusted, doc_id), sent)
    model = fit(docs, ids, doc_id, text)
    sums = model.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), body.alias("text"))
    counted = _repeat_words(_hashed(narrow))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counted = counted.withColumn("lines", lines).select(
        "row",
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        _grams(F.col("h")).alias("grams"),
    )
    counted = _counted(counted.join(ids.withColumnRenamed("id", "_rl_id"), F.col("doc_id").cast("long") == F.col("_rl_id"), "left"))
    keys = ["row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "is_target", "n"]
    counted = counted.withColumn("is_target", F.coalesce("is_target", F.lit(0))).withColumn("n", F.size("grams").cast("long"))
    scored = counted.select(*keys, F.explode_outer("by_bucket").alias("b")).select(*keys, "b.*").join(F.broadcast(model), "bucket", "left")
    # What the others have of the bucket, and what the target would have of it if it were like them.
    mine, others = F.col("is_target") * F.col("n"), F.greatest(F.lit(sums["raw"]) - F.col("n"), F.lit(1))
    expected = (F.col("raw") - F.col("own")) * ((F.lit(sums["target"]) - mine) / others)
    ratio = F.log((F.col("target") - F.col("is_target") * F.col("own") + PRIOR) / (expected + PRIOR))
    scored = scored.groupBy(*keys).agg(F.coalesce(F.sum(F.round(ratio * UNIT).cast("long") * F.col("own")), F.lit(0)).alias("total"))
    scored = stored(scored, "ratios")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    reached = scored.where(F.expr("is_target = 1 and n > 0") & ~failed).select(F.floor(F.col("total") / F.col("n")).alias("mean"))
    asked = reached.agg(F.expr(f"percentile_disc({MISSED}) within group (order by mean)").alias("mean")).first()["mean"]
    asked = min(round(least * UNIT), round(least * UNIT) if asked is None else int(asked))
    good = F.col("total") >= F.lit(asked) * F.col("n")
    return scored.select(
        F.col("doc_id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & good).alias("kept"), (F.col("total") / F.greatest(F.col("n"), F.lit(1)) / UNIT).alias("llr")
    )
