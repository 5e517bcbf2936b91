"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size. Its whole part is certain;
the fractional parts are rounded in pairs: word mass moves at random from one document of the pair to the other until
one of them is whole, so a pair's words stay as they were and every document keeps its probability. Groups of bounded
size do this side by side; each leaves one fractional document, and the left ones meet in a tree of such groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm._common import WORD, place, stored

#: Documents of one group, fractional documents that meet in one node of the tree.
GROUP, FAN_IN = 4096, 1024

_NODE = "row long, doc_id long, source string, size long, p double, copies int, open boolean, node long, key long, copy long"


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a table with a row (source, source_size) for each source: `share` of all words by
    weight (weights repeat over the sources in code point order, null last), none above `most` times its source; the
    excess goes to the others by weight. Sources stay in Spark: they may be as many as there are hosts."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sources.repartitionByRange(parts, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "sources")
    # Places from one count for each partition of the ranges.
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += n
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    offsets = spark.createDataFrame(offsets, "part int, before long")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("before") + F.col("within"), F.lit(len(weights))) + 1).cast("int"))
    rows = ranged.withColumn("within", within).join(F.broadcast(offsets), "part").select("source", "source_size", weight.alias("weight"))
    rows = stored(rows, "sources")
    left, rate, level = share * (rows.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1.0
    # The sources above the limit at one rate are above it at the next ones, which are higher: a few rounds.
    while True:
        open_ = rows.where(most * F.col("source_size") >= level * F.col("weight"))
        r = open_.agg(F.sum("weight").alias("weight"), F.sum("source_size").alias("size")).first()
        full = rows.where(most * F.col("source_size") < level * F.col("weight")).agg(F.sum("source_size")).first()[0] or 0
        if not r["weight"]:
            break
        rate = (left - most * full) / r["weight"]
        if not open_.where(rate * F.col("weight") > most * F.col("source_size")).limit(1).count():
            break
        level = rate
    return rows.select("source", "source_size", F.least(most * F.col("source_size"), rate * F.col("weight")).alias("target"))


def _settle(group: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Rounds the open documents of a group in turn; one at most stays open."""
    group = group.sort_values(["size", "key", "copy", "row"], ascending=[False, True, True, True], ignore_index=True)
    first = group.iloc[0]
    draw = np.random.Generator(np.random.Philox(key=[seed, abs(hash_of(first["source"])) ^ int(first["node"])])).random(len(group))
    size, p, copies, is_open = group["size"].tolist(), group["p"].tolist(), group["copies"].tolist(), [False] * len(group)
    held = -1
    for j in range(len(group)):
        if held < 0:
            held = j
            continue
        i, a, b = held, size[held], size[j]
        up, down = min((1 - p[i]) * a, p[j] * b), min(p[i] * a, (1 - p[j]) * b)
        if draw[j] * (up + down) < down:
            i_whole, j_whole = up == (1 - p[i]) * a, up == p[j] * b
            p[i], p[j] = (1.0 if i_whole else p[i] + up / a), (0.0 if j_whole else p[j] - up / b)
        else:
            i_whole, j_whole = down == p[i] * a, down == (1 - p[j]) * b
            p[i], p[j] = (0.0 if i_whole else p[i] - down / a), (1.0 if j_whole else p[j] + down / b)
        for k, whole in ((i, i_whole), (j, j_whole)):
            if whole:
                copies[k] += round(p[k])
        held = -1 if i_whole and j_whole else j if i_whole else i
    if held >= 0:
        is_open[held] = True
    return group.assign(p=p, copies=copies, open=is_open)


def hash_of(text) -> int:
    import zlib

    return zlib.crc32((text or "").encode("utf-8", "surrogatepass"))


def plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each document.

    docs must be a stored table: its rows are numbered by their place. A document's size is its number of words; one
    without words (null, empty) adds nothing. Null sources form one source; null ids and repeated rows are documents
    like others. Draws follow ids and texts, so equal tables give equal results however they are split (equal rows may
    swap places); an empty table gives none.
    Returns row (the number), doc_id, size, source_size, target, copies, taken.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.col(source).cast("string")
    row = place(docs)
    sized = docs.select(
        row.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), name.alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(doc_id).cast("long"), name, body).alias("key")
    )
    sized = stored(_numbered(sized), "sizes")
    spark = docs.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = targets(sums.select("source", "source_size"), weights, share, most)
    facts = stored(aims.join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    of = lambda df, *columns: df.join(facts.select(F.col("source").alias("s"), *columns), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # Spark broadcasts the sources only while they are small; else their rows are dealt by source, skewed ones apart.
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = of(sized, "source_size", "target", "n").select(
        "row", "doc_id", "source", "size", (rate - F.floor(rate)).alias("p"), F.floor(rate).cast("int").alias("copies"), F.lit(False).alias("open"), F.pmod(F.xxhash64("key", "copy"), F.ceil(F.col("n") / GROUP)).alias("node"), "key", "copy"
    )
    fractional = (F.col("p") > 0) & (F.col("size") > 0)
    done = [whole.where(~fractional)]
    settle = lambda df: df.groupBy("source", "node").applyInPandas(lambda g: _settle(g, seed), _NODE)
    nodes = -(-(facts.agg(F.max("n")).first()[0] or 1) // GROUP)
    level = stored(settle(whole.where(fractional)), "settled")
    while True:
        done.append(level.where(~F.col("open")))
        left = level.where("open")
        if nodes <= 1:
            break
        nodes = -(-nodes // FAN_IN)
        level = stored(settle(left.withColumn("node", F.floor(F.col("node") / FAN_IN))), "settled")
    # The last one of each source: taken or not by its own probability.
    coin = (F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id", "size"), F.lit(1 << 30)) / float(1 << 30)) < F.col("p")
    done.append(left.withColumn("copies", F.col("copies") + coin.cast("int")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return of(out, "source_size", "target").select("row", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _numbered(sized: DataFrame) -> DataFrame:
    """Adds copy: equal rows, which have one key, are numbered from 0, whatever files and tasks they are in. Each split of
    the table numbers its own ones; sums over the splits of a key tell where they begin."""
    split = F.shiftright("row", 33)
    again = sized.groupBy("key", split.alias("split")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = again.select(F.col("key").alias("k"), F.col("split").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("key", split).orderBy("row")) - 1
    joined = sized.withColumn("within", within).join(starts, (F.col("key") == F.col("k")) & (split == F.col("s")))
    return joined.select("row", "doc_id", "source", "size", "key", (F.col("within") + F.col("before")).alias("copy"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents that plan() takes, each as often as it says, with all their columns."""
    copies = plan(docs, **options).where("copies > 0").select(F.col("row").alias("_rl_row"), "copies")
    numbered = docs.select(F.struct(*docs.columns).alias("d"), place(docs).alias("_rl_row"))
    return numbered.join(copies, "_rl_row").select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")
