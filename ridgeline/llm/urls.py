"""URL filter: rules found through hashed host-suffix and path-prefix expressions.

Each url yields one expression for every (labels in the host, length of the path) that some rule has. Expressions
meet rules by an equi-join on the first digits of their SHA-256; the full digest then confirms, and the longest
rule wins. Nulls and urls without "://" have an empty host and path and get the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm._common import lower_ascii

#: Hex digits of the short hash that the join uses; different shapes that rules may have, each of which is an expression
#: of every url.
SHORT, SHAPES = 8, 1024


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    part = lambda k: F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of every page.

    rules: host, path (starting with "/"), verdict (block or allow). A rule fits its host and all subdomains, where
    the url's path starts with the rule's. The longest host and path together win; of equal ones the longer host,
    then block. Rules of more than SHAPES shapes are refused. Rows with null host, path or verdict are no rules. Repeated pages each get a row; an empty rule table
    gives everyone the default.
    Returns key, host, path, rule (null if none), verdict.
    """
    host, path = split_url(F.col(url))
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat("host", "path").alias("expr"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_length"),
        F.struct(F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "block").alias("block")).alias("precedence"),
    )
    shapes = [(r.labels, r.path_length) for r in rules.select("labels", "path_length").distinct().limit(SHAPES + 1).collect()]
    if len(shapes) > SHAPES:
        raise ValueError(f"rules have over {SHAPES} shapes (labels of the host, length of the path)")
    base = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    labels = F.size(F.split("host", r"\."))
    made = [
        F.when((labels >= n) & (F.length("path") >= k), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, k)))
        for n, k in shapes
    ] or [F.lit(None).cast("string")]
    digest = F.sha2(F.col("expr"), 256)
    asked = base.select("*", F.explode_outer(F.array_compact(F.array(*made))).alias("expr")).select(
        "row", "key", "host", "path", digest.alias("digest"), F.substring(digest, 1, SHORT).alias("short")
    )
    known = rules.select(digest.alias("rule_digest"), F.substring(digest, 1, SHORT).alias("short"), "precedence")
    # Left as an equi-join: Spark broadcasts the rules only while their size is below its threshold.
    best = (
        asked.join(known, "short", "left")
        .withColumn("precedence", F.when(F.col("digest") == F.col("rule_digest"), F.col("precedence")))
        .groupBy("row", "key", "host", "path")
        .agg(F.max("precedence").alias("best"))
    )
    rule = F.concat(F.expr("right(host, best.host_length)"), F.substring(F.col("path"), F.lit(1), F.col("best.length") - F.col("best.host_length")))
    return best.select(
        F.col("key").alias(key),
        "host",
        "path",
        rule.alias("rule"),
        F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.block"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
