"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only for a local master without any."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place(docs: DataFrame) -> Column:
    """The number of each row of a stored table by its place. Jobs that number the same table must split its files
    alike while executors come and go, so the number of splits stops following the number of cores. Anything but a
    plain read of files is refused, as its rows have no place."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.nodeName() not in ("LogicalRelation", "LogicalRDD", "DataSourceV2ScanRelation", "LocalRelation") and not plan.nodeName().startswith("Relation"):
        raise ValueError(f"rows of {plan.nodeName()} have no place: store the table first")
    key, spark = "spark.sql.files.minPartitionNum", docs.sparkSession
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    return F.monotonically_increasing_id()


def words(text: Column) -> Column:
    """The words of a text as an array; none for null and for a text of white space only."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(ids: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows of a table with the column id: those of smallest hash. A cut of the hashes, from the number
    of rows, leaves few more than `limit` for the one task that orders them."""
    key, n = F.shiftrightunsigned(F.xxhash64("id"), 1), ids.count()
    # So far above the limit that less than `limit` rows never pass, but by their hashes' fault; then all are ordered.
    cut = int((1 << 63) * min(1.0, (1.2 * limit + 1000) / max(1, n)))
    near = ids.where(key < cut) if n > 2 * limit + 2000 else ids
    if n > 2 * limit + 2000 and near.count() < limit:
        near = ids
    return near.orderBy(key, "id").limit(limit)
