"""Text and column tables, row checks, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only for a local master without any."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """x: one array of doubles for each line of white space separated numbers; empty lines are left out."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.select(F.split(F.trim("value"), r"\s+").cast("array<double>").alias("x"))


def write_matrix(df: DataFrame, path: str, column: str = "x") -> None:
    """One line of numbers with 16 significant digits for each row."""
    df.select(F.array_join(F.transform(column, lambda v: F.format_string("%.15e", v)), " ").alias("value")).write.text(path)


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """A TAB separated table with a header; a trailing TAB makes no column."""
    raw = spark.read.csv(path, sep="\t", header=True)
    named = [c for c in raw.columns if not (c.startswith("_c") and c[2:].isdigit())]
    return raw.select(*[F.col(f"`{c}`").try_cast("double").alias(c.strip()) for c in named])


def write_columns(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def aligned(x: DataFrame, fx: DataFrame | None = None, grads: DataFrame | None = None, m: int | None = None) -> DataFrame:
    """Samples by id with their values and gradients; rows with another number of coordinates are left out."""
    out = x
    for other in (fx, grads):
        if other is not None:
            out = out.join(other, "id")
    if m is not None:
        out = out.where((F.size("x") == m) & ((F.size("grad") == m) if grads is not None else F.lit(True)))
    return out


def finite(df: DataFrame, column: str = "fx") -> DataFrame:
    """Rows whose value is a finite number."""
    c = F.col(column)
    return df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
