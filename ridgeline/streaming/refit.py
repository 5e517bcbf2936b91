"""Results tables that grow while jobs run: additive states are kept, fits are redone for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grouped_moments(stream: DataFrame, by: list[str], value: str, watermark: str | None = None, time: str = "ts", window: str | None = None) -> DataFrame:
    """Count, sum, sum of squares and extremes for each group (and time window): additive, so it runs as a streaming
    aggregate; a watermark bounds the state of windows."""
    keys = [F.col(c) for c in by]
    if window:
        stream = stream.withWatermark(time, watermark or "1 hour")
        keys.append(F.window(time, window))
    v = F.col(value)
    return stream.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high"))


def refit_on_batches(spark: SparkSession, source: str, schema: str, results: str, checkpoint: str, refit: Callable[[DataFrame], DataFrame], to: str):
    """Follows a folder of Parquet results: every batch is appended to `results` (once, by batch number), then refit()
    runs on all of them and replaces the table at `to`. Ends when all present files are done."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{results}/batch={number}")
        refit(spark.read.parquet(results)).write.mode("overwrite").parquet(to)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
