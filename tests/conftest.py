import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[2]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def saved(spark):
    """Rows as a stored table of several files."""

    def save(rows, schema, parts=3):
        path = tempfile.mkdtemp(prefix="spark-") + "/t"
        df = spark.createDataFrame(rows, schema)
        df.repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return save
