"""Session helpers: one place that knows how a local session is configured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "loamfield", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with AQE, Arrow and UTC; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over as many tasks as the cluster runs at once, where its scan has fewer (a small table in one file, say)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, F.xxhash64(key)) if df.rdd.getNumPartitions() < n else df
