"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset in local mode (tests) a local folder is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="loamfield-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    at = f"{shared_dir(spark)}/loamfield/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(at)
    return at


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders that :func:`fresh_dir` named."""
    for at in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: list[str]):
    """Folders named within are deleted at the end, but for those in ``keep``. What was computed from them must be written by
    then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        remove(spark, *(x for x in made if x not in keep))


def staged(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Write ``df`` as a table and read it back: its lineage ends there, and lost executors lose nothing."""
    at = at or fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
