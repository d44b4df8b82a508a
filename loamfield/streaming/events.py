"""Streams: everything that has come, in bounded steps, then the table that results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamfield.staging import fresh_dir


def file_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 16) -> DataFrame:
    """A stream over the files of one table; each step takes ``files`` of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def settle(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run ``stream`` until it has read all that is there; the result is what the last step wrote (append: what all wrote)."""
    spark = stream.sparkSession
    out, state = fresh_dir(spark, name), fresh_dir(spark, f"{name}-state")

    def write(df, step):  # a step that is tried again takes the place of its first attempt
        df.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/step={step}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    got = spark.read.parquet(out)
    return got if mode == "complete" else got.drop("step")


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """``events`` with a watermark on ``ts``. Watermarks need an instant, so a time without a zone is read in the session's,
    in which its windows are written out again."""
    return events if late is None else events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _told(windowed, events: DataFrame, late: str | None) -> DataFrame:
    rows = _timed(events, late)
    grouped = rows.groupBy(windowed.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("w.start").cast("string").alias("start"), "event_type", "n", "total")


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type. With ``late`` (how late an event may come) windows close and their state goes, so
    results can be appended; without it all windows stay open."""
    return _told(F.window("ts", width), events, late)


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Like :func:`tumbling`, over windows that begin every ``step``."""
    return _told(F.window("ts", width, step), events, late)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    rows = _timed(events, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("string").alias("start"), "n")


def polled(spark: SparkSession, read, apply, rounds: int | None, seconds: float = 300.0, wait=None) -> list[str]:
    """Run an incremental ingestion again and again: ``read`` gives the entries, ``apply`` ingests them. A round that fails is
    noted and doesn't end the loop. ``rounds`` None: for ever."""
    import time

    faults, i = [], 0
    while rounds is None or i < rounds:
        try:
            apply(read(spark))
        except Exception as e:  # noqa: BLE001
            faults.append(str(e))
        i += 1
        if rounds is None or i < rounds:
            (wait or time.sleep)(seconds)
    return faults
