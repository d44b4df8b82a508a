"""Messages that are delivered at least once: attempts are counted by message, failing ones are tried again, then set aside.

State is kept by message: when its first attempt came, how many there were and whether it is settled. Messages are held together
in buckets by their hash, so that one call of Python, one row of the state store and one timer serve many of them.
"""

from __future__ import annotations

import contextlib
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "message string, status string, attempts int, cause string"
STATE = "message array<string>, first array<long>, attempts array<int>, settled array<boolean>"
#: Buckets of messages; fixed for a query's checkpoint.
BUCKETS = 1024


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """State of many messages belongs in the RocksDB store, beyond the heap; queries started within have it, others keep the
    session's."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _ledger(most: int, deadline: int, keep: int):
    """What a bucket's new attempts and the watermark make of its messages; times in microseconds."""

    def outcome_of(tries, first, tried):
        for at, _, _, outcome in tries:
            first = at if first is None else first
            if at > first + deadline:
                return first, tried, ("abandoned", "deadline")
            tried += 1
            if outcome == "done":
                return first, tried, ("done", None)
            if outcome == "fatal" or tried >= most:
                return first, tried, ("dead", "fatal" if outcome == "fatal" else "attempts")
        return first, tried, None

    def run(key, chunks, state):
        held = {m: (first, tried, done) for m, first, tried, done in zip(*state.get, strict=True)} if state.exists else {}
        come: dict = {}
        for some in [] if state.hasTimedOut else chunks:
            cols = [some[c].astype(object).where(some[c].notna(), None) for c in ("message", "at", "attempt", "outcome")]
            for m, at, attempt, outcome in zip(*cols, strict=True):
                if not (m in held and held[m][2]):
                    tries = come.setdefault(m, [])
                    tries.append((at, attempt is None, attempt or "", outcome))
                    if len(tries) > 8 * most:  # whatever they are, the first ``most`` settle it
                        come[m] = sorted(tries, key=lambda t: t[:3])[:most]
        told, now = [], state.getCurrentWatermarkMs()
        for m, tries in come.items():
            first, tried, end = outcome_of(sorted(tries, key=lambda t: t[:3])[:most], *held.get(m, (None, 0))[:2])
            held[m] = first, tried, end is not None
            if end:
                told.append((m, end[0], tried, end[1]))
        left, wait = {}, []
        for m, (first, tried, done) in held.items():
            if not done and (first + deadline) // 1000 < now:
                told.append((m, "abandoned", tried, "deadline"))
                done = True
            until = (first + (keep if done else deadline)) // 1000
            if until >= now:
                left[m] = first, tried, done
                wait.append(until)
        if left:
            state.update((list(left), *map(list, zip(*left.values(), strict=True))))
            state.setTimeoutTimestamp(max(1, min(wait)))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=["message", "status", "attempts", "cause"]).astype({"attempts": "int32"})

    return run


def settled(attempts: DataFrame, most: int = 3, deadline: timedelta = timedelta(hours=6), keep: timedelta = timedelta(days=1), late: timedelta = timedelta(hours=1), buckets: int = BUCKETS) -> DataFrame:
    """``message, status, attempts, cause`` of a stream of attempts (message, attempt, ts, outcome), as soon as a message is
    settled; start the query within :func:`state_store`, in append mode.

    A message is ``done`` with its first attempt of that outcome, ``dead`` with one that is ``fatal`` or when ``most`` have
    failed (any other outcome, null too), and ``abandoned`` when neither has come within ``deadline`` of the first attempt. An
    attempt that is delivered again (same ``attempt``) within ``late`` counts once. What comes after a message is settled is
    ignored for ``keep`` from its first attempt on; then its state goes. Attempts without a time can't be placed and are left out.
    Messages lie in ``buckets`` by hash; a bucket's state is read and written whole when one of its messages comes or is due.
    """
    us = lambda t: t // timedelta(microseconds=1)
    rows = attempts.filter("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    once = rows.withWatermark("ts", f"{us(late)} microseconds").dropDuplicatesWithinWatermark(["message", "attempt"])
    bucket = F.pmod(F.xxhash64("message"), F.lit(buckets)).cast("int").alias("bucket")
    keyed = once.select(bucket, "message", "ts", F.unix_micros("ts").alias("at"), F.col("attempt").cast("string").alias("attempt"), "outcome").groupBy("bucket")
    return keyed.applyInPandasWithState(_ledger(most, us(deadline), us(keep)), OUT, STATE, "append", "EventTimeTimeout")
