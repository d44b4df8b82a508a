"""Who may see what, what was asked, what it cost, and which requests are refused."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Guard = Callable[[DataFrame], DataFrame]


def trusted(docs: DataFrame, column: str = "trust_level", default: str = "internal", dropped: tuple[str, ...] = ("untrusted",)) -> DataFrame:
    """Rows whose level isn't among the dropped ones, without regard to case; rows without a level have the default."""
    level = F.lower(F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit(default)))
    return docs.filter(~level.isin(*[x.lower() for x in dropped]))


def guarded(hits: DataFrame, guards: list[Guard]) -> DataFrame:
    """Hits that pass all guards, one after the other; columns that a guard adds for itself are dropped."""
    columns = hits.columns
    for g in guards:
        hits = g(hits)
    return hits.select(*columns)


def hardened(prompt: Column, rule: str) -> Column:
    """The rule stands before a system prompt, parted by an empty line; alone where there is none."""
    return F.concat_ws("\n\n", F.lit(rule), F.nullif(F.trim(F.coalesce(prompt, F.lit(""))), F.lit("")))


def audit(hits: DataFrame, kind: str) -> DataFrame:
    """``query, kind, n, chunks``: an event for each query with what it was answered from, in the order of ranks."""
    x = F.sort_array(F.collect_list(F.struct("rank", "doc")))  # one query's hits
    return hits.groupBy("query").agg(F.count(F.lit(1)).alias("n"), x.alias("x")).select("query", F.lit(kind).alias("kind"), "n", F.array_join(F.transform("x.doc", lambda d: d.cast("string")), ",").alias("chunks"))


# ---- costs ---------------------------------------------------------------------------------------------------------
def priced(usage: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """``usage`` (model, tokens_in, tokens_out) with ``cost`` by prices for a million tokens; unknown models cost nothing."""
    cost = F.lit(0.0)
    for model, (a, b) in prices.items():
        cost = F.when(F.col("model") == model, (F.coalesce("tokens_in", F.lit(0)) * a + F.coalesce("tokens_out", F.lit(0)) * b) / 1e6).otherwise(cost)
    return usage.withColumn("cost", cost)


def spending(events: DataFrame, ts: str = "ts", kind: str = "kind", cost: str = "cost") -> DataFrame:
    """``day, kind, cost, month_to_date`` (of all kinds): what was spent each UTC day."""
    days = events.groupBy(F.to_date(ts).alias("day"), F.col(kind).alias("kind")).agg(F.sum(cost).alias("cost"))
    each = days.groupBy("day").agg(F.sum("cost").alias("d"))  # a row a day
    w = Window.partitionBy(F.trunc("day", "month")).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.join(each.withColumn("month_to_date", F.sum("d").over(w)).drop("d"), "day")


def over_budget(spent: DataFrame, daily: float | None = None, monthly: float | None = None) -> DataFrame:
    """Days (day, cost, month_to_date) on which a limit is reached: ``day, cost, month_to_date, limit``."""
    each = spent.groupBy("day").agg(F.sum("cost").alias("cost"), F.max("month_to_date").alias("month_to_date"))
    limit = F.when(F.col("cost") >= daily, "day") if daily is not None else F.lit(None).cast("string")
    if monthly is not None:
        limit = F.coalesce(limit, F.when(F.col("month_to_date") >= monthly, "month"))
    return each.withColumn("limit", limit).filter("limit is not null")


def latest_traces(traces: DataFrame, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The n latest traces, newest first (``place`` from 1): what a buffer of n holds."""
    return traces.orderBy(F.desc(ts), F.desc(tie)).limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.desc(ts), F.desc(tie))))


def telemetry(traces: DataFrame, kind: str = "kind", ms: str = "ms", edges: tuple[float, ...] = (5, 25, 100, 500, 2500)) -> DataFrame:
    """``kind, n, total, buckets`` (counts up to each edge and beyond): counters and histograms."""
    low = [F.lit(float("-inf")), *map(F.lit, map(float, edges))]
    high = [*map(F.lit, map(float, edges)), F.lit(float("inf"))]
    return traces.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("total"), F.array(*[F.count_if((F.col(ms) > a) & (F.col(ms) <= b)) for a, b in zip(low, high, strict=True)]).alias("buckets"))


# ---- requests ------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class SearchOptions:
    """What a search is asked for; :meth:`faults` tells what is out of range."""

    top_k: int = 5
    min_score: float = 0.0
    mmr_lambda: float = 0.5
    mmr_candidates: int | None = None
    rrf_k: int = 60
    variants: int = 3
    context_tokens: int | None = None
    ensemble: bool = False
    rerank: bool = False

    def faults(self) -> list[str]:
        out = []
        for name, ok in (
            ("top_k", self.top_k > 0), ("min_score", -1 <= self.min_score <= 1), ("mmr_lambda", 0 <= self.mmr_lambda <= 1), ("mmr_candidates", self.mmr_candidates is None or self.mmr_candidates >= self.top_k),
            ("rrf_k", self.rrf_k > 0), ("variants", self.variants >= 0), ("context_tokens", self.context_tokens is None or self.context_tokens > 0),
        ):
            if not ok:
                out.append(f"{name} is out of range: {getattr(self, name)}")
        return out


#: Hits to fetch by class of query.
TOP_K = {"simple": 3, "complex": 8, "multi_hop": 10}


def adapted(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in TOP_K.items()], F.lit(TOP_K["complex"]))


def cache_key(query: Column, filters: Column, options: SearchOptions = SearchOptions()) -> Column:
    """SHA-256 of the query, all options and the sorted filter (map of texts): equal requests have equal keys."""
    told = json.dumps({f.name: getattr(options, f.name) for f in fields(options)}, sort_keys=True)
    pairs = F.array_sort(F.map_entries(F.coalesce(filters, F.expr("cast(map() as map<string,string>)"))))
    flat = F.array_join(F.transform(pairs, lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"), e["value"].alias("v"))))), "\n")
    return F.sha2(F.concat_ws("\n", F.lit(told), query, flat).cast("binary"), 256)


def fresh(cache: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Entries (key, at) of a result cache that are young enough."""
    return cache.filter(F.col("at") > now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))


def ingest_faults(requests: DataFrame) -> DataFrame:
    """``id, fault`` of ingestion requests (id, document_id, content, max_chunk, overlap) that are refused."""
    fault = (
        F.when(F.trim(F.coalesce("document_id", F.lit(""))) == "", "document_id").when(F.col("content").isNull(), "content").when(F.col("max_chunk") < 1, "max_chunk")
        .when((F.col("overlap") < 0) | (F.col("overlap") >= F.col("max_chunk")), "overlap")
    )
    return requests.select("id", fault.alias("fault")).filter("fault is not null")


def pair_budget(first: Column, second: Column, most: int) -> tuple[Column, Column]:
    """How many tokens of each side of a pair fit beside three marks: half each, and what one leaves goes to the other."""
    room = max(most - 3, 0)
    half = room // 2
    a = F.when(first <= half, first).when(second <= room - half, F.least(first, room - second)).otherwise(F.lit(half))
    return a.cast("int"), F.least(second, room - a).cast("int")


# ---- metadata ------------------------------------------------------------------------------------------------------
def metadata_json(pairs: dict[str, Column], kinds: dict[str, str]) -> Column:
    """JSON of typed values; dates and times are objects of their own, so that texts that look like dates stay texts."""
    def one(k, c):
        return F.struct(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("$date")) if kinds.get(k) == "date" else c

    return F.to_json(F.struct(*[one(k, c).alias(k) for k, c in pairs.items()]))


def metadata_value(text: Column, key: str, kind: str) -> Column:
    """A value of such JSON, of the kind that was written."""
    if kind == "date":
        return F.to_timestamp(F.get_json_object(text, f"$.{key}['$date']"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.get_json_object(text, f"$.{key}").cast(kind)
