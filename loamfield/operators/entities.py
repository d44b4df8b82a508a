"""Entities and relationships: cleaning, upserts, routing, and the context that answers are given from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight_of(w: Column) -> Column:
    """Weights that aren't finite or positive are 1, those above 10 are 10."""
    ok = w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf")) & (w > 0)
    return F.when(ok, F.least(w, F.lit(10.0))).otherwise(F.lit(1.0))


def weight_audit(edges: DataFrame, column: str = "weight") -> DataFrame:
    """One row: ``n, replaced, clamped, most`` (the greatest finite weight)."""
    w = F.col(column).cast("double")
    finite = w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf"))
    return edges.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(finite & (w > 0), F.lit(False))).alias("replaced"), F.count_if(finite & (w > 10)).alias("clamped"), F.max(F.when(finite, w)).alias("most"))


def clean(found: DataFrame, types: list[str] | None = None, most: int = 500) -> DataFrame:
    """Extracted entities (name, type, description) without blank names or types that aren't listed; descriptions are cut."""
    ok = F.trim(F.coalesce("name", F.lit(""))) != ""
    if types:
        ok = ok & F.lower(F.coalesce("type", F.lit(""))).isin(*[t.lower() for t in types])
    return found.filter(ok).withColumns({"name": F.trim("name"), "description": F.substring(F.coalesce("description", F.lit("")), 1, most)})


def upsert(mentions: DataFrame) -> DataFrame:
    """``key, name, type, description, rank, doc`` of mentions (place, name, type, description, rank, doc): the first name, the
    last type and rank, all descriptions line by line, and the last doc that isn't null, in the order of places."""
    told = F.sort_array(F.collect_list(F.when(F.col("description") != "", F.struct("place", "description"))))  # one entity's descriptions
    return mentions.groupBy(F.upper(F.trim("name")).alias("key")).agg(
        F.min_by("name", "place").alias("name"), F.max_by("type", "place").alias("type"), F.array_join(F.transform(told, lambda x: x["description"]), "\n").alias("description"),
        F.max_by("rank", "place").alias("rank"), F.max_by("doc", F.when(F.col("doc").isNotNull(), F.col("place"))).alias("doc"),
    )


def append(edges: DataFrame, more: DataFrame) -> DataFrame:
    """All of both: parallel relationships stay apart."""
    return edges.unionByName(more.select(edges.columns))


def without(tables: list[DataFrame], doc: Column | str | int) -> list[DataFrame]:
    """Entities and relationships without those of a document."""
    return [t.filter(~F.col("doc").eqNullSafe(doc if isinstance(doc, Column) else F.lit(doc))) for t in tables]


def routed(chunks: DataFrame, column: str = "graph_type") -> tuple[DataFrame, DataFrame]:
    """(chunks of the graph, all others)."""
    mine = F.coalesce(F.trim(F.col(column)) != "", F.lit(False))
    return chunks.filter(mine), chunks.filter(~mine)


def chunk_id(doc: Column, index: Column) -> Column:
    return F.concat_ws("_", doc.cast("string"), index.cast("string"))


def chunk_parts(name: Column) -> tuple[Column, Column]:
    """(document, index) of a chunk's id, parted at its last underscore; null if it has none or no number follows it."""
    ok = F.rlike(name, F.lit(r"_\d+$"))
    return F.when(ok, F.regexp_extract(name, r"^(.*)_(\d+)$", 1)), F.when(ok, F.regexp_extract(name, r"^(.*)_(\d+)$", 2).cast("int"))


def blended(hits: DataFrame, ranks: DataFrame, w: float = 0.0) -> DataFrame:
    """``query, doc, score`` with a share ``w`` of each node's rank (ranks: doc, pagerank; none: 0), the best of repeats."""
    s = (1 - w) * F.col("score") + w * F.coalesce("pagerank", F.lit(0.0))
    return hits.join(ranks, "doc", "left").groupBy("query", "doc").agg(F.round(F.max(s), 9).alias("score"))


def batches(reports: DataFrame, size: int = 5, order: Column | None = None) -> DataFrame:
    """``reports`` (community) with ``batch``, ``size`` to each: the order is a hash of the community and the query, so it is
    the same each time. A few dozen reports are read for a query."""
    w = Window.partitionBy("query").orderBy(order if order is not None else F.md5(F.concat_ws(":", F.col("query").cast("string"), F.col("community").cast("string")).cast("binary")), "community")
    return reports.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def selected(hits: DataFrame, k: int = 20) -> DataFrame:
    """``query, name, place``: distinct names (without case) of the k best hits (query, name, rank), in their order."""
    one = hits.filter(F.col("rank") <= k).groupBy("query", F.lower("name").alias("low")).agg(F.min_by("name", "rank").alias("name"), F.min("rank").alias("rank"))
    return one.select("query", "name", F.row_number().over(Window.partitionBy("query").orderBy("rank")).alias("place"))


def report_prompt(members: DataFrame, edges: DataFrame, most: int = 50_000) -> DataFrame:
    """``community, entities, edges, left_out``: what a community's report is written from. Members (community, node, score,
    line) by score take up to three quarters of the characters, edges (community, place, line) what is left; each stops at
    the first that doesn't fit."""
    wm = Window.partitionBy("community").orderBy(F.desc("score"), "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = members.withColumn("run", F.sum(F.length("line") + 1).over(wm))
    m = m.groupBy("community").agg(F.count_if(F.col("run") <= most * 3 // 4).alias("entities"), F.coalesce(F.max(F.when(F.col("run") <= most * 3 // 4, F.col("run"))), F.lit(0)).alias("used"), F.count(F.lit(1)).alias("all_m"))
    we = Window.partitionBy("community").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = edges.withColumn("run", F.sum(F.length("line") + 1).over(we)).join(m.select("community", "used"), "community")
    e = e.groupBy("community").agg(F.count_if(F.col("run") <= most - F.col("used")).alias("edges"), F.count(F.lit(1)).alias("all_e"))
    out = m.join(e, "community", "left").fillna(0, ["edges", "all_e"])
    return out.select("community", "entities", "edges", (F.col("all_m") - F.col("entities") + F.col("all_e") - F.col("edges")).alias("left_out"))


#: Shares of the tokens that history leaves: reports and sources; the rest goes to entities and relationships.
SHARES = {"reports": 0.15, "sources": 0.50}


def context(rows: DataFrame, most: int = 12_000) -> DataFrame:
    """Rows (query, section, place, cost) that fit: history takes what it needs first, then reports, sources and local tables
    have their shares; a section stops at its first row that doesn't fit."""
    w = Window.partitionBy("query", "section").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = rows.withColumn("run", F.sum("cost").over(w))
    told = r.filter((F.col("section") == "history") & (F.col("run") <= most)).groupBy("query").agg(F.max("run").alias("told"))
    r = r.join(told, "query", "left").withColumn("room", F.lit(most) - F.coalesce("told", F.lit(0)))
    local = 1 - sum(SHARES.values())
    share = F.when(F.col("section") == "history", F.lit(float(most)))
    for name, part in SHARES.items():
        share = share.when(F.col("section") == name, F.floor(F.col("room") * part))
    return r.filter(F.col("run") <= share.otherwise(F.floor(F.col("room") * local))).select("query", "section", "place")
