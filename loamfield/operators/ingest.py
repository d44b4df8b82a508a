"""Incremental ingestion, catalogue, guards and conversation memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text) -> F.Column:
    return F.sha2(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"), 256)


def changes(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, status: new, changed, unchanged or deleted, by SHA-256 of the content; null contents are equal."""
    h = lambda df, name: df.select(key, F.struct(content_hash(text).alias("h")).alias(name))  # noqa: E731  (a struct tells a row with null from no row)
    met = h(old, "was").join(h(new, "now"), key, "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was.h").eqNullSafe(F.col("now.h")), "unchanged").otherwise("changed")
    return met.select(key, status.alias("status"))


def plan(state: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, status, etag, hash: what an incremental run does with each entry.

    ``state``: key, etag, hash; ``entries``: key, etag, text. An equal etag is ``unchanged`` (the content isn't compared);
    else equal content is ``refreshed`` (only the etag is kept anew), other content ``changed``; known keys that weren't seen
    are ``deleted``. Null etags never match.
    """
    was = state.select(key, F.struct("etag", "hash").alias("was"))
    now = entries.select(key, F.struct("etag", content_hash("text").alias("hash")).alias("now"))
    met = was.join(now, key, "full")
    status = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was.etag") == F.col("now.etag"), "unchanged")
        .when(F.col("was.hash").eqNullSafe(F.col("now.hash")), "refreshed").otherwise("changed")
    )
    return met.select(key, status.alias("status"), F.coalesce("now.etag", "was.etag").alias("etag"), F.coalesce("now.hash", "was.hash").alias("hash"))


def upsert(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Rows of ``more`` replace those of ``base`` with the same key."""
    return base.join(more.select(key).distinct(), key, "left_anti").select(base.columns).unionByName(more.select(base.columns))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """first, n of texts that occur twice or more, by hash."""
    return docs.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("h")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("first", "n")


def visible(docs: DataFrame, roles: list[str], column: str = "allowed_roles") -> DataFrame:
    """Rows without roles, or with a comma-parted role that the caller has (case doesn't matter); a caller without roles sees the former."""
    mine = F.array(*[F.lit(r.lower()) for r in roles]).cast("array<string>")
    theirs = F.transform(F.split(column, ","), lambda r: F.lower(F.trim(r)))
    return docs.filter(F.col(column).isNull() | F.arrays_overlap(theirs, mine))


def window(turns: DataFrame, n: int) -> DataFrame:
    """All system turns and the last 2 n others of each conversation."""
    w = Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.desc("turn"))
    return turns.withColumn("r", F.row_number().over(w)).filter((F.col("role") == "system") | (F.col("r") <= 2 * n)).drop("r")


def within(turns: DataFrame, most: int, cost: str = "cost") -> DataFrame:
    """All system turns, and the newest others whose cost fits beside them."""
    by = Window.partitionBy("conv_id")
    other = F.when(F.col("role") != "system", F.col(cost)).otherwise(0)
    fixed = F.sum(F.when(F.col("role") == "system", F.col(cost)).otherwise(0)).over(by)
    run = F.sum(other).over(by.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return turns.withColumn("s", fixed + run).filter((F.col("role") == "system") | (F.col("s") <= most)).drop("s")


def exchanges(turns: DataFrame) -> DataFrame:
    """conv_id, pair (from 1), n_replies, text: a user turn opens a pair, later turns attach, earlier ones are dropped."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("pair", F.sum((F.col("role") == "user").cast("int")).over(w)).filter("pair > 0")
    return t.groupBy("conv_id", "pair").agg((F.count(F.lit(1)) - 1).alias("n_replies"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x")).select(
        "conv_id", "pair", "n_replies", F.array_join(F.transform("x", lambda r: F.concat(F.initcap(r["role"]), F.lit(": "), r["text"])), "\n").alias("text")
    )


def delete(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Each of the tables without the rows of the documents in ``gone``."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti").select(df.columns) for name, df in tables.items()}


def stale(stamps: DataFrame, model: str, dim: int) -> DataFrame:
    """Rows of ``stamps`` (doc_id, model, dim) that were embedded by another model or in another size."""
    return stamps.filter(~(F.col("model").eqNullSafe(F.lit(model)) & F.col("dim").eqNullSafe(F.lit(dim))))


def precedence(*maps: F.Column) -> F.Column:
    """One map of several; where keys repeat, the later map's value stays."""
    def over(low, high):
        return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)

    return reduce(over, maps)


def cache_misses(wanted: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``key, text`` once for each text that the cache (key) doesn't hold; the key is the SHA-256 of model and text."""
    keyed = wanted.select(F.sha2(F.concat(F.lit(model), F.lit("\n"), F.col("text")).cast("binary"), 256).alias("key"), "text").filter("text is not null")
    return keyed.dropDuplicates(["key"]).join(cache.select("key").distinct(), "key", "left_anti")


def counted(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_chunks`` of all documents: those with 0 are where an ingestion ends without storing anything."""
    return docs.select(key).distinct().join(chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks")), key, "left").fillna(0, ["n_chunks"])


def tag_values(docs: DataFrame, column: str = "tags") -> DataFrame:
    """``key, value``, each pair once: what a tag index embeds. Null values are no tags."""
    return docs.select(F.explode(column).alias("key", "value")).filter("value is not null").distinct()


def drop_prefixed(rows: DataFrame, gone: DataFrame, column: str = "key") -> DataFrame:
    """Rows of a store of ``document:index`` keys without those of the documents in ``gone`` (doc_id)."""
    doc = F.regexp_extract(F.col(column), r"^(.*):[^:]*$", 1)
    return rows.join(gone.select(F.col("doc_id").alias("doc_")).distinct(), doc == F.col("doc_"), "left_anti")


def merged_state(state: DataFrame, more: DataFrame, key: list[str], at: str) -> DataFrame:
    """A state table (content hashes, versions, leaves) after an upsert: of each key the row with the greatest ``at``."""
    every = state.unionByName(more.select(state.columns))
    w = Window.partitionBy(*key).orderBy(F.desc(at))
    return every.withColumn("r_", F.row_number().over(w)).filter("r_ = 1").drop("r_")


def embedded(chunks: DataFrame, embed, batch: int = 100) -> DataFrame:
    """``chunks`` (text, embedding) with vectors where there were none; ``embed``: texts -> vectors, ``batch`` at a time. A
    model that gives another number of vectors is an error."""

    def run(batches):
        for b in batches:
            b = b.copy()
            need = [i for i, v in enumerate(b["embedding"]) if v is None]
            found = []
            for i in range(0, len(need), batch):
                some = [b["text"].iat[k] for k in need[i : i + batch]]
                got = embed(some)
                if len(got) != len(some):
                    raise ValueError("the model gave another number of vectors")
                found += got
            v = list(b["embedding"])
            for k, x in zip(need, found, strict=True):
                v[k] = list(x)
            b["embedding"] = v
            yield b

    return chunks.mapInPandas(run, chunks.schema)
