"""Trees of summaries over tables: a store of leaves by scope, levels built one from another, a rebuild that replaces a scope.

``leaves`` (scope, doc, id, text, embedding) and ``nodes`` (scope, level, id, parent, text, embedding) lie in folders by
scope. A rebuild writes a scope's nodes in one overwrite, so that readers see the old tree or the new one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamfield.operators import mixtures, tree
from loamfield.staging import fresh_dir, staged

#: Ids of a level's summaries begin here times the level; leaves have smaller ones.
LEVEL = 1 << 48
_LEAVES = "scope string, doc long, id long, text string, embedding array<double>"


@dataclass
class Store:
    path: str


def create(spark: SparkSession, path: str | None = None) -> Store:
    return Store(path or fresh_dir(spark, "forest"))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _put(rows: DataFrame, path: str) -> None:
    """Replace the scopes that ``rows`` holds."""
    rows.repartition("scope").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope").parquet(path)


def leaves(spark: SparkSession, store: Store, scope: str | None = None) -> DataFrame:
    rows = spark.read.schema(_LEAVES).parquet(f"{store.path}/leaves") if _there(spark, f"{store.path}/leaves") else spark.createDataFrame([], _LEAVES)
    return rows if scope is None else rows.filter(F.col("scope") == scope)


def nodes(spark: SparkSession, store: Store, scope: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{store.path}/nodes")
    return rows if scope is None else rows.filter(F.col("scope") == scope)


def put_leaves(spark: SparkSession, store: Store, rows: DataFrame) -> None:
    """Leaves in place of all that their documents had in their scopes; the scopes' other leaves stay."""
    names = ["scope", "doc", "id", "text", "embedding"]
    rows = staged(rows.select(F.col("scope").cast("string").alias("scope"), F.col("doc").cast("long").alias("doc"), F.col("id").cast("long").alias("id"), "text", F.col("embedding").cast("array<double>").alias("embedding")), "new-leaves")
    scopes = rows.select("scope").distinct()
    kept = leaves(spark, store).join(scopes, "scope", "left_semi").join(rows.select("scope", "doc").distinct(), ["scope", "doc"], "left_anti")
    _put(staged(kept.select(names).unionByName(rows), "leaves"), f"{store.path}/leaves")


def drop_leaves(spark: SparkSession, store: Store, docs: DataFrame) -> None:
    """Take out the leaves of documents (doc), wherever they are. A scope that loses all is left as an empty folder would be: its
    last leaves' place is taken by a row without a document, which readers of ``leaves`` of a rebuild skip."""
    held = leaves(spark, store)
    hit = held.join(docs.select("doc").distinct(), "doc", "left_semi").select("scope").distinct()
    kept = held.join(hit, "scope", "left_semi").join(docs.select("doc").distinct(), "doc", "left_anti").select("scope", "doc", "id", "text", "embedding")
    marks = hit.select("scope", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<double>").alias("embedding"))
    _put(staged(kept.filter("id is not null").unionByName(marks), "leaves"), f"{store.path}/leaves")


def clustered(level: DataFrame, width: int, dims: int = 10, most: int | None = None, seed: int = 42, rounds: int = 100) -> DataFrame | None:
    """id, cluster of a level's nodes (id, embedding; a written table); None where one cluster is all there is."""
    level = staged(mixtures.usable(level, width), "vectors")
    n = level.count()
    if n < 2:
        return None
    if width > dims:
        mean, axes = mixtures.components(level, width, dims)
        level, width = staged(mixtures.projected(level, width, mean, axes), "projected"), len(axes)
    floor = max(1, -(-n // 100))
    sizes = [tree.cluster_count(n, None, most)] if most or floor >= 10 else list(range(1, min(10, n - 1) + 1))
    models = dict(zip(sizes, mixtures.fit(level, width, [mixtures.spread_centres(level, width, k, seed) for k in sizes], rounds), strict=True))
    good = {k: m for k, m in models.items() if m is not None}
    k = tree.cluster_count(n, {k: m.criterion for k, m in good.items()}, most)
    if k <= 1 or k not in good:
        return None
    return mixtures.assign(level, width, good[k]).select("id", "cluster")


def build(leaf: DataFrame, summarise: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], depth: int = 4, **how) -> DataFrame:
    """level, id, parent, text, embedding of a tree over leaves (id, text, embedding): each level's nodes are clustered, each
    cluster's texts summarised (``summarise``: cluster, text -> cluster, text) and given vectors (``embed``: id, text -> id,
    embedding), until one cluster is left or ``depth`` is reached. Leaves without a vector have no parent."""
    level, here, made = 0, staged(leaf.select(F.col("id").cast("long").alias("id"), "text", F.col("embedding").cast("array<double>").alias("embedding")), "level"), None
    width = here.agg(F.max(F.size("embedding"))).first()[0] or 0
    parents = None
    while True:
        of = None if level >= depth else clustered(here, width, **how)
        parents = here.select("id", F.lit(None).cast("long").alias("parent")) if of is None else of.select("id", (F.col("cluster") + F.lit(LEVEL * (level + 1))).alias("parent"))
        parents = staged(parents, "parents")
        done = here.join(parents, "id", "left").select(F.lit(level).alias("level"), "id", "parent", "text", "embedding")
        made = done if made is None else made.unionByName(done)
        if of is None:
            return made
        members = here.join(parents, "id").select((F.col("parent") - F.lit(LEVEL * (level + 1))).alias("cluster"), "id", "text")
        told = summarise(tree.cluster_texts(members).select("cluster", "text")).select((F.col("cluster") + F.lit(LEVEL * (level + 1))).alias("id"), "text")
        told = staged(told, "summaries")
        here = staged(told.join(embed(told).select("id", "embedding"), "id").select("id", "text", F.col("embedding").cast("array<double>").alias("embedding")), "level")
        width = here.agg(F.max(F.size("embedding"))).first()[0] or 0
        level += 1


def rebuild(spark: SparkSession, store: Store, scope: str, summarise, embed, depth: int = 4, **how) -> int:
    """Build a scope's tree anew from its leaves and put it in place of the one before; gives the number of nodes. A scope
    without leaves keeps no node."""
    leaf = leaves(spark, store, scope).filter("id is not null").select("id", "text", "embedding")
    tree_ = staged(build(leaf, summarise, embed, depth, **how).withColumn("scope", F.lit(scope)), "tree")
    n = tree_.count()
    if n:
        _put(tree_, f"{store.path}/nodes")
    elif _there(spark, f"{store.path}/nodes"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{store.path}/nodes/scope={scope}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n
