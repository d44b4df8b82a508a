"""What happens to ranked hits (query, doc, score, rank) after search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lost_in_middle(hits: DataFrame) -> DataFrame:
    """``place`` from 0: even ranks fill from the left, odd ones from the right; two hits or fewer stay."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query"))
    r = F.col("rank") - 1
    return hits.withColumn("n", n).withColumn("place", F.when(F.col("n") <= 2, r).when(r % 2 == 0, r / 2).otherwise(F.col("n") - 1 - (r - 1) / 2).cast("int")).drop("n")


def decay(rows: DataFrame, now: str, rate: float = 0.01, score: str = "score", ts: str = "ts") -> DataFrame:
    """``score * exp(-rate * hours)``; age is 0 at least, and rows without a time keep their score."""
    hours = F.greatest((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts)) / 3600.0, F.lit(0.0))
    return rows.withColumn("decayed", F.when(F.col(ts).isNull(), F.col(score)).otherwise(F.col(score) * F.exp(-rate * hours)))


def budget(rows: DataFrame, group: str, order: str, cost: str, most: int) -> DataFrame:
    """Rows that fit, taken in order: one that doesn't fit is skipped, not the end. A group is one query's hits."""
    packed = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, cost))).alias("x"))
    kept = F.expr(f"aggregate(x, named_struct('left', cast({most} as long), 'kept', cast(array() as array<long>)), (a, r) -> if(r.{cost} <= a.left, named_struct('left', a.left - r.{cost}, 'kept', concat(a.kept, array(cast(r.{order} as long)))), a), a -> a.kept)")
    return packed.select(group, F.explode(kept).alias(order))


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of length 1; a null vector, or one of another size than the longest, is near nothing."""
    size = max((len(x) for x in vectors if x is not None), default=0)
    v = np.array([x if x is not None and len(x) == size else [0.0] * size for x in vectors], np.float64).reshape(len(vectors), size)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def mmr(hits: DataFrame, k: int = 5, balance: float = 0.5) -> DataFrame:
    """``query, doc, place`` by maximal marginal relevance; ``hits``: query, doc, rank, score, embedding; ties go to the earlier rank."""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank", kind="stable")
        v = _unit(g["embedding"])
        near, left, taken = np.zeros(len(g)), list(range(len(g))), []
        while left and len(taken) < k:
            best = max(left, key=lambda i: (round(balance * g["score"].iat[i] - (1 - balance) * max(0.0, near[i]), 12), -i))
            taken.append(best)
            left.remove(best)
            near = np.maximum(near, v @ v[best])
        return pd.DataFrame({"query": g["query"].iat[0], "doc": g["doc"].to_numpy()[taken], "place": range(len(taken))})

    return hits.groupBy("query").applyInPandas(pick, "query long, doc long, place long")


def drop_redundant(hits: DataFrame, least: float = 0.95) -> DataFrame:
    """``query, doc, rank`` of hits whose cosine with every accepted hit before is below ``least``."""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank", kind="stable")
        v = _unit(g["embedding"])
        kept: list[int] = []
        for i in range(len(g)):
            if not kept or (v[kept] @ v[i]).max() < least:
                kept.append(i)
        return g.iloc[kept][["query", "doc", "rank"]]

    return hits.groupBy("query").applyInPandas(pick, "query long, doc long, rank int")


def parents(children: DataFrame, whole: DataFrame) -> DataFrame:
    """Each child (doc, child, start) with ``parent``: the first parent (doc, parent, start, end; ends included) that holds
    its start, else the document's last; null where the document has no parents.

    A document's parents come as one array beside each child, so no row is made for a pair of them.
    """
    listed = whole.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("parent", "start", "end"))).alias("x"))  # one document's parents
    met = children.join(listed, "doc", "left")
    first = F.expr("filter(x, p -> start between p.start and p.end)[0].parent")
    return met.select("doc", "child", F.coalesce(first, F.expr("element_at(x, -1).parent")).alias("parent"))


def expand_parents(hits: DataFrame, links: DataFrame, bodies: DataFrame, k: int = 10) -> DataFrame:
    """query, doc, text, score, rank: hits (query, doc, text, score, over-fetched) with each parent's text in place of its
    best child's; hits without a parent stay as they are. ``links``: doc, parent; ``bodies``: parent, body."""
    met = hits.join(links, "doc", "left").join(bodies, "parent", "left")
    best = F.row_number().over(Window.partitionBy("query", F.coalesce(F.col("parent").cast("string"), F.concat(F.lit("child "), F.col("doc").cast("string")))).orderBy(F.desc("score"), "doc"))
    one = met.withColumn("r", best).filter("r = 1").withColumn("text", F.coalesce("body", "text"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "doc", "text", "score", "rank")
