"""Trees of summaries: how many clusters, which mixture, when to build anew, and how levels are searched."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_count(n: int, bic: dict[int, float] | None = None, most: int | None = None, per_cluster: int = 100, few: int = 10) -> int:
    """Clusters for n nodes: one for each ``per_cluster`` at least; ``most`` is taken if it isn't below that. Up to ``few``,
    the count (of ``bic``: count -> criterion) with the least criterion, if it is larger. Never as many as nodes."""
    floor = max(1, -(-n // per_cluster))
    if most is not None and most >= floor:
        k = most
    elif floor < few:
        k = max(min((k for k in (bic or {}) if k <= few), key=lambda k: (bic[k], k), default=floor), floor)
    else:
        k = floor
    return max(0, min(k, n - 1))


def mixture(x: np.ndarray, k: int, seed: int = 42, rounds: int = 100, tol: float = 1e-6, least: float = 1e-6, start: np.ndarray | None = None) -> tuple[np.ndarray, float] | None:
    """(responsibilities, criterion) of a mixture of k normal distributions without covariances, fitted by expectation and
    maximisation from spread centres, or those of ``start``; None if a component dies. For a bounded set of nodes, in one task;
    :mod:`loamfield.operators.mixtures` fits tables."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(n)]]
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(n, p=far / far.sum()) if far.sum() > 0 else rng.integers(n)])
    mean, var, share, before = np.array(centres if start is None else start, np.float64), np.tile(np.maximum(x.var(axis=0), least), (k, 1)), np.full(k, 1 / k), -math.inf
    r = np.zeros((n, k))
    for _ in range(rounds):
        logp = np.log(share) - 0.5 * (np.log(2 * math.pi * var).sum(axis=1) + ((x[:, None] - mean) ** 2 / var).sum(axis=2))
        top = logp.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
        r = np.exp(logp - total[:, None])
        weight = r.sum(axis=0)
        if (weight < 1e-9).any() or not np.isfinite(total).all():
            return None
        mean = r.T @ x / weight[:, None]
        var = np.maximum(r.T @ x**2 / weight[:, None] - mean**2, least)
        share = weight / n
        if abs(total.sum() - before) < tol:
            break
        before = total.sum()
    return r, float(-2 * total.sum() + (k * (2 * d + 1) - 1) * math.log(n))


def reduced(x: np.ndarray, dims: int = 10) -> np.ndarray:
    """The first principal components: what stands in for a neighbour embedding, which no library here offers."""
    if x.shape[1] <= dims or len(x) < 2:
        return x
    c = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    v = v[:dims] * np.sign(v[:dims, np.abs(v[:dims]).argmax(axis=1)].diagonal())[:, None]
    return c @ v.T


def clusters(x: np.ndarray, most: int | None = None, dims: int = 10, seed: int = 42) -> np.ndarray:
    """The cluster of each node."""
    y, n = reduced(np.asarray(x, np.float64), dims), len(x)
    floor = max(1, -(-n // 100))
    fits = {k: m for k in range(1, min(10, n - 1) + 1) if (m := mixture(y, k, seed)) is not None} if floor < 10 and not most else {}
    k = cluster_count(n, {k: m[1] for k, m in fits.items()}, most)
    if k <= 1:
        return np.zeros(n, int)
    m = fits.get(k) or mixture(y, k, seed)
    return m[0].argmax(axis=1) if m is not None else np.zeros(n, int)


def build(texts: list[str], vectors: np.ndarray, summarise, embed, depth: int = 4) -> list[tuple[int, int, str, list[int]]]:
    """(level, number, text, children) of all nodes of a tree over a bounded set of leaves: clusters are summarised and
    clustered again until one is left. ``summarise``: text -> text; ``embed``: texts -> vectors."""
    out = [(0, i, t, []) for i, t in enumerate(texts)]
    level, at, v = 0, list(range(len(texts))), np.asarray(vectors, np.float64)
    while level < depth and len(at) > 1:
        of = clusters(v)
        kinds = sorted(set(of.tolist()))
        if len(kinds) <= 1 and level:
            break
        level, made = level + 1, []
        for c in kinds:
            inner = [at[i] for i in np.flatnonzero(of == c)]
            made.append((level, len(out) + len(made), summarise(SEPARATOR.join(out[i][2] for i in inner)), inner))
        out += made
        at, v = [m[1] for m in made], np.asarray(embed([m[2] for m in made]), np.float64)
        if len(kinds) == 1:
            break
    return out


#: Stands between the texts of a cluster.
SEPARATOR = "\n\n---\n\n"


def cluster_texts(members: DataFrame) -> DataFrame:
    """``cluster, children, text`` of members (cluster, id, text), in the order of ids. A cluster is one prompt."""
    x = F.sort_array(F.collect_list(F.struct("id", "text")))
    return members.groupBy("cluster").agg(x.alias("x")).select("cluster", F.array_join(F.transform("x.id", lambda i: i.cast("string")), ",").alias("children"), F.array_join("x.text", SEPARATOR).alias("text"))


def due(now: DataFrame, last: DataFrame, growth: float = 0.10) -> DataFrame:
    """``scope, n, due``: whether the rows of each scope (now: scope) have grown by ``growth`` since the last build (last:
    scope, n). A scope that was never built is due."""
    n = now.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    was = last.select("scope", F.col("n").alias("was"))
    return n.join(was, "scope", "left").select("scope", "n", (F.col("was").isNull() | (F.col("n") >= F.col("was") * (1 + growth))).alias("due"))


def search_levels(hits: DataFrame, how: str = "blend", k: int = 10, boost: float = 1.2, low: int = 1, high: int = 99) -> DataFrame:
    """``query, doc, level, score, rank`` of over-fetched hits (query, doc, level, score): ``blend`` takes them as they are,
    ``boost`` raises summaries (level above 0), ``filter`` keeps levels from ``low`` to ``high``."""
    if how not in ("blend", "boost", "filter"):
        raise ValueError(how)
    if how == "boost":
        hits = hits.withColumn("score", F.round(F.when(F.col("level") > 0, F.col("score") * boost).otherwise(F.col("score")), 9))
    if how == "filter":
        hits = hits.filter(F.col("level").between(low, high))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "doc", "level", "score", "rank")
