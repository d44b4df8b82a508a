"""Exact top-k search by inner product, over vectors sorted by length.

Vectors are turned to the right singular vectors of the whole table, which keep inner products and bring most of each
vector's length into its first coordinates. They are laid out in cells by falling length. The longest cells are searched
first and give each query a score that its k-th hit must reach; by Cauchy-Schwarz a shorter vector whose length times the
query's doesn't reach it can't be a hit and isn't sent to the query. Within a cell, too, vectors come by falling length:
the products of the first coordinates plus the product of what is left of both lengths bound a score from above, and what
that doesn't rule out gets further coordinates. Survivors are scored in whole numbers.

Queries are dealt into blocks and vectors into cells of bounded size; a task has one block against one cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamfield.llm.common import read, staged
from loamfield.llm.vectors import integers, matrix, squared
from loamfield.llm.whitening import moments

SCALE = 1024
TOP = 10
EVERY = 100
#: Numbers in a block of queries and in a cell of vectors.
BLOCK = 1 << 20
#: This share of the cells, those of the longest vectors, is searched first.
FIRST = 16
#: Rows and queries that are multiplied at a time.
_ROWS, _QUERIES = 512, 512
#: Doubles may be wrong by so much of the product of two lengths.
SLACK = 1e-9
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers; those beyond a long are held at its ends."""
    most = max(abs(int(f(m))) for m in (q, v) for f in (np.min, np.max)) if q.size else 0
    if most * most * max(1, q.shape[1]) < 1 << 62:
        return np.einsum("ij,ij->i", q, v)
    return np.array([min(_MOST, max(_LEAST, sum(a * b for a, b in zip(x, y, strict=True)))) for x, y in zip(q.tolist(), v.tolist(), strict=True)], np.int64)


class Best:
    """The ``k`` best hits of each query so far, ties by the smaller id (null: last); ``least``: what a further one must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.row = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray, order: np.ndarray) -> None:
        """``order``: the place of each row among all by id."""
        query, score, row = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.row, row])
        o = np.lexsort((order[row], np.where(score == _LEAST, _MOST, -score), query))
        query, score, row = query[o], score[o], row[o]
        new = np.concatenate([[True], query[1:] != query[:-1]])
        nth = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
        full = nth == self.k - 1
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])
        keep = nth < self.k
        self.query, self.score, self.row = query[keep], score[keep], row[keep]


def _cuts(width: int) -> list[int]:
    """Coordinates after which a bound is taken."""
    return sorted({c for c in (width // 8, width // 4, width // 2, 3 * width // 4) if 0 < c < width})


def hits(q: np.ndarray, least: np.ndarray, v: np.ndarray, ids: np.ndarray, known: np.ndarray, turn: np.ndarray, k: int) -> Best:
    """The best ``k`` rows of a cell for each query, of those that reach ``least`` (the least long: no bound).

    ``ids`` of rows count where ``known``. ``turn`` has the axes as columns.
    """
    order = np.empty(len(v), np.int64)
    order[np.lexsort((ids, ~known))] = np.arange(len(v))
    best = Best(least, k)
    if not len(q) or not len(v):
        return best
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    q_len, v_len = np.sqrt((qf * qf).sum(axis=1)), np.sqrt((vf * vf).sum(axis=1))
    down = np.argsort(-v_len, kind="stable")
    qt, vt, v_len = qf @ turn, vf[down] @ turn, v_len[down]
    cuts = [0, *_cuts(q.shape[1])]
    rest = lambda m, c: np.sqrt((m[:, c:] ** 2).sum(axis=1))
    q_rest, v_rest = [rest(qt, c) for c in cuts], [rest(vt, c) for c in cuts]

    def floor(at: np.ndarray) -> np.ndarray:
        return np.where(best.least[at] == _LEAST, -np.inf, best.least[at].astype(np.float64))

    for a in range(0, len(v), _ROWS):
        b = min(len(v), a + _ROWS)
        reach = q_len * v_len[a] * (1 + SLACK) >= floor(np.arange(len(q)))
        if not reach.any():
            break  # nor does any shorter vector reach them
        some = np.flatnonzero(reach)
        for s in range(0, len(some), _QUERIES):
            at = some[s : s + _QUERIES]
            slack = SLACK * q_len[at][:, None] * v_len[a:b][None, :]
            need = floor(at)[:, None] - slack
            part = np.zeros((len(at), b - a))
            open_ = np.ones(part.shape, bool)
            for n in range(1, len(cuts)):
                part += qt[at, cuts[n - 1] : cuts[n]] @ vt[a:b, cuts[n - 1] : cuts[n]].T
                open_ = part + q_rest[n][at][:, None] * v_rest[n][a:b][None, :] >= need
                if open_.sum() * 16 < open_.size:
                    break  # few are left: they are scored one by one
            else:
                part += qt[at, cuts[-1] :] @ vt[a:b, cuts[-1] :].T
                open_ = part >= need
            i, j = np.nonzero(open_)
            for x in range(0, len(i), 1 << 15):
                who, row = at[i[x : x + (1 << 15)]], down[a + j[x : x + (1 << 15)]]
                got = scores(q[who], v[row])
                good = got >= best.least[who]
                best.add(who[good], got[good], row[good], order)
    return best


_FOUND = "qid long, score long, vec_id long, same boolean"


def _searched(queries: DataFrame, cells: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """Hits of each block of queries (block, qid, x, least) in each cell of vectors (block, cell, id, x)."""
    width = len(turn)
    held = queries.sparkSession.sparkContext.broadcast(turn)  # width x width

    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "same": pa.array([], pa.bool_())})
        q, v = (matrix(t.column("x").combine_chunks(), width) for t in (asked, rows))
        ids = rows.column("id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        best = hits(q, asked.column("least").to_numpy(), v, ids.fill_null(0).to_numpy(), known, held.value, k)
        return pa.table({
            "qid": asked.column("qid").combine_chunks().take(pa.array(best.query)), "score": pa.array(best.score),
            "vec_id": ids.take(pa.array(best.row)), "same": pa.array((q[best.query] == v[best.row]).all(axis=1)),
        })

    return cells.groupBy("block", "cell").cogroup(queries.groupBy("block", "cell")).applyInArrow(work, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)


def search(queries: DataFrame, rows: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest inner products of each query (id, x) with rows (id, x) other than
    its own, the row of equal id and vector.

    Ties go to the smaller vec_id (null: last). Fewer rows give fewer hits. A query that is repeated, or a row, counts
    as often as it stands there; of a repeated one, one row is the query's own. Vectors shorter than the longest are
    filled up with 0. Scores beyond a long are held at its ends. Empty tables give none.

    Of equal vectors the k + 1 with the smallest ids can be hits and no others; equal queries are searched once. A task
    holds one block and one cell, of ``block`` numbers each (or a row); the driver a matrix of the vectors' width.
    """
    # of equal vectors, these alone can be among the first k besides a query's own row
    w = Window.partitionBy("x").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k + 1).select("id", "x", squared("x").alias("size"))
    few = staged(few, "vectors")
    asked = staged(queries.select("x").distinct().select(F.monotonically_increasing_id().alias("qid"), "x", squared("x").alias("size")), "queries")
    (n, wide), (many, wide_q) = (t.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first() for t in (few, asked))
    width = max(wide, wide_q, 1)
    per = max(1, block // width)
    products = moments(few, width)[2].astype(np.float64)
    turn = np.linalg.eigh(products / max(1.0, np.abs(products).max()))[1][:, ::-1]

    cells = max(1, -(-n // per))
    laid = few.repartitionByRange(cells, F.col("size").desc(), F.xxhash64("x", "id")).select(F.spark_partition_id().alias("cell"), "id", "x", F.sqrt("size").alias("length"))
    laid = staged(laid, "cells")
    cells = (laid.agg(F.max("cell")).first()[0] or 0) + 1
    blocks = max(1, -(-many // per))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    first = max(1, cells // FIRST)

    dealt = lambda t, lo, hi: t.withColumn("cell", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
    every = laid.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    open_ = asked.select("block", "qid", "x", F.lit(_LEAST).alias("least"))
    found = staged(_best(_searched(dealt(open_, 0, first), every.filter(F.col("cell") < first).select("block", "cell", "id", "x"), turn, k + 1), k + 1).drop("nth"), "first-hits")
    if cells > first:
        reached = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).filter(F.col("n") == k + 1).select("qid", "low")
        bound = asked.join(reached, "qid", "left").select("block", "qid", "x", F.coalesce("low", F.lit(_LEAST)).alias("least"), "size")
        bound = staged(bound, "bounds")
        # the least length that can reach some query of a block: one row a block
        ratio = F.when((F.col("least") == _LEAST) | (F.col("least") <= 0) | (F.col("size") == 0), F.lit(0.0)).otherwise(F.col("least").cast("double") / F.sqrt("size"))
        need = bound.groupBy("block").agg((F.min(ratio) * (1 - SLACK)).alias("need"))
        near = every.filter(F.col("cell") >= first).join(F.broadcast(need), "block").filter(F.col("length") >= F.col("need"))
        more = _searched(dealt(bound.drop("size"), first, cells), near.select("block", "cell", "id", "x"), turn, k + 1)
        found = _best(found.unionByName(more), k + 1).drop("nth")
    by = "(a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.vec_id <=> b.vec_id then 0 when a.vec_id is null then 1 when b.vec_id is null then -1 when a.vec_id < b.vec_id then -1 else 1 end"
    lists = found.groupBy("qid").agg(F.expr(f"array_sort(collect_list(struct(score, vec_id, same)), {by})").alias("hits"))
    lists = asked.select("qid", F.col("x").alias("x_")).join(lists, "qid")
    own = F.expr("coalesce(array_position(transform(hits, h -> h.same and h.vec_id <=> id), true), 0)")
    got = queries.join(lists, F.col("x") == F.col("x_")).withColumn("own", own)
    kept = F.expr(f"slice(filter(hits, (h, i) -> i + 1 <> own), 1, {k})")
    got = got.select(F.col("id").alias("query_id"), F.posexplode(kept))
    return got.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "col.vec_id", "col.score")


def op13(spark, sf_dir: str) -> DataFrame:
    rows = integers(read(spark, sf_dir, "embeddings"), SCALE)
    return search(rows.filter(F.col("id") % EVERY == 0), rows)


#: The inner products of all rows with the queries, in whole numbers, ranked.
OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id ASC NULLS LAST)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
