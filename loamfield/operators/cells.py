"""Nearest neighbours by an inverted file: vectors lie in cells around centroids, queries visit the nearest cells.

The centroids come from a bounded sample; every vector is laid into the cell of its nearest centroid, in a table with a
folder for each cell. A query goes to the ``probes`` nearest cells; a task has one piece of a cell and the queries that visit
it, and answers with each query's best. With as many probes as cells the answer is the exact one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamfield.operators.search import top
from loamfield.staging import fresh_dir, staged

#: Rows that centroids are fitted on, at most: chosen by a hash of their ids.
SAMPLE = 65_536
#: Centroids are broadcast; so many numbers they have at most.
MOST_NUMBERS = 1 << 24
#: Vectors in a piece of a cell, and queries that visit it at a time, as numbers.
PIECE = 1 << 21
#: Numbers that a task makes at a time beside them.
NUMBERS = 1 << 20
#: Rows of a shelf, and queries of a block, that aren't parted further.
LEAST_ROWS = 1024


def _stack(lists, width: int) -> np.ndarray:
    """Vectors as rows of unit length; those of length 0 stay so."""
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)
    norm = np.linalg.norm(m, axis=1)[:, None]
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def centroids(unit: np.ndarray, cells: int, rounds: int = 12, seed: int = 17) -> np.ndarray:
    """Unit centroids of unit vectors by cosine, from far-apart seeds; a centroid that no vector is nearest to moves to the
    vector that is worst served."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(unit)))
    c = np.empty((cells, unit.shape[1]))
    c[0] = unit[rng.integers(len(unit))]
    near = unit @ c[0]
    for i in range(1, cells):
        far = np.maximum(1 - near, 0)
        c[i] = unit[rng.choice(len(unit), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(unit))]
        near = np.maximum(near, unit @ c[i])
    for _ in range(rounds):
        score = unit @ c.T
        of, best = score.argmax(axis=1), score.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, unit)
        empty = np.setdiff1d(np.arange(cells), of)
        sums[empty] = unit[np.argsort(best, kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1)[:, None]
        new = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
        if np.allclose(new, c, atol=1e-9):
            break
        c = new
    return c


@dataclass
class Index:
    """An inverted file: the folder of its table and its centroids."""

    path: str
    centroids: np.ndarray

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def rows(self, spark: SparkSession) -> DataFrame:
        """doc, embedding, piece, cell of what is indexed now."""
        held = spark.read.parquet(f"{self.path}/vectors")
        return held.join(gone, ["doc", "batch"], "left_anti") if (gone := self._gone(spark)) is not None else held

    def _gone(self, spark: SparkSession) -> DataFrame | None:
        """doc, batch that have been removed."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/removed")
        return spark.read.parquet(f"{self.path}/removed") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def _usable(vectors: DataFrame, width: int | None = None) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v))
    return vectors.filter(ok & ((F.size("embedding") == width) if width else (F.size("embedding") > 0))).select("doc", e.alias("embedding"))


def _celled(vectors: DataFrame, centres: np.ndarray, probes: int, name: str) -> DataFrame:
    """``name``, embedding, cells: each vector with its ``probes`` nearest cells (ties: the first); null where that is all."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)
    width, kind = centres.shape[1], vectors.schema[name].dataType.simpleString()
    step = max(1, NUMBERS // max(len(centres), width))

    def work(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                if probes < len(held.value):
                    score = np.round(_stack(b.column("embedding"), width) @ held.value.T, 12)
                    cell = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, cell.size + 1, cell.shape[1], dtype=np.int32)), pa.array(cell.ravel()))
                else:
                    cells = pa.nulls(b.num_rows, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(name), b.column("embedding"), cells], names=[name, "embedding", "cells"])

    return vectors.select(name, "embedding").mapInArrow(work, f"{name} {kind}, embedding array<double>, cells array<int>")


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, path: str | None = None) -> Index:
    """An index of vectors (doc, embedding). Rows whose embedding is null, empty, holds nulls or NaN, or has another number of
    dimensions than most do, aren't indexed. ``cells``: the square root of the rows, by default.

    Centroids are fitted on ``sample`` rows at most; all rows are indexed. Cells with many rows lie in several files.
    """
    spark = vectors.sparkSession
    some = _usable(vectors)
    sizes = some.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    if sizes is None:
        raise ValueError("no vector to index")
    some, n = some.filter(F.size("embedding") == sizes.width), sizes.n
    cells = min(cells or int(n**0.5), max(1, MOST_NUMBERS // sizes.width))
    share = min(1.0, sample / n)
    chosen = some.filter(F.pmod(F.xxhash64("doc", F.lit("cells")), F.lit(1 << 30)) < share * (1 << 30)).select("embedding").limit(sample).toArrow()
    fitted = chosen if chosen.num_rows else some.select("embedding").limit(sample).toArrow()
    index = Index(path or fresh_dir(spark, "cells"), centroids(_stack(fitted.column("embedding").combine_chunks(), sizes.width), cells))
    add(index, vectors, 0)
    return index


def add(index: Index, vectors: DataFrame, batch: int) -> None:
    """Lay further vectors into their cells. ``batch`` is a number above those of all changes before; an attempt that is made
    again takes the place of the first."""
    rows = _celled(_usable(vectors, index.width), index.centroids, 1, "doc")
    rows = rows.select("doc", "embedding", F.coalesce(F.col("cells")[0], F.lit(0)).alias("cell"))
    per = max(1, PIECE // index.width)
    piece = F.pmod(F.xxhash64("doc"), F.greatest(F.lit(1), F.ceil(F.col("n") / per))).cast("int")
    rows = staged(rows, "celled")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # a row for each cell
    laid = rows.join(F.broadcast(sizes), "cell").select("doc", "embedding", piece.alias("piece"), "cell", F.lit(batch).alias("batch"))
    laid = laid.repartition("cell", "piece").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    laid.partitionBy("batch", "cell").parquet(f"{index.path}/vectors")


def remove(index: Index, docs: DataFrame, batch: int) -> None:
    """Take out all rows of the given docs that were added before ``batch``."""
    spark = docs.sparkSession
    held = spark.read.parquet(f"{index.path}/vectors").filter(F.col("batch") < batch).select("doc", "batch")
    gone = held.join(docs.select("doc").distinct(), "doc", "left_semi").distinct()
    gone.withColumn("removed_by", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("removed_by").parquet(f"{index.path}/removed")


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 16) -> DataFrame:
    """query, doc, score, rank: the best of the ``probes`` nearest cells by cosine (rounded to 6 places, ties: the smaller doc).

    Queries (query, embedding) of other dimensions, or without a vector, find nothing. Only the cells that are visited are
    read. Cells lie together on shelves; a task has one shelf and one block of the queries that visit it, so a vector is sent
    once for each shelf or block, not for each cell.
    """
    spark = queries.sparkSession
    most = max(1, PIECE // index.width)
    asked = _usable(queries.withColumnRenamed("query", "doc"), index.width).withColumnRenamed("doc", "query")
    routed = staged(_celled(asked, index.centroids, max(1, probes), "query"), "routed")
    everywhere = probes >= len(index.centroids)
    held = index.rows(spark)
    if not everywhere:
        held = held.join(F.broadcast(routed.select(F.explode("cells").alias("cell")).distinct()), "cell")  # other cells' folders aren't read
    sizes = held.groupBy("cell", "piece").agg(F.count(F.lit(1)).alias("n")).orderBy("cell", "piece").collect()  # a row for each piece
    n, asking = sum(r.n for r in sizes), routed.count()
    per, each = (min(most, max(LEAST_ROWS, -(-x // 16))) for x in (n, asking))  # rows of a shelf, queries of a block
    shelves, shelf, room = [], 0, per
    for r in sizes:
        if r.n > room and room < per:
            shelf, room = shelf + 1, per
        shelves.append((r.cell, r.piece, shelf))
        room -= r.n
    blocks = max(1, -(-asking // each))
    placed = spark.createDataFrame(shelves, "cell int, piece int, shelf int")
    rows = held.join(F.broadcast(placed), ["cell", "piece"]).select("shelf", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "cell", "doc", "embedding")
    on: dict[int, set[int]] = {}
    for cell, _, at in shelves:
        on.setdefault(cell, set()).add(at)
    sent = spark.sparkContext.broadcast((on, shelf + 1))
    width, step = index.width, max(1, NUMBERS // (index.width * (shelf + 1)))
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((routed, "query"), (rows, "doc"))]

    def visit(batches):
        """A row for each shelf that a query visits, with its cells there."""
        at, every = sent.value
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                who, where, what = [], [], []
                for i, some in enumerate(b.column("cells").to_pylist()):
                    mine: dict[int, list[int] | None] = dict.fromkeys(range(every)) if some is None else {}
                    for c in some or ():
                        for x in at.get(c, ()):
                            mine.setdefault(x, []).append(c)
                    who += [i] * len(mine)
                    where += mine.keys()
                    what += mine.values()
                row = pa.array(who, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("query").take(row), b.column("embedding").take(row), pa.array(where, pa.int32()), pa.array(what, pa.list_(pa.int32()))], names=["query", "embedding", "shelf", "cells"])

    visits = routed.mapInArrow(visit, f"query {kinds[0]}, embedding array<double>, shelf int, cells array<int>")
    visits = visits.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))

    def work(held: pa.Table, q: pa.Table) -> pa.Table:
        ids, docs = q.column("query").combine_chunks(), held.column("doc").combine_chunks()
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(ids) and len(docs):
            order = docs.dictionary_encode()
            place = np.argsort(np.argsort(order.dictionary.to_numpy(zero_copy_only=False)))[order.indices.to_numpy(zero_copy_only=False)]
            m, x = _stack(held.column("embedding").combine_chunks(), width), _stack(q.column("embedding").combine_chunks(), width)
            if everywhere:
                parts = [(np.arange(len(x)), np.arange(len(m)))]
            else:
                cells, cell = q.column("cells").combine_chunks(), held.column("cell").to_numpy()
                asker, visited = np.repeat(np.arange(len(x)), cells.value_lengths().to_numpy(zero_copy_only=False)), cells.flatten().to_numpy()
                parts = [(asker[visited == c], np.flatnonzero(cell == c)) for c in np.unique(cell)]
            for mine, there in parts:
                size = max(1, NUMBERS // max(1, len(there)))
                for a in range(0, len(mine), size):
                    s = np.round(x[mine[a : a + size]] @ m[there].T, 6)
                    for i, row in zip(mine[a : a + size], s, strict=True):
                        least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                        some = np.flatnonzero(row >= least)
                        some = some[np.lexsort((place[there[some]], -row[some]))[:k]]
                        got.append((np.full(len(some), i), there[some], row[some]))
        who, what, score = (np.concatenate(c) for c in zip(*got, strict=True))
        return pa.table({"query": ids.take(pa.array(who)), "doc": docs.take(pa.array(what)), "score": pa.array(score)})

    found = rows.groupBy("shelf", "block").cogroup(visits.groupBy("shelf", "block")).applyInArrow(work, f"query {kinds[0]}, doc {kinds[1]}, score double")
    return top(found, ["query"], "score", "doc", k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_queries, recall: the share of the exact hits (query, doc) that were found; one row."""
    met = exact.select("query", "doc").join(found.select("query", "doc", F.lit(1).alias("hit")), ["query", "doc"], "left")
    return met.agg(F.countDistinct("query").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def neighbours(index: Index, vectors: DataFrame, k: int = 15, probes: int = 16) -> DataFrame:
    """src, dst, rank, score: the ``k`` nearest of each vector (doc, embedding) besides itself, of those indexed under other ids.

    An edge table of ``k`` links a vector. A vector that has ``k`` equals or more with smaller ids still finds ``k`` others.
    """
    hits = search(index, vectors.select(F.col("doc").alias("query"), "embedding"), k + 1, probes).filter("query <> doc")
    return top(hits.drop("rank"), ["query"], "score", "doc", k).select(F.col("query").alias("src"), F.col("doc").alias("dst"), "rank", "score")


def fuzzy(near: DataFrame, rounds: int = 40) -> DataFrame:
    """src, dst (src < dst), weight: neighbourhoods (src, dst, rank, score) as strengths of links.

    A neighbour at distance d = 1 - score counts exp(-(d - nearest) / width), where each row's width makes its strengths add up
    to the logarithm of their number, to base 2; it is found by ``rounds`` halvings. The two directions of a link join as
    a + b - a b.
    """
    by = F.array_sort(F.collect_list(F.struct((1 - F.col("score")).alias("d"), "dst")))
    rows = near.groupBy("src").agg(by.alias("near"))

    def work(batches):
        for b in batches:
            lists = b.column("near")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            d = flat.field("d").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(int)
            gap = np.maximum(d - d[first][row], 0) if len(d) else d
            aim, lo, hi = np.log2(np.maximum(size, 2)), np.zeros(len(size)), np.full(len(size), np.inf)
            width = np.ones(len(size))
            for _ in range(rounds):
                total = np.bincount(row, np.exp(-gap / width[row]), len(size))
                hi, lo = np.where(total > aim, width, hi), np.where(total > aim, lo, width)
                width = np.maximum(np.where(np.isinf(hi), width * 2, (lo + hi) / 2), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("src").take(pa.array(row)), flat.field("dst"), pa.array(np.exp(-gap / width[row]))], names=["src", "dst", "w"])

    kind = near.schema["src"].dataType.simpleString()
    one = rows.mapInArrow(work, f"src {kind}, dst {kind}, w double")
    pair = one.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return pair.agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count(F.lit(1)).alias("n")).select("src", "dst", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("weight"))


def layout(links: DataFrame, start: DataFrame, rounds: int = 30, against: int = 256, rate: float = 0.5, seed: int = 42) -> DataFrame:
    """node, position: places where linked nodes (src, dst, weight) come to lie near each other, from those of ``start`` (node,
    position: array of doubles).

    Each round adds up, for every node, the pull of its links (one join for each end) and the push of ``against`` positions
    drawn anew from all (a bounded sample, sent to the tasks), and moves it by at most ``rate``, falling to 0. Rounds are
    written tables.
    """
    spark = links.sparkSession
    both = staged(links.select("src", "dst", "weight").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).repartition("src"), "links-both-ways")
    at = staged(start.select("node", "position"), "positions")
    n = at.count()
    for r in range(rounds):
        lot = F.pmod(F.xxhash64("node", F.lit(seed + r)), F.lit(1 << 30)) < int(min(1.0, 2 * against / max(n, 1)) * (1 << 30))
        drawn = spark.sparkContext.broadcast(np.array([x.position for x in at.filter(lot).limit(against).collect()], np.float64))
        step = rate * (1 - r / rounds)
        other = at.select(F.col("node").alias("dst"), F.col("position").alias("there"))
        pull = both.join(at.select(F.col("node").alias("src"), F.col("position").alias("here")), "src").join(other, "dst")
        way = F.zip_with("there", "here", lambda a, b: a - b)
        # from the similarity 1 / (1 + d^2) of two places
        pull = pull.select("src", "weight", way.alias("way")).withColumn("q", F.aggregate("way", F.lit(0.0), lambda s, v: s + v * v))
        pull = pull.select("src", F.posexplode(F.transform("way", lambda v: 2 * F.col("weight") * v / (1 + F.col("q")))).alias("i", "pull"))
        pull = pull.groupBy("src", "i").agg(F.sum("pull").alias("pull")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("i", "pull"))).alias("pull"))
        rows = at.join(pull.select(F.col("src").alias("node"), F.col("pull.pull").alias("pull")), "node", "left")

        def move(batches, step=step, drawn=drawn):
            far = drawn.value
            for b in batches:
                p = np.array(b.column("position").to_pylist(), np.float64)
                g = np.array([x if x is not None else [0.0] * p.shape[1] for x in b.column("pull").to_pylist()], np.float64)
                if len(far):
                    gap = p[:, None] - far[None]
                    q = (gap**2).sum(axis=2)
                    g = g + (2 * gap / ((0.01 + q) * (1 + q))[:, :, None] * (q > 0)[:, :, None]).sum(axis=1) * 5 / len(far)
                size = np.linalg.norm(g, axis=1)[:, None]
                p = p + g * np.minimum(1, step / np.maximum(size, 1e-12))
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["node", "position"])

        at = staged(rows.mapInArrow(move, f"node {start.schema['node'].dataType.simpleString()}, position array<double>"), "positions")
    return at
