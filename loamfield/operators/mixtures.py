"""Mixtures of normal distributions, and principal components, fitted over tables of vectors (id, embedding).

Each pass maps the vectors to sums (of responsibilities, of vectors and of their squares, weighted) that Spark adds up; the
driver receives numbers for each component and dimension, whatever the number of vectors. Mixtures of several sizes are fitted
in the same passes. Vectors that are null, hold nulls or NaN, or have other dimensions than ``width`` take no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 1e-6
#: Numbers, rows times components, that a task makes at a time.
NUMBERS = 1 << 19


def usable(vectors: DataFrame, width: int) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    ok = F.col("embedding").isNotNull() & (F.size("embedding") == width) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v))
    return vectors.filter(ok).withColumn("embedding", e)


def _rows(lists, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _parts(batches, wide: int):
    """Batches of fewer rows, where each row makes ``wide`` numbers."""
    step = max(1, NUMBERS // max(1, wide))
    for b in batches:
        for a in range(0, b.num_rows, step):
            yield b.slice(a, step)


def _summed(vectors: DataFrame, width: int, sums, wide: int = 1) -> dict[tuple[int, int], np.ndarray]:
    """(a, b) -> the sum over all rows of the arrays that ``sums`` gives of some rows under that key; a row makes ``wide``
    numbers, or as many as its dimensions."""

    def work(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in _parts(batches, max(wide, width)):
            for key, v in sums(_rows(batch.column("embedding"), width)).items():
                total[key] = total[key] + v if key in total else v
        for (a, b), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), a)), pa.array(np.full(len(v), b)), pa.array(np.arange(len(v))), pa.array(v.astype(np.float64))], names=["a", "b", "i", "v"])

    got = vectors.select("embedding").mapInArrow(work, "a long, b long, i long, v double").groupBy("a", "b", "i").agg(F.sum("v").alias("v")).collect()
    sizes: dict[tuple[int, int], int] = {}
    for r in got:
        sizes[r.a, r.b] = max(sizes.get((r.a, r.b), 0), r.i + 1)
    out = {key: np.zeros(n) for key, n in sizes.items()}
    for r in got:
        out[r.a, r.b][r.i] = r.v
    return out


@dataclass
class Model:
    """Shares, means and variances of the components; the criterion (less is better) and log-likelihood of the fit."""

    share: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    criterion: float = math.inf
    likelihood: float = -math.inf

    def logs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log of each row's joint density with each component, of its density)."""
        # (x - m)^2 / v summed over dimensions, as products of matrices
        inv = 1 / self.var
        far = (x * x) @ inv.T - 2 * x @ (self.mean * inv).T + (self.mean * self.mean * inv).sum(axis=1)
        joint = np.log(self.share) - 0.5 * (np.log(2 * math.pi * self.var).sum(axis=1) + far)
        top = joint.max(axis=1, keepdims=True)
        return joint, top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))


def centre(vectors: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, variance of each dimension), about a first row, so that far-off vectors keep their digits."""
    first = vectors.select("embedding").first()
    if first is None:
        return 0, np.zeros(width), np.zeros(width)
    about = np.array(first.embedding, np.float64)
    got = _summed(vectors, width, lambda x: {(0, 0): np.array([len(x)], float), (1, 0): (x - about).sum(axis=0), (2, 0): ((x - about) ** 2).sum(axis=0)})
    n = int(got[0, 0][0])
    mean = got[1, 0] / n
    return n, mean + about, np.maximum(got[2, 0] / n - mean**2, 0)


def spread_centres(vectors: DataFrame, width: int, k: int, seed: int = 42, rounds: int = 3) -> np.ndarray:
    """``k`` centres far apart, in a few passes: each draws some 2 k rows, the likelier the farther they are from those drawn
    before; the drawn, weighed by the rows nearest to them, are thinned to k one by one on the driver."""
    rng = np.random.default_rng(seed)
    first = vectors.select("embedding").orderBy(F.xxhash64(F.lit(seed), "embedding")).first()
    drawn = np.array([first.embedding], np.float64)

    def far(x, c):
        return np.maximum(((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)).min(axis=1), 0)

    for r in range(rounds):
        c = drawn
        total = _summed(vectors, width, lambda x, c=c: {(0, 0): np.array([far(x, c).sum()])}, len(c))[0, 0][0]
        if total <= 0:
            break

        def pick(batches, c=c, total=total, r=r):
            for b in _parts(batches, max(len(c), width)):
                x = _rows(b.column("embedding"), width)
                lot = (b.column("lot").to_numpy(zero_copy_only=False).astype(np.float64) + 0.5) / (1 << 30)
                yield b.select(["embedding"]).filter(pa.array(lot < 2 * k * far(x, c) / total))

        lot = F.pmod(F.xxhash64(F.lit(seed * 100 + r), "embedding"), F.lit(1 << 30)).alias("lot")
        more = vectors.select("embedding", lot).mapInArrow(pick, "embedding array<double>").limit(20 * k).collect()
        if more:
            drawn = np.unique(np.concatenate([drawn, [m.embedding for m in more]]), axis=0)
    c = drawn
    nearest = lambda x: ((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
    weight = _summed(vectors, width, lambda x: {(0, 0): np.bincount(nearest(x), minlength=len(c)).astype(float)}, len(c))[0, 0]
    weight = np.pad(weight, (0, len(c) - len(weight)))
    out = [c[rng.choice(len(c), p=weight / weight.sum())]]
    for _ in range(k - 1):
        odds = weight * far(c, np.array(out))
        out.append(c[rng.choice(len(c), p=odds / odds.sum())] if odds.sum() > 0 else c[rng.integers(len(c))])
    return np.array(out)


def fit(vectors: DataFrame, width: int, starts: list[np.ndarray], rounds: int = 100, tol: float = 1e-6) -> list[Model | None]:
    """A mixture for each array of centres of ``starts``, all in the same passes; None where a component dies. A fit ends when its
    log-likelihood moves by less than ``tol``; the table of vectors should be a written one."""
    n, mean, var = centre(vectors, width)
    if not n:
        return [None] * len(starts)
    models: list[Model | None] = [Model(np.full(len(c), 1 / len(c)), np.asarray(c, np.float64) - mean, np.tile(np.maximum(var, LEAST), (len(c), 1))) for c in starts]
    open_ = {i for i, c in enumerate(starts) if len(c)}
    for _ in range(rounds):
        held = vectors.sparkSession.sparkContext.broadcast({i: models[i] for i in open_})

        def sums(x, held=held):
            x, out = x - mean, {}
            for i, m in held.value.items():
                joint, total = m.logs(x)
                r = np.exp(joint - total[:, None])
                out[i, 0] = np.array([total.sum()])
                out[i, 1], out[i, 2], out[i, 3] = r.sum(axis=0), (r.T @ x).ravel(), (r.T @ (x * x)).ravel()
            return out

        got = _summed(vectors, width, sums, max(len(m.share) for m in held.value.values()))
        for i in sorted(open_):
            old, weight, like = models[i], got[i, 1], float(got[i, 0][0])
            k = len(old.share)
            if (weight < 1e-9).any() or not np.isfinite(like):
                models[i] = None
                open_.discard(i)
                continue
            m = got[i, 2].reshape(k, width) / weight[:, None]
            v = np.maximum(got[i, 3].reshape(k, width) / weight[:, None] - m**2, LEAST)
            models[i] = Model(weight / n, m, v, -2 * like + (k * (2 * width + 1) - 1) * math.log(n), like)
            if abs(like - old.likelihood) < tol:
                open_.discard(i)
        if not open_:
            break
    for m in models:
        if m is not None:
            m.mean = m.mean + mean
    return models


def assign(vectors: DataFrame, width: int, model: Model, name: str = "id") -> DataFrame:
    """``name``, cluster (ties: the first), sure: the likeliest component of each vector and its responsibility."""
    kind = vectors.schema[name].dataType.simpleString()

    def work(batches):
        for b in _parts(batches, max(len(model.share), width)):
            joint, total = model.logs(_rows(b.column("embedding"), width))
            at = joint.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(name), pa.array(at.astype(np.int32)), pa.array(np.exp(joint[np.arange(len(at)), at] - total))], names=[name, "cluster", "sure"])

    return vectors.select(name, "embedding").mapInArrow(work, f"{name} {kind}, cluster int, sure double")


def components(vectors: DataFrame, width: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, the first principal components as rows, each with its greatest entry positive); the driver holds one
    width x width matrix."""
    n, mean, _ = centre(vectors, width)
    if not n:
        return mean, np.zeros((0, width))
    got = _summed(vectors, width, lambda x: {(0, i): v for i, v in enumerate((x - mean).T @ (x - mean))})
    c = np.array([got[0, i] for i in range(width)]) / n
    axes = np.linalg.eigh((c + c.T) / 2)[1][:, ::-1].T[:dims]
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def projected(vectors: DataFrame, width: int, mean: np.ndarray, axes: np.ndarray, name: str = "id") -> DataFrame:
    """``name``, embedding: coordinates on the axes."""
    kind = vectors.schema[name].dataType.simpleString()

    def work(batches):
        for b in batches:
            y = (_rows(b.column("embedding"), width) - mean) @ axes.T
            yield pa.RecordBatch.from_arrays([b.column(name), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), len(axes)).cast(pa.list_(pa.float64()))], names=[name, "embedding"])

    return vectors.select(name, "embedding").mapInArrow(work, f"{name} {kind}, embedding array<double>")
