"""Whitening by the exact covariance of vectors of whole numbers.

Numbers are split into limbs of 20 bits, so that a slab of 8,192 rows has products whose sums stay within the 53 bits that
a double holds exactly: the matrix products run in float64 and lose nothing. Limbs are recombined as big integers; those of
all tasks are cut into words of 32 bits, which Spark sums, and put together again. n times the sum of products less the
product of the sums is n^2 times the covariance about the mean, a whole number, so that centring loses nothing either.
Only then does it become a matrix of doubles, which is decomposed; the eigenvectors are refined in extended precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamfield.llm.common import read, staged
from loamfield.llm.vectors import integers, parts

SCALE = 256
COMPONENTS = 4
LIMB = 20
SLAB = 1 << 13
#: Slabs whose exact sums an int64 surely holds: 4 products of limbs a weight, each below 2^53.
HELD = 128
_PRIME = (1 << 31) - 1


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Limbs of whole numbers as doubles, least first; all but the last lie from 0 to 2^20."""
    out, x = [], x.copy()
    while x.size and not (-(1 << LIMB) <= x.min() and x.max() < 1 << LIMB):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x >>= LIMB
    return [*out, x.astype(np.float64)]


class Sums:
    """Exact sums and sums of products of rows of whole numbers."""

    def __init__(self, width: int):
        self.n, self.width = 0, width
        self.sums, self.products = np.zeros(width, object), np.zeros((width, width), object)
        self._held: dict[int, np.ndarray] = {}
        self._lone: dict[int, np.ndarray] = {}
        self._slabs = 0

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), SLAB):
            cut = limbs(x[at : at + SLAB])
            for i, a in enumerate(cut):
                self._lone[i] = self._lone.get(i, 0) + a.sum(axis=0).astype(np.int64)
                for j, b in enumerate(cut):
                    self._held[i + j] = self._held.get(i + j, 0) + (a.T @ b).astype(np.int64)
            self._slabs += 1
            if self._slabs == HELD:
                self._settle()
        self.n += len(x)

    def _settle(self) -> None:
        for held, to in ((self._lone, self.sums), (self._held, self.products)):
            for weight, m in held.items():
                to += m.astype(object) << (LIMB * weight) if m.size else 0
            held.clear()
        self._slabs = 0

    def rows(self) -> list[tuple[int, int, int, int]]:
        """``(i, j, k, word)``: word k of 32 bits of each sum (i = -1) and product of columns i <= j; the last has the sign."""
        self._settle()
        out = [(-2, -2, 0, self.n)]
        for i in range(-1, self.width):
            for j in range(max(i, 0), self.width):
                v, k = int(self.sums[j] if i < 0 else self.products[i, j]), 0
                while not -(1 << 31) <= v < 1 << 31:
                    out.append((i, j, k, v & 0xFFFFFFFF))
                    v, k = v >> 32, k + 1
                if v:
                    out.append((i, j, k, v))
        return out


def moments(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """(rows, sums, sums of products) of the column x, exact. The driver receives the words of a width x width matrix."""

    def work(batches):
        sums = Sums(width)
        for b in batches:
            for _, x in parts(b.column("x"), width):
                sums.add(x)
        cols = list(zip(*sums.rows(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["i", "j", "k", "word"])

    words = vectors.select("x").mapInArrow(work, "i long, j long, k long, word long")
    n, sums, products = 0, [0] * width, np.zeros((width, width), object)
    for r in words.groupBy("i", "j", "k").agg(F.sum("word").alias("word")).collect():
        v = int(r.word) << (32 * r.k)
        if r.i == -2:
            n += v
        elif r.i == -1:
            sums[r.j] += v
        else:
            products[r.i, r.j] += v
            if r.i != r.j:
                products[r.j, r.i] += v
    return n, sums, products


def rank(m: np.ndarray) -> int:
    """Rank of a matrix of whole numbers, modulo a prime of 31 bits (never above the true rank, and below it by rare chance)."""
    a, r = (m % _PRIME).astype(np.int64), 0
    for c in range(a.shape[1]):
        at = np.flatnonzero(a[r:, c])
        if not len(at):
            continue
        p = r + int(at[0])
        a[[r, p]] = a[[p, r]]
        a[r] = a[r] * pow(int(a[r, c]), -1, _PRIME) % _PRIME
        rest = a[r + 1 :]
        rest -= rest[:, c : c + 1] * a[r] % _PRIME
        rest %= _PRIME
        r += 1
        if r == len(a):
            break
    return r


def eigen(scatter: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the greatest, unit eigenvectors as columns) of ``scatter / below``, a matrix of whole numbers over one.

    Two corrections in extended precision follow the decomposition: of the vectors' right angles, and of what the matrix
    still mixes of them. The greatest entry of each vector is positive.
    """
    d = len(scatter)
    high, low = np.zeros((d, d)), np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            high[i, j] = high[j, i] = h = int(scatter[i, j]) / below
            low[i, j] = low[j, i] = float(Fraction(int(scatter[i, j]), below) - Fraction(h))
    x = np.linalg.eigh(high)[1].astype(np.longdouble)
    a = high.astype(np.longdouble) + low
    for _ in range(2):
        off = np.eye(d) - x.T @ x
        s = x.T @ a @ x
        e = np.diag(s) / (1 - np.diag(off))
        apart = e[None, :] - e[:, None]
        near = np.abs(apart) <= 2 * (np.linalg.norm((s - np.diag(e)).astype(float)) + np.abs(e).max() * np.linalg.norm(off.astype(float)))
        x = x + x @ np.where(near, off / 2, (s + e[None, :] * off) / np.where(near, 1, apart))
    x = x / np.sqrt((x * x).sum(axis=0))
    e = np.einsum("ij,ij->j", x, a @ x).astype(np.float64)
    order = np.argsort(-e, kind="stable")
    x, e = x[:, order].astype(np.float64), e[order]
    return e, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What whitens: rows fitted, their sums, eigenvalues and unit vectors of the first components, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def components(self) -> int:
        return min(self.vectors.shape[1], self.width)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(x less the mean, the sum of squares of n x less the sums where a long holds it, else null) of rows."""
        most = max([1, *(abs(s) for s in self.sums)]) + self.n * max([1, int(x.max(initial=0)), -int(x.min(initial=0))])
        if most * most * self.width < 1 << 62:
            c = x * self.n - np.array(self.sums, np.int64)
            return c / self.n, (c * c).sum(axis=1).tolist()
        c = x.astype(object) * self.n - np.array(self.sums, object)
        square = [int(s) for s in (c * c).sum(axis=1)] if self.width else [0] * len(x)
        return np.array([[int(v) / self.n for v in r] for r in c], np.float64).reshape(x.shape), [s if s < 1 << 63 else None for s in square]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.vectors / np.sqrt(np.maximum(self.values, 0)), np.nan)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of distinct vectors of whole numbers (column x, a table that is written); none for an empty table.

    Vectors shorter than the longest are filled up with 0. Components beyond the exact rank have variance 0. The driver
    holds matrices of the vectors' width, whatever their number.
    """
    width = vectors.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return None
    n, sums, products = moments(vectors, width)
    scatter = products * n - np.outer(np.array(sums, object), np.array(sums, object))
    if not width:
        return Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    values, axes = eigen(scatter, n * n)
    values[rank(scatter) :] = 0.0
    return Whitening(n, sums, values[:components], axes[:, :components], int(np.trace(scatter)) / (n * n))


def _coordinates(vectors: DataFrame, w: Whitening) -> DataFrame:
    """One column of whitened coordinates, w1, w2 ..., for each component with variance."""
    used = int((w.values > 0).sum())

    def work(batches):
        for b in batches:
            for _, x in parts(b.column("x"), w.width):
                got = w.project(w.centred(x)[0])
                yield pa.RecordBatch.from_arrays([pa.array(got[:, i]) for i in range(used)], names=[f"w{i}" for i in range(used)])

    return vectors.select("x").mapInArrow(work, ", ".join(f"w{i} double" for i in range(used)))


def identity_error(vectors: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of the covariance of whitened ``vectors`` less the identity; null without variance."""
    used = int((w.values > 0).sum())
    if not used:
        return None
    pairs = [(i, j) for i in range(used) for j in range(i, used)]
    got = _coordinates(vectors, w).agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs, strict=True))


def whiten(rows: DataFrame, w: Whitening) -> DataFrame:
    """``id, component, deviation, whitened, explained`` for each row (id, x) and component.

    ``deviation`` is the sum of (n x - sums)^2, exact; null where a long can't hold it. ``whitened`` is null for a component
    without variance, ``explained`` where nothing varies at all. Repeated rows give repeated results, null ids stay null.
    """
    k = w.components
    share = [float(v) / w.trace if w.trace > 0 else None for v in w.values[:k]]

    def work(batches):
        for b in batches:
            for at, x in parts(b.column("x"), w.width):
                m = len(x)
                centred, square = w.centred(x)
                got = w.project(centred).ravel() if k else np.zeros(0)
                row = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(at, m).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(square, pa.int64()).take(pa.array(row)), pa.array(got, mask=np.isnan(got)), pa.array(share * m, pa.float64())],
                    names=["id", "component", "deviation", "whitened", "explained"],
                )

    return rows.select("id", "x").mapInArrow(work, "id long, component int, deviation long, whitened double, explained double")


def op11(spark, sf_dir: str) -> DataFrame:
    rows = integers(read(spark, sf_dir, "embeddings"), SCALE)
    distinct = staged(rows.select("x").distinct(), "distinct-vectors")
    w = fit(distinct)
    if w is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(distinct, w)
    return whiten(rows, w).select(F.col("id").alias("vec_id"), "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
