"""Vectors of whole numbers, from vectors of floats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integers(df: DataFrame, scale: int, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, x``: floor(scale * entry), as double, of each row whose vector is not null and has no null, NaN or infinite entry.

    Entries beyond the range of long are held at its ends. Other columns aren't read.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda e: e.cast("double"))
    df = df.select(F.col(f"`{ids}`").cast("long").alias("id"), v.alias("v"))
    df = df.filter(F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    return df.select("id", F.transform("v", lambda e: F.floor(e * F.lit(float(scale)))).alias("x"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of int64; shorter ones are filled up with 0."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) * width == len(flat) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def parts(lists: pa.ListArray, width: int, most: int = 1 << 19):
    """``(first row, matrix)`` of pieces of a column of lists, of about ``most`` numbers each."""
    step = max(1, most // max(1, width))
    for at in range(0, len(lists), step):
        yield at, matrix(lists.slice(at, step), width)


def squared(x: str | Column) -> Column:
    """The squared length of a vector, as double."""
    return F.aggregate(x, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
