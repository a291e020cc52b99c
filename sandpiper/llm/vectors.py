"""Vectors in Arrow batches: which rows are sound, padding, whole numbers that stay exact."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below it doubles hold every whole number.
EXACT = float(1 << 53)
_whole = np.frompyfunc(lambda x: int(x) * 256 if abs(x) >= float(1 << 52) else math.floor(256 * x), 1, 1)
_int = np.frompyfunc(int, 1, 1)


def integers(rows: np.ndarray) -> np.ndarray:
    """As Python's integers."""
    return _int(rows)


def sound(name: str = "embedding") -> Column:
    """Whether a vector is there and holds finite components only; an empty one is sound."""
    finite = F.forall(name, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(F.col(name).isNotNull() & finite, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as doubles, one vector a row, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def quantise(rows: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every double: doubles where those hold it exactly, else Python's integers."""
    return np.floor(256 * rows) + 0.0 if np.abs(rows).max(initial=0) < float(1 << 44) else _whole(rows)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T of whole numbers, exact: one dense product of doubles if no sum can reach 2 ** 53, else Python's integers."""
    if left.dtype != object and right.dtype != object:
        most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
        if most < EXACT:
            return left @ right.T
    return integers(left) @ integers(right).T
