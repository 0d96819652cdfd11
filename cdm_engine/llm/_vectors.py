"""Vectors of whole numbers from columns of floating-point arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are held between -LIMIT and LIMIT, so that they fit 32 bits and squared distances 64.
LIMIT = 2**27
#: Below this the squared distances of up to 64 components are exact in doubles.
EXACT = 2**22


def usable(vector: str, dims: int | None = None) -> Column:
    """Whether a vector has components (``dims``, if given), none of them null or non-finite."""
    v = F.col(vector)
    size = F.size(v) == dims if dims else F.size(v) > 0
    return v.isNotNull() & F.coalesce(size & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(F.col(vector), lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int"))


def whole_numbers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their components as 64-bit integers, a row each); says the same as ``usable`` and ``whole``."""
    keep = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    right = vectors.filter(keep).flatten()
    x = np.asarray(pc.fill_null(right.cast(pa.float64()), float("nan"))).reshape(-1, dims)
    fine = np.isfinite(x).all(axis=1)
    mask = keep.to_numpy(zero_copy_only=False).copy()
    mask[np.flatnonzero(mask)] = fine
    with np.errstate(over="ignore"):
        return mask, np.floor(np.clip(x[fine] * scale, -LIMIT, LIMIT)).astype(np.int64)


def integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column that holds ``dims`` integers in each."""
    return np.asarray(vectors.flatten()).reshape(-1, dims)


def number_kind(*arrays: np.ndarray) -> type:
    """Doubles, if squared distances of these are exact in them (fast products), else 64-bit integers."""
    return np.float64 if all(not a.size or np.abs(a).max() <= EXACT // max(1, a.shape[-1] // 64) for a in arrays) else np.int64


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points (rows) to integer others (columns)."""
    kind = number_kind(points, others)
    if kind is np.int64:
        return np.stack([((points.astype(np.int64) - o) ** 2).sum(axis=1) for o in others.astype(np.int64)], axis=1) if len(others) else np.zeros((len(points), 0), np.int64)
    p, o = points.astype(kind), others.astype(kind)
    return ((p * p).sum(axis=1)[:, None] - 2 * (p @ o.T) + (o * o).sum(axis=1)).astype(np.int64)


def group_sums(points: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many points a group has, their sums), exact: no more points at a time than doubles can add."""
    count = np.bincount(group, minlength=groups)
    total = np.zeros((groups, points.shape[1]), np.int64)
    for a in range(0, len(points), 1 << 16):  # 2^16 * LIMIT is below 2^53
        own = group[a : a + (1 << 16)]
        one = np.zeros((groups, len(own)))
        one[own, np.arange(len(own))] = 1
        total += (one @ points[a : a + (1 << 16)].astype(np.float64)).astype(np.int64)
    return count, total
