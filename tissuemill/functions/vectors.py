"""Column functions over probability and composition vectors (array<double>)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / (total(e) + 1e-12))


def entropy(p: Column, eps: float = 1e-12) -> Column:
    return -total(F.transform(p, lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0)) * F.log(F.least(F.greatest(x, F.lit(eps)), F.lit(1.0)))))


def argmax(a: Column) -> Column:
    """From 0; the first largest wins."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top1(p: Column) -> Column:
    return F.array_max(p)


def margin(p: Column) -> Column:
    falling = F.sort_array(p, asc=False)
    return F.get(falling, F.lit(0)) - F.get(falling, F.lit(1))


def simplex(v: Column) -> Column:
    """Euclidean projection on the simplex: v - theta, cut at 0.

    theta is the largest of (sum of the k largest - 1) / k, since those quotients rise up to the last k whose value
    stays above them and fall after it.
    """
    falling = F.sort_array(v, asc=False)
    quotients = F.transform(F.sequence(F.lit(1), F.size(v)), lambda k: (total(F.slice(falling, 1, k)) - 1) / k)
    theta = F.array_max(quotients)
    return F.transform(v, lambda x: F.greatest(x - theta, F.lit(0.0)))


def helmert(k: int) -> np.ndarray:
    """k x (k - 1) with orthonormal columns that sum to 0: column j holds 1 / j in its first j rows, then -1."""
    rows, j = np.arange(k)[:, None], np.arange(1, k)[None, :]
    basis = np.where(rows < j, 1.0 / j, np.where(rows == j, -1.0, 0.0))
    return basis / np.linalg.norm(basis, axis=0)


def _times(v: Column, matrix: np.ndarray) -> Column:
    """v (row vector) times a constant matrix."""
    columns = [dot(v, F.array(*map(F.lit, map(float, c)))) for c in matrix.T]
    return F.array(*columns)


def closed(p: Column, eps: float = 1e-12) -> Column:
    floored = F.transform(p, lambda x: F.greatest(x, F.lit(eps)))
    return F.transform(floored, lambda x: x / total(floored))


def ilr(p: Column, k: int) -> Column:
    return _times(F.transform(closed(p), lambda x: F.log(x)), helmert(k))


def ilr_inverse(z: Column, k: int) -> Column:
    e = F.transform(_times(z, helmert(k).T), lambda x: F.exp(x))
    return F.transform(e, lambda x: x / total(e))


def gate(argmax_column: Column, p_positive: Column, positive: int, threshold: float = 0.55) -> Column:
    """The positive class wherever its probability reaches the threshold, whatever the label says."""
    return F.when(p_positive >= threshold, F.lit(positive)).otherwise(argmax_column)


def vote3(a: Column, b: Column, c: Column) -> Column:
    """Majority of three runs; without one the first run's label, even if that is null. No vote at all: null."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(a)
