"""Vector functions on ``array<double>`` columns (built-in higher-order
functions, so they stay inside whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squared_distance(a, b) -> Column:
    """sum((a_i - b_i)^2) of two equally long arrays."""
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, d: acc + d)


def euclidean(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def rbf(a, b, gamma) -> Column:
    """exp(-gamma * |a - b|^2); ``gamma`` is taken as given (the original
    passes its "width" in the gamma position unchanged)."""
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    return F.exp(-g * squared_distance(a, b))


def zeros_if_missing(v, n: int) -> Column:
    """The vector, or ``n`` zeros where it is missing (e.g. no image)."""
    return F.coalesce(_c(v), F.array_repeat(F.lit(0.0), n))


def quantile(ordered, q: float) -> Column:
    """The q-quantile of an ascending array, linearly interpolated; null if it is empty."""
    v = _c(ordered)
    at = F.lit(float(q)) * (F.size(v) - 1)
    low = F.floor(at).cast("int")
    below, above = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
    return F.when(F.size(v) > 0, below + (above - below) * (at - low))
