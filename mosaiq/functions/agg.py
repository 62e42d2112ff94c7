"""Aggregates: Column in, aggregate Column out, for any groupBy. NaN propagates unless the name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import INF, NAN, c, d


def sum(x):  # noqa: A001
    return F.coalesce(F.sum(c(x)), F.lit(0))


def prod(x):
    return F.coalesce(F.product(d(x)), F.lit(1.0))


def nansum(x):
    return sum(F.nanvl(d(x), F.lit(0.0)))


def nanprod(x):
    return prod(F.nanvl(d(x), F.lit(1.0)))


def all(x):  # noqa: A001
    return F.coalesce(F.bool_and(d(x) != 0), F.lit(True))


def any(x):  # noqa: A001
    return F.coalesce(F.bool_or(d(x) != 0), F.lit(False))


def max(x):  # noqa: A001
    return F.max(c(x))


def min(x):  # noqa: A001
    return F.when(F.bool_or(F.isnan(d(x))), F.lit(NAN)).otherwise(F.min(c(x)))


def ptp(x):
    return F.max(c(x)) - min(x)


def argmax(x, index: Column):
    """The index of the largest value, of equal ones the smallest; NaN counts as largest."""
    return F.min_by(index, F.struct(F.when(F.isnan(d(x)), F.lit(-INF)).otherwise(-d(x)), (~F.isnan(d(x))), index))


def argmin(x, index: Column):
    return F.min_by(index, F.struct((~F.isnan(d(x))), d(x), index))


def mean(x):
    return F.avg(d(x))


def average(x, w=None):
    return mean(x) if w is None else F.sum(d(x) * d(w)) / F.sum(d(w))


def _ddof(ddof: int) -> bool:
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 or 1")
    return bool(ddof)


def var(x, ddof: int = 0):
    return F.var_samp(d(x)) if _ddof(ddof) else F.var_pop(d(x))


def std(x, ddof: int = 0):
    return F.stddev_samp(d(x)) if _ddof(ddof) else F.stddev_pop(d(x))


def skew(x, unbiased: bool = True):
    n = F.count(c(x)).cast("double")
    return F.skewness(d(x)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) if unbiased else F.skewness(d(x))


def kurtosis(x, unbiased: bool = True, fischer: bool = True):
    n, k = F.count(c(x)).cast("double"), F.kurtosis(d(x))
    if unbiased:
        k = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * (k + 3) - 3 * (n - 1))
    return k if fischer else k + 3


def median(x, sketched: bool = False):
    return percentile(x, 50, sketched=sketched)


def percentile(x, q: float, interpolation: str = "linear", sketched: bool = False, accuracy: int = 10000):
    """The q-th percentile (0 to 100): linear, lower, higher, midpoint or nearest between neighbours, or sketched. NaN is the largest value here; it does not propagate."""
    if not 0 <= q <= 100:
        raise ValueError("q must lie between 0 and 100")
    if sketched:
        return F.percentile_approx(d(x), q / 100, accuracy).cast("double")
    exact = F.percentile(d(x), q / 100)
    if interpolation == "linear":
        return exact
    if interpolation not in ("lower", "higher", "midpoint", "nearest"):
        raise ValueError(f"unknown interpolation {interpolation!r}")
    rows = F.array_sort(F.collect_list(d(x)))  # the group's values: exact order statistics
    at = (F.size(rows) - 1) * (q / 100)
    low, high = F.floor(at + 1e-12).cast("int"), F.ceil(at - 1e-12).cast("int")
    lower, higher = F.element_at(rows, low + 1), F.element_at(rows, high + 1)
    return {"lower": lower, "higher": higher, "midpoint": (lower + higher) / 2, "nearest": F.element_at(rows, F.rint(at).cast("int") + 1)}[interpolation]


def cov(x, y, ddof: int = 1):
    return F.covar_samp(d(x), d(y)) if _ddof(ddof) else F.covar_pop(d(x), d(y))


def norm(x, ord: float = 2):  # noqa: A002
    """The vector norm of a group: inf, -inf, 0, 1, 2 or any p."""
    a = F.abs(d(x))
    if ord == INF:
        return F.max(a)
    if ord == -INF:
        return F.min(a)
    if ord == 0:
        return F.sum((a != 0).cast("double"))
    return F.sum(a) if ord == 1 else F.sqrt(F.sum(a * a)) if ord == 2 else F.pow(F.sum(F.pow(a, F.lit(float(ord)))), F.lit(1.0 / ord))
