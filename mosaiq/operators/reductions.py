"""Reductions, statistics and scans of arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..array import Array, array, elementwise, idx, lift, linear, number_rows, sanitize_axis, scan
from ..functions import agg, expr
from ..functions import types as ty


def _total(t: str) -> str:
    return "int64" if ty.is_exact(t) else t


def sum(a, axis=None, out=None, keepdims=False):  # noqa: A001
    return a.reduce(agg.sum if a.dtype != "bool" else lambda v: agg.sum(v.cast("int")), _total(a.dtype), axis, keepdims)


def prod(a, axis=None, out=None, keepdims=False):
    return a.reduce(agg.prod, _total(a.dtype), axis, keepdims)


def nansum(a, axis=None, out=None, keepdims=False):
    return a.reduce(agg.nansum, _total(a.dtype), axis, keepdims)


def nanprod(a, axis=None, out=None, keepdims=False):
    return a.reduce(agg.nanprod, _total(a.dtype), axis, keepdims)


def all(a, axis=None, out=None, keepdims=False):  # noqa: A001
    return a.reduce(agg.all, "bool", axis, keepdims)


def any(a, axis=None, out=None, keepdims=False):  # noqa: A001
    return a.reduce(agg.any, "bool", axis, keepdims)


def max(a, axis=None, out=None, keepdims=False):  # noqa: A001
    return a.reduce(agg.max, a.dtype, axis, keepdims)


def min(a, axis=None, out=None, keepdims=False):  # noqa: A001
    return a.reduce(agg.min, a.dtype, axis, keepdims)


def ptp(a, axis=None, out=None, keepdims=False):
    return a.reduce(agg.ptp, a.dtype, axis, keepdims)


def _arg(a, axis, f, keepdims=False):
    axis = sanitize_axis(a.shape, axis)
    at = linear(a.shape) if axis is None else F.col(f"i{axis}")
    return a.reduce(lambda v: f(v, at), "int64", axis, keepdims)


def argmax(a, axis=None, out=None, keepdims=False):
    """Index of the maximum (flat without an axis), of equal ones the first."""
    return _arg(a, axis, agg.argmax, keepdims)


def argmin(a, axis=None, out=None, keepdims=False):
    return _arg(a, axis, agg.argmin, keepdims)


def mean(a, axis=None, keepdims=False):
    return a.reduce(agg.mean, ty.at_least_float(a.dtype), axis, keepdims)


def average(a, axis=None, weights=None, returned=False):
    if weights is None:
        out = mean(a, axis)
        n = lift(float(a.size // np.prod(out.shape, dtype=int) if out.size else 0), out)
        return (out, n) if returned else out
    axis_ = sanitize_axis(a.shape, axis)
    if weights.shape != a.shape:
        if axis_ is None or weights.ndim != 1 or weights.shape[0] != a.shape[axis_]:
            raise ValueError("weights must have the array's shape, or the length of one axis")
        weights = Array(weights.cells().select(*[(F.col("i0") if k == axis_ else F.lit(0).cast("bigint")).alias(f"i{k}") for k in range(a.ndim)], "v"), [a.shape[k] if k == axis_ else 1 for k in range(a.ndim)], weights.dtype)
    both = elementwise(lambda x, w: F.struct(expr.d(x).alias("x"), expr.d(w).alias("w")), a, weights, dtype="float64")
    cells = Array(both.frame.select(*idx(a.ndim), both.value.alias("_s")), a.shape, "float64", F.lit(0.0))
    rest = [k for k in range(a.ndim) if axis_ is not None and k not in (axis_ if isinstance(axis_, tuple) else (axis_,))]
    g = cells.frame.groupBy(*[f"i{k}" for k in rest]).agg((F.sum(F.col("_s.x") * F.col("_s.w")) / F.sum("_s.w")).alias("v"), F.sum("_s.w").alias("w"))
    g = g.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(rest)], "v", "w")
    shape = [a.shape[k] for k in rest]
    out = Array(g, shape, "float64")
    return (out, Array(g, shape, "float64", F.col("w"))) if returned else out


def var(a, axis=None, ddof=0, keepdims=False):
    return a.reduce(lambda v: agg.var(v, ddof), ty.at_least_float(a.dtype), axis, keepdims)


def std(a, axis=None, ddof=0, keepdims=False):
    return a.reduce(lambda v: agg.std(v, ddof), ty.at_least_float(a.dtype), axis, keepdims)


def skew(a, axis=None, unbiased=True):
    return a.reduce(lambda v: agg.skew(v, unbiased), ty.at_least_float(a.dtype), axis)


def kurtosis(a, axis=None, unbiased=True, fischer=True):
    return a.reduce(lambda v: agg.kurtosis(v, unbiased, fischer), ty.at_least_float(a.dtype), axis)


def percentile(a, q, axis=None, out=None, interpolation="linear", keepdims=False, sketched=False, sketch_size=None):
    """The q-th percentile(s); a list of q gives a new first axis."""
    if isinstance(q, Array | list | tuple | np.ndarray):
        qs = np.asarray(q).ravel().tolist()
        parts = [percentile(a, x, axis, None, interpolation, keepdims, sketched) for x in qs]
        frame = None
        for k, p in enumerate(parts):
            f = p.cells().select(F.lit(k).cast("bigint").alias("i0"), *[F.col(f"i{j}").alias(f"i{j + 1}") for j in range(p.ndim)], "v")
            frame = f if frame is None else frame.unionByName(f)
        return Array(frame, (len(qs), *parts[0].shape), parts[0].dtype)
    return a.reduce(lambda v: agg.percentile(v, q, interpolation, sketched), "float64" if a.dtype in ("float64", "int64") else "float32", axis, keepdims)


def median(a, axis=None, keepdims=False, sketched=False, sketch_size=None):
    return percentile(a, 50, axis, keepdims=keepdims, sketched=sketched)


def cov(m, y=None, rowvar=True, bias=False, ddof=None):
    """Covariance matrix of rows (columns if not rowvar), from one pass of products of centred values."""
    x = m if m.ndim == 2 else Array(m.cells().select(F.lit(0).cast("bigint").alias("i0"), F.col("i0").alias("i1"), "v"), (1, m.shape[0]), m.dtype)
    if not rowvar and m.ndim == 2:
        x = Array(x.cells().select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v"), x.shape[::-1], x.dtype)
    if y is not None:
        other = y if y.ndim == 2 else Array(y.cells().select(F.lit(0).cast("bigint").alias("i0"), F.col("i0").alias("i1"), "v"), (1, y.shape[0]), y.dtype)
        if not rowvar and y.ndim == 2:
            other = Array(other.cells().select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v"), other.shape[::-1], other.dtype)
        x = Array(x.cells().unionByName(other.cells().withColumn("i0", F.col("i0") + x.shape[0])), (x.shape[0] + other.shape[0], x.shape[1]), "float64")
    n, k = x.shape[1], x.shape[0]
    ddof = (0 if bias else 1) if ddof is None else ddof
    mu = x.cells().groupBy("i0").agg(F.avg("v").alias("mu"))
    centred = x.cells().join(mu, "i0").select("i0", "i1", (F.col("v") - F.col("mu")).alias("v"))
    left, right = centred, centred.select(F.col("i0").alias("j0"), "i1", F.col("v").alias("w"))
    cells = left.join(right, "i1").groupBy("i0", "j0").agg((F.sum(F.col("v") * F.col("w")) / (n - ddof)).alias("v")).select("i0", F.col("j0").alias("i1"), "v")
    return Array(cells, (k, k), "float64") if k > 1 else Array(cells.select("v"), (), "float64")


def bincount(x, weights=None, minlength=0):
    """How often (or with what weight) each non-negative integer occurs, up to the largest one."""
    if weights is None:
        counts = x.cells().groupBy("v").agg(F.count("*").alias("n"))
    else:
        both = elementwise(lambda a, w: F.struct(a.alias("a"), w.alias("w")), x, weights, dtype="float64")
        counts = both.frame.select(both.value.alias("s")).groupBy(F.col("s.a").alias("v")).agg(F.sum("s.w").alias("n"))
    top = counts.agg(F.max("v")).first()[0]
    size = builtin_max(minlength, 0 if top is None else int(top) + 1)
    full = x.spark.range(size).join(counts, F.col("id") == F.col("v"), "left")
    return Array(full.select(F.col("id").alias("i0"), F.coalesce("n", F.lit(0)).alias("v")), (size,), "int64" if weights is None else "float64")


builtin_max = __builtins__["max"] if isinstance(__builtins__, dict) else __builtins__.max


def bucketize(x, boundaries, out_int32=False, right=False, out=None):
    return x.apply(lambda v: expr.bucketize(v, np.asarray(boundaries).tolist(), right), "int32" if out_int32 else "int64")


def digitize(x, bins, right=False):
    return x.apply(lambda v: expr.digitize(v, np.asarray(bins).tolist(), right), "int64")


def histc(a, bins=100, min=0, max=0, out=None):  # noqa: A002
    """Counts in bins of equal width; equal bounds mean the data's range. Values outside don't count."""
    lo, hi = float(min), float(max)
    if lo == hi:
        r = a.cells().agg(F.min("v"), F.max("v")).first()
        lo, hi = (float(r[0]), float(r[1])) if r[0] is not None else (0.0, 1.0)
        lo, hi = (lo - 1, hi + 1) if lo == hi else (lo, hi)
    v = F.col("v").cast("double")
    at = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    counts = a.cells().where(v.between(lo, hi) & ~F.isnan(v)).groupBy(at.alias("at")).agg(F.count("*").alias("n"))
    full = a.spark.range(bins).join(counts, F.col("id") == F.col("at"), "left")
    return Array(full.select(F.col("id").alias("i0"), F.coalesce("n", F.lit(0)).alias("v")), (bins,), a.dtype)


def histogram(a, bins=10, range=(0, 0), normed=None, weights=None, density=None):  # noqa: A002
    if normed or weights is not None or density:
        raise NotImplementedError("normed, weights and density aren't supported")
    return histc(a, bins, *range)


def _cum(a, axis, product):
    axis = sanitize_axis(a.shape, axis)
    if axis is None:
        raise NotImplementedError("a scan needs an axis")
    t = _total(a.dtype)
    if a.ndim == 1:  # one line of all rows: partial scans, offset
        out = scan(a.cells(), ["i0"], F.col("v").cast("double" if not ty.is_exact(t) or product else "bigint"), "_c", product)
        return Array(out.select("i0", F.col("_c").alias("v")), a.shape, t)
    w = Window.partitionBy(*[f"i{k}" for k in range(a.ndim) if k != axis]).orderBy(f"i{axis}").rowsBetween(Window.unboundedPreceding, 0)
    v = (F.product(F.col("v").cast("double")) if product else F.sum("v")).over(w)
    return Array(a.cells().select(*idx(a.ndim), v.alias("v")), a.shape, t)


range = __builtins__["range"] if isinstance(__builtins__, dict) else __builtins__.range


def cumsum(a, axis=0, dtype=None, out=None):
    return _cum(a, axis, False)


def cumprod(a, axis=0, dtype=None, out=None):
    return _cum(a, axis, True)


cumproduct = cumprod


def diff(a, n=1, axis=-1, prepend=None, append=None):
    """n-th forward difference: each cell joins the one after it, so any axis, of any length, spreads out."""
    from .manipulations import concatenate

    axis = sanitize_axis(a.shape, axis)
    parts = [x if isinstance(x, Array) else array(np.full([1 if k == axis else s for k, s in enumerate(a.shape)], x)) for x in (prepend, append) if x is not None]
    if parts:
        a = concatenate([*([parts[0]] if prepend is not None else []), a, *([parts[-1]] if append is not None else [])], axis)
    for _ in range(n):
        later = a.cells().select(*[(F.col(c) - 1).alias(c) if k == axis else F.col(c) for k, c in enumerate(idx(a.ndim))], F.col("v").alias("w"))
        out = a.cells().join(later, idx(a.ndim)).select(*idx(a.ndim), (F.col("w") - F.col("v")).alias("v"))
        a = Array(out, [s - (k == axis) for k, s in enumerate(a.shape)], a.dtype)
    return a


def norm(x, axis=None, keepdims=False, ord=None):  # noqa: A002
    """2-norm of all elements, or vector norms over an axis, or matrix norms over two."""
    from .linalg import matrix_norm

    if isinstance(axis, tuple | list) and len(axis) == 2 or ord in ("fro", "nuc") or axis is None and x.ndim == 2 and ord is not None:
        return matrix_norm(x, axis, keepdims, ord)
    return vector_norm(x, axis, keepdims, ord)


def vector_norm(x, axis=None, keepdims=False, ord=None):  # noqa: A002
    return x.reduce(lambda v: agg.norm(v, 2 if ord is None else ord), ty.at_least_float(x.dtype), axis, keepdims)


def sort(a, axis=-1, descending=False, out=None, return_sort_indices=True):
    """Values in order along an axis, and their places before; equal values keep their order, NaN goes last."""
    axis = sanitize_axis(a.shape, axis)
    v = F.col("v").cast("double") if a.dtype != "int64" else F.col("v")
    order = [F.isnan(F.col("v").cast("double")), v.desc() if descending else v.asc(), F.col(f"i{axis}")]
    others = [f"i{k}" for k in range(a.ndim) if k != axis]
    if others:
        n = a.cells().withColumn("_r", (F.row_number().over(Window.partitionBy(*others).orderBy(*order)) - 1).cast("bigint"))
    else:
        n = number_rows(a.cells(), order, "_r")
    cols = [F.col("_r").alias(c) if k == axis else F.col(c) for k, c in enumerate(idx(a.ndim))]
    frame = n.select(*cols, "v", F.col(f"i{axis}").alias("_from"))
    values, places = Array(frame, a.shape, a.dtype), Array(frame, a.shape, "int64", F.col("_from"))
    return (values, places) if return_sort_indices else values


def argsort(a, axis=-1, descending=False):
    return sort(a, axis, descending)[1]


def topk(a, k, dim=-1, largest=True, sorted=True, out=None):  # noqa: A002
    """The k largest or smallest along an axis, and their places; one axis alone needs no shuffle of all rows."""
    dim = sanitize_axis(a.shape, dim)
    v = F.col("v").cast("double")
    order = [F.isnan(v), v.desc() if largest else v.asc(), F.col(f"i{dim}")]
    others = [f"i{j}" for j in range(a.ndim) if j != dim]
    shape = [k if j == dim else s for j, s in enumerate(a.shape)]
    if not others:
        top = a.cells().orderBy(*order).limit(k)
        w = Window.orderBy(*order)  # k rows
    else:
        top, w = a.cells(), Window.partitionBy(*others).orderBy(*order)
    ranked = top.withColumn("_r", (F.row_number().over(w) - 1).cast("bigint")).where(F.col("_r") < k)
    frame = ranked.select(*[F.col("_r").alias(c) if j == dim else F.col(c) for j, c in enumerate(idx(a.ndim))], "v", F.col(f"i{dim}").alias("_from"))
    return Array(frame, shape, a.dtype), Array(frame, shape, "int64", F.col("_from"))


for _f in (sum, prod, all, any, max, min, ptp, argmax, argmin, mean, average, var, std, skew, kurtosis, percentile, median, cumsum, cumprod, diff, norm, nansum, nanprod):
    setattr(Array, _f.__name__, _f)
Array.cumsum_ = lambda a, axis=0: cumsum(a, axis).astype(a.dtype)
Array.cumprod_ = lambda a, axis=0: cumprod(a, axis).astype(a.dtype)
