"""Reshaping, joining, splitting and distinct values of arrays: arithmetic on index columns."""

from __future__ import annotations

import functools
from collections import namedtuple

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..array import Array, array, broadcast_shapes, broadcast_to, idx, linear, number_rows, sanitize_axis, unravel
from ..array import prod as _size
from ..functions import types as ty
from .reductions import argsort, sort, topk  # noqa: F401  part of this family's names


def reindexed(a: Array, cols, shape, dtype=None) -> Array:
    return Array(a.cells().select(*[c.cast("bigint").alias(f"i{k}") for k, c in enumerate(cols)], "v"), shape, dtype or a.dtype, split=a.split)


def I(k: int):  # noqa: E743, N802
    return F.col(f"i{k}")


def reshape(a, *shape, new_split=None):
    shape = tuple(shape[0]) if len(shape) == 1 and not isinstance(shape[0], int) else shape
    if shape.count(-1) > 1:
        raise ValueError("only one length can be left open")
    known = _size(n for n in shape if n != -1)
    shape = tuple(a.size // max(1, known) if n == -1 else n for n in shape)
    if _size(shape) != a.size:
        raise ValueError(f"can't reshape {a.shape} to {shape}")
    return reindexed(a, unravel(linear(a.shape), shape), shape)


def flatten(a):
    return reshape(a, (a.size,))


ravel = flatten


def transpose(a, axes=None):
    axes = tuple(range(a.ndim))[::-1] if axes is None else tuple(sanitize_axis(a.shape, x) for x in axes)
    if sorted(axes) != list(range(a.ndim)):
        raise ValueError("axes must be a permutation")
    return reindexed(a, [I(k) for k in axes], [a.shape[k] for k in axes])


permute_dims = transpose


def swapaxes(x, axis1, axis2):
    axes = list(range(x.ndim))
    i, j = sanitize_axis(x.shape, axis1), sanitize_axis(x.shape, axis2)
    axes[i], axes[j] = axes[j], axes[i]
    return transpose(x, axes)


def moveaxis(x, source, destination):
    src = [sanitize_axis(x.shape, s) for s in (source if isinstance(source, list | tuple) else [source])]
    dst = [sanitize_axis(x.shape, s) for s in (destination if isinstance(destination, list | tuple) else [destination])]
    axes = [k for k in range(x.ndim) if k not in src]
    for d, s in sorted(zip(dst, src, strict=True)):
        axes.insert(d, s)
    return transpose(x, axes)


def matrix_transpose(x):
    return swapaxes(x, -1, -2)


def expand_dims(a, axis):
    axis = axis % (a.ndim + 1)
    cols = [I(k) for k in range(a.ndim)]
    return reindexed(a, [*cols[:axis], F.lit(0), *cols[axis:]], [*a.shape[:axis], 1, *a.shape[axis:]])


def squeeze(x, axis=None):
    axis = sanitize_axis(x.shape, axis)
    gone = [k for k, n in enumerate(x.shape) if n == 1] if axis is None else [axis] if isinstance(axis, int) else list(axis)
    if any(x.shape[k] != 1 for k in gone):
        raise ValueError("only axes of length 1 can go")
    rest = [k for k in range(x.ndim) if k not in gone]
    return reindexed(x, [I(k) for k in rest], [x.shape[k] for k in rest])


def flip(a, axis=None):
    axis = sanitize_axis(a.shape, axis)
    axes = range(a.ndim) if axis is None else [axis] if isinstance(axis, int) else axis
    return reindexed(a, [n - 1 - I(k) if k in axes else I(k) for k, n in enumerate(a.shape)], a.shape)


def flipud(a):
    return flip(a, 0)


def fliplr(a):
    return flip(a, 1)


def rot90(m, k=1, axes=(0, 1)):
    i, j = (sanitize_axis(m.shape, x) for x in axes)
    if i == j:
        raise ValueError("the two axes must differ")
    k %= 4
    if k == 2:
        return flip(m, (i, j))
    if k == 0:
        return m
    return swapaxes(flip(m, j), i, j) if k == 1 else flip(swapaxes(m, i, j), j)


def roll(x, shift, axis=None):
    if axis is None:
        return reshape(reindexed(flatten(x), [F.pmod(I(0) + int(shift), F.lit(max(1, x.size)))], (x.size,)), x.shape)
    axes = axis if isinstance(axis, list | tuple) else [axis]
    shifts = shift if isinstance(shift, list | tuple) else [shift] * len(axes)
    by = dict.fromkeys(range(x.ndim), 0)
    for a, s in zip(axes, shifts, strict=True):
        by[sanitize_axis(x.shape, a)] += int(s)
    return reindexed(x, [F.pmod(I(k) + by[k], F.lit(max(1, n))) for k, n in enumerate(x.shape)], x.shape)


def concatenate(arrays, axis=0):
    arrays = list(arrays)
    axis = sanitize_axis(arrays[0].shape, axis)
    t = functools.reduce(ty.promote_types, [a.dtype for a in arrays])
    frame, at = None, 0
    for a in arrays:
        if a.ndim != arrays[0].ndim or any(n != m for k, (n, m) in enumerate(zip(a.shape, arrays[0].shape, strict=True)) if k != axis):
            raise ValueError("shapes differ off the axis")
        part = a.astype(t).cells().withColumn(f"i{axis}", I(axis) + F.lit(at).cast("bigint"))
        frame, at = part if frame is None else frame.unionByName(part), at + a.shape[axis]
    return Array(frame, [at if k == axis else n for k, n in enumerate(arrays[0].shape)], t)


concat = concatenate


def stack(arrays, axis=0, out=None):
    arrays = list(arrays)
    if any(a.shape != arrays[0].shape for a in arrays):
        raise ValueError("shapes differ")
    return concatenate([expand_dims(a, axis) for a in arrays], axis % (arrays[0].ndim + 1))


def vstack(arrays):
    return concatenate([expand_dims(a, 0) if a.ndim == 1 else a for a in arrays], 0)


row_stack = vstack


def hstack(arrays):
    arrays = list(arrays)
    return concatenate(arrays, 0 if arrays[0].ndim == 1 else 1)


def column_stack(arrays):
    return concatenate([expand_dims(a, 1) if a.ndim == 1 else a for a in arrays], 1)


def dstack(arrays):
    arrays = [a if a.ndim > 1 else expand_dims(a, 0) for a in arrays]
    return concatenate([expand_dims(a, 2) if a.ndim == 2 else a for a in arrays], 2)


def split(x, indices_or_sections, axis=0):
    axis = sanitize_axis(x.shape, axis)
    n = x.shape[axis]
    if isinstance(indices_or_sections, int):
        if n % indices_or_sections:
            raise ValueError("the axis doesn't split into equal parts")
        cuts = [k * (n // indices_or_sections) for k in range(1, indices_or_sections)]
    else:
        cuts = [min(max(int(c), 0), n) for c in np.asarray(indices_or_sections).tolist()]
    out = []
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        part = x.cells().where((I(axis) >= a) & (I(axis) < b)).withColumn(f"i{axis}", I(axis) - a)
        out.append(Array(part, [max(0, b - a) if k == axis else m for k, m in enumerate(x.shape)], x.dtype))
    return out


def vsplit(x, s):
    return split(x, s, 0)


def hsplit(x, s):
    return split(x, s, 0 if x.ndim == 1 else 1)


def dsplit(x, s):
    return split(x, s, 2)


def broadcast_arrays(*arrays):
    shape = broadcast_shapes(*[a.shape for a in arrays])
    return [broadcast_to(a, shape) for a in arrays]


def diag(a, offset=0):
    """A vector as a diagonal matrix; of a matrix its diagonal."""
    if a.ndim == 2:
        return diagonal(a, offset)
    n = a.shape[0] + abs(offset)
    cells = a.spark.range(n).withColumnRenamed("id", "i0").join(a.spark.range(n).withColumnRenamed("id", "i1"), F.lit(True), "cross")
    values = a.cells().select((I(0) + max(0, -offset)).alias("i0"), (I(0) + max(0, offset)).alias("i1"), "v")
    return Array(cells.join(values, ["i0", "i1"], "left").select("i0", "i1", F.coalesce("v", F.lit(0)).alias("v")), (n, n), a.dtype)


def diagonal(a, offset=0, dim1=0, dim2=1):
    i, j = sanitize_axis(a.shape, dim1), sanitize_axis(a.shape, dim2)
    if i == j:
        raise ValueError("the two axes must differ")
    rest = [k for k in range(a.ndim) if k not in (i, j)]
    n = max(0, min(a.shape[i] - max(0, -offset), a.shape[j] - max(0, offset)))
    cells = a.cells().where(I(j) - I(i) == offset)
    cols = [I(k).alias(f"i{m}") for m, k in enumerate(rest)] + [(I(i) - max(0, -offset)).alias(f"i{len(rest)}")]
    return Array(cells.select(*cols, "v"), [*(a.shape[k] for k in rest), n], a.dtype)


def _triangle(m, keep):
    return Array(m.cells(), m.shape, m.dtype, F.when(keep, F.col("v")).otherwise(F.lit(0).cast(ty.SPARK[m.dtype])))


def tril(m, k=0):
    return _triangle(m, I(m.ndim - 1) - I(m.ndim - 2) <= k)


def triu(m, k=0):
    return _triangle(m, I(m.ndim - 1) - I(m.ndim - 2) >= k)


def pad(a, pad_width, mode="constant", constant_values=0):
    if mode != "constant":
        raise NotImplementedError("only constant padding")
    w = np.broadcast_to(np.asarray(pad_width), (a.ndim, 2)) if np.ndim(pad_width) < 2 or len(pad_width) == 1 else np.asarray(pad_width)
    c = np.broadcast_to(np.asarray(constant_values), (a.ndim, 2))
    for k in range(a.ndim):
        parts = []
        for side in (0, 1):
            n = int(w[k][side])
            shape = [n if j == k else m for j, m in enumerate(a.shape)]
            from .factories import full

            parts.append(full(shape, c[k][side].item(), a.dtype) if n else None)
        a = concatenate([p for p in (parts[0], a, parts[1]) if p is not None], k)
    return a


def repeat(a, repeats, axis=None):
    if axis is None:
        a, axis = flatten(a), 0
    axis = sanitize_axis(a.shape, axis)
    if isinstance(repeats, int | np.integer) or np.size(repeats) == 1:
        r = int(np.asarray(repeats).ravel()[0])
        cells = a.cells().withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(r - 1)) if r else F.array().cast("array<int>")))
        return Array(cells.select(*[(c * r + F.col("_k")).cast("bigint").alias(n) if k == axis else c for k, (n, c) in enumerate((n, F.col(n)) for n in idx(a.ndim))], "v"), [m * r if k == axis else m for k, m in enumerate(a.shape)], a.dtype)
    counts = np.asarray(repeats.numpy() if isinstance(repeats, Array) else repeats)
    start = np.cumsum(counts) - counts
    rows = a.spark.createDataFrame([(k, int(s), int(n)) for k, (s, n) in enumerate(zip(start, counts, strict=True))], f"i{axis} bigint, _s bigint, _n bigint").where("_n > 0")
    cells = a.cells().join(rows, f"i{axis}").withColumn("_k", F.explode(F.expr("sequence(0L, _n - 1)"))).withColumn(f"i{axis}", F.col("_s") + F.col("_k"))
    return Array(cells.select(*idx(a.ndim), "v"), [int(counts.sum()) if k == axis else m for k, m in enumerate(a.shape)], a.dtype)


def tile(x, reps):
    reps = [reps] if isinstance(reps, int) else list(reps)
    while x.ndim < len(reps):
        x = expand_dims(x, 0)
    reps = [1] * (x.ndim - len(reps)) + reps
    cells = x.cells()
    for k, r in enumerate(reps):
        if r != 1:
            cells = cells.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(r - 1)) if r else F.array().cast("array<int>"))).withColumn(f"i{k}", I(k) + F.col("_k") * x.shape[k]).drop("_k")
    return Array(cells, [n * r for n, r in zip(x.shape, reps, strict=True)], x.dtype)


def unique(a, sorted=False, return_inverse=False, axis=None):  # noqa: A002
    """Distinct values (or slices along an axis), in order; with the place of each element among them."""
    if axis is not None:
        axis = sanitize_axis(a.shape, axis)
        others = [I(k) for k in range(a.ndim) if k != axis]
        rows = a.cells().groupBy(I(axis).alias("_i")).agg(F.array_sort(F.collect_list(F.struct(*others, "v"))).alias("_row"))
        rows = rows.withColumn("_row", F.col("_row.v"))
        ids = number_rows(rows.select("_row").distinct(), ["_row"], "_u")
        n = ids.count()
        rest = [m for k, m in enumerate(a.shape) if k != axis]
        cells = ids.select("_u", F.posexplode("_row").alias("_p", "v"))
        places = unravel(F.col("_p").cast("bigint"), rest)
        places.insert(axis, F.col("_u"))
        values = Array(cells.select(*[p.alias(f"i{k}") for k, p in enumerate(places)], "v"), [*a.shape[:axis], n, *a.shape[axis + 1 :]], a.dtype)
        inverse = Array(rows.join(ids, "_row").select(F.col("_i").alias("i0"), F.col("_u").alias("v")), (a.shape[axis],), "int64")
        return (values, inverse) if return_inverse else values
    ids = number_rows(a.cells().select("v").distinct(), ["v"], "_u")
    values = Array(ids.select(F.col("_u").alias("i0"), "v"), (ids.count(),), a.dtype)
    if not return_inverse:
        return values
    both = a.cells().join(ids, F.expr("v") == ids["v"]) if False else a.cells().withColumnRenamed("v", "_v").join(ids, F.col("_v").eqNullSafe(F.col("v")))
    return values, Array(both.select(*idx(a.ndim), F.col("_u").alias("v")), a.shape, "int64")


UniqueInverse = namedtuple("UniqueInverse", "values inverse_indices")
UniqueCounts = namedtuple("UniqueCounts", "values counts")
UniqueAll = namedtuple("UniqueAll", "values indices inverse_indices counts")


def unique_values(x):
    return unique(x)


def unique_inverse(x):
    return UniqueInverse(*unique(x, return_inverse=True))


def unique_all(x):
    ids = number_rows(x.cells().groupBy("v").agg(F.count("*").alias("_n"), F.min(linear(x.shape)).alias("_at")), ["v"], "i0")
    n = ids.count()
    values, inverse = unique(x, return_inverse=True)
    return UniqueAll(values, Array(ids, (n,), "int64", F.col("_at")), inverse, Array(ids, (n,), "int64", F.col("_n")))


def unique_counts(x):
    u = unique_all(x)
    return UniqueCounts(u.values, u.counts)


def unfold(a, axis, size, step=1):
    """Sliding windows of ``size`` every ``step`` places along an axis, in a new last axis.

    Each cell goes to the windows it lies in, by exploding: no ordering, so no axis has to fit one task.
    """
    axis = sanitize_axis(a.shape, axis)
    if size > a.shape[axis] or size < 1 or step < 1:
        raise ValueError("size or step doesn't fit the axis")
    n = (a.shape[axis] - size) // step + 1
    i = f"i{axis}"
    low = f"greatest(0L, cast(ceil(({i} - {size} + 1) / {step}) as bigint))"
    high = f"least({n - 1}L, cast(floor({i} / {step}) as bigint))"
    cells = a.cells().where(f"{low} <= {high}").withColumn("_w", F.explode(F.expr(f"sequence({low}, {high})")))
    cells = cells.withColumn(f"i{a.ndim}", I(axis) - F.col("_w") * step).withColumn(i, F.col("_w"))
    return Array(cells.select(*idx(a.ndim + 1), "v"), [*(n if k == axis else m for k, m in enumerate(a.shape)), size], a.dtype)


def shape(a):
    return a.shape


def resplit(a, axis=None):
    return a.resplit(axis)


def balance(a, copy=False):
    return a.balance(copy)


def redistribute(a, lshape_map=None, target_map=None):
    return a.redistribute(lshape_map, target_map)


def collect(a, target_rank=0):
    return a.collect(target_rank)


def take(x, indices, axis=None):
    if axis is None:
        return flatten(x)[np.asarray(indices)]
    axis = sanitize_axis(x.shape, axis)
    return x[tuple([slice(None)] * axis + [np.asarray(indices)])]


def vmap(func, out_dims=0, dtype="float64"):
    """A function of NumPy arrays, applied to Arrow batches of the rows of 2-D arrays (``row_id``, ``x``)."""
    from .linalg import from_rows, rows_of

    def call(x):
        r = rows_of(x)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    y = np.asarray(func(np.array(b.column("x").to_pylist(), dtype=np.float64)), dtype=np.float64)
                    yield pa.RecordBatch.from_pydict({"row_id": b.column("row_id"), "x": pa.array(y.reshape(len(y), -1).tolist(), pa.list_(pa.float64()))})

        out = r.mapInArrow(run, "row_id bigint, x array<double>")
        return from_rows(out, x.shape[0], len(out.first()["x"]))

    return call


for _f in (reshape, flatten, ravel, transpose, swapaxes, expand_dims, squeeze, flip, rot90, roll, unique, tril, triu, topk, sort, argsort, repeat, tile, unfold):
    setattr(Array, _f.__name__, _f)
