"""The array: cells (i0, ..., v) of a DataFrame with a shape and an element type, lazily combined.

An array holds a frame, a column expression over it for the values, and names of its index columns. Arrays made
from one frame combine by expression alone; others are joined on their indices. Nothing is computed before an
action (numpy(), item(), write). Order lives in the indices, never in partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import storage
from .functions import agg, expr
from .functions import types as ty


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def idx(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def sanitize_axis(shape: Sequence[int], axis) -> int | tuple[int, ...] | None:
    """Axes counted from the front; ValueError outside the shape."""
    if axis is None:
        return None
    if isinstance(axis, tuple | list):
        out = tuple(sanitize_axis(shape, a) for a in axis)
        if len(set(out)) < len(out):
            raise ValueError("an axis is given twice")
        return out
    if not isinstance(axis, int | np.integer):
        raise TypeError("axis must be None, an integer or a tuple of integers")
    if not -max(1, len(shape)) <= axis < max(1, len(shape)):
        raise ValueError(f"axis {axis} is out of bounds for shape {tuple(shape)}")
    return int(axis) % max(1, len(shape))


def sanitize_shape(shape) -> tuple[int, ...]:
    shape = (shape,) if isinstance(shape, int | np.integer) else tuple(shape)
    if any(not isinstance(n, int | np.integer) for n in shape):
        raise TypeError("a shape holds integers")
    if any(n < 0 for n in shape):
        raise ValueError("a shape holds no negative numbers")
    return tuple(int(n) for n in shape)


def broadcast_shapes(*shapes: Sequence[int]) -> tuple[int, ...]:
    return tuple(int(n) for n in np.broadcast_shapes(*map(tuple, shapes)))


def prod(xs) -> int:
    return math.prod(int(x) for x in xs)


def strides_of(shape: Sequence[int]) -> list[int]:
    return [prod(shape[k + 1 :]) for k in range(len(shape))]


def linear(shape: Sequence[int], names: Sequence[str] | None = None) -> Column:
    out = F.lit(0).cast("bigint")
    for name, s in zip(names or idx(len(shape)), strides_of(shape), strict=True):
        out = out + F.col(name) * s
    return out


def unravel(at: Column, shape: Sequence[int]) -> list[Column]:
    return [(F.call_function("div", at, F.lit(max(1, s))) % max(1, n)).cast("bigint") for s, n in zip(strides_of(shape), shape, strict=True)]


class Array:
    __array_priority__ = 100

    def __init__(self, frame: DataFrame, shape: Sequence[int], dtype: str, value: Column | None = None, split: int | None = 0):
        self.frame, self.shape, self.dtype, self.split = frame, tuple(int(n) for n in shape), ty.canonical(dtype), split
        self.value = F.col("v") if value is None else value

    # metadata

    @property
    def gshape(self):
        return self.shape

    @property
    def ndim(self):
        return len(self.shape)

    @property
    def size(self):
        return prod(self.shape)

    gnumel = lnumel = size

    @property
    def itemsize(self):
        return ty.numpy_type(self.dtype).itemsize

    @property
    def nbytes(self):
        return self.size * self.itemsize

    gnbytes = lnbytes = nbytes

    @property
    def stride(self):
        return tuple(strides_of(self.shape))

    @property
    def strides(self):
        return tuple(s * self.itemsize for s in self.stride)

    @property
    def spark(self):
        return self.frame.sparkSession

    comm = spark
    device = "cpu"

    def cells(self) -> DataFrame:
        """The frame (i0, ..., v) with values of the element type."""
        return self.frame.select(*idx(self.ndim), self.value.cast(ty.SPARK[self.dtype]).alias("v"))

    def with_value(self, value: Column, dtype) -> Array:
        return Array(self.frame, self.shape, dtype, value, self.split)

    def __len__(self):
        if not self.shape:
            raise TypeError("a 0-d array has no length")
        return self.shape[0]

    def __repr__(self):
        if self.size <= 1000:
            return f"Array({np.array2string(self.numpy(), separator=', ')}, dtype={self.dtype}, split={self.split})"
        return f"Array(shape={self.shape}, dtype={self.dtype}, split={self.split})"

    # leaving Spark

    def numpy(self) -> np.ndarray:
        """All values on the driver: for results that fit there."""
        rows = self.cells().toPandas()
        out = np.zeros(self.shape, ty.numpy_type(self.dtype))
        v = rows["v"].to_numpy() if not ty.is_complex(self.dtype) else np.array([complex(r["re"], r["im"]) for r in rows["v"]])
        if self.ndim:
            out[tuple(rows[n].to_numpy(np.int64) for n in idx(self.ndim))] = v
        elif len(v):
            out[()] = v[0]
        return out

    def __array__(self, dtype=None, copy=None):
        return self.numpy() if dtype is None else self.numpy().astype(dtype)

    def __array_namespace__(self, *, api_version=None):
        if api_version not in (None, "2025.12"):
            raise ValueError(f"no version {api_version} of the array API")
        from . import array_api

        return array_api

    def tolist(self):
        return self.numpy().tolist()

    def item(self):
        if self.size != 1:
            raise ValueError("only arrays of one element have an item")
        v = self.cells().first()["v"]
        return complex(v.re, v.im) if ty.is_complex(self.dtype) else v

    def __bool__(self):
        return bool(self.item())

    def __int__(self):
        return int(self.item())

    __index__ = __int__

    def __float__(self):
        return float(self.item())

    def __complex__(self):
        return complex(self.item())

    # partitions are Spark's affair; these describe them or hint at them

    @property
    def lshape_map(self):
        return [(r[0], r[1]) for r in self.frame.groupBy(F.spark_partition_id()).count().orderBy(F.spark_partition_id()).collect()]

    def counts_displs(self):
        n = [x[1] for x in self.lshape_map]
        return tuple(n), tuple(int(x) for x in np.cumsum([0, *n])[:-1])

    def is_distributed(self):
        return self.split is not None

    def is_balanced(self, force_check=False):
        n = [x[1] for x in self.lshape_map]
        return not n or max(n) - min(n) <= max(1, len(n))

    def resplit(self, axis=None) -> Array:
        """Range-partitioned by an axis; None leaves the layout to Spark."""
        axis = sanitize_axis(self.shape, axis)
        frame = self.cells() if axis is None else self.cells().repartitionByRange(f"i{axis}")
        return Array(frame, self.shape, self.dtype, split=axis)

    resplit_ = resplit

    def balance(self, copy=False) -> Array:
        return Array(self.cells().hint("rebalance"), self.shape, self.dtype, split=self.split)

    balance_ = balance

    def redistribute(self, lshape_map=None, target_map=None) -> Array:
        """Rows of axis 0 in contiguous parts of the given lengths."""
        if target_map is None:
            return self.balance()
        edges = np.cumsum(np.asarray(target_map).reshape(len(target_map), -1)[:, 0]).tolist()
        part = F.coalesce(*[F.when(F.col("i0") < e, F.lit(k)) for k, e in enumerate(edges)], F.lit(len(edges) - 1))
        return Array(self.cells().repartition(len(edges), part), self.shape, self.dtype, split=0)

    redistribute_ = redistribute

    def collect(self, target_rank=0) -> Array:
        return Array(self.cells().coalesce(1), self.shape, self.dtype, split=None)

    collect_ = collect

    def copy(self) -> Array:
        return Array(self.frame, self.shape, self.dtype, self.value, self.split)

    cpu = copy

    def get_halo(self, halo_size: int, prev=True, next=True) -> DataFrame:  # noqa: A002
        """Each cell with the values up to halo_size places before and after along axis 0, as arrays."""
        w = Window.partitionBy(*idx(self.ndim)[1:]).orderBy("i0")
        out = self.cells()
        out = out.withColumn("prev", F.collect_list("v").over(w.rowsBetween(-halo_size, -1))) if prev else out
        return out.withColumn("next", F.collect_list("v").over(w.rowsBetween(1, halo_size))) if next else out

    # element-wise

    def astype(self, dtype, copy=True) -> Array:
        new = ty.canonical(dtype)
        if ty.is_complex(new) and not ty.is_complex(self.dtype):
            return self.with_value(expr.complex_(self.value).cast(ty.SPARK[new]), new)
        if ty.is_complex(self.dtype) and not ty.is_complex(new):
            return self.with_value(self.value.re.cast(ty.SPARK[new]), new)
        if ty.is_exact(new) and new != "bool" and not ty.is_exact(self.dtype):
            return self.with_value(F.when(expr.isfinite(self.value), expr.trunc(self.value)).cast(ty.SPARK[new]), new)
        return self.with_value(self.value.cast(ty.SPARK[new]) if new != "bool" else self.value.cast("double") != 0, new)

    def apply(self, f: Callable[[Column], Column], dtype=None) -> Array:
        return self.with_value(f(self.value), dtype or self.dtype)

    @property
    def real(self):
        return self.apply(lambda v: v.re, "float64" if self.dtype == "complex128" else "float32") if ty.is_complex(self.dtype) else self

    @property
    def imag(self):
        return self.apply(lambda v: v.im, "float64" if self.dtype == "complex128" else "float32") if ty.is_complex(self.dtype) else self.apply(lambda v: F.lit(0), self.dtype)

    @property
    def T(self):
        return self.transpose()

    mT = T

    # reductions

    def reduce(self, f: Callable[[Column], Column], dtype, axis=None, keepdims=False) -> Array:
        """An aggregate over axes: a groupBy of the other index columns."""
        axis = sanitize_axis(self.shape, axis)
        axes = tuple(range(self.ndim)) if axis is None else (axis,) if isinstance(axis, int) else axis
        rest = [k for k in range(self.ndim) if k not in axes]
        out = self.cells().groupBy(*[f"i{k}" for k in rest]).agg(f(F.col("v")).alias("v"))
        if keepdims:
            names = [F.col(f"i{k}") if k in rest else F.lit(0).cast("bigint").alias(f"i{k}") for k in range(self.ndim)]
            return Array(out.select(*names, "v"), [self.shape[k] if k in rest else 1 for k in range(self.ndim)], dtype)
        names = [F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(rest)]
        return Array(out.select(*names, "v"), [self.shape[k] for k in rest], dtype)

    # indexing

    def __getitem__(self, key) -> Array:
        if isinstance(key, Array) and key.dtype == "bool" and key.shape == self.shape:
            return masked(self, key)
        key = key if isinstance(key, tuple) else (key,)
        given = sum(k is not None and k is not Ellipsis for k in key)
        if Ellipsis not in [k for k in key if not isinstance(k, Array | np.ndarray)]:
            key = (*key, Ellipsis)
        at = next(i for i, k in enumerate(key) if k is Ellipsis)
        key = (*key[:at], *([slice(None)] * (self.ndim - given)), *key[at + 1 :])
        frame, cols, shape, axis, lists = self.cells(), [], [], 0, []
        for k in key:
            if k is None:
                cols.append(F.lit(0).cast("bigint"))
                shape.append(1)
                continue
            name, n = f"i{axis}", self.shape[axis]
            if isinstance(k, int | np.integer):
                if not -n <= k < n:
                    raise IndexError(f"index {k} is out of bounds for axis {axis} with size {n}")
                frame = frame.where(F.col(name) == int(k) % n)
            elif isinstance(k, slice):
                a, b, s = k.indices(n)
                m = len(range(a, b, s))
                low, high = (a, a + (m - 1) * s) if s > 0 else (a + (m - 1) * s, a)
                frame = frame.where(F.col(name).between(low, high) if m else F.lit(False))
                if abs(s) > 1:
                    frame = frame.where((F.col(name) - a) % abs(s) == 0)
                cols.append(F.call_function("div", F.col(name) - a, F.lit(s)))
                shape.append(m)
            else:
                lists.append((axis, len(cols), np.asarray(k.numpy() if isinstance(k, Array) else k)))
                cols.append(None)
            axis += 1
        if lists:
            flat = np.broadcast_arrays(*[np.flatnonzero(x) if x.dtype == bool else x for _, _, x in lists])
            rows = [tuple(int(f.ravel()[p]) % self.shape[ax] for (ax, _, _), f in zip(lists, flat, strict=True)) + (p,) for p in range(flat[0].size)]
            names = [f"i{ax}" for ax, _, _ in lists]
            places = self.spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in [*names, "_p"]))
            frame = frame.join(places, names)
            first = lists[0][1]
            cols[first] = unravel(F.col("_p"), flat[0].shape)
            cols = [x for c in cols if c is not None for x in (c if isinstance(c, list) else [c])]
            shape[first:first] = flat[0].shape
        out = frame.select(*[c.cast("bigint").alias(f"i{j}") for j, c in enumerate(cols)], "v")
        return Array(out, shape, self.dtype)

    def set(self, key, value) -> Array:
        """A new array with a selection assigned: a left join of the new cells."""
        if isinstance(key, Array) and key.dtype == "bool":
            return elementwise(lambda m, a, b: F.when(m, a).otherwise(b), key, lift(value, self), self, dtype=self.dtype)
        if isinstance(key, int | slice | np.integer) or isinstance(key, tuple) and all(isinstance(k, int | slice | np.integer) for k in key):
            positions = [k for k in (key if isinstance(key, tuple) else (key,))]
            positions += [slice(None)] * (self.ndim - len(positions))
            test, new, names = F.lit(True), [], []
            for ax, k in enumerate(positions):
                n = self.shape[ax]
                a, b, s = k.indices(n) if isinstance(k, slice) else (int(k) % n, int(k) % n + 1, 1)
                m = len(range(a, b, s))
                low, high = sorted((a, a + (m - 1) * s))
                test = test & (F.col(f"i{ax}").between(low, high) & ((F.col(f"i{ax}") - a) % abs(s) == 0) if m else F.lit(False))
                if isinstance(k, slice):
                    new.append(m)
                    names.append((f"i{ax}", a, s))
            if not isinstance(value, Array | np.ndarray | list):
                return Array(self.cells(), self.shape, self.dtype, F.when(test, F.lit(value)).otherwise(F.col("v")))
            value = broadcast_to(value if isinstance(value, Array) else array(value), new)
            other = value.cells().select(*[(F.col(f"i{j}") * s + a).alias(n) for j, (n, a, s) in enumerate(names)], F.struct("v").alias("_new"))
            fixed = [(f"i{ax}", int(k) % self.shape[ax]) for ax, k in enumerate(positions) if not isinstance(k, slice)]
            for n, k in fixed:
                other = other.withColumn(n, F.lit(k).cast("bigint"))
            joined = self.cells().join(other, idx(self.ndim), "left")
            return Array(joined, self.shape, self.dtype, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col("v")))
        raise TypeError("assignment needs integers, slices or a mask")

    def fill_diagonal(self, value) -> Array:
        return Array(self.cells(), self.shape, self.dtype, F.when(F.col("i0") == F.col("i1"), F.lit(value)).otherwise(F.col("v")))


def array(obj, dtype=None, copy=None, ndmin: int = 0, order="C", split: int | None = 0, is_split=None) -> Array:
    """From nested lists, NumPy arrays, scalars or arrays; small data, sent from the driver."""
    if split not in (0, None) and is_split is not None:
        raise ValueError("split and is_split exclude each other")
    if isinstance(obj, Array):
        return obj if dtype is None else obj.astype(dtype)
    x = np.asarray(obj)
    if dtype is None and not isinstance(obj, np.ndarray):
        x = x.astype({"f": "float32", "i": "int64", "c": "complex64"}.get(x.dtype.kind, x.dtype))
        x = x.astype("int32") if x.dtype.kind == "i" and (not x.size or np.abs(x).max() < 2**31) else x
    x = x.reshape((1,) * (ndmin - x.ndim) + x.shape)
    name = ty.canonical(dtype if dtype is not None else x.dtype)
    x = x.astype(ty.numpy_type(name))
    spark = session()
    at = np.indices(x.shape).reshape(x.ndim, -1)
    value = [(float(v.real), float(v.imag)) for v in x.ravel()] if ty.is_complex(name) else x.ravel().tolist()
    schema = ", ".join([*(f"{n} bigint" for n in idx(x.ndim)), f"v {ty.SPARK[name]}"])
    rows = [(*map(int, at[:, k]), v) for k, v in enumerate(value)]
    return Array(spark.createDataFrame(rows, schema), x.shape, name, split=split)


asarray = array


def from_frame(df: DataFrame, value: str | Column, index: Sequence[str] | None = None, shape: Sequence[int] | None = None, dtype=None) -> Array:
    """An array over a frame's column. Index columns are the given ones (0-based); without any, rows are numbered in order of
    all their columns (a distributed numbering, see number_rows)."""
    value = F.col(value) if isinstance(value, str) else value
    if index is None:
        df = number_rows(df.withColumn("_v", value), df.columns)
        frame = df.select(F.col("row_id").alias("i0"), F.col("_v").alias("v"))
        index = ["i0"]
    else:
        frame = df.select(*[F.col(n).cast("bigint").alias(f"i{k}") for k, n in enumerate(index)], value.alias("v"))
    if shape is None:
        r = frame.agg(*[F.max(f"i{k}") for k in range(len(index))]).first()
        shape = [0 if x is None else x + 1 for x in r]
    return Array(frame, shape, dtype or frame.schema["v"].dataType)


def ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows in ranges of the order, numbered by ``_part``, as a table in the shared folder.

    Which range a row falls in is decided once: bounds that were sampled again, for another branch of the plan or
    after a lost executor, would be others.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return storage.written(parts, "ranges")


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """Dense 0-based row numbers in an order, without one partition for all rows.

    Rows are range-partitioned by the order and written, numbered inside their range, and offset by the number of
    rows in the ranges before; only one count for each range is gathered. Rows that the order leaves equal are numbered
    in any order.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = ranged(df, order)
    inside = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    total = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = total.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")  # one row a range


def scan(df: DataFrame, order: Sequence[str], value: Column, name: str = "scan", product: bool = False) -> DataFrame:
    """Running sum (or product) over all rows in an order: partial scans by written range, offset by totals before."""
    f = F.product if product else F.sum
    parts = ranged(df.withColumn("_v", value), order)
    inside = parts.withColumn("_s", f("_v").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    total = parts.groupBy("_part").agg(f("_v").alias("_t"))
    before = total.select("_part", f("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    start = F.coalesce("_before", F.lit(1.0 if product else 0))
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col("_s") * start if product else F.col("_s") + start).drop("_v", "_part", "_s", "_before")  # one row a range


def lift(x, like: Array) -> Array:
    return x if isinstance(x, Array) else Array(like.frame, like.shape, ty.canonical(type(x)) if isinstance(x, bool | int | float | complex) else ty.canonical(np.asarray(x).dtype), F.lit(x) if not isinstance(x, complex) else expr.complex_(F.lit(x.real), F.lit(x.imag))) if np.ndim(x) == 0 else array(x)


def elementwise(f: Callable[..., Column], *operands, dtype, where: Array | bool = True) -> Array:
    """Operands of one frame combine by expression; others are broadcast and joined on their indices."""
    like = next(x for x in operands if isinstance(x, Array))
    arrays = [lift(x, like) for x in operands]
    shape = broadcast_shapes(*[a.shape for a in arrays])
    if all(a.frame is arrays[0].frame and a.shape == shape for a in arrays):
        out = Array(arrays[0].frame, shape, dtype, f(*[a.value for a in arrays]), like.split)
    else:
        frame = None
        for k, a in enumerate(arrays):
            cells = broadcast_to(a, shape).cells().withColumnRenamed("v", f"_v{k}")
            frame = cells if frame is None else frame.join(cells, idx(len(shape))) if shape else frame.crossJoin(cells)
        out = Array(frame, shape, dtype, f(*[F.col(f"_v{k}") for k in range(len(arrays))]), like.split)
    if where is not True:
        return elementwise(lambda m, a, b: F.when(m, a).otherwise(b), lift(where, out), out, arrays[0], dtype=dtype)
    return out


def broadcast_to(a: Array, shape) -> Array:
    """Length-1 and missing axes are repeated by exploding a sequence: no shuffle."""
    shape = sanitize_shape(shape)
    if broadcast_shapes(a.shape, shape) != shape:
        raise ValueError(f"{a.shape} can't be broadcast to {shape}")
    if a.shape == shape:
        return a
    new = len(shape) - a.ndim
    cols, frame = [], a.cells()
    for k, n in enumerate(shape):
        if k < new or a.shape[k - new] == 1 and n != 1:
            frame = frame.withColumn(f"_b{k}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")) if n else F.array().cast("array<bigint>")))
            cols.append(F.col(f"_b{k}").alias(f"i{k}"))
        else:
            cols.append(F.col(f"i{k - new}").alias(f"i{k}"))
    return Array(frame.select(*cols, "v"), shape, a.dtype)


def masked(a: Array, mask: Array) -> Array:
    """Values where a mask is true, in row-major order."""
    both = elementwise(lambda m, v: F.struct(m.alias("m"), v.alias("v")), mask, a, dtype=a.dtype)
    rows = both.frame.select(linear(a.shape).alias("_at"), both.value.alias("s")).where("s.m").select("_at", F.col("s.v").alias("v"))
    out = number_rows(rows, ["_at"], "i0").select("i0", "v")
    return Array(out, (out.count(),), a.dtype)
