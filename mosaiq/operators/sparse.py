"""Sparse matrices: cells without zeros (i0, i1, v), row- or column-compressed only in how they are partitioned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..array import Array, array
from ..functions import types as ty


class Sparse:
    def __init__(self, frame, shape, dtype, orientation="row"):
        self.frame, self.shape, self.dtype, self.orientation = frame, tuple(shape), ty.canonical(dtype), orientation
        self.ndim, self.split = 2, 0 if orientation == "row" else 1

    gshape = property(lambda self: self.shape)

    @property
    def gnnz(self) -> int:
        return self.frame.count()

    nnz = lnnz = gnnz

    @property
    def data(self):
        return self._ordered("v")

    @property
    def indices(self):
        return self._ordered("i1" if self.orientation == "row" else "i0")

    @property
    def indptr(self):
        """Where each row (column) starts among the stored values, and their number."""
        import numpy as np

        key, n = ("i0", self.shape[0]) if self.orientation == "row" else ("i1", self.shape[1])
        counts = np.zeros(n, np.int64)
        for r in self.frame.groupBy(key).count().toLocalIterator():
            counts[r[key]] = r["count"]
        return np.concatenate([[0], np.cumsum(counts)])

    def _ordered(self, column):
        import numpy as np

        order = ("i0", "i1") if self.orientation == "row" else ("i1", "i0")
        return np.array([r[0] for r in self.frame.orderBy(*order).select(column).collect()])

    def astype(self, dtype):
        return Sparse(self.frame.withColumn("v", F.col("v").cast(ty.SPARK[ty.canonical(dtype)])), self.shape, dtype, self.orientation)

    def todense(self, order="C", out=None) -> Array:
        return to_dense(self)

    to_dense = todense
    __add__ = __radd__ = lambda self, other: add(self, other)
    __mul__ = __rmul__ = lambda self, other: mul(self, other)

    @property
    def T(self):
        return Sparse(self.frame.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v"), self.shape[::-1], self.dtype, "col" if self.orientation == "row" else "row")


def _sparse(obj, dtype=None, orientation="row") -> Sparse:
    if hasattr(obj, "tocoo"):
        obj = obj.toarray()
    a = obj if isinstance(obj, Array) else array(obj, dtype)
    if a.ndim != 2:
        raise ValueError("sparse matrices have two axes")
    a = a if dtype is None else a.astype(dtype)
    return Sparse(a.cells().where("v != 0"), a.shape, a.dtype, orientation)


def sparse_csr_matrix(obj, dtype=None, **_):
    return _sparse(obj, dtype, "row")


def sparse_csc_matrix(obj, dtype=None, **_):
    return _sparse(obj, dtype, "col")


to_sparse_csr, to_sparse_csc = sparse_csr_matrix, sparse_csc_matrix


def to_dense(m: Sparse, order="C", out=None) -> Array:
    from .factories import cells_of

    grid = cells_of(m.shape, F.lit(0), m.dtype).frame.drop("id")
    return Array(grid.join(m.frame, ["i0", "i1"], "left").select("i0", "i1", F.coalesce("v", F.lit(0)).alias("v")), m.shape, m.dtype)


def _both(a, b, how):
    if a.shape != b.shape:
        raise ValueError("shapes differ")
    return a.frame.join(b.frame.withColumnRenamed("v", "_w"), ["i0", "i1"], how)


def add(a, b, orientation="row"):
    """Sum of two matrices; a number is added to the stored values only."""
    a, b = (b, a) if not isinstance(a, Sparse) else (a, b)
    if not isinstance(b, Sparse):
        return Sparse(a.frame.withColumn("v", F.col("v") + b), a.shape, ty.result_type(a.dtype, b), orientation)
    v = F.coalesce("v", F.lit(0)) + F.coalesce("_w", F.lit(0))
    return Sparse(_both(a, b, "full").select("i0", "i1", v.alias("v")).where("v != 0"), a.shape, ty.promote_types(a.dtype, b.dtype), orientation)


def mul(a, b, orientation="row"):
    a, b = (b, a) if not isinstance(a, Sparse) else (a, b)
    if not isinstance(b, Sparse):
        return Sparse(a.frame.withColumn("v", F.col("v") * b), a.shape, ty.result_type(a.dtype, b), orientation)
    return Sparse(_both(a, b, "inner").select("i0", "i1", (F.col("v") * F.col("_w")).alias("v")), a.shape, ty.promote_types(a.dtype, b.dtype), orientation)


Array.to_sparse_csr, Array.to_sparse_csc = to_sparse_csr, to_sparse_csc
