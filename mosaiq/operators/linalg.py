"""Linear algebra. Products join blocks; factorisations of tall matrices reduce small factors by partition.

Tall matrices have any number of rows; their columns (and the sides of square matrices that are factorised) must fit
one task, at most LARGEST, and only factors of that size are gathered. Beyond it use rsvd, hsvd, lanczos or cg.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import Array, array, elementwise, idx, sanitize_axis
from ..functions import expr
from ..functions import types as ty
from .manipulations import diagonal, matrix_transpose, transpose, tril, triu  # noqa: F401  part of this family's names
from .reductions import norm, vector_norm  # noqa: F401

LARGEST = 8192
QR, SVD, Eigh, Polar, SlogDet = (namedtuple(n, f) for n, f in (("QR", "Q R"), ("SVD", "U S Vh"), ("Eigh", "eigenvalues eigenvectors"), ("Polar", "U H"), ("SlogDet", "sign logabsdet")))


def rows_of(a: Array) -> DataFrame:
    """A 2-D array as row_id, x: zeros where a cell is missing."""
    n = a.shape[1]
    g = a.cells().groupBy(F.col("i0").alias("row_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("i1").alias("j"), F.col("v").cast("double").alias("v")))).alias("c"))
    dense = F.col("c.v")
    sparse = F.transform(F.sequence(F.lit(0), F.lit(max(0, n - 1))), lambda j: F.coalesce(F.element_at(F.map_from_entries("c"), j.cast("bigint")), F.lit(0.0)))
    return g.select("row_id", F.when(F.size("c") == n, dense).otherwise(sparse).alias("x"))


def from_rows(rows: DataFrame, m: int, n: int, dtype: str = "float64") -> Array:
    cells = rows.select(F.col("row_id").alias("i0"), F.posexplode("x").alias("_j", "v")).select("i0", F.col("_j").cast("bigint").alias("i1"), "v")
    return Array(cells, (m, n), dtype)


def matrix(b: pa.RecordBatch, column: str = "x") -> np.ndarray:
    c = b.column(column)
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(np.float64) if len(c) else np.zeros((0, 0))


def reduced(rows: DataFrame, part, merge) -> np.ndarray | None:
    """part(matrix of a task's rows) gives a matrix; these are merged in pairs by a few tasks, then here."""

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if b.num_rows:
                x = part(b)
                out = x if out is None else merge(out, x)
        if out is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([out.shape[0]], pa.int32()), "v": pa.array([out.tobytes()], pa.binary())})

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for m, v in zip(b.column("m").to_pylist(), b.column("v").to_pylist(), strict=True):
                x = np.frombuffer(v).reshape(m, -1)
                out = x if out is None else merge(out, x)
        if out is not None:
            yield pa.RecordBatch.from_pydict({"m": pa.array([out.shape[0]], pa.int32()), "v": pa.array([out.tobytes()], pa.binary())})

    some = rows.mapInArrow(first, "m int, v binary").repartition(8).mapInArrow(again, "m int, v binary").collect()
    out = None
    for r in some:
        x = np.frombuffer(r.v).reshape(r.m, -1)
        out = x if out is None else merge(out, x)
    return out


def gram(rows: DataFrame) -> np.ndarray:
    """X^T X of the rows."""
    return reduced(rows, lambda b: matrix(b).T @ matrix(b), lambda x, y: x + y)


def _r_of(x: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(x, mode="r")
    s = np.sign(np.diag(r))
    return r * np.where(s == 0, 1, s)[:, None]


def small(a: Array) -> np.ndarray:
    if max(a.shape, default=0) > LARGEST:
        raise ValueError(f"a side of {a.shape} is over {LARGEST}")
    return a.numpy().astype(np.complex128 if ty.is_complex(a.dtype) else np.float64)


def times(rows: DataFrame, m: np.ndarray) -> DataFrame:
    """Rows times a small matrix on the right."""
    sent = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        for b in batches:
            if b.num_rows:
                y = matrix(b) @ sent.value
                yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))], ["row_id", "x"])

    return rows.select("row_id", "x").mapInArrow(run, "row_id bigint, x array<double>")


def dot(a, b, out=None):
    if a.ndim == 1 and b.ndim == 1:
        return vecdot(a, b)
    return matmul(a, b) if min(a.ndim, b.ndim) else elementwise(expr.mul, a, b, dtype=ty.promote_types(a.dtype, b.dtype))


def vecdot(x1, x2, axis=None, keepdims=None):
    p = elementwise(expr.mul, x1, x2, dtype=ty.promote_types(x1.dtype, x2.dtype))
    return p.reduce(F.sum, p.dtype, p.ndim - 1 if axis is None else axis, bool(keepdims))


def vdot(x1, x2):
    """Flat dot product, the first operand conjugated."""
    if ty.is_complex(x1.dtype) or ty.is_complex(x2.dtype):
        p = elementwise(lambda a, b: expr.cmul(expr.conjugate(a), b), x1.astype("complex128"), x2.astype("complex128"), dtype="complex128")
        g = p.frame.select(p.value.alias("z")).agg(F.struct(F.sum("z.re").alias("re"), F.sum("z.im").alias("im")).alias("v"))
        return Array(g, (), "complex128")
    return elementwise(expr.mul, x1, x2, dtype=ty.promote_types(x1.dtype, x2.dtype)).reduce(F.sum, "float64")


def outer(a, b, out=None, split=None):
    """All products of two vectors: the longer one's cells, each with the other vector's."""
    left = a.cells().select("i0", F.col("v").alias("_a"))
    right = b.cells().select(F.col("i0").alias("i1"), F.col("v").alias("_b"))
    return Array(left.crossJoin(right), (a.size, b.size), ty.promote_types(a.dtype, b.dtype), F.col("_a") * F.col("_b"))


def matmul(a, b, allow_resplit=False, block: int = 256):
    """Product over a's last and b's first (second to last) axis. Dense large matrices are multiplied in blocks."""
    if a.ndim == 1 and b.ndim == 1:
        return vecdot(a, b)
    if a.shape[-1] != b.shape[-2 if b.ndim > 1 else 0]:
        raise ValueError(f"shapes {a.shape} and {b.shape} don't match")
    t = ty.promote_types(a.dtype, b.dtype)
    if a.ndim == 2 and b.ndim == 2 and min(a.shape + b.shape) > 64 and not ty.is_complex(t):
        return _blocked(a, b, t, block)
    na, nb = a.ndim, b.ndim
    batch = max(na, nb) - 2 if max(na, nb) > 2 else 0
    left = a.cells().select(*[F.col(f"i{k}").alias(f"b{k + batch - (na - 2)}") for k in range(na - 2)], *([F.col(f"i{na - 2}").alias("_i")] if na > 1 else []), F.col(f"i{na - 1}").alias("_k"), F.col("v").alias("_a"))
    right = b.cells().select(*[F.col(f"i{k}").alias(f"b{k + batch - (nb - 2)}") for k in range(nb - 2)], F.col(f"i{max(0, nb - 2)}").alias("_k"), *([F.col(f"i{nb - 1}").alias("_j")] if nb > 1 else []), F.col("v").alias("_b"))
    shared = [f"b{k}" for k in range(batch) if f"b{k}" in left.columns and f"b{k}" in right.columns]
    keys = [f"b{k}" for k in range(batch)] + ["_i"] * (na > 1) + ["_j"] * (nb > 1)
    g = left.join(right, [*shared, "_k"])
    if ty.is_complex(t):
        p = expr.cmul(expr.complex_(F.col("_a.re"), F.col("_a.im")) if ty.is_complex(a.dtype) else expr.complex_(F.col("_a")), expr.complex_(F.col("_b.re"), F.col("_b.im")) if ty.is_complex(b.dtype) else expr.complex_(F.col("_b")))
        g = g.withColumn("_p", p).groupBy(*keys).agg(F.struct(F.sum("_p.re").alias("re"), F.sum("_p.im").alias("im")).alias("v"))
    else:
        g = g.groupBy(*keys).agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))
    shape = [n for k in range(batch) for n in [(a.shape if na - 2 >= batch - k else b.shape)[k - batch + (na if na - 2 >= batch - k else nb) - 2]]] + ([a.shape[-2]] if na > 1 else []) + ([b.shape[-1]] if nb > 1 else [])
    return Array(g.select(*[F.col(k).alias(f"i{j}") for j, k in enumerate(keys)], "v"), shape, t)


def _blocks(a: Array, block: int, names: tuple[str, str], data: str) -> DataFrame:
    cells = a.cells()
    i, j = (F.call_function("div", F.col(c), F.lit(block)) for c in ("i0", "i1"))
    at = (F.col("i0") % block * block + F.col("i1") % block).cast("int")
    return cells.groupBy(i.alias(names[0]), j.alias(names[1])).agg(F.collect_list(F.struct(at.alias("p"), F.col("v").cast("double").alias("v"))).alias(data))


def _blocked(a: Array, b: Array, t: str, block: int) -> Array:
    """Blocks (bi, bk) and (bk, bj) meet on bk; products are summed by (bi, bj), in each task first."""
    pairs = _blocks(a, block, ("bi", "bk"), "x").join(_blocks(b, block, ("bk", "bj"), "y"), "bk").select("bi", "bj", "x", "y")
    schema = "bi bigint, bj bigint, p int, v double"

    def dense(s) -> np.ndarray:
        out = np.zeros(block * block)
        v = s.values
        out[v.field("p").to_numpy()] = v.field("v").to_numpy()
        return out.reshape(block, block)

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}

        def flush():
            for (i, j), m in total.items():
                p = np.flatnonzero(m)
                yield pa.RecordBatch.from_pydict({"bi": np.full(len(p), i), "bj": np.full(len(p), j), "p": p.astype(np.int32), "v": m.ravel()[p]})
            total.clear()

        for b in batches:
            for r in range(b.num_rows):
                key = (b.column("bi")[r].as_py(), b.column("bj")[r].as_py())
                m = dense(b.column("x")[r]) @ dense(b.column("y")[r])
                total[key] = total[key] + m if key in total else m
                if len(total) > 64:
                    yield from flush()
        yield from flush()

    g = pairs.mapInArrow(run, schema).groupBy("bi", "bj", "p").agg(F.sum("v").alias("v"))
    cells = g.select((F.col("bi") * block + F.call_function("div", F.col("p"), F.lit(block))).alias("i0"), (F.col("bj") * block + F.col("p") % block).alias("i1"), "v")
    return Array(cells, (a.shape[0], b.shape[1]), t)


def projection(a, b):
    """a's projection onto b."""
    s = float(vecdot(a, b)) / float(vecdot(b, b))
    return b.apply(lambda v: v * s, ty.at_least_float(b.dtype))


def cross(a, b, axisa=-1, axisb=-1, axisc=-1, axis=-1):
    """Vector product along the last axis of 2 or 3 components."""
    n = a.ndim - 1
    pick = lambda x, k: Array(x.cells().where(F.col(f"i{n}") == k).select(*idx(n), "v"), x.shape[:-1], x.dtype)
    from .elementwise import mul, sub
    from .manipulations import stack

    if a.shape[-1] == 2 and b.shape[-1] == 2:
        return sub(mul(pick(a, 0), pick(b, 1)), mul(pick(a, 1), pick(b, 0)))
    return stack([sub(mul(pick(a, (k + 1) % 3), pick(b, (k + 2) % 3)), mul(pick(a, (k + 2) % 3), pick(b, (k + 1) % 3))) for k in range(3)], n)


def trace(a, offset=0, axis1=0, axis2=1, dtype=None, out=None):
    d = diagonal(a, offset, axis1, axis2)
    return d.reduce(lambda v: F.coalesce(F.sum(v), F.lit(0)), dtype or ("int64" if ty.is_exact(a.dtype) else a.dtype), d.ndim - 1)


def matrix_norm(x, axis=None, keepdims=False, ord=None):  # noqa: A002
    """Frobenius norm, or the largest (smallest) sum of absolute values of a column (1) or row (inf)."""
    i, j = sanitize_axis(x.shape, tuple(axis)) if axis is not None else (x.ndim - 2, x.ndim - 1)
    if ord in (None, "fro"):
        return x.reduce(lambda v: F.sqrt(F.sum(expr.square(v))), ty.at_least_float(x.dtype), (i, j), keepdims)
    if ord not in (1, -1, np.inf, -np.inf):
        raise NotImplementedError(f"no matrix norm {ord!r}")
    sums = x.reduce(lambda v: F.sum(F.abs(v)), ty.at_least_float(x.dtype), i if abs(ord) == 1 else j, True)
    return sums.reduce(F.max if ord > 0 else F.min, sums.dtype, (i, j), keepdims)


def _each(a: Array, f, shape, dtype="float64") -> Array:
    """A function of every matrix in the last two axes, each in one task."""
    nb = a.ndim - 2
    if max(a.shape[-2:], default=0) > LARGEST:
        raise ValueError(f"a side of {a.shape} is over {LARGEST}")
    m, n = a.shape[-2:]
    keys = idx(nb) or ["_one"]
    frame = a.cells() if nb else a.cells().withColumn("_one", F.lit(0).cast("bigint"))

    def run(table: pa.Table) -> pa.Table:
        x = np.zeros((m, n))
        x[table.column(f"i{nb}").to_numpy(), table.column(f"i{nb + 1}").to_numpy()] = table.column("v").to_numpy()
        y = np.asarray(f(x), dtype=np.float64)
        at = np.indices(y.shape).reshape(y.ndim, -1) if y.ndim else np.zeros((0, 1), np.int64)
        out = {k: np.full(y.size, table.column(k)[0].as_py(), np.int64) for k in keys}
        return pa.table(out | {f"o{k}": at[k].astype(np.int64) for k in range(y.ndim)} | {"v": y.ravel()})

    names = [f"o{k}" for k in range(len(shape))]
    done = frame.select(*keys, f"i{nb}", f"i{nb + 1}", F.col("v").cast("double").alias("v")).groupBy(*keys).applyInArrow(run, ", ".join([*(f"{k} bigint" for k in [*keys, *names]), "v double"]))
    return Array(done.select(*[F.col(k).alias(f"i{j}") for j, k in enumerate([*(idx(nb)), *names])], "v"), [*a.shape[:nb], *shape], dtype)


def det(a):
    return _each(a, np.linalg.det, ())


def inv(a):
    return _each(a, np.linalg.inv, a.shape[-2:])


def matrix_exp(a):
    """Scaling and squaring of a Taylor polynomial, matrix by matrix."""

    def f(x):
        s = max(0, int(np.ceil(np.log2(max(np.abs(x).sum(1).max(initial=0), 1e-30)))) + 1)
        y, term = np.eye(len(x)), np.eye(len(x))
        for k in range(1, 20):
            term = term @ (x / 2**s) / k
            y = y + term
        for _ in range(s):
            y = y @ y
        return y

    return _each(a, f, a.shape[-2:])


expm = matrix_exp


def qr(a, mode="reduced", procs_to_merge=2):
    """Q and R with a positive diagonal of R. Partitions' R factors are merged in pairs; Q is A times R's inverse,
    taken twice for orthogonality. Wide matrices factorise their first square part."""
    if mode not in ("reduced", "r"):
        raise ValueError("mode is reduced or r")
    m, n = a.shape
    if n > LARGEST:
        raise ValueError(f"{n} columns are over {LARGEST}")
    rows = rows_of(a)
    if m < n:
        q, r = np.linalg.qr(small(a))
        s = np.where(np.sign(np.diag(r)) == 0, 1, np.sign(np.diag(r)))
        return QR(None if mode == "r" else array(q * s), array(r * s[:, None]))
    stacked = lambda x, y: _r_of(np.vstack([x, y]))
    r1 = reduced(rows, lambda b: _r_of(matrix(b)), stacked)
    r1 = np.vstack([r1, np.zeros((max(0, n - len(r1)), n))])
    if mode == "r":
        return QR(None, array(r1))
    tiny = np.abs(np.diag(r1)) < 1e-13 * max(1e-300, np.abs(r1).max())
    if tiny.any():  # columns that depend on others
        q, r = np.linalg.qr(small(a))
        return QR(array(q), array(r))
    q = times(rows, np.linalg.inv(r1))
    r2 = reduced(q, lambda b: _r_of(matrix(b)), stacked)
    return QR(from_rows(times(q, np.linalg.inv(r2)), m, n), array(r2 @ r1))


def svd(a, full_matrices=False, compute_uv=True, **_):
    """Reduced SVD from R of the QR (of the transpose, if wide); vectors have their largest entry positive."""
    m, n = a.shape
    if m < n:
        if not compute_uv:
            return svd(matrix_transpose(a), compute_uv=False)
        u, s, vh = svd(matrix_transpose(a))
        return SVD(matrix_transpose(vh), s, matrix_transpose(u))
    r = reduced(rows_of(a), lambda b: _r_of(matrix(b)), lambda x, y: _r_of(np.vstack([x, y])))
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    if not compute_uv:
        return array(s)
    vt = vt * np.where(vt[np.arange(len(vt)), np.abs(vt).argmax(1)] < 0, -1, 1)[:, None]
    inverse = np.where(s > s.max(initial=0) * 1e-14, 1 / np.where(s == 0, 1, s), 0)
    u = from_rows(times(rows_of(a), vt.T * inverse), m, len(s))
    return SVD(u, array(s), array(vt))


def svdvals(a):
    return svd(a, compute_uv=False)


def _left(a: Array, m: np.ndarray) -> np.ndarray:
    """A^T M for a small-column M given by rows of A's order: sums of outer products by partition."""
    n = a.shape[1]
    sent = a.spark.sparkContext.broadcast(m)
    return reduced(rows_of(a), lambda b: matrix(b).T @ sent.value[b.column("row_id").to_numpy()], lambda x, y: x + y) if len(m) else np.zeros((n, m.shape[1]))


def rsvd(a, svd_rank, n_oversamples=10, power_iter=0, qr_procs_to_merge=2, seed=0):
    """Randomised SVD: a Gaussian sketch of the rows, power steps on the Gram product, then the small factor."""
    m, n = a.shape
    k = min(svd_rank + n_oversamples, m, n)
    rows = rows_of(a)
    z = np.random.default_rng(seed).normal(size=(n, k))
    for _ in range(power_iter + 1):  # A^T A z, each task its rows' part
        sent = a.spark.sparkContext.broadcast(np.linalg.qr(z)[0])
        z = reduced(rows, lambda b, s=sent: matrix(b).T @ (matrix(b) @ s.value), lambda x, y: x + y)
    v = np.linalg.qr(z)[0]
    small_ = svd(from_rows(times(rows, v), m, k))
    vt = small_.Vh.numpy() @ v.T
    r = min(svd_rank, k)
    return SVD(small_.U[:, :r], array(small_.S.numpy()[:r]), array(vt[:r]))


def _merge_svd(x: np.ndarray, y: np.ndarray, rank: int) -> np.ndarray:
    u, s, _ = np.linalg.svd(np.hstack([x, y]), full_matrices=False)
    return (u * s)[:, :rank]


def hsvd(a, maxrank=None, rtol=None, compute_sv=False, safetyshift=5, maxmergedim=None, no_of_merges=2, silent=True, warnings_off=True):
    """Hierarchical truncated SVD of columns: left factors of parts are merged and cut again and again.

    Parts are the tasks' rows of the transpose, so a's first axis must fit a task. Returns U, and with compute_sv
    also the singular values and V; then the estimate of the relative error.
    """
    m, n = a.shape
    rank = min(m, n, (maxrank or min(m, n)) + safetyshift)
    total = float(norm(a))
    f = reduced(rows_of(matrix_transpose(a)), lambda b: _merge_svd(matrix(b).T, np.zeros((m, 0)), rank), lambda x, y: _merge_svd(x, y, rank))
    u, s, _ = np.linalg.svd(f, full_matrices=False)
    keep = min(maxrank or len(s), len(s))
    if rtol is not None:
        tail = np.sqrt(np.maximum(total**2 - np.cumsum(s**2), 0)) / max(total, 1e-300)
        keep = min(keep, int(np.argmax(tail <= rtol)) + 1 if (tail <= rtol).any() else len(s))
    keep = max(1, min(keep, int((s > 1e-14 * s.max(initial=0)).sum()) or 1))
    error = float(np.sqrt(max(total**2 - (s[:keep] ** 2).sum(), 0)) / max(total, 1e-300))
    u = u[:, :keep] * np.where(u[np.abs(u[:, :keep]).argmax(0), np.arange(keep)] < 0, -1, 1)
    if not compute_sv:
        return array(u), error
    v = from_rows(times(rows_of(matrix_transpose(a)), u / s[:keep]), n, keep)
    return array(u), array(s[:keep]), v, error


def hsvd_rank(a, maxrank, compute_sv=False, **more):
    return hsvd(a, maxrank=maxrank, compute_sv=compute_sv)


def hsvd_rtol(a, rtol, compute_sv=False, maxrank=None, **more):
    return hsvd(a, maxrank=maxrank, rtol=rtol, compute_sv=compute_sv)


def isvd(new_data, u_old, s_old, vt_old=None, maxrank=None):
    """SVD of old and new columns from the old factors and the new data."""
    u, s = small(u_old), np.asarray(s_old.numpy() if isinstance(s_old, Array) else s_old, float)
    x = small(new_data)
    inside = u.T @ x
    q, r = np.linalg.qr(x - u @ inside)
    k = np.block([[np.diag(s), inside], [np.zeros((r.shape[0], len(s))), r]])
    u2, s2, vt2 = np.linalg.svd(k, full_matrices=False)
    keep = min(maxrank or len(s2), len(s2), int((s2 > 1e-14 * s2.max(initial=0)).sum()) or 1)
    un = np.hstack([u, q]) @ u2[:, :keep]
    if vt_old is None:
        return array(un), array(s2[:keep])
    v = small(vt_old)
    wide = np.block([[v, np.zeros((len(v), x.shape[1]))], [np.zeros((x.shape[1], v.shape[1])), np.eye(x.shape[1])]])
    return array(un), array(s2[:keep]), array(vt2[:keep] @ wide)


def eigh(a, r_max_zolopd=8, silent=True):
    """Eigenvalues of a symmetric matrix in descending order, and vectors with their largest entry positive."""
    w, v = np.linalg.eigh(small(a))
    w, v = w[::-1], v[:, ::-1]
    return Eigh(array(w), array(v * np.where(v[np.abs(v).argmax(0), np.arange(len(w))] < 0, -1, 1)))


def eigvalsh(a):
    return eigh(a).eigenvalues


def reigh(a, n_eigenvalues, n_oversamples=10, power_iter=0, qr_procs_to_merge=2, seed=0):
    """Randomised top eigenpairs of a symmetric matrix."""
    n = a.shape[0]
    k = min(n, n_eigenvalues + n_oversamples)
    rows, z = rows_of(a), np.random.default_rng(seed).normal(size=(n, k))
    apply = lambda y: reduced(rows, lambda b, s=a.spark.sparkContext.broadcast(y): matrix(b).T @ s.value[b.column("row_id").to_numpy()], lambda p, q: p + q)
    for _ in range(power_iter + 1):
        z = np.linalg.qr(apply(np.linalg.qr(z)[0]))[0]
    w, v = np.linalg.eigh(z.T @ apply(z))
    order = np.argsort(-w)[:n_eigenvalues]
    return Eigh(array(w[order]), array(z @ v[:, order]))


def polar(a, r=None, calcH=True, **_):  # noqa: N803
    """A = U H with orthonormal columns of U and symmetric positive H."""
    m, n = a.shape
    if m < n:
        raise ValueError("needs at least as many rows as columns")
    r_ = reduced(rows_of(a), lambda b: _r_of(matrix(b)), lambda x, y: _r_of(np.vstack([x, y])))
    _, s, vt = np.linalg.svd(r_, full_matrices=False)
    if s.min() <= s.max() * n * np.finfo(float).eps:
        raise ValueError("needs full column rank: the orthonormal factor isn't unique")
    u = from_rows(times(rows_of(a), vt.T @ np.diag(1 / s) @ vt), m, n)
    return Polar(u, array(vt.T @ np.diag(s) @ vt)) if calcH else u


def condest(a, p=None, algorithm="randomized", params=None):
    """Condition number in the 2-norm, from R."""
    s = svd(a, compute_uv=False).numpy()
    return float(s.max() / s.min())


def cond(a):
    return condest(a)


def matrix_rank(a, rtol=None):
    s = svd(a, compute_uv=False).numpy()
    return int((s > s.max(initial=0) * (rtol or max(a.shape) * np.finfo(float).eps)).sum())


def pinv(a, rtol=None):
    u, s, vh = svd(a)
    s_ = s.numpy()
    keep = s_ > s_.max(initial=0) * (rtol or max(a.shape) * np.finfo(float).eps)
    m = vh.numpy().T * np.where(keep, 1 / np.where(s_ == 0, 1, s_), 0)
    return matrix_transpose(from_rows(times(rows_of(u), m.T), a.shape[0], a.shape[1]))


def slogdet(a):
    return SlogDet(_each(a, lambda x: np.linalg.slogdet(x)[0], ()), _each(a, lambda x: np.linalg.slogdet(x)[1], ()))


def solve(a, b, out=None):
    """x with a x = b, for a square matrix that fits a task."""
    x, y = small(a), small(b)
    return array(np.linalg.solve(x, y))


def solve_triangular(a, b):
    """x with a x = b for an upper triangular matrix, by back substitution."""
    u, y = small(a), small(b)
    x = np.zeros_like(y)
    for k in range(len(u) - 1, -1, -1):
        x[k] = (y[k] - u[k, k + 1 :] @ x[k + 1 :]) / u[k, k]
    return array(x)


def cholesky(a, upper=False):
    return _each(a, lambda x: np.linalg.cholesky(x).T if upper else np.linalg.cholesky(x), a.shape[-2:])


def _times_vector(a: Array, rows: DataFrame, v: np.ndarray) -> np.ndarray:
    sent = a.spark.sparkContext.broadcast(v)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict({"row_id": b.column("row_id"), "y": matrix(b) @ sent.value})

    out = np.zeros(a.shape[0])
    for r in rows.mapInArrow(run, "row_id bigint, y double").collect():
        out[r.row_id] = r.y
    return out


def cg(a, b, x0=None, out=None, tol=1e-10):
    """Conjugate gradients: vectors of one side here, products with the rows of A in tasks."""
    rows = rows_of(a).cache()
    y = small(b).ravel()
    x = np.zeros_like(y) if x0 is None else small(x0).ravel()
    r = y - _times_vector(a, rows, x)
    p, rs = r.copy(), r @ r
    for _ in range(len(y)):
        if np.sqrt(rs) < tol:
            break
        ap = _times_vector(a, rows, p)
        alpha = rs / (p @ ap)
        x, r = x + alpha * p, r - alpha * ap
        new = r @ r
        p, rs = r + new / rs * p, new
    rows.unpersist()
    return array(x)


def krylov(times, n: int, m: int, v=None, seed=0) -> tuple[np.ndarray, np.ndarray]:
    """V and tridiagonal T, here, after m Krylov steps of times(v), orthogonalised against all vectors each time."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n) if v is None else v
    vs, t = np.empty((m, n)), np.zeros((m, m))
    vs[0] = v / np.linalg.norm(v)
    for k in range(m):
        w = times(vs[k])
        t[k, k] = w @ vs[k]
        q = vs[: k + 1]
        for _ in range(2):
            w = w - q.T @ (q @ w)
        beta = np.linalg.norm(w)
        if k + 1 < m:
            if beta < 1e-12:  # an invariant subspace: go on with a new direction
                w = rng.normal(size=n)
                w = w - q.T @ (q @ w)
                vs[k + 1] = w / np.linalg.norm(w)
            else:
                t[k, k + 1] = t[k + 1, k] = beta
                vs[k + 1] = w / beta
    return vs.T, t


def lanczos(a, m, v0=None, V_out=None, T_out=None, seed=0):  # noqa: N803
    """V and tridiagonal T after m Krylov steps, orthogonalised against all vectors each time."""
    rows = rows_of(a).cache()
    v, t = krylov(lambda x: _times_vector(a, rows, x), a.shape[0], m, None if v0 is None else small(v0).ravel(), seed)
    rows.unpersist()
    return array(v), array(t)


def tensordot(a, b, axes=2):
    """Sum of products over pairs of axes."""
    from .manipulations import reshape, transpose

    if isinstance(axes, int):
        ax, bx = list(range(a.ndim - axes, a.ndim)), list(range(axes))
    else:
        ax, bx = ([x] if isinstance(x, int) else list(x) for x in axes)
    ax, bx = [x % a.ndim for x in ax], [x % b.ndim for x in bx]
    ra, rb = [k for k in range(a.ndim) if k not in ax], [k for k in range(b.ndim) if k not in bx]
    n = int(np.prod([a.shape[k] for k in ax], dtype=int))
    x = reshape(transpose(a, ra + ax), (-1, n)) if ra else reshape(transpose(a, ax), (1, n))
    y = reshape(transpose(b, bx + rb), (n, -1)) if rb else reshape(transpose(b, bx), (n, 1))
    return reshape(matmul(x, y), tuple([a.shape[k] for k in ra] + [b.shape[k] for k in rb]))


Array.__matmul__ = matmul
Array.trace, Array.T = trace, property(lambda a: transpose(a))
