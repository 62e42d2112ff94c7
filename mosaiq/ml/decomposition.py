"""PCA (at once or in batches) and dynamic mode decomposition (with control)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..array import Array
from ..operators.linalg import gram, rows_of, small, times
from .base import BaseEstimator, RegressionMixin, TransformMixin, by_feature, literal, vectors

#: Bytes of the sums of chunks that are gathered at a time.
CHUNK_BYTES = 1 << 26


def signed(v: np.ndarray) -> np.ndarray:
    """Rows with their largest entry positive."""
    return v * np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1, 1)[:, None]


def wanted(s: np.ndarray, rank) -> int:
    if rank is None:
        return len(s)
    if isinstance(rank, float) and rank < 1:
        share = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
        return int(np.searchsorted(share, rank)) + 1
    return min(int(rank), len(s))


class _Projection(BaseEstimator, TransformMixin):
    def transform(self, x):
        rows = vectors(x).select("row_id", F.zip_with("x", literal(self.mean_), lambda v, m: v - m).alias("x"))
        m = self.components_.T
        if self.whiten:
            m = m / np.sqrt(np.maximum(self.explained_variance_, 1e-300))
        return times(rows, m)

    def inverse_transform(self, y):
        m = self.components_
        if self.whiten:
            m = m * np.sqrt(self.explained_variance_)[:, None]
        return times(vectors(y), m).select("row_id", F.zip_with("x", literal(self.mean_), lambda v, a: v + a).alias("x"))


class PCA(_Projection):
    """From the covariance matrix, which one pass sums by partition (features must fit a task; rows may be any number)."""

    def __init__(self, n_components=None, copy=True, whiten=False, svd_solver="hierarchical", tol=None, iterated_power=0, n_oversamples=10, power_iteration_normalizer="qr", random_state=None):
        if svd_solver not in ("full", "hierarchical", "randomized"):
            raise ValueError("svd_solver is full, hierarchical or randomized")
        self.n_components, self.copy, self.whiten, self.svd_solver, self.tol, self.iterated_power, self.n_oversamples, self.power_iteration_normalizer, self.random_state = n_components, copy, whiten, svd_solver, tol, iterated_power, n_oversamples, power_iteration_normalizer, random_state

    def fit(self, x, y=None):
        rows = vectors(x)
        t = by_feature(rows, F.avg("v").alias("m"), F.count("*").alias("n")).toPandas().sort_values("j")
        self.mean_, self.n_samples_ = t["m"].to_numpy(float), int(t["n"].iloc[0])
        g = gram(rows.select("row_id", F.zip_with("x", literal(self.mean_), lambda v, m: v - m).alias("x")))
        w, v = np.linalg.eigh(g)
        s = np.sqrt(np.maximum(w[::-1], 0))
        k = min(wanted(s, self.n_components), self.n_samples_)
        self.components_, self.singular_values_ = signed(v[:, ::-1].T[:k]), s[:k]
        self.explained_variance_ = s[:k] ** 2 / max(1, self.n_samples_ - 1)
        self.explained_variance_ratio_ = s[:k] ** 2 / max((s**2).sum(), 1e-300)
        self.total_explained_variance_ratio_ = float(self.explained_variance_ratio_.sum())
        self.noise_variance_ = float((s[k:] ** 2).mean() / max(1, self.n_samples_ - 1)) if k < len(s) else 0.0
        self.n_components_ = k
        return self


class IncrementalPCA(_Projection):
    """PCA over batches: of the rows seen so far it keeps their number, mean and leading singular vectors."""

    def __init__(self, n_components=None, copy=True, whiten=False, batch_size=None):
        self.n_components, self.copy, self.whiten, self.batch_size = n_components, copy, whiten, batch_size
        self.n_samples_seen_ = 0

    def partial_fit(self, x, y=None):
        rows = vectors(x)
        t = by_feature(rows, F.avg("v").alias("m"), F.count("*").alias("n")).toPandas().sort_values("j")
        mean, n = t["m"].to_numpy(float), int(t["n"].iloc[0])
        return self._add(n, mean, gram(rows.select("row_id", F.zip_with("x", literal(mean), lambda v, m: v - m).alias("x"))))

    def _add(self, n: int, mean: np.ndarray, g: np.ndarray):
        """A batch by its number of rows, its mean and its products of centred features."""
        if self.n_samples_seen_:
            old = (self.components_ * self.singular_values_[:, None]).T
            d, total = mean - self.mean_, n + self.n_samples_seen_
            g = g + old @ old.T + np.outer(d, d) * (n * self.n_samples_seen_ / total)
            mean = self.mean_ + d * (n / total)
        self.mean_, self.n_samples_seen_ = mean, self.n_samples_seen_ + n
        w, v = np.linalg.eigh(g)
        s = np.sqrt(np.maximum(w[::-1], 0))
        k = min(self.n_components or len(s), len(s), self.n_samples_seen_)
        self.components_, self.singular_values_, self.n_components_ = signed(v[:, ::-1].T[:k]), s[:k], k
        self.explained_variance_ = s[:k] ** 2 / max(1, self.n_samples_seen_ - 1)
        return self

    def fit(self, x, chunk_size=None, dataset=None):
        """A frame or array in chunks of rows; all at once without a chunk size.

        Tasks sum up the chunks, many in a job; here they are added in their order, a bounded number of bytes at a time.
        """
        rows = vectors(x)
        size = chunk_size or self.batch_size
        if not size:
            return self.partial_fit(rows)
        top, width = rows.agg(F.max("row_id"), F.max(F.size("x"))).first()
        if top is None:
            return self

        def summed(table: pa.Table) -> pa.Table:
            v = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            mean = v.mean(0)
            v = v - mean
            return pa.table({"c": table.column("c")[:1], "n": pa.array([len(v)], pa.int64()), "m": pa.array([mean.tobytes()], pa.binary()), "g": pa.array([(v.T @ v).tobytes()], pa.binary())})

        many = max(1, CHUNK_BYTES // (8 * max(1, width) ** 2)) * size
        chunk = F.call_function("div", F.col("row_id"), F.lit(size)).alias("c")
        for start in range(0, top + 1, many):
            some = rows.where(F.col("row_id").between(start, start + many - 1)).select(chunk, "x")
            sums = some.groupBy("c").applyInArrow(summed, "c bigint, n bigint, m binary, g binary")
            for r in sorted(sums.collect(), key=lambda r: r.c):
                self._add(r.n, np.frombuffer(r.m), np.frombuffer(r.g).reshape(width, width))
        return self


def _cut(x: np.ndarray, rank, tol):
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    k = wanted(s, rank) if tol is None else max(1, int((s > tol * s[0]).sum()))
    return u[:, :k], s[:k], vt[:k]


class DMD(BaseEstimator, RegressionMixin):
    """Linear dynamics of (features, time): from the time-by-time Gram matrix, so there may be any number of features."""

    def __init__(self, svd_solver="full", svd_rank=None, svd_tol=None):
        self.svd_solver, self.svd_rank, self.svd_tol = svd_solver, svd_rank, svd_tol

    def fit(self, x: Array):
        m, n = x.shape
        if n < 2:
            raise ValueError("needs two times at least")
        rows = rows_of(x)
        g = gram(rows)
        w, v = np.linalg.eigh(g[:-1, :-1])
        s, v = np.sqrt(np.maximum(w[::-1], 0)), v[:, ::-1]
        k = wanted(s, self.svd_rank) if self.svd_tol is None else max(1, int((s > self.svd_tol * s[0]).sum()))
        k = min(k, int((s > 1e-7 * s[0]).sum()))
        s, v = s[:k], v[:, :k]
        # U^T X' V / S, with U = X V / S
        self.rom_transfer_matrix_ = (v / s).T @ g[:-1, 1:] @ (v / s)
        self._basis = times(rows.select("row_id", F.slice("x", 1, n - 1).alias("x")), v / s).cache()
        self.rom_eigenvalues_, self.rom_eigenmodes_ = np.linalg.eig(self.rom_transfer_matrix_)
        self.n_modes_, self._m = k, m
        return self

    @property
    def rom_basis_(self) -> np.ndarray:
        return np.array([r.x for r in self._basis.orderBy("row_id").collect()])

    def _next(self, state: np.ndarray, steps: int) -> list[np.ndarray]:
        out = []
        for _ in range(steps):
            state = self.rom_transfer_matrix_ @ state
            out.append(state)
        return out

    def predict_next(self, x: Array, n_steps: int = 1) -> Array:
        from ..operators.linalg import from_rows

        y = small(x).reshape(self._m, -1)
        z = self._next(self.rom_basis_.T @ y, n_steps)[-1]
        return from_rows(times(self._basis, z), self._m, y.shape[1])

    def predict(self, x: Array, steps) -> Array:
        from ..operators.linalg import from_rows

        steps = list(range(steps)) if isinstance(steps, int) else list(steps)
        z0 = self.rom_basis_.T @ small(x).reshape(self._m, -1)[:, :1]
        z = np.hstack([np.linalg.matrix_power(self.rom_transfer_matrix_, int(t)) @ z0 for t in steps])
        return from_rows(times(self._basis, z), self._m, len(steps))


class DMDc(BaseEstimator, RegressionMixin):
    """DMD with control inputs: x(t+1) = A x(t) + B c(t), in the basis of the later states."""

    def __init__(self, svd_solver="full", svd_rank=None, svd_tol=None):
        self.svd_solver, self.svd_rank, self.svd_tol = svd_solver, svd_rank, svd_tol

    def fit(self, x: Array, c: Array):
        y, u = small(x), small(c)
        u = u[:, : y.shape[1] - 1]
        before, after = y[:, :-1], y[:, 1:]
        ub, _, _ = _cut(after, self.svd_rank, self.svd_tol)
        us, ss, vs = _cut(np.vstack([before, u]), None if isinstance(self.svd_rank, int) else self.svd_rank, self.svd_tol or 1e-12)
        g = ub.T @ after @ vs.T / ss
        self.rom_basis_ = ub
        self.rom_transfer_matrix_ = g @ us[: len(y)].T @ ub
        self.rom_control_matrix_ = g @ us[len(y) :].T
        self.rom_eigenvalues_ = np.linalg.eigvals(self.rom_transfer_matrix_)
        self.n_modes_ = ub.shape[1]
        return self

    def predict(self, x: Array, c: Array) -> Array:
        from ..array import array

        z, out = self.rom_basis_.T @ small(x).reshape(len(self.rom_basis_), -1)[:, 0], []
        for u in small(c).T:
            z = self.rom_transfer_matrix_ @ z + self.rom_control_matrix_ @ u
            out.append(self.rom_basis_ @ z)
        return array(np.array(out).T)


