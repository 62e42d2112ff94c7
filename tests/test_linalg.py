"""Linear algebra, transforms, convolution, sparse matrices, distances: against NumPy."""

import numpy as np
import pytest

import mosaiq as mq
from mosaiq.operators import distance, linalg, signal, sparse

rng = np.random.default_rng(1)
A, B, T = rng.normal(size=(6, 5)), rng.normal(size=(5, 4)), rng.normal(size=(40, 5))
S = A.T @ A


def close(got, want, tol=1e-8):
    np.testing.assert_allclose(got.numpy() if hasattr(got, "numpy") else got, want, rtol=tol, atol=tol)


def test_products(spark):
    a, b = mq.array(A), mq.array(B)
    close(a @ b, A @ B)
    close(mq.matmul(mq.array(np.stack([A, A])), b), np.stack([A, A]) @ B)
    close(linalg._blocked(a, b, "float64", 2), A @ B)
    close(mq.outer(mq.array(A[0]), mq.array(B[0])), np.outer(A[0], B[0]))
    close(mq.vdot(a, a), np.vdot(A, A))
    close(mq.cross(mq.array(A[:, :3]), mq.array(A[:, 2:5])), np.cross(A[:, :3], A[:, 2:5]))
    close(mq.tensordot(a, b, 1), np.tensordot(A, B, 1))
    close(mq.trace(mq.array(S)), np.trace(S))
    close(mq.projection(mq.array(A[0]), mq.array(A[1])), A[0] @ A[1] / (A[1] @ A[1]) * A[1])
    for o in (None, "fro", 1, -1, np.inf, -np.inf):
        close(mq.matrix_norm(a, ord=o), np.linalg.norm(A, o))
    for o in (0, 1, 2, 3, np.inf, -np.inf):
        close(mq.vector_norm(mq.array(A[0]), ord=o), np.linalg.norm(A[0], o))


def test_factorisations(spark):
    t, s = mq.array(T), mq.array(S)
    q, r = linalg.qr(t)
    close(q @ r, T)
    close(q.T @ q, np.eye(5))
    u, sv, vh = linalg.svd(t)
    close(sv, np.linalg.svd(T, compute_uv=False))
    close((u.numpy() * sv.numpy()) @ vh.numpy(), T)
    close(linalg.svd(mq.array(T.T)).S, np.linalg.svd(T, compute_uv=False))
    w, v = linalg.eigh(s)
    close(w, np.linalg.eigvalsh(S)[::-1])
    close(v.numpy() @ np.diag(w.numpy()) @ v.numpy().T, S)
    p = linalg.polar(t)
    close(p.U @ p.H, T)
    close(linalg.det(s), np.linalg.det(S))
    close(linalg.inv(s), np.linalg.inv(S), 1e-6)
    close(linalg.solve(s, mq.array(B[:, 0])), np.linalg.solve(S, B[:, 0]), 1e-6)
    close(linalg.cg(s, mq.array(B[:, 0])), np.linalg.solve(S, B[:, 0]), 1e-5)
    close(linalg.solve_triangular(mq.array(np.triu(S)), mq.array(B)), np.linalg.solve(np.triu(S), B))
    close(linalg.matrix_exp(mq.array(S / 10)), np.linalg.eigh(S / 10)[1] @ np.diag(np.exp(np.linalg.eigh(S / 10)[0])) @ np.linalg.eigh(S / 10)[1].T)
    close(linalg.pinv(t), np.linalg.pinv(T))
    assert linalg.matrix_rank(t) == 5 and abs(linalg.condest(t) - np.linalg.cond(T)) < 1e-8


def test_truncated_factorisations(spark):
    low = T[:, :2] @ rng.normal(size=(2, 12))
    a = mq.array(low)
    close(linalg.rsvd(a, 2).S, np.linalg.svd(low, compute_uv=False)[:2])
    u, s, v, err = linalg.hsvd_rank(a, 2, compute_sv=True)
    close(s, np.linalg.svd(low, compute_uv=False)[:2])
    close((u.numpy() * s.numpy()) @ v.numpy().T, low)
    assert err < 1e-6 and linalg.hsvd_rtol(a, 1e-3)[0].shape[1] == 2
    close(linalg.reigh(mq.array(S), 2, power_iter=3).eigenvalues, np.linalg.eigvalsh(S)[::-1][:2], 1e-5)
    v, t = linalg.lanczos(mq.array(S), 5)
    close(v.numpy() @ t.numpy() @ v.numpy().T, S)
    u0, s0, vt0 = np.linalg.svd(T[:, :3], full_matrices=False)
    close(linalg.isvd(mq.array(T[:, 3:]), mq.array(u0), mq.array(s0))[1], np.linalg.svd(T, compute_uv=False))


def test_convolution(spark):
    x, k = rng.normal(size=30), rng.normal(size=5)
    for mode in ("full", "same", "valid"):
        close(mq.convolve(mq.array(x), mq.array(k), mode), np.convolve(x, k, mode))
    close(mq.convolve(mq.array(x), mq.array(k), "valid", 3), np.convolve(x, k, "valid")[::3])
    img, ker = rng.normal(size=(7, 6)), rng.normal(size=(3, 3))
    full = np.zeros((9, 8))
    for i in range(3):
        for j in range(3):
            full[i : i + 7, j : j + 6] += ker[i, j] * img
    close(mq.convolve2d(mq.array(img), mq.array(ker)), full)
    close(mq.convolve2d(mq.array(img), mq.array(ker), "valid"), full[2:-2, 2:-2])
    with pytest.raises(ValueError):
        mq.convolve(mq.array(x), mq.array(k), "same", 2)


def test_fourier(spark):
    x = rng.normal(size=(3, 8))
    a = mq.array(x)
    for n in ("fft", "ifft", "rfft", "fft2", "rfft2", "fftn", "ifftn", "rfftn", "hfft", "ihfft"):
        close(getattr(signal, n)(a), getattr(np.fft, n)(x))
    close(signal.irfft(mq.array(np.fft.rfft(x))), x)
    close(signal.irfftn(signal.rfftn(a)), x)
    close(signal.fft(a, n=5, norm="ortho"), np.fft.fft(x, n=5, norm="ortho"))
    close(signal.fftfreq(9, 0.5, dtype="float64"), np.fft.fftfreq(9, 0.5))
    close(signal.rfftfreq(9, dtype="float64"), np.fft.rfftfreq(9))
    close(signal.fftshift(a), np.fft.fftshift(x))
    close(signal.ifftshift(a, 1), np.fft.ifftshift(x, 1))
    with pytest.raises(TypeError):
        signal.rfft(mq.array(x * 1j))


def test_sparse(spark):
    x, y = np.array([[0, 2.0, 0], [1, 0, 0]]), np.array([[3.0, -2.0, 0], [0, 0, 5]])
    a, b = sparse.sparse_csr_matrix(x), sparse.sparse_csr_matrix(y)
    close((a + b).todense(), x + y)
    close((a * b).todense(), x * y)
    close((a * 3).todense(), 3 * x)
    close((a + 1).todense(), np.where(x != 0, x + 1, 0))
    assert a.nnz == 2 and a.indptr.tolist() == [0, 1, 2] and a.indices.tolist() == [1, 0] and sparse.sparse_csc_matrix(x).indices.tolist() == [1, 0]


def test_distances(spark):
    x, y = T[:7, :3], T[7:12, :3]
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    close(mq.cdist(mq.array(x), mq.array(y)), d)
    close(mq.cdist(mq.array(x), mq.array(y), True), d, 1e-6)
    close(mq.rbf(mq.array(x), mq.array(y), 2.0), np.exp(-(d**2) / 8))
    close(mq.manhattan(mq.array(x), mq.array(y)), np.abs(x[:, None] - y[None]).sum(2))
    own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    close(mq.Array(distance.pair_blocks(mq.array(x), None, distance.euclidean, 3), (7, 7), "float64"), own)
    s = np.exp(-(own**2) / 2) - np.eye(7)
    g = s.sum(1)
    close(mq.Laplacian(lambda v: mq.rbf(v), definition="simple").construct(mq.array(x)), np.diag(g) - s)
    close(mq.Laplacian(lambda v: mq.rbf(v)).construct(mq.array(x)), np.eye(7) - s / np.sqrt(np.outer(g, g)))


def test_random_matrices(spark):
    q = mq.random.random_orthogonal(6, 3, dtype="float64").numpy()
    close(q.T @ q, np.eye(3))
    m, _ = mq.random.random_known_singularvalues(6, 5, [3.0, 1.0], dtype="float64")
    close(np.linalg.svd(m.numpy(), compute_uv=False)[:3], [3, 1, 0])
    h = mq.random.hermitian(4, positive_definite=True).numpy()
    assert np.allclose(h, h.conj().T) and np.linalg.eigvalsh(h).min() > 0
    close(mq.random.parter(3, dtype="float64"), [[1 / (i - j + 0.5) for j in range(3)] for i in range(3)])
    assert mq.random.create_spherical_dataset(10).shape == (40, 3)
    c = mq.random.create_clusters(50, 2, 2, [[0, 0], [9, 9]], [1, 1]).numpy()
    assert c.shape == (50, 2) and (c > 5).any() and (c < 4).any()


def test_pairs_meet_without_copies_of_rows(spark):
    """Rows are packed once and blocks meet in a nested loop: no row is exploded or shuffled for its pairs."""
    plan = distance.pair_blocks(mq.array(T[:9, :3]), None, distance.rounded(distance.euclidean, 5), 4)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "explode" not in plan and "shuffle" not in plan[: plan.index("CartesianProduct")].split("== Physical Plan ==")[-1].lower()


def test_rounding_as_in_sql():
    np.testing.assert_array_equal(distance.rounding(np.array([0.5, -1.5, 2.4, -0.2, 0.49999999999999994, np.inf]), 0), [1, -2, 2, 0, 0, np.inf])
    assert not np.signbit(distance.rounding(np.array([-0.2]), 0))[0]


@pytest.mark.parametrize("definition", ["simple", "norm_sym"])
@pytest.mark.parametrize("more", [{}, {"mode": "eNeighbour", "threshold_key": "lower", "threshold_value": 0.3}, {"mode": "eNeighbour", "weighted": False, "threshold_key": "lower", "threshold_value": 0.3}])
def test_laplacian_of_cells_of_blocks_and_as_operator(spark, definition, more):
    """The same matrix from cells, from blocks of pairs, and through its products, which keep no cell."""
    x = mq.array(T[:9, :3])
    cells = lambda v: mq.Array(mq.rbf(v).cells(), (9, 9), "float64")
    want = mq.Laplacian(cells, definition=definition, **more).construct(x).numpy()
    lap = mq.Laplacian(mq.rbf, definition=definition, **more)
    close(lap.construct(x), want)
    close(lap.construct(x, digits=3), np.round(want, 3), 1e-3)
    v = np.arange(9.0)
    close(lap.operator(x)(v), want @ v)
    assert mq.Laplacian(cells).operator(x) is None


def test_short_lines_are_transformed_together(spark, monkeypatch):
    """40 lines of 5 cells are one group, not 40; and several groups, with a missing cell, give the same."""
    for together in (1 << 16, 20):
        monkeypatch.setattr(signal, "TOGETHER", together)
        x = mq.array(T)
        x = mq.Array(x.cells().where("i0 <> 7 or i1 <> 2"), x.shape, "float64")
        want = T.copy()
        want[7, 2] = 0
        close(signal.fft(x), np.fft.fft(want))
        close(signal.ifft(signal.fft(x, axis=0), axis=0).real, want)
        close(signal.fft(x, n=8), np.fft.fft(want, n=8))
    close(signal.rfftn(mq.array(T.reshape(4, 10, 5))), np.fft.rfftn(T.reshape(4, 10, 5)))
    monkeypatch.setattr(signal, "TOGETHER", 1 << 16)
    seen = spark.sparkContext.accumulator(0)

    def counted(lines):
        seen.add(1)
        return lines

    signal._line(mq.array(T), 1, counted, 5, False).cells().collect()
    assert seen.value == 1
