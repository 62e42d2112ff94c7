"""Arrays against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import mosaiq as mq
from mosaiq.array import number_rows, scan
from mosaiq.functions import types as ty

A = np.array([[1.5, -2.0, 0.0, 3.25], [-0.5, 7.0, 2.0, -9.0], [4.0, 4.0, -1.0, 0.25]])
I = np.array([-7, 7, 0, 5], dtype=np.int32)  # noqa: E741
J = np.array([3, -3, 2, -2], dtype=np.int32)
X = np.array([1.0, np.nan, np.inf, -np.inf, 0.0, -0.0, -2.5, 2.5])


def close(got, want):
    got = got.numpy() if isinstance(got, mq.Array) else got
    np.testing.assert_allclose(np.asarray(got, dtype=np.asarray(want).dtype), want, rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def a(spark):
    return mq.array(A)


def test_unary_functions_follow_numpy(spark):
    x = mq.array(X)
    names = {"exp": np.exp, "expm1": np.expm1, "exp2": np.exp2, "log": np.log, "log2": np.log2, "log10": np.log10, "log1p": np.log1p, "sqrt": np.sqrt, "square": np.square, "arccos": np.arccos, "arcsin": np.arcsin, "arctan": np.arctan, "asinh": np.arcsinh, "acosh": np.arccosh, "atanh": np.arctanh, "sin": np.sin, "cos": np.cos, "tan": np.tan, "tanh": np.tanh, "floor": np.floor, "ceil": np.ceil, "trunc": np.trunc, "round": np.round, "fabs": np.fabs, "abs": np.abs, "sign": np.sign, "isnan": np.isnan, "isinf": np.isinf, "isfinite": np.isfinite, "signbit": np.signbit, "isposinf": np.isposinf, "isneginf": np.isneginf, "neg": np.negative, "nan_to_num": np.nan_to_num, "deg2rad": np.deg2rad, "rad2deg": np.rad2deg}
    rows = x.frame.select("i0", *[getattr(mq, n)(x).value.alias(n) for n in names]).orderBy("i0").toPandas()
    with np.errstate(all="ignore"):
        for n, f in names.items():
            np.testing.assert_allclose(rows[n].to_numpy(float), np.asarray(f(X), float), rtol=1e-12, err_msg=n)


def test_binary_functions_follow_numpy(spark):
    x, y = mq.array(np.repeat(X, 8)), None
    other = np.tile(X, 8)
    df = spark.createDataFrame([(k, float(p), float(q)) for k, (p, q) in enumerate(zip(np.repeat(X, 8), other, strict=True))], "i0 bigint, v double, w double")
    from pyspark.sql import functions as F

    x, y = mq.Array(df, (64,), "float64"), mq.Array(df, (64,), "float64", F.col("w"))
    names = {"add": np.add, "sub": np.subtract, "mul": np.multiply, "div": np.divide, "hypot": np.hypot, "copysign": np.copysign, "arctan2": np.arctan2, "logaddexp": np.logaddexp, "maximum": np.maximum, "minimum": np.minimum, "eq": np.equal, "ne": np.not_equal, "lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal, "isclose": np.isclose, "logical_xor": np.logical_xor}
    rows = df.select("i0", *[getattr(mq, n)(x, y).value.alias(n) for n in names]).orderBy("i0").toPandas()
    with np.errstate(all="ignore"):
        for n, f in names.items():
            np.testing.assert_allclose(rows[n].to_numpy(float), np.asarray(f(np.repeat(X, 8), other), float), rtol=1e-12, err_msg=n)


def test_integers(spark):
    x, y = mq.array(I), mq.array(J)
    for n, f in {"floordiv": np.floor_divide, "remainder": np.remainder, "fmod": np.fmod, "gcd": np.gcd, "lcm": np.lcm, "bitwise_and": np.bitwise_and, "bitwise_or": np.bitwise_or, "bitwise_xor": np.bitwise_xor, "add": np.add}.items():
        close(getattr(mq, n)(x, y), f(I, J))
    close(~x, ~I)
    close(x << 2, I << 2)
    close(divmod(x, y)[1], I % J)
    with pytest.raises(TypeError):
        mq.bitwise_and(mq.array(A), 1)


def test_broadcasting_and_operators(a):
    row = mq.array(A[0])
    close(a + row, A + A[0])
    close(2 - a, 2 - A)
    close((a * 2 + 1) / 3, (A * 2 + 1) / 3)
    close(a[:, 1:2] * row, A[:, 1:2] * A[0])
    close(mq.where(a > 0, a, -1.0), np.where(A > 0, A, -1))
    assert mq.allclose(a, A) and mq.equal(a, a) and not mq.equal(a, a + 1)
    close(mq.add(a, 1.0, where=a > 0), np.where(A > 0, A + 1, A))


def test_types():
    assert [ty.promote_types(*p) for p in (("int32", "float32"), ("int8", "uint8"), ("int64", "float32"), ("bool", "int8"))] == ["float32", "int16", "float64", "int8"]
    assert ty.result_type("int64", 2.0) == "float64" and ty.result_type("float32", 1) == "float32"
    assert ty.can_cast("int32", "int64", "safe") and not ty.can_cast("int64", "int32", "safe") and ty.can_cast("int32", "float32")
    assert ty.issubdtype("int8", "integer") and ty.finfo("float32").bits == 32 and ty.iinfo("int8").max == 127


def test_reductions(a):
    for n, f in {"sum": np.sum, "prod": np.prod, "max": np.max, "min": np.min, "ptp": np.ptp, "mean": np.mean, "std": np.std, "var": np.var, "median": np.median, "all": np.all, "any": np.any, "argmax": np.argmax, "argmin": np.argmin}.items():
        for axis in (None, 0, 1):
            close(getattr(mq, n)(a, axis), f(A, axis=axis))
    close(mq.sum(a, (0, 1), keepdims=True), A.sum(keepdims=True))
    for q in ("linear", "lower", "higher", "midpoint", "nearest"):
        close(mq.percentile(a, 37, interpolation=q), np.percentile(A, 37, method=q))
    close(mq.percentile(a, [10, 90], axis=0), np.percentile(A, [10, 90], axis=0))
    close(mq.var(a, 0, ddof=1), A.var(0, ddof=1))
    close(mq.cov(a), np.cov(A))
    close(mq.average(a, 1, mq.array(np.arange(1.0, 5))), np.average(A, 1, np.arange(1.0, 5)))
    x = np.array([1.0, 2, 4, 9, 11])
    n, m = 5, x - x.mean()
    g1 = (m**3).mean() / (m**2).mean() ** 1.5
    close(mq.skew(mq.array(x)), g1 * np.sqrt(n * (n - 1)) / (n - 2))
    with pytest.raises(ValueError):
        mq.var(a, ddof=2)


def test_nan_in_reductions(spark):
    x = mq.array(np.array([1.0, np.nan, 2.0]))
    assert np.isnan(float(mq.max(x))) and np.isnan(float(mq.min(x))) and float(mq.nansum(x)) == 3
    assert int(mq.argmax(x)) == 1 and int(mq.argmin(x)) == 1
    e = mq.array(np.zeros((0,)))
    assert float(mq.sum(e)) == 0 and bool(mq.all(e)) and not bool(mq.any(e))


def test_histograms(spark):
    v = np.array([0, 1, 1, 3, 2, 1, 7])
    close(mq.bincount(mq.array(v), minlength=9), np.bincount(v, minlength=9))
    close(mq.histc(mq.array(A), 5, -9, 7), np.histogram(A, 5, (-9, 7))[0])
    for bins in ([0.0, 1, 2, 4], [4.0, 2, 1, 0]):
        for right in (False, True):
            close(mq.digitize(mq.array(A), bins, right), np.digitize(A, bins, right))


def test_scans_sorts_and_windows(a):
    close(mq.cumsum(a, 1), A.cumsum(1))
    close(mq.cumprod(a, 0), A.cumprod(0))
    v = np.arange(50.0)
    close(mq.cumsum(mq.array(v), 0), v.cumsum())
    close(mq.diff(a, 2, 1), np.diff(A, 2, 1))
    close(mq.diff(a, axis=0, prepend=0.0), np.diff(A, axis=0, prepend=0))
    s, i = mq.sort(a, 1)
    close(s, np.sort(A, 1))
    close(i, np.argsort(A, 1, kind="stable"))
    close(mq.sort(mq.flatten(a), descending=True)[0], -np.sort(-A.ravel()))
    close(mq.topk(a, 2)[0], -np.sort(-A, 1)[:, :2])
    close(mq.topk(mq.flatten(a), 3, largest=False)[0], np.sort(A.ravel())[:3])
    close(mq.unfold(a, 1, 2, 1), np.lib.stride_tricks.sliding_window_view(A, 2, 1))
    assert [r.prev for r in mq.array(v[:4]).get_halo(1).orderBy("i0").collect()] == [[], [0.0], [1.0], [2.0]]


def test_reshaping(a):
    close(mq.reshape(a, 2, -1), A.reshape(2, -1))
    close(a.T, A.T)
    for n, f in {"flip": np.flip, "rot90": np.rot90, "flipud": np.flipud, "fliplr": np.fliplr, "tril": np.tril, "triu": np.triu, "diagonal": np.diagonal, "flatten": np.ravel}.items():
        close(getattr(mq, n)(a), f(A))
    close(mq.roll(a, 2, 1), np.roll(A, 2, 1))
    close(mq.roll(a, 5), np.roll(A, 5))
    close(mq.repeat(a, 2, 0), np.repeat(A, 2, 0))
    close(mq.repeat(a, [1, 0, 2], 0), np.repeat(A, [1, 0, 2], 0))
    close(mq.tile(a, (2, 1)), np.tile(A, (2, 1)))
    close(mq.pad(a, ((1, 0), (0, 2)), constant_values=9), np.pad(A, ((1, 0), (0, 2)), constant_values=9))
    close(mq.expand_dims(a, 1), A[:, None])
    close(mq.squeeze(mq.expand_dims(a, 1)), A)
    close(mq.concatenate([a, a], 1), np.concatenate([A, A], 1))
    close(mq.stack([a, a], 1), np.stack([A, A], 1))
    close(mq.vstack([a, a]), np.vstack([A, A]))
    close(mq.column_stack([mq.array(A[:, 0]), a]), np.column_stack([A[:, 0], A]))
    for p, q in zip(mq.split(a, [1, 3], 1), np.split(A, [1, 3], 1), strict=True):
        close(p, q)
    close(mq.diag(mq.array(np.array([1.0, 2]))), np.diag([1.0, 2]))
    close(mq.moveaxis(mq.expand_dims(a, 0), 0, 2), np.moveaxis(A[None], 0, 2))
    with pytest.raises(ValueError):
        mq.reshape(a, 5, 5)


def test_indexing(a):
    for key in (0, (1, 2), slice(None, None, -1), (slice(None), slice(1, 4, 2)), (Ellipsis, -1), (None, 1), [2, 0, 0], ([0, 1], [1, 2]), (slice(None), [3, 0])):
        close(a[key], A[key])
    close(a[a > 1], A[A > 1])
    B = A.copy()
    B[1, 1:3] = 5
    close(a.set((1, slice(1, 3)), 5.0), B)
    B = A.copy()
    B[:, 0] = [9, 8, 7]
    close(a.set((slice(None), 0), [9.0, 8.0, 7.0]), B)
    close(a.set(a < 0, 0.0), np.where(A < 0, 0, A))
    close(mq.nonzero(a), np.stack(np.nonzero(A), 1))
    with pytest.raises(IndexError):
        a[7]


def test_distinct_values(spark):
    v = np.array([[3, 1], [3, 2], [3, 1]])
    x = mq.array(v)
    close(mq.unique(x), np.unique(v))
    close(mq.unique_inverse(x).inverse_indices, np.unique(v, return_inverse=True)[1].reshape(v.shape))
    close(mq.unique(x, axis=0), np.unique(v, axis=0))
    close(mq.unique_counts(x).counts, np.unique(v, return_counts=True)[1])


def test_generators(spark):
    close(mq.arange(2, 9, 3), np.arange(2, 9, 3))
    close(mq.linspace(0, 1, 5, dtype="float64"), np.linspace(0, 1, 5))
    close(mq.logspace(0, 2, 3, dtype="float64"), np.logspace(0, 2, 3))
    close(mq.eye((2, 3)), np.eye(2, 3))
    for g, w in zip(mq.meshgrid(mq.arange(3), mq.arange(2)), np.meshgrid(np.arange(3), np.arange(2)), strict=True):
        close(g, w)
    mq.random.seed(3)
    x = mq.random.rand(2000, dtype="float64")
    u = x.numpy()
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03
    mq.random.seed(3)
    assert (mq.random.rand(2000, dtype="float64").numpy() == u).all()
    z = mq.random.randn(4000, dtype="float64").numpy()
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.06
    assert sorted(mq.random.randperm(20).tolist()) == list(range(20))
    k = mq.random.randint(2, 5, (100,)).numpy()
    assert set(k.tolist()) == {2, 3, 4}


def test_complex(spark):
    z = np.array([1 + 2j, -3j, 0, 2.5])
    x = mq.array(z)
    close(mq.conj(x), z.conj())
    close(x * x, z * z)
    close(mq.abs(x), np.abs(z))
    close(mq.angle(x), np.angle(z))
    close(x.real, z.real)
    close(mq.iscomplex(x), np.iscomplex(z))


def test_array_api_namespace(spark):
    xp = mq.array(A).__array_namespace__()
    assert xp.arange(3).dtype == "int64" and xp.asarray([1.5]).dtype == "float64" and xp.zeros((2,)).dtype == "float64"
    close(xp.sum(xp.asarray(A), axis=1, keepdims=True), A.sum(1, keepdims=True))
    close(xp.equal(xp.asarray([1, 2]), xp.asarray([1, 3])), np.array([True, False]))
    close(xp.cumulative_sum(xp.asarray([1.0, 2.0]), include_initial=True), [0, 1, 3])
    close(xp.sort(xp.asarray(A), axis=0, descending=True), -np.sort(-A, 0))
    close(xp.clip(xp.asarray(A), 0, 2), np.clip(A, 0, 2))
    info = xp.__array_namespace_info__()
    assert "float64" in info.dtypes(kind="real floating") and info.default_dtypes()["integral"] == "int64" and xp.isdtype("int8", "integral")
    with pytest.raises(ValueError):
        mq.array(A).__array_namespace__(api_version="1")


def test_row_numbers_with_payload_columns(spark):
    """Rows in random order, columns beside the order, many partitions: every number once, in order."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        n = 300_000
        df = spark.range(n).select(F.xxhash64("id").alias("k"), "id", F.col("id").cast("string").alias("payload"))
        out = number_rows(df, ["k"])
        got = out.agg(F.count("*"), F.countDistinct("row_id"), F.min("row_id"), F.max("row_id")).first()
        assert tuple(got) == (n, n, 0, n - 1)
        place = out.selectExpr("k", "lag(k) over (partition by row_id div 1000 order by row_id) b").where("b >= k").count()
        assert place == 0
        total = scan(df.select("k", "payload", F.lit(1).alias("one")), ["k"], F.col("one"), "s").agg(F.max("s"), F.countDistinct("s"), F.count("*")).first()
        assert tuple(total) == (n, n, n)
        assert number_rows(df.limit(0), ["k"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_in_place_scans_keep_the_type(spark):
    a = mq.array(np.array([1, 2, 3, 4], "int32"))
    assert a.cumsum_(0).numpy().tolist() == [1, 3, 6, 10] and a.cumprod_(0).numpy().tolist() == [1, 2, 6, 24]
    assert a.cumsum_(0).dtype == a.dtype


def test_pairwise_blocks_equal_numpy(spark):
    """Several blocks on both sides; points that lie close together far from the origin."""
    from mosaiq.operators import distance

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(23, 5)) * 1e-3 + 1e4, rng.normal(size=(11, 5)) * 1e-3 + 1e4
    for other in (None, y):
        b = x if other is None else other
        want = np.sqrt(((x[:, None] - b[None]) ** 2).sum(2))
        got = distance.pair_blocks(mq.array(x), None if other is None else mq.array(other), distance.euclidean, block=4).toPandas()
        out = np.full(want.shape, np.nan)
        out[got["i0"], got["i1"]] = got["v"]
        assert len(got) == want.size and np.allclose(out, want, rtol=1e-9)


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
@pytest.mark.parametrize("block", [4, 7, 1 << 16])
def test_convolution_in_blocks(spark, monkeypatch, mode, block):
    """Blocks that are shorter and longer than signal and kernel, batches, strides, integers and kernels sent by expression."""
    from mosaiq.array import array
    from mosaiq.operators import signal

    monkeypatch.setattr(signal, "BLOCK", block)
    rng = np.random.default_rng(block)
    x, k = rng.normal(size=(3, 40)), rng.normal(size=5)
    np.testing.assert_allclose(signal.convolve(array(x), array(k), mode).numpy(), [np.convolve(row, k, mode) for row in x], atol=1e-12)
    if mode != "same":
        np.testing.assert_allclose(signal.convolve(array(x[0]), array(k), mode, 3).numpy(), np.convolve(x[0], k, mode)[::3], atol=1e-12)
    n, m = rng.integers(-9, 9, 30), rng.integers(-9, 9, 9)
    got = signal.convolve(array(n), array(m), mode)
    assert got.dtype == "int64" and (got.numpy() == np.convolve(n, m, mode)).all()
    monkeypatch.setattr(signal, "LONGEST", 1)
    np.testing.assert_allclose(signal.convolve(array(x[0]), array(k), mode).numpy(), np.convolve(x[0], k, mode), atol=1e-12)


@pytest.mark.parametrize("accuracy", [2000, 40])
def test_percentiles_of_large_groups(spark, monkeypatch, accuracy):
    """Exact in groups larger than the sketch, with ties, NaN, infinities and nulls; no task gets a group's values."""
    from pyspark.sql import functions as F

    from mosaiq.functions import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(4)
    data = {"many": rng.normal(size=9000), "ties": rng.integers(0, 5, 9000).astype(float), "few": rng.normal(size=7), "one": np.array([2.0]), None: np.r_[rng.normal(size=3000), [np.inf] * 900, [np.nan] * 900, [-np.inf] * 40]}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("none", None), ("few", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    out = quantiles.percentiles(df, ["g"], F.col("v"), [0, 37, 50, 75, 100])
    got = {r.g: tuple(r)[1:] for r in out.collect()}
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(*[F.percentile("v", q / 100).alias(f"p{q}") for q in (0, 37, 50, 75, 100)]).collect()}
    assert got.keys() == want.keys()
    for g in want:
        np.testing.assert_array_equal(np.array(got[g], float), np.array(want[g], float), err_msg=str(g))
    assert "percentile(" not in out._jdf.queryExecution().toString()


def test_percentile_query_collects_no_group(spark):
    from mosaiq.plans import queries

    assert "percentile(" not in queries.QUERIES["percentiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
