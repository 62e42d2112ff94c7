"""Estimators, scalers, files and incremental fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import mosaiq as mq
from mosaiq import ml, streaming
from mosaiq.sources import io

rng = np.random.default_rng(2)
CENTRES = np.array([[0.0, 0, 0], [8, 8, 8], [-8, 8, 0], [8, -8, 4]])
X = np.vstack([c + rng.normal(size=(15, 3)) for c in CENTRES])
Y = np.repeat(np.arange(4), 15)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, [float(v) for v in x], int(y)) for k, (x, y) in enumerate(zip(X, Y, strict=True))], "row_id bigint, x array<double>, label bigint").cache()


def matrix(df, column="x"):
    return np.array([r[column] for r in df.orderBy("row_id").collect()])


def test_clusterings(rows):
    for model in (ml.KMeans(4, init="kmeans++", random_state=0), ml.KMedians(4, init=CENTRES), ml.KMedoids(4, init=CENTRES, max_iter=4), ml.BatchParallelKMeans(4, random_state=0), ml.BatchParallelKMedians(4, random_state=1)):
        got = matrix(model.fit(rows).predict(rows), "label")
        assert len({(a, b) for a, b in zip(got, Y, strict=True)}) == 4, model
    s = ml.Spectral(4, gamma=0.05, n_lanczos=40).fit(mq.array(X))
    assert len(set(zip(matrix(s.labels_, "label"), Y, strict=True))) == 4
    assert ml.is_clusterer(s) and ml.KMeans(3).get_params()["n_clusters"] == 3


def test_silhouette(rows):
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    want = []
    for i in range(len(X)):
        a = d[i][Y == Y[i]].sum() / 14
        b = min(d[i][Y == k].mean() for k in range(4) if k != Y[i])
        want.append((b - a) / max(a, b))
    np.testing.assert_allclose(matrix(ml.silhouette_samples(rows, rows), "silhouette"), want, rtol=1e-8)
    assert abs(ml.silhouette_score(rows, rows) - np.mean(want)) < 1e-8


def test_classifiers(rows):
    knn = ml.KNeighborsClassifier(3, block=16).fit(rows, rows)
    assert (matrix(knn.predict(rows), "label") == Y).all()
    nb = ml.GaussianNB().fit(rows, rows)
    assert (matrix(nb.predict(rows), "label") == Y).all()
    np.testing.assert_allclose(matrix(nb.predict_proba(rows)).sum(1), 1)
    np.testing.assert_allclose(nb.theta_, [X[Y == k].mean(0) for k in range(4)])
    parts = ml.GaussianNB().partial_fit(rows.where("row_id % 2 = 0"), rows).partial_fit(rows.where("row_id % 2 = 1"), rows)
    np.testing.assert_allclose(parts.theta_, nb.theta_)
    np.testing.assert_allclose(parts.class_count_, nb.class_count_)


def test_lasso(spark):
    z = rng.normal(size=(200, 3))
    x = np.column_stack([np.ones(200), (z - z.mean(0)) / z.std(0)])  # on one scale, as the estimator expects
    y = x @ np.array([2.0, 3.0, 0.0, -1.0])
    rows = spark.createDataFrame([(k, r.tolist(), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))], "row_id bigint, x array<double>, y double")
    m = ml.Lasso(lam=0.01, max_iter=200).fit(rows, rows)
    assert np.abs(m.theta - [2, 3, 0, -1]).max() < 0.1 and abs(m.theta[2]) < 0.02
    assert m.rmse(y, matrix(m.predict(rows), "y")) < 0.1


def test_scalers(rows):
    mean, sd = X.mean(0), X.std(0)
    s = ml.StandardScaler().fit(rows)
    np.testing.assert_allclose(matrix(s.transform(rows)), (X - mean) / sd)
    np.testing.assert_allclose(matrix(s.inverse_transform(s.transform(rows))), X)
    np.testing.assert_allclose(matrix(ml.MinMaxScaler((0, 2)).fit_transform(rows)), 2 * (X - X.min(0)) / np.ptp(X, 0))
    np.testing.assert_allclose(matrix(ml.MaxAbsScaler().fit_transform(rows)), X / np.abs(X).max(0))
    q = np.percentile(X, [25, 50, 75], axis=0)
    np.testing.assert_allclose(matrix(ml.RobustScaler().fit_transform(rows)), (X - q[1]) / (q[2] - q[0]))
    for n, f in (("l1", lambda a: np.abs(a).sum(1)), ("l2", lambda a: np.sqrt((a * a).sum(1))), ("max", lambda a: np.abs(a).max(1))):
        np.testing.assert_allclose(matrix(ml.Normalizer(n).transform(rows)), X / f(X)[:, None])
    with pytest.raises(NotImplementedError):
        ml.StandardScaler().fit(rows, sample_weight=1)


def test_pca(rows):
    centred = X - X.mean(0)
    s = np.linalg.svd(centred, compute_uv=False)
    p = ml.PCA(2).fit(rows)
    np.testing.assert_allclose(p.singular_values_, s[:2])
    np.testing.assert_allclose(p.explained_variance_ratio_, s[:2] ** 2 / (s**2).sum())
    full = ml.PCA().fit(rows)
    np.testing.assert_allclose(matrix(full.inverse_transform(full.transform(rows))), X)
    np.testing.assert_allclose(matrix(ml.PCA(3, whiten=True).fit_transform(rows)).std(0, ddof=1), 1)
    i = ml.IncrementalPCA().fit(rows, chunk_size=17)
    np.testing.assert_allclose(i.singular_values_, s)
    np.testing.assert_allclose(np.abs(i.components_), np.abs(full.components_), rtol=1e-6)


def test_dynamic_modes(spark):
    a = np.array([[0.9, 0.2], [-0.2, 0.9]])
    z = [np.array([1.0, 0.5])]
    for _ in range(9):
        z.append(a @ z[-1])
    lift = rng.normal(size=(12, 2))
    data = lift @ np.array(z).T
    d = ml.DMD().fit(mq.array(data))
    assert d.n_modes_ == 2
    np.testing.assert_allclose(sorted(np.abs(d.rom_eigenvalues_)), sorted(np.abs(np.linalg.eigvals(a))), rtol=1e-5)
    np.testing.assert_allclose(d.predict_next(mq.array(data[:, :9])).numpy(), data[:, 1:], rtol=1e-4, atol=1e-5)
    np.testing.assert_allclose(d.predict(mq.array(data[:, 0]), [0, 3]).numpy(), data[:, [0, 3]], rtol=1e-4, atol=1e-5)
    u, b = rng.normal(size=(1, 9)), np.array([[1.0], [0.3]])
    z = [np.array([1.0, 0.5])]
    for t in range(9):
        z.append(a @ z[-1] + b @ u[:, t])
    data = lift @ np.array(z).T
    c = ml.DMDc(svd_rank=2).fit(mq.array(data), mq.array(u))
    np.testing.assert_allclose(c.predict(mq.array(data[:, 0]), mq.array(u)).numpy(), data[:, 1:], rtol=1e-4, atol=1e-5)


def test_files(spark, tmp_path):
    a = mq.array(X[:7])
    io.save_csv(a, str(tmp_path / "c"), decimals=6)
    np.testing.assert_allclose(io.load_csv(str(tmp_path / "c"), dtype="float64").numpy(), X[:7], atol=1e-6)
    (tmp_path / "one.csv").write_text("head\n1;2\n3;4\n")
    assert mq.load(str(tmp_path / "one.csv"), header_lines=1, sep=";").tolist() == [[1, 2], [3, 4]]
    io.save_parquet(a, str(tmp_path / "p"))
    np.testing.assert_allclose(io.load_cells(str(tmp_path / "p"), (7, 3)).numpy(), X[:7])
    (tmp_path / "n").mkdir()
    for k in range(2):
        np.save(tmp_path / "n" / f"{k}.npy", np.arange(6).reshape(2, 3) + 10 * k)
    assert io.load_npy_from_path(str(tmp_path / "n")).tolist() == [[0, 1, 2], [3, 4, 5], [10, 11, 12], [13, 14, 15]]
    with pytest.raises(ValueError):
        mq.load("x.unknown")
    if not io.supports_hdf5():
        with pytest.raises(ImportError):
            io.load_hdf5("x.h5", "data")


def test_streams_and_loaders(spark, rows, tmp_path):
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    p = ml.IncrementalPCA()
    streaming.fit_stream(stream, p, checkpoint=str(tmp_path / "ck")).awaitTermination()
    np.testing.assert_allclose(p.singular_values_, np.linalg.svd(X - X.mean(0), compute_uv=False))
    m = streaming.RunningMoments()
    for k in range(3):
        m.update(rows.where(F.col("row_id") % 3 == k).select(F.col("x")[0].alias("v")))
    v = X[:, 0]
    np.testing.assert_allclose([m.mean, m.var(), m.skew(), m.kurtosis()], [v.mean(), v.var(), ((v - v.mean()) ** 3).mean() / v.std() ** 3, ((v - v.mean()) ** 4).mean() / v.var() ** 2 - 3])
    loader = streaming.DataLoader(streaming.Dataset(rows), batch_size=16)
    got = np.vstack(list(loader))
    assert len(loader) == 4 and got.shape == X.shape and np.allclose(np.sort(got[:, 0]), np.sort(X[:, 0]))
    a, b, c, e = streaming.create_train_val_split(rows, rows, 0.7, 1)
    assert a.count() == b.count() and a.count() + c.count() == 60 and c.count() == e.count()
    plateau = streaming.DetectMetricPlateau(patience=2)
    assert [plateau.test_if_improving(x) for x in (5, 4, 4, 4, 4)] == [False, False, False, False, True]


def test_sums_over_pairs_make_no_rows_of_cells(rows, monkeypatch):
    """Silhouettes and spectral clustering take sums where blocks meet: neither the cells nor the Laplacian are built."""
    from mosaiq.operators import distance

    def no(*a, **b):
        raise AssertionError("cells of all pairs")

    monkeypatch.setattr(distance.Laplacian, "construct", no)
    s = ml.Spectral(4, gamma=0.05, n_lanczos=40).fit(mq.array(X))
    assert len(set(zip(matrix(s.labels_, "label"), Y, strict=True))) == 4
    monkeypatch.setattr(distance, "pair_blocks", no)
    assert ml.silhouette_samples(rows, rows).count() == len(X)


def test_silhouette_of_text_labels_and_of_rows_without_one(rows):
    names = rows.select("row_id", F.when(F.col("row_id") == 3, None).otherwise(F.concat(F.lit("c"), F.col("label"))).alias("label"))
    keep = np.arange(len(X)) != 3
    got = {r.row_id: r.silhouette for r in ml.silhouette_samples(rows, names).collect()}
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    assert len(got) == len(X) and got[3] == 0
    for i in np.flatnonzero(keep):
        a = d[i][(Y == Y[i]) & keep].sum() / (((Y == Y[i]) & keep).sum() - 1)
        b = min(d[i][(Y == k) & keep].mean() for k in range(4) if k != Y[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-8


def test_incremental_pca_takes_few_jobs_for_many_chunks(rows, spark, monkeypatch):
    """The same as chunk by chunk, with gaps between the ids, in a number of jobs that doesn't grow with the chunks."""
    from mosaiq.ml import decomposition

    gaps = rows.select((F.col("row_id") + F.when(F.col("row_id") >= 20, 30).otherwise(0)).alias("row_id"), "x").cache()
    one = ml.IncrementalPCA(2)
    for k in range(0, 90, 6):
        if (part := gaps.where(F.col("row_id").between(k, k + 5))).count():
            one.partial_fit(part)
    calls = []
    for limit in (1 << 26, 4 * 72):
        monkeypatch.setattr(decomposition, "CHUNK_BYTES", limit)
        spark.sparkContext.setJobGroup(f"pca{limit}", "")
        two = ml.IncrementalPCA(2).fit(gaps, chunk_size=6)
        calls.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pca{limit}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert two.n_samples_seen_ == one.n_samples_seen_ == len(X)
        np.testing.assert_allclose(two.components_, one.components_, rtol=1e-8, atol=1e-10)
        np.testing.assert_allclose(two.singular_values_, one.singular_values_, rtol=1e-8)
        np.testing.assert_allclose(two.mean_, one.mean_, atol=1e-10)
    assert 0 < calls[0] < 10
