"""Clustering. Centres are small and stay on the driver; rows are assigned by expression and summed by partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..array import Array, number_rows
from ..operators.distance import Laplacian, cdist, euclidean, packed, pair_sums, rbf
from ..operators.linalg import krylov, matrix, reduced
from .base import BaseEstimator, ClusteringMixin, absolute_distance, square_distance, vectors


def assigned(rows, centres, metric=square_distance):
    """row_id, x, label, cost: the nearest centre, of equally near ones the first."""
    d = [F.struct(metric(F.col("x"), list(map(float, c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]
    best = F.array_min(F.array(*d))
    return rows.withColumn("_b", best).select("row_id", "x", F.col("_b.k").alias("label"), F.col("_b.d").alias("cost"))


class _KCluster(BaseEstimator, ClusteringMixin):
    metric = staticmethod(square_distance)

    def _init(self, rows, k):
        """Starting centres: given ones, rows drawn by hash, or kmeans-parallel (k-means++ over oversampled rows)."""
        seed = 0 if self.random_state is None else int(self.random_state)
        if isinstance(self.init, Array | np.ndarray | list):
            c = np.asarray(self.init, dtype=float)
            if c.shape[0] != k:
                raise ValueError("init has another number of centres")
            return c
        draw = lambda n, s: np.array([r.x for r in rows.orderBy(F.xxhash64("row_id", F.lit(s)), "row_id").limit(n).collect()], float)
        if self.init == "random":
            return draw(k, seed)
        if self.init not in ("kmeans++", "k-means++", "probability_based", "k-medians++", "kmedoids++", "kmedians++"):
            raise ValueError(f"unknown init {self.init!r}")
        chosen = draw(1, seed)
        for step in range(5):  # each round adds about 2k rows, by their share of the cost
            cost = assigned(rows, chosen, self.metric)
            total = cost.agg(F.sum("cost")).first()[0] or 0.0
            if total <= 0:
                break
            u = F.pmod(F.xxhash64("row_id", F.lit(seed + 1 + step)), F.lit(2**40)) / float(2**40)
            new = [r.x for r in cost.where(u < F.col("cost") * (2.0 * k / total)).select("x").collect()]  # 2k rows expected
            chosen = np.vstack([chosen, np.array(new, float)]) if new else chosen
        weights = np.zeros(len(chosen))
        for r in assigned(rows, chosen, self.metric).groupBy("label").count().collect():
            weights[r.label] = r["count"]
        rng, picked = np.random.default_rng(seed), [int(weights.argmax())]
        while len(picked) < k and len(picked) < len(chosen):
            d = ((chosen[:, None] - chosen[picked][None]) ** 2).sum(2).min(1) * weights
            picked.append(int(rng.choice(len(chosen), p=d / d.sum())) if d.sum() > 0 else int(np.setdiff1d(range(len(chosen)), picked)[0]))
        out = chosen[picked]
        return out if len(out) == k else np.vstack([out, draw(k, seed + 99)])[:k]

    def _step(self, rows, centres):
        return self._update(assigned(rows, centres, self.metric), centres)

    def fit(self, x, oversampling=2, iter_multiplier=1):
        rows = vectors(x).cache()
        centres = self._init(rows, self.n_clusters)
        self._n_iter = 0
        for _ in range(self.max_iter):
            self._n_iter += 1
            new = self._step(rows, centres)
            moved = float(((new - centres) ** 2).sum())
            centres = new
            if moved <= (self.tol or 0.0):
                break
        self._centres = centres
        self._labels = assigned(rows, centres, self.metric)
        self._inertia = float(self._labels.agg(F.sum("cost")).first()[0] or 0.0)
        return self

    def predict(self, x):
        return assigned(vectors(x), self._centres, self.metric).select("row_id", "label")

    cluster_centers_ = property(lambda self: self._centres)
    labels_ = property(lambda self: self._labels.select("row_id", "label"))
    inertia_ = functional_value_ = property(lambda self: self._inertia)
    n_iter_ = property(lambda self: self._n_iter)


class KMeans(_KCluster):
    """Lloyd's steps; a cluster that loses all rows keeps its centre."""

    def __init__(self, n_clusters=8, init="random", max_iter=300, tol=1e-4, random_state=None):
        self.n_clusters, self.init, self.max_iter, self.tol, self.random_state = n_clusters, init, max_iter, tol, random_state

    def _step(self, rows, centres):
        """Counts and sums by partition: centres travel with the task, so no plan is compiled anew."""

        def part(b):
            x = matrix(b)
            label = np.stack([((x - c) ** 2).sum(1) for c in centres], 1).argmin(1)
            out = np.zeros((len(centres), x.shape[1] + 1))
            np.add.at(out, label, np.column_stack([np.ones(len(x)), x]))
            return out

        sums = reduced(rows, part, lambda p, q: p + q)
        return np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centres)


class KMedians(_KCluster):
    metric = staticmethod(absolute_distance)

    def __init__(self, n_clusters=8, init="random", max_iter=300, tol=1e-4, random_state=None):
        self.n_clusters, self.init, self.max_iter, self.tol, self.random_state = n_clusters, init, max_iter, tol, random_state

    def _medians(self, labelled, centres):
        out = centres.copy()
        for r in labelled.select("label", F.posexplode("x").alias("j", "v")).groupBy("label", "j").agg(F.percentile("v", 0.5).alias("m")).collect():
            out[r.label, r.j] = r.m
        return out

    def _update(self, labelled, centres):
        return self._medians(labelled, centres)


class KMedoids(KMedians):
    """Centres are data rows: of all rows the nearest to each cluster's medians."""

    def __init__(self, n_clusters=8, init="random", max_iter=300, random_state=None):
        self.n_clusters, self.init, self.max_iter, self.tol, self.random_state = n_clusters, init, max_iter, 0.0, random_state

    def _update(self, labelled, centres):
        goal = self._medians(labelled, centres)
        near = [F.min(F.struct(absolute_distance(F.col("x"), list(map(float, g))).alias("d"), "row_id", "x")).alias(f"m{k}") for k, g in enumerate(goal)]
        r = labelled.agg(*near).first()
        return np.array([r[f"m{k}"].x for k in range(len(goal))], float)


class _BatchParallel(_KCluster):
    """Each partition is clustered by itself; its centres, with their weights, are clustered again."""

    p = 2

    def fit(self, x):
        k, p, seed, steps = self.n_clusters, self.p, 0 if self.random_state is None else int(self.random_state), self.max_iter

        def local(points, weights, s):
            rng = np.random.default_rng(s)
            c = points[[int(rng.integers(len(points)))]]
            d = lambda c: (np.abs(points[:, None] - c[None]) ** p).sum(2)
            while len(c) < min(k, len(points)):
                w = d(c).min(1) * weights
                c = np.vstack([c, points[[int(rng.choice(len(points), p=w / w.sum())) if w.sum() > 0 else int(rng.integers(len(points)))]]])
            for _ in range(steps):
                label = d(c).argmin(1)
                new = np.array([(np.average(points[label == j], 0, weights[label == j]) if p == 2 else np.median(points[label == j], 0)) if (label == j).any() else c[j] for j in range(len(c))])
                if ((new - c) ** 2).sum() <= self.tol:
                    break
                c = new
            label = d(c).argmin(1)
            return np.column_stack([np.array([weights[label == j].sum() for j in range(len(c))]), c])

        rows = vectors(x).cache()
        part = lambda b: local(matrix(b), np.ones(b.num_rows), seed)
        merge = lambda a, b: local(np.vstack([a, b])[:, 1:], np.maximum(np.vstack([a, b])[:, 0], 1e-9), seed)
        self._centres = reduced(rows, part, merge)[:, 1:]
        self._n_iter = 1
        self._labels = assigned(rows, self._centres, self.metric)
        self._inertia = float(self._labels.agg(F.sum("cost")).first()[0] or 0.0)
        return self


class BatchParallelKMeans(_BatchParallel):
    def __init__(self, n_clusters=8, init="k-means++", max_iter=300, tol=1e-4, random_state=None, n_procs_to_merge=None):
        self.n_clusters, self.init, self.max_iter, self.tol, self.random_state, self.n_procs_to_merge = n_clusters, init, max_iter, tol, random_state, n_procs_to_merge


class BatchParallelKMedians(_BatchParallel):
    p = 1
    metric = staticmethod(absolute_distance)

    def __init__(self, n_clusters=8, init="k-medians++", max_iter=300, tol=1e-4, random_state=None, n_procs_to_merge=None):
        self.n_clusters, self.init, self.max_iter, self.tol, self.random_state, self.n_procs_to_merge = n_clusters, init, max_iter, tol, random_state, n_procs_to_merge


class Spectral(BaseEstimator, ClusteringMixin):
    """KMeans over the smallest eigenvectors of the Laplacian, from Lanczos steps."""

    def __init__(self, n_clusters=None, gamma=1.0, metric="rbf", laplacian="fully_connected", threshold=1.0, boundary="upper", eigen_solver="lanczos", n_lanczos=300, assign_labels="kmeans", **params):
        self.n_clusters, self.gamma, self.metric, self.laplacian, self.threshold, self.boundary, self.n_lanczos, self.params = n_clusters, gamma, metric, laplacian, threshold, boundary, n_lanczos, params
        if metric not in ("rbf", "euclidean"):
            raise NotImplementedError("metric is rbf or euclidean")
        sim = (lambda x: rbf(x, sigma=np.sqrt(1 / (2 * gamma)))) if metric == "rbf" else cdist
        self._laplacian = Laplacian(sim, mode=laplacian, threshold_key=boundary, threshold_value=threshold)

    def _embed(self, x):
        """The number of clusters and row_id, x: the rows in the smallest eigenvectors. The Laplacian itself is never kept."""
        steps = min(self.n_lanczos, x.shape[0])
        v, t = krylov(self._laplacian.operator(x), x.shape[0], steps)
        w, s = np.linalg.eigh(t)
        k = self.n_clusters or int(np.argmax(np.diff(w[: min(len(w), 20)]))) + 1
        e = np.ascontiguousarray(v @ s[:, :k])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1) * k, pa.int32()), pa.array(e.ravel()))
        return k, x.spark.createDataFrame(pa.table({"row_id": pa.array(np.arange(len(e))), "x": lists}))

    def fit(self, x):
        k, e = self._embed(x)
        self.n_clusters_ = k
        self._k = KMeans(k, init="kmeans++", random_state=0, **self.params).fit(e)
        self._seen = x
        return self

    labels_ = property(lambda self: self._k.labels_)

    def predict(self, x):
        if x is not self._seen:
            raise NotImplementedError("only the fitted rows have labels")
        return self.labels_


def silhouette_samples(x, labels, *, metric="euclidean"):
    """row_id, silhouette. Distances are summed by label where a pair of blocks is computed; a cluster of one gives 0.

    ``x``: rows (row_id, x), or their distance matrix as an array if metric is precomputed; labels: row_id, label.
    """
    if metric not in ("euclidean", "precomputed"):
        raise ValueError("metric is euclidean or precomputed")
    labels = labels.select("row_id", "label")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    if metric == "precomputed":
        sums = x.cells().join(labels.toDF("i1", "other"), "i1").groupBy(F.col("i0").alias("row_id"), "other").agg(F.sum("v").alias("s"))
    else:
        sizes = number_rows(sizes.where("label is not null"), ["label"], "k")
        rows = vectors(x)
        top, width = (r := rows.agg(F.max("row_id"), F.max(F.size("x"))).first())[0], r[1]
        if top is None:
            return rows.select("row_id", F.lit(0.0).alias("silhouette"))
        known = labels.join(sizes, "label", "left").select("row_id", F.coalesce("k", F.lit(-1)).alias("w"))

        def by_label(at, w):  # rows without a label count for none
            keys, where = np.unique(w, return_inverse=True)
            m = np.zeros((len(w), len(keys)))
            m[np.arange(len(w)), where] = 1
            return keys[keys >= 0].astype(int), m[:, keys >= 0]

        sums = pair_sums(packed(rows.join(known, "row_id"), width), top + 1, width, euclidean, by_label, apart=True)
        sums = sums.join(sizes.select("k", F.col("label").alias("other")), "k").select("row_id", "other", "s")
        sizes = sizes.select("label", "n")
    full = sums.join(labels, "row_id").join(sizes.toDF("other", "n"), "other")
    own = F.when(F.col("other") == F.col("label"), F.when(F.col("n") > 1, F.col("s") / F.nullif(F.col("n") - 1, F.lit(0))))
    away = F.when(F.col("other") != F.col("label"), F.col("s") / F.col("n"))
    g = full.groupBy("row_id").agg(F.max(own).alias("a"), F.min(away).alias("b"))
    s = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    return g.select("row_id", F.coalesce(s, F.lit(0.0)).alias("silhouette"))


def silhouette_score(x, labels, *, metric="euclidean", sample_size=None, random_state=None):
    if sample_size is not None and metric != "precomputed":
        keep = labels.orderBy(F.xxhash64("row_id", F.lit(random_state or 0))).limit(sample_size)
        rows = vectors(x).join(keep.select("row_id"), "row_id")
        rows = number_rows(rows.join(keep, "row_id"), ["row_id"], "_n").select(F.col("_n").alias("row_id"), "x", "label")
        x, labels = rows, rows
    return silhouette_samples(x, labels, metric=metric).agg(F.avg("silhouette")).first()[0]


