"""Nearest neighbours, Gaussian naive Bayes, Lasso."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators.distance import euclidean_fast
from ..operators.linalg import gram
from .base import BaseEstimator, ClassificationMixin, RegressionMixin, by_feature, literal, vectors, width


class KNeighborsClassifier(BaseEstimator, ClassificationMixin):
    """Majority of the k nearest rows; of equal votes the smallest label, of equally near rows the smallest row_id.

    Training rows are cut into blocks; every task keeps the k best of its blocks for its queries, then they meet.
    """

    def __init__(self, n_neighbors=5, effective_metric_=None, block=2048):
        self.n_neighbors, self.effective_metric_, self.block = n_neighbors, effective_metric_, block

    @staticmethod
    def one_hot_encoding(y):
        classes = [r[0] for r in y.select("label").distinct().orderBy("label").collect()]
        return y.select("row_id", F.array(*[(F.col("label") == c).cast("double") for c in classes]).alias("x"))

    def fit(self, x, y):
        self.train = vectors(x).join(y.select("row_id", "label"), "row_id")
        return self

    def neighbours(self, x):
        k, metric = self.n_neighbors, self.effective_metric_ or euclidean_fast
        cut = lambda df, name, *c: df.groupBy(F.call_function("div", F.col("row_id"), F.lit(self.block)).alias(f"b{name}")).agg(F.collect_list(F.struct("row_id", "x", *c)).alias(name))
        pairs = cut(vectors(x), "q").crossJoin(cut(self.train, "t", "label")).select("q", "t")

        def run(batches):
            for b in batches:
                for r in range(b.num_rows):
                    q, t = b.column("q")[r].as_py(), b.column("t")[r].as_py()
                    ids = np.array([p["row_id"] for p in t])
                    d = np.asarray(metric(np.array([p["x"] for p in q], float), np.array([p["x"] for p in t], float)))
                    at = np.stack([np.lexsort((ids, row))[:k] for row in d])
                    yield pa.RecordBatch.from_pydict({"row_id": np.repeat([p["row_id"] for p in q], at.shape[1]), "d": np.take_along_axis(d, at, 1).ravel(), "near": ids[at].ravel(), "label": [int(t[j]["label"]) for j in at.ravel()]})

        found = pairs.mapInArrow(run, "row_id bigint, d double, near bigint, label bigint")
        best = found.groupBy("row_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "near", "label"))), 1, k).alias("n"))  # k from each block
        return best.select("row_id", F.posexplode("n").alias("place", "n")).select("row_id", "place", "n.d", "n.near", "n.label")

    def predict(self, x):
        votes = self.neighbours(x).groupBy("row_id", "label").agg(F.count("*").alias("n"))
        return votes.groupBy("row_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))


class GaussianNB(BaseEstimator, ClassificationMixin):
    """Means and variances of every feature by class; partial fits merge counts, means and sums of squares."""

    def __init__(self, priors=None, var_smoothing=1e-9):
        self.priors, self.var_smoothing = priors, var_smoothing

    def fit(self, x, y, sample_weight=None):
        self._state = None
        return self.partial_fit(x, y, None, sample_weight)

    def partial_fit(self, x, y, classes=None, sample_weight=None):
        rows = vectors(x).join(y.select("row_id", "label"), "row_id")
        w = F.lit(1.0)
        if sample_weight is not None:
            rows, w = rows.join(sample_weight.select("row_id", F.col("weight").cast("double").alias("_w")), "row_id"), F.col("_w")
        long = rows.select("label", w.alias("_w"), F.posexplode("x").alias("j", "v"))
        t = long.groupBy("label", "j").agg(F.sum("_w").alias("n"), (F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("mean"))
        off = F.col("v") - F.col("mean")  # squares are taken around the mean, so large means lose no digits
        t = long.join(t, ["label", "j"]).groupBy("label", "j").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("_w") * off * off).alias("m2")).toPandas()
        spread = by_feature(vectors(x), F.var_pop("v").alias("v")).agg(F.max("v")).first()[0] or 0.0
        self.epsilon_ = self.var_smoothing * spread
        state = dict(getattr(self, "_state", None) or {})
        for label, g in t.groupby("label"):
            g = g.sort_values("j")
            n, mean = g["n"].to_numpy()[0], g["mean"].to_numpy()
            m2 = g["m2"].to_numpy()
            if label in state:
                n0, mean0, m20 = state[label]
                d = mean - mean0
                mean, m2, n = mean0 + d * n / (n + n0), m20 + m2 + d * d * n * n0 / (n + n0), n + n0
            state[label] = (n, mean, m2)
        for c in classes if classes is not None else ():
            state.setdefault(c, (0.0, np.zeros(width(rows)), np.zeros(width(rows))))
        self._state = state
        self.classes_ = sorted(state)
        self.class_count_ = np.array([state[c][0] for c in self.classes_])
        self.theta_ = np.array([state[c][1] for c in self.classes_])
        self.var_ = np.array([state[c][2] / max(state[c][0], 1e-300) for c in self.classes_]) + self.epsilon_
        prior = self.class_count_ / self.class_count_.sum() if self.priors is None else np.asarray(self.priors, float)
        if len(prior) != len(self.classes_) or abs(prior.sum() - 1) > 1e-8 or (prior < 0).any():
            raise ValueError("priors must be one number a class that sum to 1")
        self.class_prior_ = prior
        return self

    @staticmethod
    def logsumexp(a, axis=None, b=None, keepdims=False, return_sign=False):
        a = np.asarray(a, float)
        top = a.max(axis=axis, keepdims=True)
        s = (np.exp(a - top) * (1 if b is None else b)).sum(axis=axis, keepdims=True)
        out = np.log(np.abs(s)) + top
        out = out if keepdims else np.squeeze(out, axis)
        return (out, np.sign(s if keepdims else np.squeeze(s, axis))) if return_sign else out

    def _joint(self, x):
        terms = []
        for k in range(len(self.classes_)):
            if self.class_count_[k] == 0:
                terms.append(F.lit(-np.inf))
                continue
            base = float(np.log(max(self.class_prior_[k], 1e-300)) - 0.5 * np.log(2 * np.pi * self.var_[k]).sum())
            z = F.zip_with("x", literal(self.theta_[k]), lambda v, m: (v - m) * (v - m))
            z = F.zip_with(z, literal(self.var_[k]), lambda s, v: s / v)
            terms.append(F.lit(base) - 0.5 * F.aggregate(z, F.lit(0.0), lambda s, v: s + v))
        return vectors(x).select("row_id", F.array(*terms).alias("joint"))

    def predict(self, x):
        at = F.array_position("joint", F.array_max("joint")).cast("int")
        return self._joint(x).select("row_id", F.element_at(F.array(*[F.lit(c) for c in self.classes_]), at).alias("label"))

    def predict_log_proba(self, x):
        top = F.array_max("joint")
        total = top + F.log(F.aggregate(F.transform("joint", lambda v: F.exp(v - F.array_max("joint"))), F.lit(0.0), lambda s, v: s + v))
        return self._joint(x).withColumn("_t", total).select("row_id", F.transform("joint", lambda v: v - F.col("_t")).alias("x"))

    def predict_proba(self, x):
        return self.predict_log_proba(x).select("row_id", F.transform("x", lambda v: F.exp(v)).alias("x"))


class Lasso(BaseEstimator, RegressionMixin):
    """Coordinate descent on the Gram matrix, which one pass over the rows sums; column 0 (ones) isn't penalised.

    Features are expected on one scale: the step of a coordinate isn't divided by its norm beyond the number of rows.
    """

    def __init__(self, lam=0.1, max_iter=100, tol=1e-6):
        self.lam, self.max_iter, self.tol = lam, max_iter, tol

    def soft_threshold(self, rho):
        return float(np.sign(rho) * max(abs(rho) - self.lam, 0.0))

    @staticmethod
    def rmse(gt, yest):
        return float(np.sqrt(np.mean((np.asarray(gt, float) - np.asarray(yest, float)) ** 2)))

    def fit(self, x, y):
        rows = vectors(x).join(y.select("row_id", F.col("y").cast("double").alias("y")), "row_id")
        g = gram(rows.select("row_id", F.concat("x", F.array("y")).alias("x")))
        n, d = rows.count(), len(g) - 1
        a, b = g[:d, :d] / n, g[:d, d] / n
        theta = np.zeros(d)
        self.n_iter_ = 0
        for _ in range(self.max_iter):
            self.n_iter_ += 1
            old = theta.copy()
            for j in range(d):
                rho = b[j] - a[j] @ theta + a[j, j] * theta[j]
                theta[j] = rho if j == 0 else self.soft_threshold(rho)
            if self.rmse(old, theta) < self.tol:
                break
        self.theta = theta
        return self

    coef_ = property(lambda self: None if getattr(self, "theta", None) is None else self.theta[1:])
    intercept_ = property(lambda self: None if getattr(self, "theta", None) is None else self.theta[0])

    def predict(self, x):
        return vectors(x).select("row_id", F.aggregate(F.zip_with("x", literal(self.theta), lambda v, t: v * t), F.lit(0.0), lambda s, v: s + v).alias("y"))


