"""Scalers of features. Fitting aggregates every feature once; transforming is a projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles
from .base import BaseEstimator, TransformMixin, by_feature, literal, vectors

TINY = 1e-14


def _fitted(rows, *aggs):
    table = by_feature(rows, *aggs).toPandas().sort_values("j")
    return {c: table[c].to_numpy(float) for c in table.columns if c != "j"}


class _Affine(BaseEstimator, TransformMixin):
    """y = (x - shift) * factor + add."""

    shift = factor = add = None

    def transform(self, x):
        y = F.zip_with("x", F.zip_with(literal(self.shift), literal(self.factor), lambda s, f: F.struct(s.alias("s"), f.alias("f"))), lambda v, p: (v - p.s) * p.f)
        y = F.zip_with(y, literal(self.add), lambda v, a: v + a)
        return vectors(x).select("row_id", self._last(y).alias("x"))

    def _last(self, y):
        return y

    def inverse_transform(self, y):
        back = F.zip_with(F.zip_with("x", literal(self.add), lambda v, a: v - a), F.zip_with(literal(self.shift), literal(self.factor), lambda s, f: F.struct(s.alias("s"), f.alias("f"))), lambda v, p: v / p.f + p.s)
        return vectors(y).select("row_id", back.alias("x"))


class StandardScaler(_Affine):
    """Mean 0 and population variance 1; features of (almost) no variance are only centred."""

    def __init__(self, *, copy=True, with_mean=True, with_std=True):
        self.copy, self.with_mean, self.with_std = copy, with_mean, with_std

    def fit(self, x, sample_weight=None):
        if sample_weight is not None:
            raise NotImplementedError("no sample weights")
        t = _fitted(vectors(x), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
        self.mean_, self.var_ = t["mean"], t["var"]
        self.shift = self.mean_ if self.with_mean else np.zeros_like(self.mean_)
        self.factor = np.where(self.var_ > TINY, 1 / np.sqrt(np.maximum(self.var_, TINY)), 1.0) if self.with_std else np.ones_like(self.mean_)
        self.add = np.zeros_like(self.mean_)
        return self


class MinMaxScaler(_Affine):
    def __init__(self, feature_range=(0.0, 1.0), *, copy=True, clip=False):
        if feature_range[0] >= feature_range[1]:
            raise ValueError("the range must grow")
        self.feature_range, self.copy, self.clip = feature_range, copy, clip

    def fit(self, x):
        t = _fitted(vectors(x), F.min("v").alias("lo"), F.max("v").alias("hi"))
        self.data_min_, self.data_max_ = t["lo"], t["hi"]
        span = self.data_max_ - self.data_min_
        low, high = self.feature_range
        self.shift, self.factor, self.add = self.data_min_, (high - low) / np.where(span > TINY, span, 1.0), np.full_like(span, low)
        return self

    def _last(self, y):
        low, high = (float(v) for v in self.feature_range)
        return F.transform(y, lambda v: F.greatest(F.least(v, F.lit(high)), F.lit(low))) if self.clip else y


class MaxAbsScaler(_Affine):
    def __init__(self, *, copy=True):
        self.copy = copy

    def fit(self, x):
        self.max_abs_ = _fitted(vectors(x), F.max(F.abs("v")).alias("m"))["m"]
        self.shift = self.add = np.zeros_like(self.max_abs_)
        self.factor = 1 / np.where(self.max_abs_ > TINY, self.max_abs_, 1.0)
        return self


class RobustScaler(_Affine):
    """Centre at the median, scale by the range between two percentiles; sketched percentiles on request."""

    def __init__(self, *, with_centering=True, with_scaling=True, quantile_range=(25.0, 75.0), copy=True, unit_variance=False, sketched=False, sketch_size=None):
        self.with_centering, self.with_scaling, self.quantile_range, self.copy, self.unit_variance, self.sketched, self.sketch_size = with_centering, with_scaling, quantile_range, copy, unit_variance, sketched, sketch_size

    def fit(self, x):
        if self.unit_variance:
            raise NotImplementedError("no unit variance")
        qs = [50, *self.quantile_range]
        if self.sketched:
            t = _fitted(vectors(x), *[F.percentile_approx("v", q / 100).alias(f"p{k}") for k, q in enumerate(qs)])
        else:
            long = vectors(x).select(F.posexplode("x").alias("j", "v"))
            table = percentiles(long, ["j"], F.col("v"), qs).toPandas().sort_values("j")
            t = {c: table[c].to_numpy(float) for c in ("p0", "p1", "p2")}
        self.center_, self.iqr_ = t["p0"], t["p2"] - t["p1"]
        self.shift = self.center_ if self.with_centering else np.zeros_like(self.center_)
        self.factor = 1 / np.where(self.iqr_ > TINY, self.iqr_, 1.0) if self.with_scaling else np.ones_like(self.center_)
        self.add = np.zeros_like(self.center_)
        return self


class Normalizer(BaseEstimator, TransformMixin):
    """Rows of norm 1 (l1, l2 or max); rows of (almost) no norm stay."""

    def __init__(self, norm="l2", *, copy=True):
        if norm not in ("l1", "l2", "max"):
            raise NotImplementedError("norm is l1, l2 or max")
        self.norm, self.copy = norm, copy

    def fit(self, x):
        return self

    def transform(self, x):
        a = F.transform("x", lambda v: F.abs(v))
        total = lambda f: F.aggregate("x", F.lit(0.0), f)
        n = {"l1": total(lambda s, v: s + F.abs(v)), "l2": F.sqrt(total(lambda s, v: s + v * v)), "max": F.array_max(a)}[self.norm]
        rows = vectors(x).withColumn("_n", n)
        return rows.select("row_id", F.transform("x", lambda v: F.when(F.col("_n") > TINY, v / F.nullif(F.col("_n"), F.lit(0.0))).otherwise(v)).alias("x"))
