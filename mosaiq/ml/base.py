"""What estimators share: parameters by reflection, and the kinds of estimators."""

from __future__ import annotations

import inspect
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..array import Array
from ..operators.linalg import rows_of


class BaseEstimator:
    def get_params(self, deep=True) -> dict:
        return {k: getattr(self, k) for k in inspect.signature(type(self).__init__).parameters if k != "self"}

    def set_params(self, **params):
        known = self.get_params()
        for k, v in params.items():
            if k not in known:
                raise ValueError(f"no parameter {k!r}")
            setattr(self, k, v)
        return self

    def __repr__(self):
        return f"{type(self).__name__}({json.dumps(self.get_params(), default=str)})"


class ClassificationMixin:
    def fit_predict(self, x, y):
        return self.fit(x, y).predict(x)


class TransformMixin:
    def fit_transform(self, x):
        return self.fit(x).transform(x)


class ClusteringMixin:
    def fit_predict(self, x):
        return self.fit(x).predict(x)


class RegressionMixin:
    def fit_predict(self, x, y):
        return self.fit(x, y).predict(x)


def is_estimator(e):
    return isinstance(e, BaseEstimator)


def is_classifier(e):
    return isinstance(e, ClassificationMixin)


def is_transformer(e):
    return isinstance(e, TransformMixin)


def is_clusterer(e):
    return isinstance(e, ClusteringMixin)


def is_regressor(e):
    return isinstance(e, RegressionMixin)


def vectors(x) -> DataFrame:
    """row_id, x of a 2-D array or of a frame that has them."""
    return rows_of(x) if isinstance(x, Array) else x.select("row_id", F.col("x").cast("array<double>").alias("x"))


def width(rows: DataFrame) -> int:
    r = rows.select(F.size("x").alias("n")).first()
    return r.n if r else 0


def literal(v):
    return F.array(*[F.lit(float(x)) for x in v])


def square_distance(x, centre):
    """Squared Euclidean distance of an array column and a list of numbers, or another array column."""
    c = literal(centre) if isinstance(centre, list) or hasattr(centre, "tolist") else centre
    return F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def absolute_distance(x, centre):
    c = literal(centre) if isinstance(centre, list) or hasattr(centre, "tolist") else centre
    return F.aggregate(F.zip_with(x, c, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)


def by_feature(rows: DataFrame, *aggregates, group: str | None = None) -> DataFrame:
    """Aggregates of every feature v (of every group): j, and the aggregates."""
    long = rows.select(*([group] if group else []), F.posexplode("x").alias("j", "v"))
    return long.groupBy(*([group] if group else []), "j").agg(*aggregates)
