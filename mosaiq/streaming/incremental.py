"""Estimators fed by micro-batches, running moments, shuffled batches for training loops, plateau detection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_stream(stream: DataFrame, estimator, label: str | None = None, checkpoint: str | None = None, trigger: dict | None = None):
    """Feed a streaming frame (row_id, x, and a label column) to partial_fit, one micro-batch after the other.

    The state lives in the estimator on the driver; its size depends on features and classes only.
    """

    def each(batch: DataFrame, _id: int) -> None:
        if batch.isEmpty():
            return
        rows = batch.select("row_id", "x")
        estimator.partial_fit(rows, batch.select("row_id", F.col(label).alias("label"))) if label else estimator.partial_fit(rows)

    w = stream.writeStream.foreachBatch(each)
    w = w.option("checkpointLocation", checkpoint) if checkpoint else w
    return w.trigger(**(trigger or {"availableNow": True})).start()


class RunningMoments:
    """Count, mean, and sums of powers of deviations, merged pairwise: mean, var, skew and kurtosis over batches."""

    def __init__(self):
        self.n, self.mean, self.m2, self.m3, self.m4 = 0, 0.0, 0.0, 0.0, 0.0

    def update(self, df: DataFrame, column: str = "v") -> RunningMoments:
        v = F.col(column).cast("double")
        r = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("v"), F.skewness(v).alias("s"), F.kurtosis(v).alias("k")).first()
        if r.n:
            sd = math.sqrt(r.v)
            self.merge(r.n, r.mean, r.n * r.v, r.n * (r.s or 0.0) * sd**3, r.n * ((r.k or 0.0) + 3) * r.v**2)
        return self

    def merge(self, n, mean, m2, m3, m4) -> None:
        a, b, total, d = self.n, n, self.n + n, mean - self.mean
        m2_ = self.m2 + m2 + d * d * a * b / total
        m3_ = self.m3 + m3 + d**3 * a * b * (a - b) / total**2 + 3 * d * (a * m2 - b * self.m2) / total
        self.m4 = self.m4 + m4 + d**4 * a * b * (a * a - a * b + b * b) / total**3 + 6 * d * d * (a * a * m2 + b * b * self.m2) / total**2 + 4 * d * (a * m3 - b * self.m3) / total
        self.n, self.mean, self.m2, self.m3 = total, self.mean + d * b / total, m2_, m3_

    def var(self, ddof=0):
        return self.m2 / (self.n - ddof)

    def skew(self):
        return math.sqrt(self.n) * self.m3 / self.m2**1.5

    def kurtosis(self):
        return self.n * self.m4 / self.m2**2 - 3


class Dataset:
    """Rows with an optional transform of NumPy batches; shuffles by hash, the same for linked frames."""

    def __init__(self, rows: DataFrame, transforms=None, ishuffle=False, test_set=False, seed=0):
        self.rows, self.transforms, self.seed, self.test_set = rows, transforms, seed, test_set

    def __len__(self):
        return self.rows.count()

    def shuffle(self):
        self.seed += 1
        return self

    def ordered(self) -> DataFrame:
        return dataset_shuffle(self.rows, self.seed) if not self.test_set else self.rows.orderBy("row_id")


DistributedDataset = PartialDataset = Dataset


def dataset_shuffle(rows: DataFrame, seed: int = 0) -> DataFrame:
    return rows.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id")


dataset_ishuffle = dataset_shuffle


class DataLoader:
    """NumPy batches of a dataset, fetched partition by partition."""

    def __init__(self, dataset: Dataset, batch_size=1, drop_last=False, shuffle=True):
        self.dataset, self.batch_size, self.drop_last, self.shuffle = dataset, batch_size, drop_last, shuffle

    def __len__(self):
        n = len(self.dataset)
        return n // self.batch_size if self.drop_last else -(-n // self.batch_size)

    def __iter__(self):
        frame = self.dataset.ordered() if self.shuffle else self.dataset.rows.orderBy("row_id")
        some = []
        for r in frame.select("x").toLocalIterator(prefetchPartitions=True):
            some.append(r.x)
            if len(some) == self.batch_size:
                yield self._done(some)
                some = []
        if some and not self.drop_last:
            yield self._done(some)
        if self.shuffle:
            self.dataset.shuffle()

    def _done(self, some):
        x = np.array(some)
        return self.dataset.transforms(x) if self.dataset.transforms else x


def create_train_val_split(x: DataFrame, y: DataFrame, p: float = 0.95, seed: int | None = None):
    """Both frames, cut by a hash of row_id, so that their rows stay together."""
    u = F.pmod(F.xxhash64("row_id", F.lit(0 if seed is None else seed)), F.lit(2**30)) / float(2**30)
    return x.where(u < p), y.where(u < p), x.where(u >= p), y.where(u >= p)


class DetectMetricPlateau:
    """Whether a metric has stopped to get better for more than ``patience`` tests."""

    def __init__(self, mode="min", patience=10, threshold=1e-4, threshold_mode="rel", cooldown=0):
        if mode not in ("min", "max") or threshold_mode not in ("rel", "abs"):
            raise ValueError("mode is min or max, threshold_mode rel or abs")
        self.mode, self.patience, self.threshold, self.threshold_mode, self.cooldown = mode, patience, threshold, threshold_mode, cooldown
        self.reset()

    def reset(self):
        self.best, self.bad, self.wait = math.inf if self.mode == "min" else -math.inf, 0, 0

    def get_state(self):
        return vars(self).copy()

    def set_state(self, state):
        vars(self).update(state)

    def is_better(self, a, best):
        sign = 1 if self.mode == "min" else -1
        edge = self.threshold * (abs(best) if self.threshold_mode == "rel" and math.isfinite(best) else 1.0)
        return sign * a < sign * best - edge if math.isfinite(best) else True

    def test_if_improving(self, metric) -> bool:
        """True once the plateau is reached; counting starts anew then."""
        if self.is_better(float(metric), self.best):
            self.best, self.bad = float(metric), 0
        else:
            self.bad += 1
        if self.wait > 0:
            self.wait, self.bad = self.wait - 1, 0
        if self.bad > self.patience:
            self.wait, self.bad = self.cooldown, 0
            return True
        return False
