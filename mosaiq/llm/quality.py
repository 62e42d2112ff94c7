"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document is described by a few statistics of its whole text. Random Fourier features approximate a Gaussian
kernel over them; normal equations, summed by partition, fit ridge scores of the labels; isotonic regression over
a fixed grid of raw scores turns them into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, text_blocks
from .words import as_bytes, gram_hashes, segment, word_hashes

NAMES = ("log_bytes", "log_words", "word_len", "upper", "digit", "punct", "symbol", "pipe", "bang", "high", "line_len", "distinct_words", "repeat_next", "top_word", "distinct_pairs", "distinct_lines", "one_byte_words", "end_symbol")


def byte_class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.float32)
    t[list(chars)] = 1
    return t


CLASSES = np.stack([byte_class(x) for x in (bytes(range(65, 91)), b"0123456789", b".,;:'\"-()?", b"#$%&*@^~<>{}[]\\/_+=", b"|", b"!", bytes(range(128, 256)), b"\n", bytes(range(33, 127)))])


def distinct_by_text(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the largest count of one value, for each text."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(h):
        order = np.lexsort((h, doc))
        d, v = doc[order], h[order]
        head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
        np.add.at(distinct, d[head], 1)
        np.maximum.at(most, d[head], np.diff(np.append(head, len(d))))
    return distinct, most


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each text; a text without words gives zeros but for its size."""
    w = segment(texts, lower=False)
    n = len(w)
    h, doc = word_hashes(w), w.doc
    size = np.array([len(t) for t in texts], np.float64)
    words = np.diff(w.first).astype(np.float64)
    count = np.zeros((len(CLASSES), n))
    for k, t in enumerate(CLASSES):
        total = np.concatenate([[0], np.cumsum(t[w.data], dtype=np.float64)])
        count[k] = total[w.text_start[1:] - 1] - total[w.text_start[:-1]]
    some, per = np.maximum(size, 1), np.maximum(words, 1)
    distinct, most = distinct_by_text(h, doc, n)
    pairs = gram_hashes(h, 2)
    same = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.empty(0, np.int64)
    distinct_pairs, _ = distinct_by_text(pairs[same], doc[same], n)
    again = np.bincount(doc[same], h[same] == h[same + 1], n) if len(same) else np.zeros(n)
    lines = np.array([len(set(t.split(b"\n"))) / (t.count(b"\n") + 1) for t in texts])
    one = np.bincount(doc, w.end - w.start == 1, n) if len(doc) else np.zeros(n)
    last = np.bincount(doc, CLASSES[3][w.data[w.end - 1]] + CLASSES[5][w.data[w.end - 1]], n) if len(doc) else np.zeros(n)
    length = np.bincount(doc, w.end - w.start, n) if len(doc) else np.zeros(n)
    x = [np.log1p(size), np.log1p(words), length / per, *(count[:7] / some), np.log1p(size / (count[7] + 1)), distinct / per, again / per, most / per, distinct_pairs / per, lines, one / per, last / per]
    return np.stack(x, 1).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics x."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            x = statistics(as_bytes(b.column("text")))
            yield batch(schema, doc_id=b.column("doc_id"), x=pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel())))

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, x array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    direction: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    at: np.ndarray  # calibration: raw scores, in order
    to: np.ndarray  # and their probabilities

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.direction, self.phase) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.to), 0.0, 1.0)


def fourier(x: np.ndarray, mean, scale, direction, phase) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([np.sqrt(2 / len(phase)) * np.cos(z @ direction + phase), np.ones((len(x), 1))], axis=1)


def to_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def summed(rows: DataFrame, fn, size: int) -> np.ndarray:
    """The sum over all rows of fn(x, y), a flat array of ``size``: by partition, then by eight tasks, then here."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for b in batches:
            if b.num_rows:
                total, some = total + fn(to_matrix(b.column("x")), b.column("y").to_numpy()), True
        if some:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for v in b.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("x", "y").mapInArrow(partial, "v binary").repartition(8).mapInArrow(merge, "v binary").collect()
    return np.sum([np.frombuffer(r.v) for r in sums] + [np.zeros(size)], axis=0)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit with the least weighted squares: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (a, m, i), (b, n, j) = pools[-2:]
            pools[-2:] = [[(a * m + b * n) / (m + n), m + n, i + j]]
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def fit(rows: DataFrame, dims: int = 256, gamma: float = 0.05, ridge: float = 1e-3, grid: int = 200, seed: int = 4, most_rows: int = 1_000_000) -> Model:
    """Fit on rows (doc_id, x, y), y 0 or 1. Of more than ``most_rows`` rows, about so many are used, by a hash of their ids."""
    share = int(2**20 * min(1.0, most_rows / max(1, rows.count())))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**20)) < share).select("x", F.col("y").cast("double").alias("y"))
    d = len(NAMES)
    s = summed(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    n = max(s[0], 1.0)
    mean = s[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(s[2 + d :] / n - mean**2, 0)) + 1e-3
    rng = np.random.default_rng(seed)
    direction, phase = rng.normal(0, np.sqrt(2 * gamma), (d, dims)), rng.uniform(0, 2 * np.pi, dims)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x, mean, scale, direction, phase)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    m = dims + 1
    eq = summed(rows, normal, m * m + m)
    weight = np.linalg.solve(eq[: m * m].reshape(m, m) + ridge * n * np.eye(m) / dims, eq[m * m :])

    def by_bin(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.clip(np.round(fourier(x, mean, scale, direction, phase) @ weight * grid), -grid, 2 * grid).astype(int) + grid
        return np.concatenate([np.bincount(k, minlength=3 * grid + 1), np.bincount(k, y, 3 * grid + 1)])

    bins = summed(rows, by_bin, 2 * (3 * grid + 1)).reshape(2, -1)
    used = np.flatnonzero(bins[0])
    if not len(used):  # nothing learned: every score is one half
        return Model(mean, scale, direction, phase, weight, np.array([0.0]), np.array([0.5]))
    smooth = (bins[1] + s[1] / n)[used] / (bins[0][used] + 1)
    return Model(mean, scale, direction, phase, weight, (used - grid) / grid, isotonic(smooth, bins[0][used]))


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row (doc_id, x)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(schema, doc_id=b.column("doc_id"), score=model.score(to_matrix(b.column("x"))))

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")


def score_documents(docs: DataFrame, labels: DataFrame, learn=None, **params) -> DataFrame:
    """Fit on labelled documents for which ``learn`` (a condition on doc_id) holds, then score all: doc_id, score.

    Null labels and null ids teach nothing; of several labels of a document, each counts. Null and empty texts
    are scored like any other. With no labels all scores are 0.5. Repeated rows give a row each, an empty table
    none; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    x = scratch.save(features(docs), "features")
    y = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("y")).where("doc_id is not null and y is not null")
    train = scratch.save(x.join(y if learn is None else y.where(learn), "doc_id"), "train")
    return predict(x, fit(train, **params))
