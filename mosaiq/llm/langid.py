"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place; a text's vector bundles (adds) those of its trigrams, a language's prototype
those of its training texts. A text takes the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_blocks

SLOTS = 128
_tables: dict[str, np.ndarray] = {}


def slots() -> np.ndarray:
    """Code point -> slot: 0 for what is no letter, 1..26 for a-z, a hashed slot for every other letter."""
    if "slots" not in _tables:
        t = np.zeros(0x110000, np.uint8)
        letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
        t[letters] = 27 + (letters * 2654435761 >> 7) % (SLOTS - 27)
        t[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _tables["slots"] = t
    return _tables["slots"]


def trigrams(text: str) -> np.ndarray:
    """Codes of a text's letter trigrams, with one boundary sign for each run of other characters."""
    s = slots()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
    if not s.any():
        return np.empty(0, np.int32)
    s = np.concatenate([[0], s, [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    return (s[:-2] * SLOTS + s[1:-1]) * SLOTS + s[2:]


class Space:
    """Letter vectors from a seed, and a bounded cache of trigram vectors."""

    def __init__(self, dims: int, seed: int, most: int = 16384):
        letter = np.random.default_rng(seed).integers(0, 2, (SLOTS, dims), np.int8) * 2 - 1
        self.by_place = [np.roll(letter, 2 - k, axis=1) for k in range(3)]
        self.dims, self.most, self.n = dims, most, 0
        self.row = np.full(SLOTS**3, -1, np.int32)
        self.cache = np.empty((256, dims), np.float32)

    def make(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = self.by_place
        return (a[codes // SLOTS**2] * b[codes // SLOTS % SLOTS] * c[codes % SLOTS]).astype(np.float32)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.row[codes] < 0]
        if len(new):
            if self.n + len(new) > self.most:
                return self.make(codes)
            while self.n + len(new) > len(self.cache):
                self.cache = np.concatenate([self.cache, np.empty_like(self.cache)])
            self.cache[self.n : self.n + len(new)] = self.make(new)
            self.row[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
        return self.cache[self.row[codes]]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dims, np.float64)
        for i in range(0, len(codes), 4096):
            out += counts[i : i + 4096].astype(np.float32) @ self.vectors(codes[i : i + 4096])
        return out


def space(dims: int, seed: int) -> Space:
    key = f"{dims} {seed}"
    if key not in _tables:
        _tables[key] = Space(dims, seed)
    return _tables[key]


def forget(dims: int, seed: int) -> None:
    """Let a space go at the end of a task: Python workers are used again, by other operators too."""
    _tables.pop(f"{dims} {seed}", None)


def fit_languages(docs: DataFrame, dims: int = 1024, seed: int = 8) -> dict[str, np.ndarray]:
    """Prototypes of the languages of ``docs`` (text, lang): unit vectors, one for each lang, on the driver.

    Rows with null text or lang, and texts without letters, teach nothing. The result holds languages times
    dims numbers, however many documents there are; sums are taken by partition before they are shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in text_blocks(batches):
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(trigrams(text))
            for lang, codes in by_lang.items():
                at, n = np.unique(np.concatenate(codes), return_counts=True)
                if len(at):
                    total.setdefault(lang, np.zeros(SLOTS**3, np.int64))[at] += n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            v = space(dims, seed).bundle(at, n[at])
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dims, "at": pa.array(range(dims), pa.int32()), "v": v})
        forget(dims, seed)

    rows = docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(run, "lang string, at int, v double")
    sums = rows.groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in sums:
        out.setdefault(r.lang, np.zeros(dims))[r.at] = r.v
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if v.any()}


def predict_languages(docs: DataFrame, prototypes: dict[str, np.ndarray], dims: int = 1024, seed: int = 8, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, lang_pred, score (the cosine, 0 at least); with ``keep_text`` all of its columns too.

    ``und`` with score 0 for a null text, one without a letter, or if no language was learned; of equal
    cosines the first language in order. Rows are independent; other columns are ignored, or passed on, but
    for those named lang_pred and score, which are replaced.
    """
    names, matrix = list(prototypes), np.array(list(prototypes.values()), np.float64).reshape(-1, dims)
    docs = docs.drop("lang_pred", "score") if keep_text else docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    passed = docs.columns if keep_text else ["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = space(dims, seed)
        for b in text_blocks(batches):
            lang, score = [], []
            for text in b.column("text").to_pylist():
                codes = trigrams(text or "")
                if not len(codes) or not names:
                    lang.append("und")
                    score.append(0.0)
                    continue
                at, n = np.unique(codes, return_counts=True)
                v = sp.bundle(at, n)
                cos = matrix @ v / (np.linalg.norm(v) or 1)
                lang.append(names[k := int(cos.argmax())])
                score.append(min(1.0, max(0.0, float(cos[k]))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*passed, "lang_pred", "score"])
        forget(dims, seed)

    schema = T.StructType([docs.schema[c] for c in passed] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)
