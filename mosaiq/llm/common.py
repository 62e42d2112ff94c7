"""Shared helpers: scratch tables in the cluster's shared folder, batching, partition counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="mosaiq-scratch-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Parquet tables of one operator call, in the shared folder.

    ``save`` writes a frame and returns a frame that reads it back, so the lineage before it is cut and
    survives the loss of executors. The shuffle files of the write go as soon as it ends: nothing reads them any more.
    Tables that a lazy result still reads stay until the application ends.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark)}/mosaiq/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._end)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, before = self.path(name), self.spark.conf.get(self.CLEAN)
        self.spark.conf.set(self.CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._mosaiq_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_mosaiq_path", None):
                delete_path(self.spark, path)

    def _end(self) -> None:
        try:
            delete_path(self.spark, self.base)
        except Exception:  # noqa: BLE001  the session is gone, and with it the way to its store
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits places for the values of the first column: set bits are gathered in words of 32."""
    c = F.shiftrightunsigned(F.col(values.columns[0]), 7).bitwiseAND(F.lit(2**bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(F.lit(31)).cast("int"))
    words = values.select(F.shiftright(c, 5).alias("w"), one.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(2 ** (bits - 5), "<u4")
    for r in words.collect():  # 2**(bits - 5) rows at most
        out[r.w] = r.bits
    return out.view(np.uint8)


def in_bitmap(x: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    at = (x.view(np.uint64) >> np.uint64(7)) & np.uint64(2**bits - 1)
    return ((held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


ID_BITS = 24


def parted(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose id may be among the ids (the first column), and those whose id isn't.

    So that only the former need be shuffled to meet the ids in a join. A bitmap of the ids is broadcast: words of 64
    bits, at most 2**(ID_BITS - 6) of them for any number of ids.
    """
    place = lambda c: F.xxhash64(F.col(c).cast("bigint"))
    word = lambda c: F.shiftrightunsigned(place(c), 6).bitwiseAND(F.lit(2 ** (ID_BITS - 6) - 1))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), place(c).bitwiseAND(F.lit(63)).cast("int"))
    first = ids.columns[0]
    words = F.broadcast(ids.select(word(first).alias("_word"), bit(first).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    held = (word(column) == F.col("_word")) & (bit(column).bitwiseAND(F.col("_bits")) != 0)
    return docs.join(words, held, "left_semi"), docs.join(words, held, "left_anti")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't among the ids (a column doc_id); a null id stays."""
    held, rest = parted(docs, ids)
    return rest.unionByName(held.join(ids, "doc_id", "left_anti").select(*docs.columns))


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices whose texts hold about ``most`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)
