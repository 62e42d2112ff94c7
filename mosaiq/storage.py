"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one, on a local master only."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="mosaiq-scratch-"))
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _gone(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # noqa: BLE001  the session is gone, and with it the way to its store
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """A frame written as Parquet and read again: every reader sees the same rows. It stays until the program ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/mosaiq/{name}-{uuid.uuid4().hex}"
    atexit.register(_gone, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
