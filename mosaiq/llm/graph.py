"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: each node with the smallest node it reaches by them."""
    parts = [np.stack([b.column("n").to_numpy(), b.column("m").to_numpy()], 1) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts), return_inverse=True)
    ends = ends.reshape(-1, 2)
    low = np.arange(len(nodes))
    while True:
        u, v = low[ends[:, 0]], low[ends[:, 1]]
        if (u == v).all():
            break
        np.minimum.at(low, np.maximum(u, v), np.minimum(u, v))
        while (low[low] != low).any():
            low = low[low]
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[low[i : i + 100_000]])], ["n", "m"])


def components(edges: DataFrame, scratch: Scratch, u: str = "a", v: str = "b", few: int = 2_000_000) -> DataFrame:
    """For each node of an edge: node, component (the smallest node it reaches).

    Edges may be repeated, in any direction; loops give a component of one node. Every task turns its edges into
    stars first. If at most ``few`` of these are left, one task joins them; otherwise rounds of steps point nodes to
    smaller ones, by grouped minima that are pre-aggregated, so the edges never grow in number; steps are written
    out. It ends when a round changes nothing: every node then hangs on its component's smallest one.
    """
    stars = edges.select(F.greatest(u, v).alias("n"), F.least(u, v).alias("m")).mapInArrow(forest, "n bigint, m bigint")
    now = scratch.save(stars, "edges")
    if now.count() <= few:
        return scratch.save(now.coalesce(1).mapInArrow(forest, "n bigint, m bigint"), "stars").toDF("node", "component")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("m").alias("n"), F.col("n").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.where("m > n").join(low, "n").select(F.col("m").alias("n"), F.col("low").alias("m"))
        large = large.unionByName(now.where("n = m")).distinct()
        down = large.groupBy("n").agg(F.min("m").alias("low"))
        small = large.join(down, "n")
        small = small.select(F.greatest("m", "low").alias("n"), F.least("m", "low").alias("m")).where("n <> m").unionByName(down.select("n", F.col("low").alias("m")))
        after = scratch.save(small.distinct(), "star")
        scratch.drop(now)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("n", "m").cast("decimal(38,0)"))).first()
        now = after
        if state == seen:
            break
        seen = state
    pairs = now.where("n <> m")
    return pairs.select(F.col("n").alias("node"), F.col("m").alias("component")).unionByName(now.select(F.col("m").alias("node"), F.col("m").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
