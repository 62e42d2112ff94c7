"""Exact percentiles of groups of any size.

F.percentile brings all distinct values of a group to one task. Here a sketch gives bounds around every percentile; values
outside them are only counted, by task, and one task ranks the small share of values inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage

#: Accuracy of the sketch; the bounds leave four times its error on each side.
ACCURACY, MARGIN = 2000, 4
#: Groups whose bounds are sent to all tasks, at most.
MOST_SENT = 10_000


def percentiles(df: DataFrame, group: Sequence[str], value: Column, qs: Sequence[float]) -> DataFrame:
    """The groups with p0, p1, ...: the percentiles qs (0 to 100), linear between neighbours, of values without nulls; NaN is the largest.

    A group without a value has nulls.
    """
    if any(not 0 <= q <= 100 for q in qs):
        raise ValueError("q must lie between 0 and 100")
    inf, nan, slack = float("inf"), float("nan"), MARGIN / ACCURACY
    names = [f"_g{k}" for k in range(len(group))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)], value.cast("double").alias("_v"))
    at = [F.lit(min(1.0, max(0.0, q / 100 + s))) for q in qs for s in (-slack, slack)]
    sketch = F.percentile_approx(F.when(F.isnan("_v"), inf).otherwise(F.col("_v")), F.array(*at), F.lit(ACCURACY))
    bounds = storage.written(rows.groupBy(*names).agg(F.count("_v").alias("_n"), sketch.alias("_s")), "bounds")
    few = F.col("_n") <= MARGIN * ACCURACY  # all of a small group
    low = [F.when(few, -inf).otherwise(F.col("_s")[2 * k]) for k in range(len(qs))]
    high = [F.when(few | (F.col("_s")[2 * k + 1] == inf), nan).otherwise(F.col("_s")[2 * k + 1]) for k in range(len(qs))]
    bounds = bounds.select(*names, "_n", F.array(*low).alias("_l"), F.array(*high).alias("_h"))
    known = bounds.toDF(*[f"{n}_" for n in names], "_n", "_l", "_h")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    sent = F.broadcast(known) if not names or known.count() <= MOST_SENT else known
    v, inside = F.col("_v"), F.lit(False)
    for k in range(len(qs)):
        inside = inside | v.between(F.col("_l")[k], F.col("_h")[k])
    above = F.array(*[v >= F.col("_l")[k] for k in range(len(qs))])
    counted = rows.where("_v is not null").join(sent, same).groupBy(*names, above.alias("_a"), F.when(inside, v).alias("_m")).agg(F.count("*").alias("_c"))
    # of each percentile: those below its bounds, counted, come first, then the values inside in order
    each = counted.join(F.broadcast(known) if sent is not known else known, same).select(*names, "_n", "_l", "_h", "_a", "_m", "_c", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q / 100).alias("p")) for k, q in enumerate(qs)])).alias("_q"))
    k, m = F.col("_q.k"), F.when(F.col("_a")[F.col("_q.k")], F.col("_m"))
    each = each.where(~F.col("_a")[k] | F.coalesce(F.col("_m") <= F.col("_h")[k], F.lit(False))).select(*names, k.alias("_k"), ((F.col("_n") - 1) * F.col("_q.p")).alias("_r"), m.alias("_m"), "_c")
    each = each.groupBy(*names, "_k", "_r", "_m").agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*names, "_k").orderBy(F.col("_m").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = each.withColumn("_u", upto)
    first = lambda rank: F.min(F.when(F.col("_m").isNotNull() & (F.col("_u") > rank), F.col("_m")))
    found = ranked.groupBy(*names, "_k", "_r").agg(first(F.floor("_r")).alias("_x"), first(F.ceil("_r")).alias("_y"), F.coalesce(F.max(F.when(F.col("_m").isNull(), F.col("_u"))), F.lit(0)).alias("_b"))
    r, x, y = F.col("_r"), F.col("_x"), F.col("_y")
    line = F.when(x == y, x).otherwise((F.ceil(r) - r) * x + (r - F.floor(r)) * y)
    right = (F.col("_b") <= F.floor(r)) & y.isNotNull()
    found = found.withColumn("_p", F.when(right, line).otherwise(F.raise_error(F.lit("a percentile lies outside the bounds of its sketch")).cast("double")))
    wide = found.groupBy(*names).agg(*[F.max(F.when(F.col("_k") == k, F.col("_p"))).alias(f"p{k}") for k in range(len(qs))])
    out = known.join(wide, same, "left") if names else known.crossJoin(wide)
    return out.select(*[F.col(f"{n}_").alias(c) for n, c in zip(names, group, strict=True)], *[f"p{k}" for k in range(len(qs))])
