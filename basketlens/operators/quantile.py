"""Exact interpolated quantile (`quantile_cont`) without a single-task buffer.

Spark's exact `percentile` keeps every distinct value of a group in one aggregation
buffer. Here the distinct values with their counts are cut into ranges (see
`ranges`); the counts of the ranges, one row each, tell which range holds the wanted
rank, and only the rows of those ranges are ranked, each range in a task of its own.
The plan is the same for groups of any size.

With pos = q * (n - 1) the result is v[floor(pos)] + (v[ceil(pos)] - v[floor(pos)]) *
(pos - floor(pos)) over the sorted values v.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.operators.ranges import PART, in_ranges


def exact_quantile(
    df: DataFrame,
    value: str,
    q: float,
    by: Sequence[str] = (),
    out: str = "quantile",
) -> DataFrame:
    """One row per group (or one row) with the exact `quantile_cont(value, q)`."""
    by = list(by)
    base = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = in_ranges(base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_cnt")), *by, "_v")

    # One row for each range of a group: ranks before it, and the wanted ranks.
    so_far = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos = (F.sum("_n").over(Window.partitionBy(*by)) - 1) * F.lit(float(q))
    ranges = (
        counts.groupBy(*by, PART)
        .agg(F.sum("_cnt").alias("_n"))
        .withColumns({"_end": F.sum("_n").over(so_far), "_pos": pos})
        .withColumns({"_i": F.floor("_pos"), "_j": F.ceil("_pos"), "_before": F.col("_end") - F.col("_n")})
        .filter((F.col("_i") < F.col("_end")) & (F.col("_j") >= F.col("_before")))
    )
    ranges = ranges.select(*by, PART, "_before", "_pos", "_i", "_j").alias("r")
    rows = counts.alias("c")
    cond = F.col(f"c.{PART}") == F.col(f"r.{PART}")
    for c in by:
        cond = cond & F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}"))
    inside = rows.join(ranges, cond).select(
        *(F.col(f"c.{c}").alias(c) for c in by), F.col(f"c.{PART}").alias(PART), "_v", "_cnt", "_before", "_pos", "_i", "_j"
    )
    in_range = Window.partitionBy(*by, PART).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("_upto", F.col("_before") + F.sum("_cnt").over(in_range))
    picked = ranked.groupBy(*by).agg(
        F.min(F.when(F.col("_upto") > F.col("_i"), F.col("_v"))).alias("_vi"),
        F.min(F.when(F.col("_upto") > F.col("_j"), F.col("_v"))).alias("_vj"),
        F.max(F.col("_pos") - F.col("_i")).alias("_frac"),
    )
    result = F.col("_vi") + (F.col("_vj") - F.col("_vi")) * F.col("_frac")
    return picked.select(*by, result.cast("double").alias(out))
