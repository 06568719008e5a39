"""Exact distinct counts of any period from one table of bitmaps.

An id sets one bit of the bitmap that its bucket of ids has for a day. Bitmaps of days
merge by OR, so the distinct ids of a month, a quarter or a trailing window follow from
the saved day table without another pass over the facts, which a sum of daily counts
doesn't allow. A bitmap has a fixed size (4 KB for 32,768 ids); a group has one row for
each bucket and day in use, so nothing grows with the number of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_bitmaps(df: DataFrame, day: Column, by: Sequence[str], id_column: str) -> DataFrame:
    """Bitmaps of the distinct ids: `by`, day, bucket, bits. Null ids and days have none."""
    rows = df.select(*by, day.alias("day"), F.col(id_column).cast("long").alias("_id")).dropna(subset=["day", "_id"])
    # One row for each id and day first: a partial aggregate of ids is smaller than one of bitmaps.
    once = rows.distinct()
    return once.groupBy(*by, "day", F.bitmap_bucket_number("_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits")
    )


def distinct_by(bitmaps: DataFrame, period: Column, by: Sequence[str], out: str) -> DataFrame:
    """Distinct ids of each group and period (an expression of `day`): `by`, period_start, out."""
    merged = bitmaps.groupBy(*by, period.alias("period_start"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by, "period_start").agg(F.sum(F.bitmap_count("bits")).alias(out))


def distinct_trailing(bitmaps: DataFrame, days: int, by: Sequence[str], out: str) -> DataFrame:
    """Distinct ids of the `days` days that end with each day on which the group has any
    id: `by`, day, out.

    A bucket without ids on such a day still counts with those of the days before, so
    each bucket stands for the days from one of its rows up to its next, or till its ids are
    out of reach; a day's ids are the sum of what stands there.
    """
    buckets = Window.partitionBy(*by, "bucket").orderBy("at")
    seen = bitmaps.withColumn("at", F.unix_date("day"))
    # A bucket changes where a day enters and where one leaves; both are rows of the sweep.
    enter = seen.select(*by, "bucket", "at", "bits")
    leave = seen.select(*by, "bucket", (F.col("at") + days).alias("at"), F.lit(None).cast("binary").alias("bits"))
    # A day that enters where another leaves keeps its bitmap.
    steps = enter.unionByName(leave).groupBy(*by, "bucket", "at").agg(F.max("bits").alias("bits"))
    within = F.bitmap_or_agg("bits").over(buckets.rangeBetween(1 - days, Window.currentRow))
    counted = steps.withColumn("n", F.bitmap_count(within))
    change = counted.withColumn("change", F.col("n") - F.coalesce(F.lag("n").over(buckets), F.lit(0)))
    by_day = change.groupBy(*by, "at").agg(F.sum("change").alias("change"))
    running = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = by_day.withColumn(out, F.sum("change").over(running)).withColumn("day", F.date_from_unix_date("at"))
    active = bitmaps.select(*by, "day").distinct()
    return total.join(active, [*by, "day"], "left_semi").select(*by, "day", out)
