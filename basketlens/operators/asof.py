"""As-of join: to each row the last row of another table at or before its time.

Both tables are put in one order of (key, time) and cut into ranges. The last row to
join is looked for in the range by a window; where the range has none before, it comes from
one row for each key and range. No window or join holds all rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.operators.ranges import PART, in_ranges


def last_before(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: Sequence[str]) -> DataFrame:
    """left with right's `columns` (a time first) of the last row with the same key and
    right_ts <= left_ts; null where there is none. Of several right rows at that time the
    one with the largest `columns` is taken. A null key or time finds nothing.
    """
    # One row for each key and time, so that no instant is large.
    known = right.filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull())
    found = known.groupBy(F.col(key).alias("key"), F.col(right_ts).alias("at")).agg(F.max(F.struct(*columns)).alias("found"))
    rows = left.select(F.col(key).alias("key"), F.col(left_ts).alias("at"), F.struct("*").alias("row"))
    of = found.schema["found"].dataType
    both = found.select("key", "at", F.lit(0).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "found").unionByName(
        rows.select("key", "at", F.lit(1).alias("side"), "row", F.lit(None).cast(of).alias("found"))
    )
    # The digest spreads rows of one key and time over ranges.
    ranged = in_ranges(both.withColumn("spread", F.xxhash64("row")), "key", "at", "side", "spread")
    here = Window.partitionBy(PART, "key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("last", F.last("found", ignorenulls=True).over(here)).filter("side = 1").alias("l")
    per_range = ranged.groupBy("key", PART).agg(F.max(F.when(F.col("side") == 0, F.struct("at", "found"))).alias("newest"))
    earlier = Window.partitionBy("key").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_range.select("key", PART, F.last("newest", ignorenulls=True).over(earlier)["found"].alias("carried")).alias("c")
    same = (F.col(f"l.{PART}") == F.col(f"c.{PART}")) & F.col("l.key").eqNullSafe(F.col("c.key"))
    taken = F.when(F.col("l.key").isNotNull() & F.col("l.at").isNotNull(), F.coalesce("l.last", "c.carried"))
    joined = local.join(carried, same).select("l.row", taken.alias("taken"))
    return joined.select(*(F.col("row")[c].alias(c) for c in left.columns), *(F.col("taken")[c].alias(c) for c in columns))
