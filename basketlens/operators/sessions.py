"""Gap-based sessions of a user's events, without a task for each user.

Events are cut into ranges of (user, time). Gaps inside a range are found by a window there;
what stands between a range and the ones before it (is the session still open, and
how many were there) comes from one row for each user and range. A user with a third of
all events is spread over many ranges like anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.operators.ranges import PART, in_ranges


def _later(ts: Column, before: Column, gap_minutes: int) -> Column:
    return ts >= before + F.make_dt_interval(mins=F.lit(gap_minutes))


def sessions(events: DataFrame, gap_minutes: int, user: str = "user_id", ts: str = "created_at") -> DataFrame:
    """user_id, session_no (from 1), started_at, ended_at and n_events of every session.

    A session ends where its user has no event for `gap_minutes` or longer. Rows without a
    user or a time belong to no session. A user has at most one session for each gap
    of the calendar, however many events.
    """
    known = events.filter(F.col(user).isNotNull() & F.col(ts).isNotNull())
    # One row for each time: events at one instant are one row with a count.
    times = known.groupBy(F.col(user).alias("user_id"), F.col(ts).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    rows = in_ranges(times, "user_id", "at")
    here = Window.partitionBy(PART, "user_id").orderBy("at")
    opens = F.coalesce(_later(F.col("at"), F.lag("at").over(here), gap_minutes), F.lit(False)).cast("int")
    local = rows.withColumn("opens", opens).withColumn("inside", F.sum("opens").over(here))
    per_range = local.groupBy("user_id", PART).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.max("inside").alias("opened")
    )
    by_range = Window.partitionBy("user_id").orderBy(PART)
    before = F.lag("last").over(by_range)
    first_opens = (before.isNull() | _later(F.col("first"), before, gap_minutes)).cast("int")
    so_far = F.sum(F.col("first_opens") + F.col("opened")).over(by_range.rowsBetween(Window.unboundedPreceding, 0))
    offsets = (
        per_range.withColumn("first_opens", first_opens)
        .withColumn("offset", so_far - F.col("opened"))
        .select("user_id", PART, "offset")
    )
    return (
        local.join(offsets, ["user_id", PART])
        .groupBy("user_id", (F.col("offset") + F.col("inside")).alias("session_no"))
        .agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.sum("n").alias("n_events"))
    )
