"""Band counts: distinct items that follow a query time within h days, by one sweep.

`LEFT JOIN facts ON same user AND last < d <= last + h` compares each query row with all
of the user's rows. Here facts and queries are put in one order of days for each user,
and a count is the difference of two running sums: what is known up to last + h, less what
was known up to last.

An item with several days counts once. Of its days that lie in a band all but one are
reached from the day before them, so the upper sum leaves out each day that follows
another of the item by less than h days, and the lower sum each day that is followed so.
(A step of h days or more never has both ends in a band.)

Facts are summed by user and day before the window, which then holds at most one row for
each calendar day and one for each query of a user, however many items a user has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_following(
    queries: DataFrame,
    facts: DataFrame,
    horizon_days: int,
    out: str,
) -> DataFrame:
    """For each query (user_id, month, last_day) count distinct `fact_id`
    among facts (user_id, fact_day, fact_id) with last_day < fact_day <= last_day + h.

    Queries with no match, without a user or without a day get 0 (left-join semantics).
    Facts without an id, a user or a day count for nothing.
    """
    days = facts.select("user_id", "fact_id", "fact_day").dropna().distinct()
    of_item = Window.partitionBy("user_id", "fact_id").orderBy("fact_day")
    since = F.date_diff("fact_day", F.lag("fact_day").over(of_item))
    until = F.date_diff(F.lead("fact_day").over(of_item), "fact_day")
    near = lambda gap: F.when(gap < horizon_days, 0).otherwise(1)
    stepped = days.select("user_id", "fact_day", near(since).alias("upper"), near(until).alias("lower"))
    known = stepped.groupBy("user_id", F.unix_date("fact_day").alias("day")).agg(
        F.sum("upper").alias("upper"), F.sum("lower").alias("lower")
    )
    asked = queries.select("user_id", F.unix_date("last_day").alias("day"), F.struct(*queries.columns).alias("query"))
    both = known.unionByName(asked, allowMissingColumns=True)
    by_day = Window.partitionBy("user_id").orderBy("day")
    reached = F.sum("upper").over(by_day.rangeBetween(Window.unboundedPreceding, horizon_days))
    passed = F.sum("lower").over(by_day.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    count = F.coalesce(reached, F.lit(0)) - F.coalesce(passed, F.lit(0))
    swept = both.withColumn("count", count).filter(F.col("query").isNotNull())
    return swept.select(*(F.col("query")[c].alias(c) for c in queries.columns), F.col("count").cast("long").alias(out))
