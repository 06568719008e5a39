"""Distinct users of any period by activity, from one table of daily bitmaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import day
from basketlens.operators.distinct import day_bitmaps, distinct_by, distinct_trailing
from basketlens.operators.facts import completed_items, materialize
from basketlens.params import Params
from basketlens.sources.tables import Tables

GRAINS = ("day", "month", "quarter", "year")


ORDER = "order"


def user_bitmaps(t: Tables, p: Params) -> DataFrame:
    """Known users by activity and day, as bitmaps, saved once for an input bundle. An
    activity is an event type, or `ORDER` for the customers of completed items."""

    def build() -> DataFrame:
        seen = t.events.select(F.col("event_type").alias("activity"), "created_at", "user_id")
        bought = completed_items(t, p).select(F.lit(ORDER).alias("activity"), "created_at", "user_id")
        return day_bitmaps(seen.unionByName(bought), day("created_at"), ["activity"], "user_id")

    return materialize(t, ("user_bitmaps", p), build)


def distinct_users_by_period(t: Tables, p: Params) -> DataFrame:
    """Distinct known users by activity and day, month, quarter and year."""
    bitmaps = user_bitmaps(t, p)
    parts = [
        distinct_by(bitmaps, F.to_date(F.date_trunc(grain, "day")), ["activity"], "users").withColumn("grain", F.lit(grain))
        for grain in GRAINS
    ]
    return reduce(DataFrame.unionByName, parts).select("grain", "period_start", "activity", "users")


def distinct_users_trailing(t: Tables, p: Params, days: int = 90) -> DataFrame:
    """Distinct known users by activity in the `days` days up to each active day."""
    return distinct_trailing(user_bitmaps(t, p), days, ["activity"], f"users_{days}d")
