"""Session churn: users who start no new session within some days after their last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import bucket, plus_days, ratio
from basketlens.operators.facts import materialize, max_scalar
from basketlens.operators.sessions import sessions
from basketlens.params import Params
from basketlens.sources.tables import Tables

GAP_MINUTES = 30


def user_sessions(t: Tables, p: Params, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Every session of every known user (see `operators.sessions`)."""
    return materialize(t, ("sessions", gap_minutes), lambda: sessions(t.events, gap_minutes))


def session_gap_churn(t: Tables, p: Params, horizon: int, period: str = "day", gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """By the period in which a user's session ends: users whose last session there is at
    least `horizon` days older than the newest event of all, and those of them who started
    no other session in these days."""
    found = user_sessions(t, p, gap_minutes)
    # Bounded by the calendar: a user has at most one session for each gap of it.
    by_user = Window.partitionBy("user_id").orderBy("session_no")
    after = found.withColumn("next_start", F.lead("started_at").over(by_user)).withColumn("_period", bucket("ended_at", period))
    last = after.groupBy("user_id", "_period").agg(F.max(F.struct("ended_at", "next_start")).alias("last"))
    ended, boundary = F.col("last.ended_at"), max_scalar(t.events, F.col("created_at"))
    until = plus_days(ended, horizon)
    back = F.coalesce(F.col("last.next_start") <= until, F.lit(False))
    g = last.filter(until <= boundary).groupBy(F.col("_period").alias(period)).agg(
        F.count(F.lit(1)).alias("eligible_users"), F.count_if(~back).alias("churned_users")
    )
    return g.withColumn("churn_rate", ratio("churned_users", "eligible_users")).orderBy(period)
