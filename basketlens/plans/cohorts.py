"""Cohort retention: share of each first-purchase cohort active N months later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import ratio
from basketlens.operators.facts import order_month_rollup
from basketlens.params import Params
from basketlens.sources.tables import Tables


def cohort_retention(t: Tables, p: Params) -> DataFrame:
    active = order_month_rollup(t, p, from_start=False).select("user_id", F.col("period_start").alias("month"))
    active = active.filter(F.col("user_id").isNotNull())
    # Window over distinct user-months: at most one row per month per user.
    x = active.withColumn("cohort_month", F.min("month").over(Window.partitionBy("user_id")))
    x = x.withColumn("month_offset", F.months_between("month", "cohort_month").cast("long"))
    g = x.groupBy("cohort_month", "month_offset").agg(F.count(F.lit(1)).alias("customers"))
    # One row per month offset per cohort: a small, calendar-bounded window.
    size = F.max(F.when(F.col("month_offset") == 0, F.col("customers"))).over(Window.partitionBy("cohort_month"))
    return g.select(
        "cohort_month",
        "month_offset",
        "customers",
        size.alias("cohort_size"),
        ratio("customers", size).alias("retention_rate"),
    ).orderBy("cohort_month", "month_offset")
