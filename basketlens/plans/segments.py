"""Customer snapshot and RFM-style segments (section 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import day, label_rank, midnight, money, ordered, ordered_case, ratio
from basketlens.operators.facts import all_orders, materialize, max_scalar, order_month_rollup
from basketlens.operators.quantile import exact_quantile
from basketlens.params import Params
from basketlens.sources.tables import Tables

# Segment names in report order.
SEGMENTS = ["Dormant", "At risk", "Newly acquired", "Active repeat", "Champions"]


def _snapshot(t: Tables, p: Params, clock: str = "date") -> DataFrame:
    """Per customer: first/last purchase, lifetime orders and revenue, recency.

    clock='date' (dashboard SQL): orders up to the whole snapshot day,
    calendar dates, recency in calendar days.
    clock='ts' (notebook): orders up to midnight of the snapshot day, order
    timestamps, recency in whole elapsed days.
    """
    return materialize(t, ("snapshot", p, clock), lambda: _build_snapshot(t, p, clock))


def _build_snapshot(t: Tables, p: Params, clock: str) -> DataFrame:
    if clock == "date":
        # The snapshot day is the last day of a month, so "order day <= snapshot"
        # is "order month < latest month": the shared user-month rollup suffices.
        um = order_month_rollup(t, p, from_start=False)
        m0 = F.trunc(max_scalar(um, F.col("last_t")), "MM")
        snap = F.date_sub(m0, 1)
        last = F.max(day("last_t"))
        return (
            um.filter(F.col("period_start") < m0)
            .groupBy("user_id")
            .agg(
                F.min(day("first_t")).alias("first_purchase_date"),
                last.alias("last_purchase_date"),
                F.sum("n_orders").alias("lifetime_orders"),
                F.sum("value").alias("lifetime_revenue"),
                F.datediff(snap, last).cast("long").alias("recency_days"),
            )
        )
    if clock == "ts":
        orders = all_orders(t, p)
        # Latest order time from the shared rollup, not another pass over orders.
        last = max_scalar(order_month_rollup(t, p, from_start=False), F.col("last_t"))
        cut = midnight(F.date_sub(F.trunc(last, "MM"), 1))
        o = orders.filter(F.col("order_ts") <= cut)
        # One row per (user, order): COUNT(*) per user is the distinct order count.
        return o.groupBy("user_id").agg(
            F.min("order_ts").alias("first_purchase_date"),
            F.max("order_ts").alias("last_purchase_date"),
            F.count(F.lit(1)).alias("lifetime_orders"),
            F.sum("order_value").alias("lifetime_revenue"),
            F.timestamp_diff("DAY", F.max("order_ts"), cut).alias("recency_days"),
        )
    raise ValueError(f"unknown clock {clock!r}")


def customer_snapshot(t: Tables, p: Params, clock: str = "date") -> DataFrame:
    s = _snapshot(t, p, clock)
    return s.select(
        "user_id",
        "first_purchase_date",
        "last_purchase_date",
        "lifetime_orders",
        money("lifetime_revenue").alias("lifetime_revenue"),
        "recency_days",
    )


def revenue_threshold(t: Tables, p: Params, clock: str = "date") -> DataFrame:
    """Exact 75th percentile (interpolated) of lifetime revenue; one row."""
    return exact_quantile(
        _snapshot(t, p, clock), "lifetime_revenue", p.high_value_quantile, out="high_value_threshold"
    )


def segmented_customers(t: Tables, p: Params, clock: str = "date") -> DataFrame:
    s = _snapshot(t, p, clock)
    thr = exact_quantile(s, "lifetime_revenue", p.high_value_quantile, out="high_value_threshold")
    # The one-row threshold enters as a scalar subquery.
    x = s.withColumn("high_value_threshold", thr.scalar())
    recent = F.col("recency_days") <= p.recent_days
    rules = [
        (recent & (F.col("lifetime_orders") >= p.champion_min_orders)
         & (F.col("lifetime_revenue") >= F.col("high_value_threshold")), "Champions"),
        (recent & (F.col("lifetime_orders") >= p.repeat_min_orders), "Active repeat"),
        (recent, "Newly acquired"),
        (F.col("recency_days") <= p.at_risk_days, "At risk"),
    ]
    return x.withColumn("segment", ordered_case(F.col("recency_days"), rules, "Dormant"))


def segment_split(t: Tables, p: Params, clock: str = "date", sort: bool = True) -> DataFrame:
    """Customers, revenue, mean orders and shares per segment, in report order."""
    g = segmented_customers(t, p, clock).groupBy("segment").agg(
        F.count("user_id").alias("customers"),
        F.sum("lifetime_revenue").alias("_rev"),
        ratio(F.sum("lifetime_orders"), F.count(F.lit(1))).alias("avg_orders"),
    )
    # At most five rows: the grand-total window runs on a tiny relation.
    total = Window.partitionBy()
    out = g.select(
        "segment",
        "customers",
        money("_rev").alias("revenue"),
        "avg_orders",
        ratio("customers", F.sum("customers").over(total)).alias("customer_share"),
        ratio("_rev", F.sum("_rev").over(total)).alias("revenue_share"),
    )
    return ordered(out, label_rank("segment", SEGMENTS), on=sort)


def segment_split_notebook(t: Tables, p: Params) -> DataFrame:
    return segment_split(t, p, clock="ts")
