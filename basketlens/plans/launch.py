"""Launch impact and pre/post baseline around a product change (Task D, section 5.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import date_lit, day, mean_of, midnight, money, month, ordered, ratio, share_of_rows
from basketlens.operators.facts import (
    completed_items,
    completed_orders,
    materialize,
    order_totals_by_date,
)
from basketlens.operators.quantile import exact_quantile
from basketlens.params import Params
from basketlens.sources.tables import Tables


def launch_window_order_totals(t: Tables, p: Params) -> DataFrame:
    """Order value per (order, user, day, month) for items inside the scenario window."""
    items = completed_items(t, p, p.pre_start, p.post_end)
    return order_totals_by_date(items)


def launch_impact(t: Tables, p: Params) -> DataFrame:
    """Orders, revenue and AOV by order month x period x traffic source x
    threshold segment. An order whose items fall on two days is split into
    two carts (one per day), as in the original query."""
    ot = launch_window_order_totals(t, p)
    # The dimension grows with the data: left to the planner / AQE.
    j = ot.join(t.users, ot.user_id == t.users.id, "inner")
    period = F.when(F.col("order_date") < date_lit(p.launch_date), F.lit(p.pre_label)).otherwise(F.lit(p.post_label))
    segment = F.when(F.col("order_value") >= F.lit(p.threshold), F.lit(p.at_or_above_label)).otherwise(
        F.lit(p.below_label)
    )
    keys = ["order_month", "period", "traffic_source", "threshold_segment"]
    x = j.select("order_id", "order_month", "traffic_source", "order_value", period.alias("period"), segment.alias("threshold_segment"))
    return x.groupBy(*keys).agg(
        F.countDistinct("order_id").alias("completed_orders"),
        money(F.sum("order_value")).alias("total_revenue"),
        ratio(F.sum("order_value"), F.countDistinct("order_id")).alias("aov"),
    ).orderBy(*keys)


def launch_impact_notebook(t: Tables, p: Params) -> DataFrame:
    """Notebook form of Task D: carts by order, channel, month and day, with the labels
    of `p` (see `catalog.notebook_labels`)."""
    items = completed_items(t, p, p.pre_start, p.post_end).withColumn("order_date", day("created_at"))
    carts = (
        items.join(t.users.withColumnRenamed("id", "user"), F.col("user_id") == F.col("user"))
        .groupBy("order_id", "traffic_source", month("order_date").alias("order_month"), "order_date")
        .agg(F.sum("sale_price").alias("cart"))
    )
    keys = ["order_month", "period", "traffic_source", "cart_segment"]
    labelled = carts.withColumns(
        {
            "period": F.when(F.col("order_date") < date_lit(p.launch_date), p.pre_label).otherwise(p.post_label),
            "cart_segment": F.when(F.col("cart") >= F.lit(p.threshold), p.at_or_above_label).otherwise(p.below_label),
        }
    )
    # An order has one row for each of its days; the days of a group are summed first.
    per_order = labelled.groupBy(*keys, "order_id").agg(F.sum("cart").alias("cart"))
    return per_order.groupBy(*keys).agg(
        F.count("order_id").alias("total_completed_orders"),
        money(F.sum("cart")).alias("total_revenue"),
        ratio(F.sum("cart"), F.count("order_id")).alias("aov"),
    ).orderBy(*keys)


def prepost_display(t: Tables, p: Params) -> DataFrame:
    """The baseline as it is shown: values to 2 decimals, the share in percent to 1."""
    b = prepost_baseline(t, p, sort=False)
    return b.select(
        "period",
        "completed_orders",
        F.round("avg_order_value", 2).alias("avg_order_value"),
        F.round("median_order_value", 2).alias("median_order_value"),
        F.round(F.col("pct_orders_above_threshold") * 100, 1).alias("pct_orders_above_threshold"),
    ).orderBy(F.desc("period"))


def prepost_orders(t: Tables, p: Params, prefilter: bool = True) -> DataFrame:
    """Completed orders in the scenario window with a period label.

    prefilter=True: items are cut to the window days first, then rolled up
    (edge orders are truncated) and the period uses the order's day.
    prefilter=False: orders are rolled up over all history and then cut by
    their first-item time against midnight bounds (the end day is dropped).
    """
    if prefilter:
        orders = completed_orders(completed_items(t, p, p.pre_start, p.post_end))
        pre = day("order_ts") < date_lit(p.launch_date)
    else:
        orders = completed_orders(completed_items(t, p)).filter(
            F.col("order_ts").between(midnight(date_lit(p.pre_start)), midnight(date_lit(p.post_end)))
        )
        pre = F.col("order_ts") < midnight(date_lit(p.launch_date))
    label = F.when(pre, F.lit(p.baseline_pre_label)).otherwise(F.lit(p.baseline_post_label))
    return orders.withColumn("period", label)


def _prepost_orders_materialized(t: Tables, p: Params, prefilter: bool) -> DataFrame:
    # Read three times (counts, quantile sketch, quantile ranks): computed once.
    return materialize(t, ("prepost_orders", p, prefilter), lambda: prepost_orders(t, p, prefilter))


def prepost_baseline(
    t: Tables, p: Params, prefilter: bool = True, with_median: bool = True, sort: bool = True
) -> DataFrame:
    """Per period: completed orders, mean and median order value and the share
    of orders at or above the threshold."""
    o = _prepost_orders_materialized(t, p, prefilter) if with_median else prepost_orders(t, p, prefilter)
    base = o.groupBy("period").agg(
        F.countDistinct("order_id").alias("completed_orders"),
        mean_of("order_value").alias("avg_order_value"),
        share_of_rows(F.col("order_value") >= F.lit(p.threshold)).alias("pct_orders_above_threshold"),
    )
    if not with_median:
        return ordered(base, F.desc("period"), on=sort)
    med = exact_quantile(o, "order_value", 0.5, by=["period"], out="median_order_value")
    # One row per period on both sides.
    out = base.join(med, "period", "left").select(
        "period", "completed_orders", "avg_order_value", "median_order_value", "pct_orders_above_threshold"
    )
    return ordered(out, F.desc("period"), on=sort)


def prepost_baseline_rollup_first(t: Tables, p: Params) -> DataFrame:
    """Notebook form (orders rolled up over all history, midnight bounds)."""
    return prepost_baseline(t, p, prefilter=False, with_median=False)
