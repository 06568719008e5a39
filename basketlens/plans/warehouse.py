"""Metrics over catalog tables laid out by user (see `sources.warehouse`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import mean_of, money, month, plus_days, ratio, share_of_rows
from basketlens.operators.facts import completed_items, completed_orders
from basketlens.operators.sequence import first_two_orders
from basketlens.params import Params
from basketlens.sources.tables import Tables
from basketlens.sources.warehouse import Layout


def user_order_months(t: Tables, p: Params) -> DataFrame:
    """(user, order, month) rollup of the window's items; over bucketed items it is
    finished within each bucket."""
    items = completed_items(t, p, p.start_date, p.end_date)
    return items.groupBy("user_id", "order_id", month("created_at").alias("month")).agg(
        F.sum("sale_price").alias("revenue"), F.count("id").alias("units")
    )


def catalog_monthly_sales(layout: Layout, p: Params) -> DataFrame:
    """`monthly_sales` from the layout. An order belongs to one customer, so a row of the
    rollup is an order of a month."""
    rolled = user_order_months(layout.ordinary, p).unionByName(user_order_months(layout.large, p))
    g = rolled.groupBy("month").agg(
        F.sum("revenue").alias("_revenue"), F.count(F.lit(1)).alias("orders"), F.sum("units").alias("units")
    )
    return g.select("month", money("_revenue").alias("revenue"), "orders", "units", ratio("_revenue", "orders").alias("aov")).orderBy("month")


def first_orders_with_users(t: Tables, p: Params) -> DataFrame:
    """Each customer's first order and the time of the next, joined to the customer; over
    bucketed tables without a shuffle."""
    f = first_two_orders(completed_orders(completed_items(t, p)))
    return f.join(t.users, f.user_id == t.users.id).select("traffic_source", "order_ts", "order_value", "next_order_ts")


def catalog_first_order_repeat(layout: Layout, p: Params) -> DataFrame:
    """`first_order_repeat_by_channel` from the layout."""
    large = first_two_orders(completed_orders(completed_items(layout.large, p)).filter(F.col("user_id").isNotNull()))
    users = layout.large.users
    # Fewer customers than buckets.
    joined = users.join(F.broadcast(large), users.id == large.user_id).select("traffic_source", "order_ts", "order_value", "next_order_ts")
    both = first_orders_with_users(layout.ordinary, p).unionByName(joined)
    repeat = F.col("next_order_ts").isNotNull() & (F.col("next_order_ts") <= plus_days("order_ts", p.horizon_days))
    out = both.groupBy("traffic_source").agg(
        F.count(F.lit(1)).alias("customers"),
        share_of_rows(repeat).alias("repeat_90d"),
        mean_of("order_value").alias("first_order_aov"),
    )
    return out.orderBy(F.desc("customers"), "traffic_source")
