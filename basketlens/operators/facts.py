"""Shared fact relations: completed items, orders, per-user period rollups.

Every later metric starts from one of these. They are plain DataFrame
transformations, so when several metrics are combined in one plan Spark
reuses identical exchanges instead of rescanning.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions import bucket, day, in_days, month
from basketlens.params import Params
from basketlens.session import ensure_checkpoint_dir
from basketlens.sources.tables import Tables


def completed_items(t: Tables, p: Params, start: date | None = None, end: date | None = None) -> DataFrame:
    """Completed, non-returned items (`status = 'Complete' AND returned_at IS NULL`) of the
    calendar days [start, end] (either bound optional)."""
    rows = t.items_near(p.completed_status, start, end)
    done = rows.filter((F.col("status") == p.completed_status) & F.col("returned_at").isNull())
    return items_in_window(done.select("id", "order_id", "user_id", "created_at", "sale_price"), start, end)


def items_in_window(items: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """Items whose calendar day lies in [start, end] (either bound optional)."""
    return items.filter(in_days("created_at", start, end))


def completed_orders(items: DataFrame) -> DataFrame:
    """Item-to-order rollup: one row per (user, order) with its first item
    time and summed value. Partial aggregation runs before the shuffle, so a
    very large order or customer does not land whole in one task."""
    return items.groupBy("user_id", "order_id").agg(
        F.min("created_at").alias("order_ts"),
        F.sum("sale_price").alias("order_value"),
    )


def order_totals_by_date(items: DataFrame) -> DataFrame:
    """Item-to-(order, user, date, month) rollup: an order whose items fall on
    several days yields one row per day (the Task D cart grain)."""
    return (
        items.withColumn("order_date", day("created_at"))
        .withColumn("order_month", month("order_date"))
        .groupBy("order_id", "user_id", "order_date", "order_month")
        .agg(F.sum("sale_price").alias("order_value"))
    )


def period_rollup(
    df: DataFrame,
    user: str,
    ts: Column,
    period: str = "month",
    value: str | None = None,
) -> DataFrame:
    """Per (user, period) first and last time, and optionally summed value.

    Output: user, period_start, first_t, last_t[, value]. The result has at
    most one row per user per calendar period, which bounds every per-user
    window computed over it regardless of how many rows a user has.
    """
    aggs = [F.min("_t").alias("first_t"), F.max("_t").alias("last_t")]
    if value is not None:
        aggs.append(F.sum(value).alias("value"))
    return (
        df.withColumn("_t", ts)
        .withColumn("period_start", bucket("_t", period))
        .groupBy(F.col(user).alias("user_id"), "period_start")
        .agg(*aggs)
    )


def user_month_orders(orders: DataFrame) -> DataFrame:
    """The shared order-grain (user, month) rollup: first and last order time,
    summed value and order count.

    Mix, churn, cohorts and monthly order revenue all read this one relation;
    with identical plans Spark reuses its exchange when they run together.
    """
    return orders.groupBy("user_id", month("order_ts").alias("period_start")).agg(
        F.min("order_ts").alias("first_t"),
        F.max("order_ts").alias("last_t"),
        F.sum("order_value").alias("value"),
        F.count(F.lit(1)).alias("n_orders"),
    )


def materialize(t: Tables, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Compute a rollup once per input bundle, write it as a Parquet table in
    the session's shared checkpoint folder (`spark.checkpoint.dir`) and read
    it back.

    Used for per-user rollups that several branches of a plan read (a data
    boundary subquery, the main pipeline, the sections of a report). Catalyst
    prunes each branch's aggregates differently, so without this each branch
    would scan and shuffle the fact table again. The folder is shared, reliable
    storage, so this also cuts lineage: a lost executor does not force a
    recomputation from the raw scan.
    """
    if key not in t.memo:
        df = build()
        spark = df.sparkSession
        path = os.path.join(ensure_checkpoint_dir(spark), "basketlens-tables", uuid.uuid4().hex)
        # One job writes the rollup (an eager RDD checkpoint would compute it
        # twice: once to count, once to save); reading it back gives the
        # planner exact file sizes for later join decisions.
        df.write.mode("overwrite").parquet(path)
        t.memo[key] = spark.read.parquet(path)
    return t.memo[key]


def order_months(t: Tables, p: Params) -> DataFrame:
    """Completed items of all history by user, order and calendar month: the one table
    that whole-history orders, user months and monthly revenue are derived from."""

    def build() -> DataFrame:
        keys = ["user_id", "order_id", month("created_at").alias("item_month")]
        return completed_items(t, p).groupBy(*keys).agg(F.min("created_at").alias("first_ts"), F.sum("sale_price").alias("value"))

    return materialize(t, ("order_months", p), build)


def all_orders(t: Tables, p: Params) -> DataFrame:
    """Completed orders of all history (see `completed_orders`)."""
    return order_months(t, p).groupBy("user_id", "order_id").agg(
        F.min("first_ts").alias("order_ts"), F.sum("value").alias("order_value")
    )


def item_month_revenue(t: Tables, p: Params) -> DataFrame:
    """Revenue by the month of the items: month, revenue (exact)."""
    return order_months(t, p).groupBy(F.col("item_month").alias("month")).agg(F.sum("value").alias("revenue"))


def order_month_rollup(t: Tables, p: Params, from_start: bool) -> DataFrame:
    """Materialized `user_month_orders` over completed orders (optionally only
    items from the start date on)."""

    def build() -> DataFrame:
        orders = completed_orders(completed_items(t, p, p.start_date)) if from_start else all_orders(t, p)
        return user_month_orders(orders)

    return materialize(t, ("order_month_rollup", p, from_start), build)


def row_scalar(df: DataFrame) -> Column:
    """The single row of a one-row DataFrame as a struct-valued scalar
    subquery: `row_scalar(stats)["field"]`. Every field read refers to the
    same subquery, which Spark evaluates once; no join is needed to attach a
    one-row relation to another."""
    return df.select(F.struct(*df.columns).alias("_row")).scalar()


def max_scalar(df: DataFrame, c: Column) -> Column:
    """One-value scalar subquery (e.g. the data boundary). Spark runs it once
    and inlines the value; no join with a one-row relation is needed."""
    return df.select(c.alias("v")).agg(F.max("v")).scalar()
