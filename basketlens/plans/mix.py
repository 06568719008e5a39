"""New versus returning customers and revenue by month (Task B / mix section)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import money, month, ordered, ratio
from basketlens.operators.facts import completed_items, order_month_rollup
from basketlens.params import Params
from basketlens.sources.tables import Tables


def _items(t: Tables, p: Params, history: str, end: bool) -> DataFrame:
    if history == "window":
        return completed_items(t, p, p.start_date, p.end_date if end else None)
    if history != "all":
        raise ValueError(f"history must be 'window' or 'all', got {history!r}")
    return completed_items(t, p)


def monthly_user_sales(t: Tables, p: Params, history: str = "window", grain: str = "item") -> DataFrame:
    """One row per (user, month) with the user's revenue in that month.

    grain='item': month of each item's own time; grain='order': month of the
    order's first item time (the whole order counts in that month).
    """
    if grain == "item":
        items = _items(t, p, history, end=True)
        return items.groupBy("user_id", month("created_at").alias("month")).agg(
            F.sum("sale_price").alias("user_revenue")
        )
    if grain == "order":
        if history not in ("window", "all"):
            raise ValueError(f"history must be 'window' or 'all', got {history!r}")
        um = order_month_rollup(t, p, from_start=history == "window")
        return um.select("user_id", F.col("period_start").alias("month"), F.col("value").alias("user_revenue"))
    raise ValueError(f"grain must be 'item' or 'order', got {grain!r}")


def first_purchase(t: Tables, p: Params, history: str = "window") -> DataFrame:
    """First purchase month per user (over the chosen history)."""
    mus = monthly_user_sales(t, p, history)
    return mus.groupBy("user_id").agg(F.min("month").alias("first_purchase_month"))


def _known(mus: DataFrame) -> DataFrame:
    """Without null users, whose first month is unknown: their revenue is neither new
    nor returning."""
    return mus.filter(F.col("user_id").isNotNull())


def _mix(mus: DataFrame) -> DataFrame:
    # The user's first month comes from a window over the user-month rollup
    # (at most one row per month per user), not from a join back.
    x = _known(mus).withColumn("_first", F.min("month").over(Window.partitionBy("user_id")))
    is_new = F.col("month") == F.col("_first")
    is_ret = F.col("month") > F.col("_first")
    zero = F.lit(0)
    return x.groupBy("month").agg(
        F.count(F.lit(1)).alias("_active"),
        F.count_if(is_new).alias("_new"),
        F.count_if(is_ret).alias("_ret"),
        F.sum(F.when(is_new, F.col("user_revenue")).otherwise(zero)).alias("_rev_new"),
        F.sum(F.when(is_ret, F.col("user_revenue")).otherwise(zero)).alias("_rev_ret"),
        F.sum("user_revenue").alias("_rev"),
    )


def customer_mix(
    t: Tables, p: Params, history: str = "window", grain: str = "item", sort: bool = True
) -> DataFrame:
    """Task B columns: active/new/returning customers and revenue split."""
    m = _mix(monthly_user_sales(t, p, history, grain))
    out = m.select(
        "month",
        F.col("_active").alias("active_customers"),
        F.col("_new").alias("new_customers"),
        F.col("_ret").alias("returning_customers"),
        money("_rev_new").alias("revenue_new"),
        money("_rev_ret").alias("revenue_returning"),
        ratio("_rev_ret", "_rev").alias("pct_revenue_from_returning"),
    )
    return ordered(out, "month", on=sort)


def customer_mix_windowed(t: Tables, p: Params) -> DataFrame:
    return customer_mix(t, p, history="window", grain="item")


def customer_mix_full_history(t: Tables, p: Params) -> DataFrame:
    return customer_mix(t, p, history="all", grain="item")


def customer_mix_order_grain(t: Tables, p: Params, history: str = "window", sort: bool = True) -> DataFrame:
    """Dashboard form at order grain (history='window' keeps orders from the
    start date on, history='all' is the notebook's all-history variant)."""
    m = _mix(monthly_user_sales(t, p, history, grain="order"))
    out = m.select(
        "month",
        F.col("_active").alias("active_customers"),
        F.col("_new").alias("new_customers"),
        F.col("_ret").alias("returning_customers"),
        money("_rev_new").alias("new_revenue"),
        money("_rev_ret").alias("returning_revenue"),
        money(F.col("_rev_new") + F.col("_rev_ret")).alias("total_revenue"),
        ratio("_rev_ret", "_rev").alias("returning_share"),
    )
    return ordered(out, "month", on=sort)


def mix_full_outer(t: Tables, p: Params) -> DataFrame:
    """Notebook form: new-revenue and returning-revenue monthly series joined
    column-wise (FULL OUTER on month) with missing sides filled with 0."""
    mus = _known(monthly_user_sales(t, p, history="all", grain="order"))
    x = mus.withColumn("_first", F.min("month").over(Window.partitionBy("user_id")))
    new = x.filter(F.col("month") == F.col("_first")).groupBy("month").agg(F.sum("user_revenue").alias("new_revenue"))
    ret = x.filter(F.col("month") > F.col("_first")).groupBy("month").agg(
        F.sum("user_revenue").alias("returning_revenue")
    )
    j = new.join(ret, "month", "full")
    zero = F.lit(0)
    return j.select(
        "month",
        money(F.coalesce("new_revenue", zero)).alias("new_revenue"),
        money(F.coalesce("returning_revenue", zero)).alias("returning_revenue"),
    ).orderBy("month")

