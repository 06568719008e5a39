"""Monthly sales, funnel and conversion (Task A and the overview section)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import bucket, in_days, money, ordered, ratio
from basketlens.operators.facts import completed_items
from basketlens.params import Params
from basketlens.sources.tables import Tables

_KEEP = object()


def _window(p: Params, end: object) -> tuple[date | None, date | None]:
    return p.start_date, (p.end_date if end is _KEEP else end)


def monthly_sales(
    t: Tables,
    p: Params,
    end_date: object = _KEEP,
    grain: str = "month",
    count_star: bool = False,
    sort: bool = True,
) -> DataFrame:
    """Revenue, distinct orders, units and AOV per calendar period.

    An order whose items fall in two periods counts once in each.
    """
    start, end = _window(p, end_date)
    items = completed_items(t, p, start, end)
    units = F.count(F.lit(1)) if count_star else F.count("id")
    out = items.groupBy(bucket("created_at", grain).alias(grain)).agg(
        money(F.sum("sale_price")).alias("revenue"),
        F.countDistinct("order_id").alias("orders"),
        units.alias("units"),
        ratio(F.sum("sale_price"), F.countDistinct("order_id")).alias("aov"),
    )
    return ordered(out, grain, on=sort)


def monthly_funnel(
    t: Tables, p: Params, end_date: object = _KEEP, grain: str = "month", sort: bool = True
) -> DataFrame:
    """Distinct users with a top-of-funnel event and with a conversion event.

    Rolled up to (period, user) with two boolean flags first, then counted:
    exact distinct counts without the Expand that two COUNT(DISTINCT ..)
    aggregates would need. Every period with any event keeps its row.
    """
    start, end = _window(p, end_date)
    ev = t.events_near(start, end).filter(in_days("created_at", start, end)).select(
        bucket("created_at", grain).alias(grain),
        "user_id",
        (F.col("event_type") == p.top_funnel_event).alias("_top"),
        (F.col("event_type") == p.conversion_event).alias("_conv"),
    )
    per_user = ev.groupBy(grain, "user_id").agg(F.bool_or("_top").alias("_top"), F.bool_or("_conv").alias("_conv"))
    known = F.col("user_id").isNotNull()
    out = per_user.groupBy(grain).agg(
        F.count_if(known & F.col("_top")).alias("top_funnel_users"),
        F.count_if(known & F.col("_conv")).alias("converted_users"),
    )
    return ordered(out, grain, on=sort)


def funnel_pivot(t: Tables, p: Params) -> DataFrame:
    """pandas-style funnel: known users, only the two event types, all history,
    pivoted per month with missing counts filled with 0."""
    ev = t.events.filter(
        F.col("user_id").isNotNull() & F.col("event_type").isin(p.top_funnel_event, p.conversion_event)
    ).select(bucket("created_at", "month").alias("month"), "event_type", "user_id")
    piv = (
        ev.distinct()
        .groupBy("month")
        .pivot("event_type", [p.top_funnel_event, p.conversion_event])
        .count()
        .fillna(0)
    )
    return piv.select(
        "month",
        F.col(p.top_funnel_event).cast("long").alias("top_funnel_users"),
        F.col(p.conversion_event).cast("long").alias("converted_users"),
    ).orderBy("month")


def monthly_product_metrics(
    t: Tables,
    p: Params,
    end_date: object = _KEEP,
    grain: str = "month",
    keep_funnel: bool = False,
    rate_name: str = "monthly_conversion_rate",
    count_star: bool = False,
    sort: bool = True,
) -> DataFrame:
    """Sales LEFT JOIN funnel on the period, plus the conversion proxy.

    Both sides have at most one row per calendar period.
    """
    sales = monthly_sales(t, p, end_date, grain, count_star, sort=False)
    funnel = monthly_funnel(t, p, end_date, grain, sort=False)
    j = sales.join(funnel, grain, "left")
    cols = [grain, "revenue", "orders", "units", "aov"]
    if keep_funnel:
        cols += ["top_funnel_users", "converted_users"]
    out = j.select(*cols, ratio("converted_users", "top_funnel_users").alias(rate_name))
    return ordered(out, grain, on=sort)


def overview_monthly_metrics(t: Tables, p: Params) -> DataFrame:
    """Dashboard form: open-ended window, funnel counts kept, COUNT(*) units."""
    return monthly_product_metrics(
        t, p, end_date=None, keep_funnel=True, rate_name="monthly_conversion_rate_proxy", count_star=True
    )


def latest_months(t: Tables, p: Params, n: int = 5) -> DataFrame:
    """The n most recent months of the open-ended Task A result (`head()`)."""
    return monthly_product_metrics(t, p, end_date=None, sort=False).orderBy(F.desc("month")).limit(n)
