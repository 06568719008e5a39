"""Churn after the last activity of each user-period (Task C and variants).

All variants share one plan:

1. roll activity up to (user, period): first and last time in the period;
2. `next_first_t` = first time of the user's next active period (LEAD over
   the rollup, at most one row per period per user);
3. keep user-periods whose horizon has matured before the data boundary
   (a scalar subquery, evaluated once);
4. a user-period is churned when the next activity is missing or later
   than `last + horizon`.

Because `last_t` is the latest time in its period, the next period's first
time is exactly the next distinct activity time, so step 2 gives the same
answer as the band self-join "no activity in (last, last + h]" and as the
per-order LEAD, without comparing every pair of a user's rows.

Clocks: 'date' compares calendar days (`DATE_ADD(last, h)`), 'ts' compares
timestamps (`last + INTERVAL h DAY`), 'floor_days' counts whole elapsed days
(`(next - last).days <= h`) against a midnight boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions import date_plus, day, midnight, money, month, ordered, plus_days, ratio
from basketlens.operators.bands import count_following
from basketlens.operators.facts import (
    completed_items,
    completed_orders,
    item_month_revenue,
    materialize,
    max_scalar,
    order_month_rollup,
    period_rollup,
    user_month_orders,
)
from basketlens.operators.sequence import sequence, with_next_period
from basketlens.params import Params
from basketlens.sources.tables import Tables


def period_end(period_start: Column, period: str) -> Column:
    """First day after the period (exclusive end) as a DATE."""
    if period == "month":
        return F.add_months(period_start, 1)
    return F.date_add(period_start, 7 if period == "week" else 1)


def flag_churn(
    rollup: DataFrame,
    boundary: Column,
    horizon: int,
    clock: str,
    full_periods_only: bool = False,
    period: str = "month",
    keep_all: bool = False,
) -> DataFrame:
    """Eligible user-periods with a boolean `churned` column.

    keep_all=True keeps every user-period with an `eligible` flag instead of
    filtering, so measures over all user-periods (revenue) can be summed in
    the same aggregation.

    full_periods_only=True also drops periods that are only partly mature,
    i.e. whose last possible day plus the horizon is past the boundary
    (otherwise the last kept month holds only its early buyers).
    """
    r = with_next_period(rollup)
    last, nxt = F.col("last_t"), F.col("next_first_t")
    if clock == "date":
        limit = date_plus(last, horizon)
        eligible = limit <= boundary
        churned = nxt.isNull() | (nxt > limit)
    elif clock == "ts":
        limit = plus_days(last, horizon)
        eligible = limit <= boundary
        churned = nxt.isNull() | (nxt > limit)
    elif clock == "floor_days":
        eligible = last <= boundary - F.make_dt_interval(F.lit(horizon))
        # floor((next - last) / 1 day) <= h  <=>  next < last + (h + 1) days
        churned = ~(nxt.isNotNull() & (nxt < plus_days(last, horizon + 1)))
    else:
        raise ValueError(f"unknown clock {clock!r}")
    if full_periods_only:
        end = period_end(F.col("period_start"), period)
        if clock == "date":
            eligible = eligible & (F.date_add(end, horizon - 1) <= boundary)
        elif clock == "ts":
            eligible = eligible & (plus_days(end.cast("timestamp_ntz"), horizon) <= boundary)
        else:
            eligible = eligible & (end.cast("timestamp_ntz") <= boundary - F.make_dt_interval(F.lit(horizon)))
    if keep_all:
        return r.withColumn("eligible", eligible).withColumn("churned", eligible & churned)
    return r.filter(eligible).withColumn("churned", churned)


def churn_counts(flagged: DataFrame, horizon: int, label: str = "month", who: str = "customers") -> DataFrame:
    """Distinct known users by period: rows are one per user and period, so a count
    of non-null users is the distinct count."""
    known = F.count("user_id")
    churned = F.count_if(F.col("churned") & F.col("user_id").isNotNull())
    return flagged.groupBy(F.col("period_start").alias(label)).agg(
        known.alias(f"active_{who}"),
        churned.alias(f"churned_{who}_{horizon}d"),
        ratio(churned, known).alias(f"churn_rate_{horizon}d"),
    )


# -- item grain, calendar days (Task C SQL and notebook) ----------------------


def _item_day_rollup(t: Tables, p: Params, windowed: bool) -> tuple[DataFrame, DataFrame]:
    items = completed_items(t, p, p.start_date, p.end_date) if windowed else completed_items(t, p)
    r = materialize(t, ("item_day_rollup", p, windowed), lambda: period_rollup(items, "user_id", day("created_at")))
    return items, r


def user_month_activity(t: Tables, p: Params) -> DataFrame:
    """Last completed-order day per user and month inside the window."""
    _, r = _item_day_rollup(t, p, windowed=True)
    return r.select("user_id", F.col("period_start").alias("month"), F.col("last_t").alias("last_order_date_in_month"))


def data_boundary(t: Tables, p: Params) -> DataFrame:
    """Latest completed-order day inside the window (one row)."""
    items = completed_items(t, p, p.start_date, p.end_date)
    return items.agg(F.max(day("created_at")).alias("max_observed_order_date"))


def rollup_boundary(rollup: DataFrame, c: str = "last_t") -> Column:
    """Data boundary (latest activity) as a scalar subquery over the
    materialized per-user rollup: a scan of one small column, not another
    pass over the fact table."""
    return max_scalar(rollup, F.col(c))


def eligible_user_months(t: Tables, p: Params) -> DataFrame:
    """User-months whose 90-day horizon ends on or before the data boundary."""
    _, r = _item_day_rollup(t, p, windowed=True)
    f = flag_churn(r, rollup_boundary(r), p.horizon_days, "date")
    return f.select("user_id", F.col("period_start").alias("month"), F.col("last_t").alias("last_order_date_in_month"))


def churn_90d_windowed(t: Tables, p: Params, full_months_only: bool = False) -> DataFrame:
    """Task C: windowed history, boundary = last completed day in the window."""
    _, r = _item_day_rollup(t, p, windowed=True)
    flagged = flag_churn(r, rollup_boundary(r), p.horizon_days, "date", full_months_only)
    out = churn_counts(flagged, p.horizon_days)
    return out.orderBy("month")


def _is_done(p: Params) -> Column:
    """Completed and not returned (an unknown status is not)."""
    return F.col("status").eqNullSafe(p.completed_status) & F.col("returned_at").isNull()


def _order_days(t: Tables, p: Params) -> DataFrame:
    """Items of any status by user, order and day, with whether any was completed; saved
    once: the boundary, the user-months and the orders to count all come from it."""
    return materialize(
        t,
        ("order_days_any_status", p),
        lambda: t.order_items.groupBy("user_id", "order_id", day("created_at").alias("day")).agg(F.bool_or(_is_done(p)).alias("done")),
    )


def _done_days(order_days: DataFrame) -> DataFrame:
    return order_days.filter("done").select("user_id", F.col("day").alias("fact_day"), F.col("order_id").alias("fact_id"))


def _any_status_rollup(rows: DataFrame, done: Column, d: Column) -> DataFrame:
    return (
        rows.withColumn("_d", d)
        .groupBy("user_id", month("_d").alias("period_start"))
        .agg(
            F.min(F.when(done, F.col("_d"))).alias("first_t"),
            F.max(F.when(done, F.col("_d"))).alias("last_t"),
            F.max("_d").alias("_any_t"),
        )
    )


def churn_90d_full_history(t: Tables, p: Params, method: str = "lead", full_months_only: bool = False) -> DataFrame:
    """Notebook Task C: all history, boundary = last day over all items of any status.

    method='lead' (default) reads the next active month's first day;
    method='band' is the original formulation: count the user's orders in
    (last, last + h] with the band join and flag "any order" (MAX(CASE ..)).

    One scan: the (user, month) rollup runs over every item, with the
    completed-only first/last days as conditional aggregates and the
    any-status maximum alongside; user-months without completed items are
    dropped after the boundary is read."""
    done = _is_done(p)
    if method == "band":
        order_days = _order_days(t, p)
        r_all = _any_status_rollup(order_days, F.col("done"), F.col("day"))
    else:
        r_all = materialize(t, ("item_day_rollup_any_status", p), lambda: _any_status_rollup(t.order_items, done, day("created_at")))
    boundary = rollup_boundary(r_all, "_any_t")
    r = r_all.filter(F.col("last_t").isNotNull()).drop("_any_t")
    if method == "lead":
        flagged = flag_churn(r, boundary, p.horizon_days, "date", full_months_only)
    elif method == "band" and not full_months_only:
        q = r.filter(date_plus("last_t", p.horizon_days) <= boundary).select(
            "user_id", F.col("period_start").alias("month"), F.col("last_t").alias("last_day")
        )
        counted = count_following(q, _done_days(order_days), p.horizon_days, "_n")
        flagged = counted.groupBy("user_id", F.col("month").alias("period_start")).agg(
            F.max(F.when(F.col("_n") > 0, 1).otherwise(0)).alias("_has_future")
        ).withColumn("churned", F.col("_has_future") == 0)
    else:
        raise ValueError(f"unknown method {method!r}")
    return churn_counts(flagged, p.horizon_days).orderBy("month")


def orders_in_next_days(t: Tables, p: Params) -> DataFrame:
    """For each eligible user-month (Task C), the number of distinct completed
    orders with an item day in (last, last + h] (the band join's count)."""
    order_days = materialize(
        t,
        ("order_days", p),
        lambda: completed_items(t, p, p.start_date, p.end_date).select("user_id", "order_id", day("created_at").alias("day")).distinct(),
    )
    r = period_rollup(order_days, "user_id", F.col("day"))
    boundary = rollup_boundary(order_days, "day")
    q = r.filter(date_plus("last_t", p.horizon_days) <= boundary).select(
        "user_id", F.col("period_start").alias("month"), F.col("last_t").alias("last_day")
    )
    facts = order_days.select("user_id", F.col("day").alias("fact_day"), F.col("order_id").alias("fact_id"))
    out = f"orders_in_next_{p.horizon_days}d"
    return count_following(q, facts, p.horizon_days, out).select("user_id", "month", out)


# -- order grain, timestamps (dashboard) ---------------------------------------


def _orders(t: Tables, p: Params, from_start: bool) -> DataFrame:
    return completed_orders(completed_items(t, p, p.start_date if from_start else None))


def _monthly_order_revenue(um: DataFrame) -> DataFrame:
    return um.groupBy(F.col("period_start").alias("month")).agg(F.sum("value").alias("_revenue"))


def _lead_join_flags(orders: DataFrame, r: DataFrame, boundary: Column, h: int) -> DataFrame:
    """The dashboard's own formulation: LEAD of the order time per user, joined
    back to each eligible user-month on (user, last order time); a user-month
    is churned when any joined row has no next order within h days. The
    per-order LEAD comes from the skew-safe two-level `sequence`."""
    seq = sequence(orders, "user_id", "order_ts", "order_id").select(
        "user_id", F.col("order_ts").alias("last_t"), F.col("next_ts")
    )
    el = r.filter(plus_days("last_t", h) <= boundary).select("user_id", "period_start", "last_t")
    j = el.join(seq, ["user_id", "last_t"], "left")
    churn_row = F.col("next_ts").isNull() | (F.col("next_ts") > plus_days("last_t", h))
    return j.groupBy("user_id", "period_start").agg(F.bool_or(churn_row).alias("churned"))


def churn_vs_revenue(
    t: Tables,
    p: Params,
    horizon: int | None = None,
    full_months_only: bool = False,
    sort: bool = True,
    method: str = "rollup",
) -> DataFrame:
    """Dashboard churn: order timestamps from the start date, boundary = last
    order time, joined to revenue by order month.

    method='rollup' (default) reads the next active month's first order;
    method='lead_join' joins user-months back to the per-order LEAD sequence.
    """
    h = p.horizon_days if horizon is None else horizon
    if method == "rollup":
        r = order_month_rollup(t, p, from_start=True)
        # Churn counts and order-month revenue in one aggregation over the
        # rollup: every user-month adds revenue, eligible ones add counts.
        known = F.col("user_id").isNotNull()
        flagged = flag_churn(r, rollup_boundary(r), h, "ts", full_months_only, keep_all=True)
        g = flagged.groupBy(F.col("period_start").alias("month")).agg(
            F.count_if("eligible").alias("_rows"),
            F.count_if(F.col("eligible") & known).alias("active_customers"),
            F.count_if(F.col("churned") & known).alias(f"churned_customers_{h}d"),
            F.sum("value").alias("_revenue"),
        )
        out = g.filter(F.col("_rows") > 0).select(
            "month",
            "active_customers",
            f"churned_customers_{h}d",
            ratio(f"churned_customers_{h}d", "active_customers").alias(f"churn_rate_{h}d"),
            money("_revenue").alias("revenue"),
        )
    elif method == "lead_join" and not full_months_only:
        # One fact pass: user-months and the sequence come from the saved orders.
        orders = materialize(t, ("orders_from_start", p), lambda: _orders(t, p, from_start=True))
        r = user_month_orders(orders)
        churn = churn_counts(_lead_join_flags(orders, r, rollup_boundary(r), h), h)
        # Both sides have one row per month.
        rev = _monthly_order_revenue(r)
        out = churn.join(rev, "month", "left").select(*churn.columns, money("_revenue").alias("revenue"))
    else:
        raise ValueError(f"unsupported method {method!r}")
    return ordered(out, "month", on=sort)


def churn_30d(t: Tables, p: Params) -> DataFrame:
    return churn_vs_revenue(t, p, horizon=30)


def churn_vs_revenue_full_months(t: Tables, p: Params) -> DataFrame:
    return churn_vs_revenue(t, p, full_months_only=True)


def churn_90d_floor_days(t: Tables, p: Params, sort: bool = True, full_months_only: bool = False) -> DataFrame:
    """Notebook churn: all-history orders, whole elapsed days, midnight
    boundary; joined to item-month revenue like the notebook's chart."""
    r = order_month_rollup(t, p, from_start=False)
    boundary = midnight(rollup_boundary(r))
    churn = churn_counts(flag_churn(r, boundary, p.horizon_days, "floor_days", full_months_only), p.horizon_days)
    rev = item_month_revenue(t, p).withColumnRenamed("revenue", "_revenue")
    out = churn.join(rev, "month", "left").select(*churn.columns, money("_revenue").alias("revenue"))
    return ordered(out, "month", on=sort)


def session_churn(t: Tables, p: Params, horizon: int = 14, period: str = "month") -> DataFrame:
    """Activity churn over events: a user-period is churned when the user has
    no event within `horizon` days after their last event in the period."""
    # One scan: anonymous events form their own (null-user) group, which
    # still counts for the boundary and is dropped afterwards.
    r_all = materialize(
        t, ("event_rollup", period), lambda: period_rollup(t.events, "user_id", F.col("created_at"), period=period)
    )
    boundary = rollup_boundary(r_all)
    r = r_all.filter(F.col("user_id").isNotNull())
    return churn_counts(flag_churn(r, boundary, horizon, "ts"), horizon, label=period, who="users").orderBy(period)


def session_churn_14d(t: Tables, p: Params) -> DataFrame:
    return session_churn(t, p, horizon=14, period="month")


def session_churn_1d(t: Tables, p: Params) -> DataFrame:
    return session_churn(t, p, horizon=1, period="day")
