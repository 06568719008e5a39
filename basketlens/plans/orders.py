"""Order-value bands and first-order repeat by channel (sections 5.2, 5.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import band, day, label_rank, mean_of, ordered, plus_days, ratio, share_of_rows
from basketlens.operators.facts import all_orders, max_scalar, order_month_rollup
from basketlens.operators.sequence import first_two_orders
from basketlens.params import Params
from basketlens.sources.tables import Tables


def _last_order_ts(t: Tables, p: Params):
    """Latest completed order time, read from the shared (materialized)
    user-month rollup instead of a second pass over the orders."""
    return max_scalar(order_month_rollup(t, p, from_start=False), F.col("last_t"))


def trailing_orders(t: Tables, p: Params) -> DataFrame:
    """Orders whose day lies in the last `trailing_months` full months."""
    orders = all_orders(t, p)
    m0 = F.trunc(_last_order_ts(t, p), "MM")
    return orders.filter(day("order_ts").between(F.add_months(m0, -p.trailing_months), F.date_sub(m0, 1)))


def order_value_bands(t: Tables, p: Params, sort: bool = True) -> DataFrame:
    """Orders and share per order-value band over the trailing full months.

    (user, order) rows are unique after the rollup and an order id belongs
    to one user, so COUNT(*) is the distinct order count.
    """
    labels = p.band_labels
    o = trailing_orders(t, p).withColumn("order_band", band("order_value", p.band_edges, labels))
    g = o.groupBy("order_band").agg(F.count(F.lit(1)).alias("orders"))
    # At most len(labels) rows.
    out = g.select(
        "order_band", "orders", ratio("orders", F.sum("orders").over(Window.partitionBy())).alias("order_share")
    )
    return ordered(out, label_rank("order_band", labels), on=sort)


def first_orders(t: Tables, p: Params) -> DataFrame:
    """First completed order per user (by time, then order id) and the time of
    the user's next order."""
    return first_two_orders(all_orders(t, p))


def first_order_repeat_by_channel(t: Tables, p: Params, censor: bool = False, sort: bool = True) -> DataFrame:
    """Customers, repeat within the horizon after the first order, and first-order
    AOV per acquisition channel.

    censor=True keeps only customers whose first order is at least `horizon`
    days before the last order time, so recent buyers are not counted as
    non-repeaters.
    """
    orders = all_orders(t, p)
    f = first_two_orders(orders)
    if censor:
        f = f.filter(plus_days("order_ts", p.horizon_days) <= _last_order_ts(t, p))
    j = f.join(t.users, f.user_id == t.users.id, "inner")
    repeat = F.col("next_order_ts").isNotNull() & (F.col("next_order_ts") <= plus_days("order_ts", p.horizon_days))
    # One row per user on the left, so COUNT(*) counts distinct customers.
    out = j.groupBy("traffic_source").agg(
        F.count(F.lit(1)).alias("customers"),
        share_of_rows(repeat).alias("repeat_90d"),
        mean_of("order_value").alias("first_order_aov"),
    )
    return ordered(out, F.desc("customers"), "traffic_source", on=sort)


def first_order_repeat_censored(t: Tables, p: Params) -> DataFrame:
    return first_order_repeat_by_channel(t, p, censor=True)

