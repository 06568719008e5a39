"""Experiment readout by arm (conversion, AOV, revenue per visitor, threshold
share, repeat rate).

There is no assignment table, so the arm is a deterministic function of the
user id. Every input is reduced to one row per user before the join, so the
join is keyed by user on both sides and carries no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions import in_days, money, ratio
from basketlens.operators.facts import completed_items, completed_orders
from basketlens.params import Params
from basketlens.sources.tables import Tables

# Fixed values of the assignment rule: bucket = ((id mod 1000003) * 7919 + 13) mod 100.
_MOD, _MUL, _ADD = 1000003, 7919, 13


def assignment_bucket(user_id: Column) -> Column:
    return F.pmod(F.pmod(user_id, F.lit(_MOD)) * F.lit(_MUL) + F.lit(_ADD), F.lit(100))


def arm(user_id: Column, treatment_share_pct: int) -> Column:
    return F.when(assignment_bucket(user_id) < treatment_share_pct, F.lit("treatment")).otherwise(F.lit("control"))


def experiment_readout(t: Tables, p: Params) -> DataFrame:
    visitors = (
        t.events_near(p.exp_start, p.exp_end)
        .filter(F.col("user_id").isNotNull() & in_days("created_at", p.exp_start, p.exp_end))
        .select("user_id")
        .distinct()
        .withColumn("_visitor", F.lit(True))
    )
    items = completed_items(t, p, p.exp_start, p.exp_end)
    # Without a user there is no arm.
    per_user = completed_orders(items).filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_orders"),
        F.sum("order_value").alias("_revenue"),
        F.count_if(F.col("order_value") >= F.lit(p.threshold)).alias("_big"),
    )
    u = visitors.join(per_user, "user_id", "full").withColumn("arm", arm(F.col("user_id"), p.treatment_share_pct))
    is_visitor = F.coalesce(F.col("_visitor"), F.lit(False))
    is_buyer = F.col("_orders").isNotNull()
    g = u.groupBy("arm").agg(
        F.count_if(is_visitor).alias("visitors"),
        F.count_if(is_visitor & is_buyer).alias("converted_visitors"),
        F.count_if(is_buyer).alias("customers"),
        F.coalesce(F.sum("_orders"), F.lit(0)).cast("long").alias("orders"),
        F.sum("_revenue").alias("_rev"),
        F.coalesce(F.sum("_big"), F.lit(0)).cast("long").alias("_big"),
        F.count_if(F.col("_orders") >= 2).alias("_repeaters"),
    )
    return g.select(
        "arm",
        "visitors",
        "converted_visitors",
        ratio("converted_visitors", "visitors").alias("conversion_rate"),
        "customers",
        "orders",
        money(F.coalesce(F.col("_rev"), F.lit(0))).alias("revenue"),
        ratio("_rev", "orders").alias("aov"),
        ratio("_rev", "visitors").alias("revenue_per_visitor"),
        ratio("_big", "orders").alias("share_orders_at_or_above_threshold"),
        ratio("_repeaters", "customers").alias("repeat_rate"),
    ).orderBy("arm")
