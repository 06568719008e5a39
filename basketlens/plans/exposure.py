"""Experiment arms from exposure, and the lift between arms with its uncertainty.

A user takes part from the first qualifying event in the window on; orders before it are left
out. The lift of each metric comes with two intervals: by the delta method from exact
sums, and by a one-pass Poisson bootstrap, whose weights are a keyed digest of user and
replicate: the same on every run, in any layout, and in any other engine.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import in_days, money, ratio
from basketlens.operators.asof import last_before
from basketlens.operators.facts import completed_items, completed_orders, materialize
from basketlens.params import Params
from basketlens.plans.experiment import arm
from basketlens.sources.tables import Tables

REPLICATES = 200
SEED = "lift"
# Two-sided 95 %: the normal quantile and the bootstrap's places in per mille.
Z = 1.959963984540054
LOW, HIGH = 25, 975
# Digests give this many 32-bit numbers each.
_IN_DIGEST = 4
# Poisson(1): a 32-bit number below the first bound is weight 0, below the second 1, ...
BOUNDS = [int(sum(exp(-1) / factorial(k) for k in range(n + 1)) * 2**32) for n in range(13)]


def exposures(t: Tables, p: Params) -> DataFrame:
    """user_id, exposed_at of every qualifying event of a known user in the window."""
    near = t.events_near(p.exp_start, p.exp_end)
    good = F.col("user_id").isNotNull() & (F.col("event_type") == p.top_funnel_event) & in_days("created_at", p.exp_start, p.exp_end)
    return near.filter(good).select("user_id", F.col("created_at").alias("exposed_at"))


def exposed_orders(t: Tables, p: Params) -> DataFrame:
    """Completed orders of the window that follow an exposure of their user, with the
    last exposure at or before them."""

    def build() -> DataFrame:
        orders = completed_orders(completed_items(t, p, p.exp_start, p.exp_end))
        joined = last_before(orders, exposures(t, p), "user_id", "order_ts", "exposed_at", ["exposed_at"])
        return joined.filter(F.col("exposed_at").isNotNull())

    return materialize(t, ("exposed_orders", p), build)


def exposed_orders_q(t: Tables, p: Params) -> DataFrame:
    return exposed_orders(t, p).withColumn("order_value", money("order_value"))


def assigned_users(t: Tables, p: Params) -> DataFrame:
    """One row for each exposed user: arm, assigned_at, orders, revenue (exact) and whether
    there was an order (0 or 1)."""

    def build() -> DataFrame:
        first = exposures(t, p).groupBy("user_id").agg(F.min("exposed_at").alias("assigned_at"))
        micros = F.unix_micros(F.col("order_ts").cast("timestamp")) - F.unix_micros(F.col("exposed_at").cast("timestamp"))
        bought = exposed_orders(t, p).groupBy("user_id").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("order_value").alias("revenue"), F.sum(micros).alias("waited")
        )
        none = F.lit(0)
        return first.join(bought, "user_id", "left").select(
            "user_id",
            arm(F.col("user_id"), p.treatment_share_pct).alias("arm"),
            "assigned_at",
            F.coalesce("orders", none).cast("long").alias("orders"),
            F.coalesce("revenue", none).cast("decimal(24,4)").alias("revenue"),
            F.coalesce("waited", none).cast("long").alias("waited"),
            F.col("orders").isNotNull().cast("int").alias("bought"),
        )

    return materialize(t, ("assigned_users", p), build)


def experiment_by_exposure(t: Tables, p: Params) -> DataFrame:
    """Readout by arm, of exposed users and their orders since exposure."""
    g = assigned_users(t, p).groupBy("arm").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("bought").alias("buyers"),
        F.sum("orders").alias("orders"),
        F.sum("revenue").alias("_revenue"),
        F.sum("waited").alias("_waited"),
        F.min("assigned_at").alias("first_assigned_at"),
    )
    return g.select(
        "arm",
        "users",
        "buyers",
        ratio("buyers", "users").alias("conversion_rate"),
        "orders",
        money("_revenue").alias("revenue"),
        ratio("_revenue", "orders").alias("aov"),
        ratio("_revenue", "users").alias("revenue_per_user"),
        (ratio("_waited", "orders") / F.lit(3.6e9)).alias("hours_since_exposure"),
        "first_assigned_at",
    ).orderBy("arm")


# Each metric is a ratio of two sums over users.
METRICS = {"conversion_rate": ("bought", None), "revenue_per_user": ("revenue", None), "aov": ("revenue", "orders")}


def _delta(users: DataFrame) -> DataFrame:
    """metric, arm, value and variance of the value (linearised), from exact sums."""
    parts = []
    for name, (above, below) in METRICS.items():
        n = F.col(above).cast("decimal(18,4)")
        d = (F.col(below) if below else F.lit(1)).cast("decimal(18,0)")
        parts.append(F.struct(F.lit(name).alias("metric"), n.alias("n"), d.alias("d")))
    each = users.select("arm", F.explode(F.array(*parts)).alias("m")).select("arm", "m.*")
    sums = each.groupBy("metric", "arm").agg(
        F.count(F.lit(1)).cast("double").alias("users"),
        *(money(F.sum(c)).alias(a) for a, c in (("n", F.col("n")), ("d", F.col("d")), ("nn", F.col("n") * F.col("n")), ("nd", F.col("n") * F.col("d")), ("dd", F.col("d") * F.col("d")))),
    )
    value = F.try_divide("n", "d")
    squares = F.col("nn") - 2 * F.col("value") * F.col("nd") + F.col("value") * F.col("value") * F.col("dd")
    spread = F.try_divide(squares, F.col("d") * F.col("d")) * F.try_divide(F.col("users"), F.col("users") - 1)
    return sums.withColumn("value", value).withColumn("variance", F.greatest(spread, F.lit(0.0)))


def poisson_weights(users: DataFrame, replicates: int, seed: str = SEED) -> DataFrame:
    """users with `replicate` (from 0) and its `weight`, where that is above 0."""
    blocks = -(-replicates // _IN_DIGEST)
    block = users.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("user_id").cast("string"), F.col("_block").cast("string")))
    each = block.withColumn("_digest", digest).withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(_IN_DIGEST - 1))))
    number = F.conv(F.substr("_digest", F.col("_at") * 8 + 1, F.lit(8)), 16, 10).cast("long")
    weight = sum(((F.col("_number") >= b).cast("int") for b in BOUNDS), F.lit(0))
    out = each.withColumn("replicate", F.col("_block") * _IN_DIGEST + F.col("_at")).withColumn("_number", number)
    return out.withColumn("weight", weight).filter((F.col("weight") > 0) & (F.col("replicate") < replicates)).drop(
        "_block", "_digest", "_at", "_number"
    )


def bootstrap_lifts(users: DataFrame, replicates: int = REPLICATES, seed: str = SEED) -> DataFrame:
    """metric, replicate, lift (treatment less control; null where an arm has no base).

    Weights are made and summed where a user's row is: what is shuffled are two arms of
    `replicates` rows from each task.
    """
    w, treated = F.col("weight"), F.col("arm") == "treatment"
    columns = {"one": F.lit(1), "bought": F.col("bought"), "orders": F.col("orders"), "revenue": F.col("revenue")}
    sums = [
        F.sum(F.when(side, w * c)).cast("double").alias(f"{name}_{tag}")
        for name, c in columns.items()
        for side, tag in ((treated, "t"), (~treated, "c"))
    ]
    g = poisson_weights(users, replicates, seed).groupBy("replicate").agg(*sums)
    lifts = [
        F.struct(
            F.lit(name).alias("metric"),
            (F.try_divide(f"{above}_t", f"{below or 'one'}_t") - F.try_divide(f"{above}_c", f"{below or 'one'}_c")).alias("lift"),
        )
        for name, (above, below) in METRICS.items()
    ]
    return g.select("replicate", F.explode(F.array(*lifts)).alias("m")).select("m.metric", "replicate", "m.lift")


def _place(per_mille: int) -> Column:
    """The place in a sorted array below which a share of it lies (from 1)."""
    return F.greatest(F.ceil(F.size("sorted") * F.lit(per_mille) / 1000), F.lit(1)).cast("int")


def experiment_lift(t: Tables, p: Params, replicates: int = REPLICATES, seed: str = SEED) -> DataFrame:
    """Per metric: both arms, lift, its standard error and 95 % intervals (delta method,
    bootstrap), the chi-square of the arms' sizes against the intended shares, and whether the
    lift is positive beyond doubt (`ship`: both intervals above 0)."""
    users = assigned_users(t, p)
    by_arm = [
        F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}_{a}") for a in ("control", "treatment") for c in ("value", "variance", "users")
    ]
    point = _delta(users).groupBy("metric").agg(*by_arm)
    lift = F.col("value_treatment") - F.col("value_control")
    error = F.sqrt(F.col("variance_treatment") + F.col("variance_control"))
    # At most `replicates` values for each metric.
    boot = bootstrap_lifts(users, replicates, seed).groupBy("metric").agg(F.array_sort(F.collect_list("lift")).alias("sorted"))
    ends = boot.select(
        "metric",
        F.when(F.size("sorted") > 0, F.element_at("sorted", _place(LOW))).alias("boot_low"),
        F.when(F.size("sorted") > 0, F.element_at("sorted", _place(HIGH))).alias("boot_high"),
    )
    share = p.treatment_share_pct / 100
    treated, control = (F.coalesce(F.col(f"users_{a}"), F.lit(0.0)) for a in ("treatment", "control"))
    off = treated - (treated + control) * share
    chi2 = F.try_divide(off * off, (treated + control) * share * (1 - share))
    out = point.join(ends, "metric", "left").select(
        "metric",
        F.col("value_control").alias("control"),
        F.col("value_treatment").alias("treatment"),
        lift.alias("lift"),
        error.alias("standard_error"),
        (lift - Z * error).alias("low"),
        (lift + Z * error).alias("high"),
        "boot_low",
        "boot_high",
        chi2.alias("sample_ratio_chi2"),
    )
    return out.withColumn("ship", F.coalesce((F.col("low") > 0) & (F.col("boot_low") > 0), F.lit(False))).orderBy("metric")
