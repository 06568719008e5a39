"""Churn over all horizons: product-limit estimate of the time to the next purchase.

The churn tables drop user-months whose horizon ends after the data does. Here such a
user-month counts as censored: it is at risk until the data ends. S(t), the share that
has not come back within t days, follows for every t from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import day, ratio
from basketlens.operators.facts import completed_items, materialize, period_rollup
from basketlens.operators.sequence import with_next_period
from basketlens.params import Params
from basketlens.plans.churn import rollup_boundary
from basketlens.sources.tables import Tables


def product_limit(spans: DataFrame, horizon: int) -> DataFrame:
    """S(t) for t = 1..horizon from spans (elapsed int, ended boolean, n long: rows alike).

    A span that did not end was watched for `elapsed` days and is at risk on each of
    them. Output: elapsed_days, at_risk, returned, censored (spans last at risk that day),
    survival, std_error (Greenwood; null where everyone at risk returned).
    Days on which nobody is at risk have no row.
    """
    spark = spans.sparkSession
    # All that outlast the horizon are one group: at most horizon + 2 rows leave here.
    capped = F.least(F.col("elapsed"), F.lit(horizon + 1))
    by_day = spans.groupBy(capped.alias("elapsed_days")).agg(
        F.sum(F.when(F.col("ended"), F.col("n")).otherwise(0)).alias("returned"),
        F.sum(F.when(F.col("ended"), 0).otherwise(F.col("n"))).alias("censored"),
    )
    days = spark.range(0, horizon + 2).select(F.col("id").cast("int").alias("elapsed_days"))
    filled = days.join(by_day, "elapsed_days", "left").fillna(0, ["returned", "censored"])
    from_here = Window.orderBy("elapsed_days").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    risk = filled.withColumn("at_risk", F.sum(F.col("returned") + F.col("censored")).over(from_here))
    risk = risk.filter(F.col("elapsed_days").between(1, horizon) & (F.col("at_risk") > 0))
    so_far = Window.orderBy("elapsed_days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stay = F.lit(1.0) - ratio("returned", "at_risk")
    spread = F.try_divide(F.col("returned").cast("double"), F.col("at_risk").cast("double") * (F.col("at_risk") - F.col("returned")))
    out = risk.withColumn("survival", F.product(stay).over(so_far)).withColumn("_sum", F.sum(spread).over(so_far))
    error = F.when(F.col("survival") > 0, F.col("survival") * F.sqrt("_sum"))
    return out.select("elapsed_days", "at_risk", "returned", "censored", "survival", error.alias("std_error"))


def return_survival(t: Tables, p: Params, horizon: int = 180) -> DataFrame:
    """S(t) over the user-months of Task C's window: from the last completed-order day of a
    known user's month to the next order day, or to the last day of the data."""
    r = materialize(
        t,
        ("item_day_rollup", p, True),
        lambda: period_rollup(completed_items(t, p, p.start_date, p.end_date), "user_id", day("created_at")),
    )
    known = with_next_period(r).filter(F.col("user_id").isNotNull())
    until = F.coalesce(F.col("next_first_t"), rollup_boundary(r))
    spans = known.select(F.date_diff(until, "last_t").alias("elapsed"), F.col("next_first_t").isNotNull().alias("ended"))
    counted = spans.groupBy("elapsed", "ended").agg(F.count(F.lit(1)).alias("n"))
    return product_limit(counted, horizon).orderBy("elapsed_days")
