"""Monthly sales and churn kept up to date by the months that changed.

A store is a folder with three tables partitioned by month: completed items by (user, order,
month), monthly sales, monthly churn. A run is told which items came, changed or went
since the last one, late ones included; it recomputes their months from the source and
overwrites those partitions, nothing else. A month's churn also depends on what follows
within the horizon and on how far the data reaches, so the months before a changed one
and those that were not mature are recomputed too, from the partitions that their horizons
reach. A run that died is repeated as it was: partitions are replaced, never added to.

Only lists of months, which grow with the calendar, are held by the driver.
"""

from __future__ import annotations

import calendar
import os
from collections.abc import Iterable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions import date_lit, day, money, month, ratio
from basketlens.operators.facts import completed_items
from basketlens.params import Params
from basketlens.plans.churn import churn_counts, flag_churn
from basketlens.sources.export import _file_system
from basketlens.sources.tables import Tables

ORDERS, SALES, CHURN = "order_months", "monthly_sales", "monthly_churn"
ORDERS_SCHEMA = "user_id long, order_id long, first_day date, last_day date, value decimal(38,4), units long, month date"
SALES_SCHEMA = "revenue double, orders long, units long, aov double, last_day date, month date"


def _last_day(m: date) -> date:
    return m.replace(day=calendar.monthrange(m.year, m.month)[1])


def _runs(months: Iterable[date]) -> list[tuple[date, date]]:
    """First and last day of each run of adjoining months."""
    runs: list[tuple[date, date]] = []
    for m in sorted(months):
        if runs and runs[-1][1] + timedelta(days=1) == m:
            runs[-1] = (runs[-1][0], _last_day(m))
        else:
            runs.append((m, _last_day(m)))
    return runs


def _read(spark: SparkSession, path: str, schema: str, months: Iterable[date] | None = None) -> DataFrame:
    """A table of the store, or only the partitions of some months."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path)
    return df if months is None else df.filter(F.col("month").isin([date_lit(m) for m in months]))


def _replace(df: DataFrame, path: str, months: Iterable[date]) -> None:
    """Overwrite the partitions of `months`; one without rows any more is removed."""
    spark = df.sparkSession
    # Large months are cut into several files, small ones are not scattered.
    spread = df.hint("rebalance", "month")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    written = {r["month"] for r in df.select("month").distinct().collect()} if months else set()
    for m in set(months) - written:
        fs, at = _file_system(spark, os.path.join(path, f"month={m.isoformat()}"))
        fs.delete(at, True)


def order_months(t: Tables, p: Params, months: Iterable[date]) -> DataFrame:
    """Completed items of some months by user, order and month, from the source."""
    parts = [completed_items(t, p, first, last) for first, last in _runs(months)]
    items = reduce(DataFrame.unionByName, parts).withColumn("_day", day("created_at"))
    return items.groupBy("user_id", "order_id", month("_day").alias("month")).agg(
        F.min("_day").alias("first_day"),
        F.max("_day").alias("last_day"),
        F.sum("sale_price").cast("decimal(38,4)").alias("value"),
        F.count("id").alias("units"),
    )


def _sales(orders: DataFrame) -> DataFrame:
    return orders.groupBy("month").agg(
        money(F.sum("value")).alias("revenue"),
        F.countDistinct("order_id").alias("orders"),
        F.sum("units").alias("units"),
        ratio(F.sum("value"), F.countDistinct("order_id")).alias("aov"),
        F.max("last_day").alias("last_day"),
    )


def _churn(orders: DataFrame, months: list[date], boundary: date, horizon: int) -> DataFrame:
    rollup = orders.groupBy("user_id", F.col("month").alias("period_start")).agg(
        F.min("first_day").alias("first_t"), F.max("last_day").alias("last_t")
    )
    flagged = flag_churn(rollup, date_lit(boundary), horizon, "date")
    return churn_counts(flagged.filter(F.col("period_start").isin([date_lit(m) for m in months])), horizon)


def refresh(t: Tables, p: Params, store: str, changed: DataFrame | None = None) -> dict[str, list[date]]:
    """Bring a store up to date with `t`. changed(created_at): the items that differ from the
    last run (their old times too, where a time changed); None: all. Returns the months
    recomputed by table. Items without a time count nowhere.
    """
    spark = t.order_items.sparkSession
    path = lambda name: os.path.join(store, name)
    told = t.order_items if changed is None else changed
    dirty = sorted(r[0] for r in told.select(month("created_at")).distinct().collect() if r[0] is not None)
    if not dirty:
        return {SALES: [], CHURN: []}
    before = {r["month"]: r["last_day"] for r in _read(spark, path(SALES), SALES_SCHEMA).collect()}
    _replace(order_months(t, p, dirty), path(ORDERS), dirty)
    sales = _sales(_read(spark, path(ORDERS), ORDERS_SCHEMA, dirty))
    _replace(sales, path(SALES), dirty)

    now = {r["month"]: r["last_day"] for r in _read(spark, path(SALES), SALES_SCHEMA).collect()}
    reach = timedelta(days=p.horizon_days)
    # Up to this day nothing changed in how far the data reaches.
    settled = min(max(before.values(), default=date.min), max(now.values(), default=date.min))
    again = [
        m
        for m in sorted(before.keys() | now.keys())
        if _last_day(m) + reach > settled or any(m <= d <= _last_day(m) + reach for d in dirty)
    ]
    needed = [m for m in now if any(a <= m <= _last_day(a) + reach for a in again)]
    if now:
        orders = _read(spark, path(ORDERS), ORDERS_SCHEMA, needed)
        churn = _churn(orders, again, max(now.values()), p.horizon_days)
    else:
        churn = _read(spark, path(CHURN), _churn_schema(p.horizon_days)).limit(0)
    _replace(churn, path(CHURN), again)
    return {SALES: dirty, CHURN: again}


def _churn_schema(h: int) -> str:
    return f"active_customers long, churned_customers_{h}d long, churn_rate_{h}d double, month date"


def stored_sales(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, os.path.join(store, SALES), SALES_SCHEMA).select("month", "revenue", "orders", "units", "aov")


def stored_churn(spark: SparkSession, p: Params, store: str) -> DataFrame:
    h = p.horizon_days
    columns = ["month", "active_customers", f"churned_customers_{h}d", f"churn_rate_{h}d"]
    return _read(spark, os.path.join(store, CHURN), _churn_schema(h)).select(*columns)
