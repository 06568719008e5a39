"""Views that present the driver's TPC-H-style tables as the three inputs.

Mapping (see FIXTURES.md section 3):

* order_items = lineitem JOIN orders on the order key.
  created_at is the order date plus 7 hours per line number, so orders span
  days and sometimes months; status 'Complete' for finished orders ('F');
  returned_at is the ship date of returned lines ('R'); sale_price is the
  discounted extended price as DECIMAL(18,4) so sums are exact.
  Every 29th order has no known customer.
* events = events with every tenth event anonymous (null user), shifted back
  24 years so it overlaps the sales history.
* users = customers, market segment as traffic source.

The join is an equi join on the order key; both sides grow with the data,
so it is left to the planner (sort-merge, or broadcast when AQE measures
one side as small). `narrow_items` and `narrow_events` state a metric's filters on the raw
columns, which is where Parquet can skip row groups.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.sources.tables import Tables, load

COMPLETE = "Complete"
EVENT_YEARS = 24
# An order has at most seven lines (fixed by the tables' specification), 42 hours.
SPREAD_DAYS = 2


def order_items_view(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    # One price and one time that is mostly null pass through the join, not the columns
    # that they are made from. The price becomes a decimal, which may fail, after it.
    price = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))
    li = lineitem.select("l_orderkey", "l_linenumber", price.alias("_price"), returned.alias("returned_at"))
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        F.col("l_linenumber").cast("long").alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_orderkey") % 29 != 0, F.col("o_custkey")).alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit(COMPLETE)).otherwise(F.lit("Other")).alias("status"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(7) * (F.col("l_linenumber") - 1))).alias(
            "created_at"
        ),
        "returned_at",
        F.col("_price").cast("decimal(18,4)").alias("sale_price"),
    )


def events_view(events: DataFrame) -> DataFrame:
    return events.select(
        F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("user_id"),
        (F.col("ts") - F.make_ym_interval(F.lit(EVENT_YEARS), F.lit(0))).alias("created_at"),
        "event_type",
    )


def users_view(customer: DataFrame) -> DataFrame:
    return customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("traffic_source"))


def _shifted(day: date | None, days: int, years: int = 0) -> datetime | None:
    """Midnight of a day moved by whole days and years."""
    if day is None:
        return None
    moved = datetime.combine(day, datetime.min.time()) + timedelta(days=days)
    return moved.replace(year=moved.year + years, day=min(moved.day, 28) if moved.month == 2 else moved.day)


def _between(c: str, low: datetime | None, high: datetime | None) -> Column:
    """low <= c < high on a raw column, so that the bounds reach the scan."""
    cond = F.lit(True)
    if low is not None:
        cond = cond & (F.col(c) >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        cond = cond & (F.col(c) < F.lit(high).cast("timestamp_ntz"))
    return cond


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    lineitem, orders, events = (load(spark, sf_dir, n) for n in ("lineitem", "orders", "events"))

    def items_near(status: str, start: date | None, end: date | None) -> DataFrame:
        # Item times are up to 7 hours a line behind the order date, so an order in
        # question begins at most SPREAD_DAYS before the window and not after it.
        low, high = _shifted(start, -SPREAD_DAYS), _shifted(end, 1)
        near = orders.filter(_between("o_orderdate", low, high))
        if status != COMPLETE:
            return order_items_view(lineitem, near)
        # Completed items: finished orders and no returned lines.
        return order_items_view(
            lineitem.filter(~F.col("l_returnflag").eqNullSafe("R")), near.filter(F.col("o_orderstatus") == "F")
        )

    def events_near(start: date | None, end: date | None) -> DataFrame:
        # One day more on either side, as months differ in length.
        return events_view(events.filter(_between("ts", _shifted(start, -2, EVENT_YEARS), _shifted(end, 3, EVENT_YEARS))))

    return Tables(
        order_items=order_items_view(lineitem, orders),
        events=events_view(events),
        users=users_view(load(spark, sf_dir, "customer")),
        narrow_items=items_near,
        narrow_events=events_near,
    )
