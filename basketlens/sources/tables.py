"""Parquet scans and the three logical inputs every metric reads.

The metrics take a `Tables` bundle:

* ``order_items``: id, order_id, user_id, status, created_at (TIMESTAMP_NTZ,
  UTC wall clock), returned_at, sale_price
* ``events``: user_id (nullable), created_at (TIMESTAMP_NTZ), event_type
* ``users``: id, traffic_source

Loading is lazy: nothing is read until an action runs, and Catalyst prunes
each scan to the columns and row groups a query needs.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_ITEM_COLUMNS = ["id", "order_id", "user_id", "status", "created_at", "returned_at", "sale_price"]
EVENT_COLUMNS = ["user_id", "created_at", "event_type"]
USER_COLUMNS = ["id", "traffic_source"]


def load(spark: SparkSession, directory: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan `<directory>/<table>.parquet` (a file or a folder of parts)."""
    df = spark.read.parquet(os.path.join(directory, f"{table}.parquet"))
    return df.select(*columns) if columns else df


def scan_projected(spark: SparkSession, directory: str, table: str, columns: Sequence[str]) -> DataFrame:
    """Scan with an explicit column list; the Parquet reader only decodes these."""
    return load(spark, directory, table, columns)


@dataclass(frozen=True)
class Tables:
    order_items: DataFrame
    events: DataFrame
    users: DataFrame
    # Materialized intermediates shared by every metric built on this bundle
    # (see `operators.facts.materialize`).
    memo: dict = field(default_factory=dict, compare=False, repr=False)
    # Views over raw tables may narrow their scans: given a status and calendar days
    # (either bound None), a frame with at least the rows that have them. Metrics
    # still filter what they get.
    narrow_items: Callable[[str, date | None, date | None], DataFrame] | None = None
    narrow_events: Callable[[date | None, date | None], DataFrame] | None = None

    def items_near(self, status: str, start: date | None, end: date | None) -> DataFrame:
        return self.narrow_items(status, start, end) if self.narrow_items else self.order_items

    def events_near(self, start: date | None, end: date | None) -> DataFrame:
        return self.narrow_events(start, end) if self.narrow_events else self.events

    def register(self, prefix: str = "") -> None:
        """Expose the inputs as temp views (warehouse-style names)."""
        self.order_items.createOrReplaceTempView(f"{prefix}order_items")
        self.events.createOrReplaceTempView(f"{prefix}events")
        self.users.createOrReplaceTempView(f"{prefix}users")


def _ntz(df: DataFrame, c: str, unit: str | None) -> Column:
    """A UTC wall clock. Timestamps in nanoseconds reach Spark as bigint, and only if
    the session has spark.sql.legacy.parquet.nanosAsLong set; `unit` says what a
    bigint counts."""
    if dict(df.dtypes)[c] == "bigint":
        if unit is None:
            raise ValueError(f"{c} is a bigint: say what it counts (unit='ns', 'us', 'ms' or 's')")
        per_second = {"ns": 10**9, "us": 10**6, "ms": 10**3, "s": 1}[unit]
        micros = f"`{c}` div {per_second // 10**6}" if per_second > 10**6 else f"`{c}` * {10**6 // per_second}"
        return F.timestamp_micros(F.expr(micros)).cast("timestamp_ntz").alias(c)
    return F.col(c).cast("timestamp_ntz").alias(c)


def _typed(items: DataFrame, events: DataFrame, users: DataFrame, unit: str | None) -> Tables:
    """The three inputs with the columns, times and exact money that metrics rely on."""
    ids = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
    return Tables(
        order_items=items.select(
            *ids("id", "order_id", "user_id"),
            "status",
            _ntz(items, "created_at", unit),
            _ntz(items, "returned_at", unit),
            F.col("sale_price").cast("decimal(18,4)").alias("sale_price"),
        ),
        events=events.select(*ids("user_id"), _ntz(events, "created_at", unit), "event_type"),
        users=users.select(*ids("id"), "traffic_source"),
    )


def shop_tables(spark: SparkSession, directory: str, unit: str | None = None) -> Tables:
    """Inputs in the original file layout (order_items/events/users.parquet).

    Timezone-aware timestamps become UTC wall-clock TIMESTAMP_NTZ (the session's
    time zone has to be UTC), money becomes DECIMAL.
    """
    return _typed(*(load(spark, directory, n) for n in ("order_items", "events", "users")), unit)


def catalog_tables(spark: SparkSession, database: str | None = None, prefix: str = "", unit: str | None = None) -> Tables:
    """Inputs from the session catalog by name (`spark.table`): warehouse
    tables `<database>.order_items` / `events` / `users`, or temp views."""

    def table(n: str) -> DataFrame:
        return spark.table(f"{database}.{prefix}{n}" if database else f"{prefix}{n}")

    return _typed(table("order_items"), table("events"), table("users"), unit)
