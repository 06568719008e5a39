"""Per-user ordering operators: next activity, first orders, full sequences.

A window partitioned by user over raw rows puts all of one user's rows in
one task. A single customer can hold a large share of all orders, so these
operators never do that. Instead they:

* roll up to (user, calendar period) first: at most one row per period,
  so per-user windows work on a bounded number of rows;
* use `row_number() <= k`, which Spark turns into a partial
  WindowGroupLimit that keeps only k rows per user *before* the shuffle;
* for a full sequence, rank inside ranges of the global (user, time) order and add
  per-range offsets (see `ranges`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.operators.ranges import PART, in_ranges


def with_next_period(rollup: DataFrame, user: str = "user_id", period: str = "period_start") -> DataFrame:
    """Add `next_first_t`: first time of the user's next active period.

    Because `last_t` is the latest time in its period, the first time of the
    next active period is the next distinct time after `last_t` (or null).
    This replaces the band self-join "any order in (last, last + h]" and the
    per-order LEAD with a window over at most one row per period.
    """
    w = Window.partitionBy(user).orderBy(period)
    return rollup.withColumn("next_first_t", F.lead("first_t").over(w))


def first_rows(df: DataFrame, key: str, order_cols: list[str], k: int) -> DataFrame:
    """The first k rows per key by `order_cols` (ties broken by later columns).

    Planned as Sort -> WindowGroupLimit(Partial) -> Exchange -> WindowGroupLimit(Final),
    so at most k rows per key and map task are shuffled.
    """
    w = Window.partitionBy(key).orderBy(*order_cols)
    return df.withColumn("seq", F.row_number().over(w)).filter(F.col("seq") <= k)


def first_two_orders(orders: DataFrame) -> DataFrame:
    """Per user: the first order (by time, then order id) and the time of the
    order that follows it (`LEAD` at rank 1). Output: user_id, order_id,
    order_ts, order_value, next_order_ts."""
    top = first_rows(orders, "user_id", ["order_ts", "order_id"], 2)
    # Rows are already partitioned by user after the window: no new shuffle.
    return top.groupBy("user_id").agg(
        F.max(F.when(F.col("seq") == 1, F.col("order_id"))).alias("order_id"),
        F.max(F.when(F.col("seq") == 1, F.col("order_ts"))).alias("order_ts"),
        F.max(F.when(F.col("seq") == 1, F.col("order_value"))).alias("order_value"),
        F.max(F.when(F.col("seq") == 2, F.col("order_ts"))).alias("next_order_ts"),
    )


def sequence(df: DataFrame, key: str, ts: str, tiebreak: str) -> DataFrame:
    """Full per-key sequence: adds `order_rank` (ROW_NUMBER by ts, tiebreak)
    and `next_ts` (LEAD of ts in that order) to every row, null keys included.

    The rows are cut into ranges of (key, ts, tiebreak), so a customer with a large
    share of all orders is spread over many tasks, even on one day. Ranks and next
    times inside a range come from a window there; a window over one row per (key, range)
    adds the rank offset and the first time of the key's next range.
    """
    rows = in_ranges(df, *dict.fromkeys([key, ts, tiebreak]))
    here = Window.partitionBy(PART, key).orderBy(ts, tiebreak)
    local = rows.withColumn("_rn", F.row_number().over(here)).withColumn("_next", F.lead(ts).over(here)).alias("l")
    per_range = rows.groupBy(key, PART).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_first"))
    w = Window.partitionBy(key).orderBy(PART)
    offsets = per_range.select(
        key,
        PART,
        (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_off"),
        F.lead("_first").over(w).alias("_next_range"),
    ).alias("o")
    same = (F.col(f"l.{PART}") == F.col(f"o.{PART}")) & F.col(f"l.{key}").eqNullSafe(F.col(f"o.{key}"))
    return local.join(offsets, same).select(
        *(F.col(f"l.{c}").alias(c) for c in df.columns),
        (F.col("_off") + F.col("_rn")).cast("long").alias("order_rank"),
        F.coalesce("_next", "_next_range").alias("next_ts"),
    )


def next_distinct_time(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Distinct (key, ts) pairs with the next distinct time per key
    (dedupe + sort + shift(-1)). Same two-level plan as `sequence`."""
    d = df.select(key, ts).distinct()
    s = sequence(d, key, ts, ts)
    return s.select(key, ts, F.col("next_ts").alias("next_" + ts))
