"""Column helpers: calendar buckets, safe ratios, money, labels.

All return built-in Column expressions, so they stay inside whole-stage
codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(c: str | Column) -> Column:
    """Calendar day of a timestamp (`DATE(ts)`)."""
    return F.to_date(col(c))


def month(c: str | Column) -> Column:
    """First day of the month as a DATE (`DATE_TRUNC(.., MONTH)`)."""
    return F.trunc(F.to_date(col(c)), "MM")


def bucket(c: str | Column, period: str) -> Column:
    """Calendar bucket start as a DATE: 'month', 'week' (Monday) or 'day'."""
    if period == "month":
        return month(c)
    if period == "week":
        return F.trunc(F.to_date(col(c)), "week")
    if period == "day":
        return day(c)
    raise ValueError(f"unknown period {period!r}")


def midnight(c: str | Column) -> Column:
    """Midnight of a timestamp, as TIMESTAMP_NTZ (pandas `normalize`)."""
    return F.to_date(col(c)).cast("timestamp_ntz")


def plus_days(c: str | Column, n: int) -> Column:
    """Add whole days to a timestamp (`ts + INTERVAL n DAY`)."""
    return col(c) + F.make_dt_interval(F.lit(n))


def date_plus(c: str | Column, n: int) -> Column:
    """Add whole days to a DATE (`DATE_ADD(d, INTERVAL n DAY)`)."""
    return F.date_add(col(c), n)


def date_lit(d: date) -> Column:
    return F.lit(d).cast("date")


def in_days(c: str | Column, start: date | None, end: date | None) -> Column:
    """Inclusive calendar-day window on a timestamp (`DATE(ts) BETWEEN a AND b`).

    Catalyst turns this into a half-open timestamp range that reaches the
    Parquet scan as a pushed filter.
    """
    d = day(c)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (d >= date_lit(start))
    if end is not None:
        cond = cond & (d <= date_lit(end))
    return cond


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as DOUBLE; null when den is 0 or null (`SAFE_DIVIDE`)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def money(c: str | Column) -> Column:
    """Money output type (exact decimal sums are converted once, at the end)."""
    return col(c).cast("double")


def share_of_rows(cond: Column) -> Column:
    """Mean of a boolean as DOUBLE (`AVG(CASE WHEN .. THEN 1.0 ELSE 0.0 END)`)."""
    return ratio(F.count_if(cond), F.count(F.lit(1)))


def mean_of(c: str | Column) -> Column:
    """Mean as DOUBLE computed from the exact sum and the row count."""
    return ratio(F.sum(col(c)), F.count(col(c)))


def ordered_case(value: Column, rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Multi-way CASE, first matching rule wins."""
    expr = None
    for cond, label in rules:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def band(value: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label a value by half-open bands: < e0, [e0, e1), ..., >= e_last."""
    v = col(value)
    rules = [(v < F.lit(e), lab) for e, lab in zip(edges, labels)]
    return ordered_case(v, rules, labels[len(edges)])


def ordered(df, *cols, on: bool = True):
    """Sort a (small) result for presentation, like the original ORDER BY.

    Internal reuse passes on=False so no sort sits inside a larger plan."""
    return df.orderBy(*cols) if on else df


def numbered(df, *by):
    """Add `position`, the place of each row of a small result in the order of `by`."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*by)).cast("long"))


def label_rank(c: str | Column, labels: Sequence[str]) -> Column:
    """Integer position of a label in a fixed order (ordered categorical)."""
    m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i + 1))])
    return m[col(c)]
