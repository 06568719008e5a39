"""Column-level helpers (built-in expressions only)."""

from basketlens.functions.columns import (  # noqa: F401
    band,
    bucket,
    date_lit,
    date_plus,
    day,
    in_days,
    label_rank,
    mean_of,
    midnight,
    money,
    month,
    numbered,
    ordered,
    ordered_case,
    plus_days,
    ratio,
    share_of_rows,
)
