"""Query parameters.

Every definition that differs between the reference's three dialects
(date window, grain, purchase-history scope, churn clock, labels) is an
explicit field here instead of a silent choice inside a metric.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from datetime import date


def _money_label(x: float) -> str:
    """'$100', '$1250000', '$99.5': plain digits at any size."""
    return "$" + (f"{x:.0f}" if x == int(x) else f"{x:.2f}".rstrip("0"))


# The defaults below (dates, threshold 100, bands 50/75/100/125,
# 90/180-day recency, 3/2 order cuts, 0.75 quantile, event names 'department'
# and 'purchase', status 'Complete', and the period labels) are the ones the
# original analysis uses; every one can be overridden.


@dataclass(frozen=True)
class Params:
    # Analysis window (inclusive calendar days). end_date=None means open-ended.
    start_date: date | None = date(2020, 1, 1)
    end_date: date | None = date(2024, 12, 31)

    # Launch scenario (pre/post proxy around a product change).
    pre_start: date = date(2021, 12, 16)
    launch_date: date = date(2022, 1, 15)
    post_end: date = date(2022, 2, 14)

    # Money thresholds.
    threshold: float = 100.0
    band_edges: tuple[float, ...] = (50.0, 75.0, 100.0, 125.0)

    # Churn and recency.
    horizon_days: int = 90
    recent_days: int = 90
    at_risk_days: int = 180
    champion_min_orders: int = 3
    repeat_min_orders: int = 2
    high_value_quantile: float = 0.75

    # Funnel event names.
    top_funnel_event: str = "department"
    conversion_event: str = "purchase"
    completed_status: str = "Complete"

    # Trailing window for the order-value bands and summary KPIs.
    trailing_months: int = 12

    # Experiment readout window (defaults to the post-launch window).
    experiment_start: date | None = None
    experiment_end: date | None = None
    treatment_share_pct: int = 50

    # Labels (the dialects disagree, so they are parameters; see V12).
    pre_label: str = "Pre-Launch"
    post_label: str = "Post-Launch"
    baseline_pre_label: str = "Pre-launch"
    baseline_post_label: str = "Post-launch"
    # None: built from the threshold.
    high_label: str | None = None
    low_label: str | None = None
    # Index in band_edges of the lower edge of the band just below the threshold.
    near_band: int = 1

    def with_(self, **kw) -> "Params":
        return dataclasses.replace(self, **kw)

    @property
    def at_or_above_label(self) -> str:
        return self.high_label or f"At/Above {_money_label(self.threshold)}"

    @property
    def below_label(self) -> str:
        return self.low_label or f"Below {_money_label(self.threshold)}"

    @property
    def band_labels(self) -> list[str]:
        """'<$50', '$50-$74', ..., '$125+' built from the band edges."""
        e = self.band_edges
        labels = [f"<{_money_label(e[0])}"]
        for lo, hi in zip(e, e[1:]):
            labels.append(f"{_money_label(lo)}-{_money_label(hi - 1)}")
        labels.append(f"{_money_label(e[-1])}+")
        return labels

    @property
    def near_band_label(self) -> str:
        """The band that starts at band_edges[near_band]."""
        return self.band_labels[self.near_band + 1]

    @property
    def exp_start(self) -> date:
        return self.experiment_start or self.launch_date

    @property
    def exp_end(self) -> date:
        return self.experiment_end or self.post_end


def default_params() -> Params:
    """Parameters of the original analysis over order_items/events/users tables."""
    return Params()


def fixture_params() -> Params:
    """Parameters for the driver tables (dates moved into the fixture's range,
    money scaled by 1000 because fixture order values are ~1000x larger,
    and `view` plays the top-of-funnel event)."""
    return Params(
        start_date=date(1996, 1, 1),
        end_date=date(2000, 12, 31),
        pre_start=date(1997, 12, 16),
        launch_date=date(1998, 1, 15),
        post_end=date(1998, 2, 14),
        threshold=100000.0,
        band_edges=(50000.0, 75000.0, 100000.0, 125000.0),
        top_funnel_event="view",
        experiment_start=date(2000, 1, 1),
        experiment_end=date(2000, 1, 31),
    )
