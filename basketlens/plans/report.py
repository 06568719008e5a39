"""Analysis context, summary KPIs and the dashboard payload document.

Every piece here is a one-row aggregate or a relation bounded by the
calendar (one row per month) or by a fixed label set. One-row pieces enter
the final row as scalar subqueries (no joins), and the document's arrays
are small `collect_list`s over those bounded relations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions import date_lit, label_rank, midnight, ordered
from basketlens.operators.facts import all_orders, item_month_revenue, max_scalar, order_month_rollup, row_scalar
from basketlens.params import Params
from basketlens.plans.churn import churn_90d_floor_days
from basketlens.plans.launch import prepost_baseline
from basketlens.plans.mix import customer_mix_order_grain
from basketlens.plans.orders import first_order_repeat_by_channel, order_value_bands
from basketlens.plans.segments import SEGMENTS, customer_snapshot, revenue_threshold, segment_split
from basketlens.sources.tables import Tables

# Row labels of the analysis context table.
CONTEXT_LABELS = [
    "Latest completed-order date in dataset",
    "Last full month used for mix and segmentation",
    "Last mature month available for 90-day churn",
    "Purchasing customers in segment snapshot",
]

STAT_DIGITS = 10


def _date_context(t: Tables, p: Params) -> dict[str, Column]:
    """Latest completed-order day, last full month and its last day.

    One scalar subquery over the materialized user-month rollup; every use of
    these columns refers to it, so it is evaluated once per query."""
    mx = F.to_date(max_scalar(order_month_rollup(t, p, from_start=False), F.col("last_t")))
    lfm = F.add_months(F.trunc(mx, "MM"), -1)
    return {"datasetMaxDate": mx, "lastFullMonth": lfm, "snapshotDate": F.last_day(lfm)}


def _iso(c: str | Column) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def analysis_context(t: Tables, p: Params) -> DataFrame:
    """Four metric/value rows, notebook semantics (midnight cutoffs)."""
    dc = _date_context(t, p)
    orders = all_orders(t, p)
    churn_max = churn_90d_floor_days(t, p, sort=False).agg(F.max("month")).scalar()
    buyers = orders.filter(F.col("order_ts") <= midnight(dc["snapshotDate"])).agg(
        F.countDistinct("user_id").alias("_buyers")
    )
    names = ["_a", "_b", "_c", "_d"]
    values = [_iso(dc["datasetMaxDate"]), _iso(dc["snapshotDate"]), _iso(churn_max), F.format_number("_buyers", 0)]
    row = buyers.select(*[v.alias(n) for v, n in zip(values, names)])
    args = ", ".join(f"'{label}', {name}" for label, name in zip(CONTEXT_LABELS, names))
    return row.selectExpr(f"stack(4, {args}) AS (metric, value)")


def _churn_since_start(t: Tables, p: Params) -> DataFrame:
    c = churn_90d_floor_days(t, p, sort=False)
    return c.filter(F.col("month") >= date_lit(p.start_date)) if p.start_date else c


def mix_since_start(t: Tables, p: Params, sort: bool = True) -> DataFrame:
    """The mix chart: months from the start to the last full one, first months over all
    history."""
    lfm = _date_context(t, p)["lastFullMonth"]
    mix = customer_mix_order_grain(t, p, history="all", sort=False)
    return ordered(mix.filter((F.col("month") >= date_lit(p.start_date)) & (F.col("month") <= lfm)), "month", on=sort)


def churn_since_start(t: Tables, p: Params) -> DataFrame:
    """The churn chart: notebook churn with item-month revenue from the start."""
    return _churn_since_start(t, p).orderBy("month")


def revenue_churn_corr(t: Tables, p: Params) -> DataFrame:
    """Pearson correlation of monthly churn rate and revenue since the start month."""
    c = _churn_since_start(t, p)
    rate = f"churn_rate_{p.horizon_days}d"
    return c.agg(
        F.count(F.lit(1)).alias("months"),
        F.round(F.corr(rate, "revenue"), STAT_DIGITS).alias("revenue_churn_correlation"),
    )


def _pct_mean(cond: str, c: str) -> Column:
    return F.round(F.avg(F.when(F.col(cond), F.col(c) * 100)), STAT_DIGITS)


def summary_kpis(t: Tables, p: Params) -> DataFrame:
    """The 17 summary scalars (shares in percent, as in the published summary)."""
    dc = _date_context(t, p)
    lfm = dc["lastFullMonth"]
    first12 = F.add_months(lfm, -(p.trailing_months - 1))
    start = date_lit(p.start_date)
    in_last12 = F.col("month").between(first12, lfm)

    # Item-month revenue: the base one-row relation of the summary.
    rev = item_month_revenue(t, p).withColumnRenamed("revenue", "rev")
    base = rev.withColumn("_since", F.col("month") >= start).withColumn("_last12", in_last12).agg(
        F.sum(F.when(F.col("_since"), F.col("rev"))).cast("double").alias("totalRevenueSince2020"),
        F.sum(F.when(F.col("_last12"), F.col("rev"))).cast("double").alias("revenueLast12Months"),
    )

    mix = customer_mix_order_grain(t, p, history="all", sort=False)
    mix_row = row_scalar(
        mix.select(
            "month",
            "returning_share",
            ((F.col("month") >= start) & (F.year("month") == F.year(start))).alias("_y0"),
            in_last12.alias("_last12"),
            (F.col("month") == lfm).alias("_lfm"),
        ).agg(
            _pct_mean("_y0", "returning_share").alias("y0"),
            _pct_mean("_last12", "returning_share").alias("last12"),
            F.round(F.max(F.when(F.col("_lfm"), F.col("returning_share") * 100)), STAT_DIGITS).alias("latest"),
        )
    )

    rate = f"churn_rate_{p.horizon_days}d"
    churn = _churn_since_start(t, p)
    churn_row = row_scalar(
        churn.agg(
            F.round(F.avg(F.col(rate) * 100), STAT_DIGITS).alias("avg"),
            F.round(F.min(F.col(rate) * 100), STAT_DIGITS).alias("min"),
            F.min(rate).alias("min_rate"),
            F.round(F.corr(rate, "revenue"), STAT_DIGITS).alias("corr"),
        )
    )
    min_month = churn.filter(F.col(rate) == churn_row["min_rate"]).agg(F.min("month")).scalar()
    mature = churn_90d_floor_days(t, p, sort=False).agg(F.max("month")).scalar()

    customers = customer_snapshot(t, p).agg(F.count("user_id")).scalar()
    threshold = revenue_threshold(t, p).scalar()
    near = p.near_band_label
    band_row = row_scalar(
        order_value_bands(t, p, sort=False).agg(
            F.coalesce(F.max(F.when(F.col("order_band") == near, F.col("orders"))), F.lit(0)).alias("orders"),
            F.round(F.max(F.when(F.col("order_band") == near, F.col("order_share") * 100)), STAT_DIGITS).alias(
                "share"
            ),
        )
    )
    return base.select(
        dc["datasetMaxDate"].alias("datasetMaxDate"),
        lfm.alias("lastFullMonth"),
        dc["snapshotDate"].alias("snapshotDate"),
        mature.alias("lastMatureChurnMonth"),
        "totalRevenueSince2020",
        "revenueLast12Months",
        mix_row["y0"].alias("returningShare2020Avg"),
        mix_row["last12"].alias("returningShareLatest12mAvg"),
        mix_row["latest"].alias("latestReturningShare"),
        churn_row["avg"].alias("avgChurnSince2020"),
        churn_row["min"].alias("minChurnSince2020"),
        min_month.alias("minChurnMonth"),
        churn_row["corr"].alias("revenueChurnCorrelation"),
        customers.alias("purchasingCustomersSnapshot"),
        threshold.alias("highValueThreshold"),
        band_row["orders"].alias("orders75to99Last12m"),
        band_row["share"].alias("orders75to99ShareLast12m"),
    )


def _array(key: Column, fields: list[Column]) -> Column:
    """Bounded relation -> sorted array<struct> (aggregate expression)."""
    return F.transform(
        F.sort_array(F.collect_list(F.struct(key.alias("_k"), *fields))), lambda s: s.dropFields("_k")
    )


def dashboard_payload(t: Tables, p: Params) -> DataFrame:
    """The published document: summary + six sections, as one JSON string."""
    s = summary_kpis(t, p)
    # Decimals, so that large amounts are written in plain digits.
    r2 = lambda c: F.col(c).cast("decimal(24,2)")
    r3 = lambda c: F.col(c).cast("decimal(24,3)")
    r4 = lambda c: F.col(c).cast("decimal(24,4)")
    summary = F.struct(
        _iso("datasetMaxDate").alias("datasetMaxDate"),
        _iso("lastFullMonth").alias("lastFullMonth"),
        _iso("snapshotDate").alias("snapshotDate"),
        _iso("lastMatureChurnMonth").alias("lastMatureChurnMonth"),
        r2("totalRevenueSince2020").alias("totalRevenueSince2020"),
        r2("revenueLast12Months").alias("revenueLast12Months"),
        r2("returningShare2020Avg").alias("returningShare2020Avg"),
        r2("returningShareLatest12mAvg").alias("returningShareLatest12mAvg"),
        r2("latestReturningShare").alias("latestReturningShare"),
        r2("avgChurnSince2020").alias("avgChurnSince2020"),
        r2("minChurnSince2020").alias("minChurnSince2020"),
        _iso("minChurnMonth").alias("minChurnMonth"),
        r3("revenueChurnCorrelation").alias("revenueChurnCorrelation"),
        F.col("purchasingCustomersSnapshot"),
        r2("highValueThreshold").alias("highValueThreshold"),
        F.col("orders75to99Last12m"),
        r2("orders75to99ShareLast12m").alias("orders75to99ShareLast12m"),
    )
    h = p.horizon_days

    mix = mix_since_start(t, p, sort=False)
    mix_arr = mix.agg(
        _array(F.col("month"), [
            _iso("month").alias("month"), r2("new_revenue").alias("new_revenue"),
            r2("returning_revenue").alias("returning_revenue"), r2("total_revenue").alias("total_revenue"),
            r4("returning_share").alias("returning_share"),
        ])
    ).scalar()
    churn_arr = _churn_since_start(t, p).agg(
        _array(F.col("month"), [
            _iso("month").alias("month"), F.col("active_customers"),
            F.col(f"churned_customers_{h}d").alias(f"churned_customers_{h}d"),
            r4(f"churn_rate_{h}d").alias(f"churn_rate_{h}d"), r2("revenue").alias("revenue"),
        ])
    ).scalar()
    seg_arr = segment_split(t, p, sort=False).agg(
        _array(label_rank("segment", SEGMENTS), [
            F.col("segment"), F.col("customers"), r4("revenue").alias("revenue"), r4("avg_orders").alias("avg_orders"),
            r4("customer_share").alias("customer_share"), r4("revenue_share").alias("revenue_share"),
        ])
    ).scalar()
    ship_arr = prepost_baseline(t, p, sort=False).agg(
        _array(F.when(F.col("period") == p.baseline_post_label, 0).otherwise(1), [
            F.col("period"), F.col("completed_orders"), r4("avg_order_value").alias("avg_order_value"),
            r4("pct_orders_above_threshold").alias("pct_orders_above_100"),
            r4("median_order_value").alias("median_order_value"),
        ])
    ).scalar()
    ch_arr = first_order_repeat_by_channel(t, p, sort=False).agg(
        _array(-F.col("customers"), [
            F.col("traffic_source"), F.col("customers"), r4("repeat_90d").alias("repeat_90d"),
            r4("first_order_aov").alias("first_order_aov"),
        ])
    ).scalar()
    band_arr = order_value_bands(t, p, sort=False).agg(
        _array(label_rank("order_band", p.band_labels), [
            F.col("order_band"), F.col("orders"), r4("order_share").alias("share"),
        ])
    ).scalar()
    doc = F.struct(
        summary.alias("summary"),
        mix_arr.alias("monthlyMix"),
        churn_arr.alias("monthlyChurn"),
        seg_arr.alias("segmentSummary"),
        ship_arr.alias("shippingBaseline"),
        ch_arr.alias("channelRepeat"),
        band_arr.alias("orderBandSummary"),
    )
    return s.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("payload"))


# The document's sections of several rows.
SECTIONS = ["monthlyMix", "monthlyChurn", "segmentSummary", "shippingBaseline", "channelRepeat", "orderBandSummary"]


def dashboard_payload_rows(t: Tables, p: Params) -> DataFrame:
    """The document's values as text: section, item (place in the section, 0 for the
    summary), field, value (numbers with four decimals). Read back from the document itself."""
    return document_rows(dashboard_payload(t, p))


def document_rows(payload: DataFrame) -> DataFrame:
    """The values of a document in the column `payload`."""
    values = "map<string,string>"
    schema = ", ".join([f"summary {values}", *(f"{s} array<{values}>" for s in SECTIONS)])
    doc = payload.select(F.from_json("payload", schema).alias("d")).select("d.*")

    def entry(section: str, item: Column, found: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.alias("item"), found.alias("values"))

    def entries(section: str) -> Column:
        return F.transform(section, lambda found, i: entry(section, i + 1, found))

    items = F.concat(F.array(entry("summary", F.lit(0), F.col("summary"))), *map(entries, SECTIONS))
    rows = doc.select(F.explode(items).alias("r")).select("r.section", "r.item", F.explode("r.values").alias("field", "value"))
    number = F.col("value").try_cast("decimal(24,4)").cast("string")
    return rows.select("section", F.col("item").cast("long").alias("item"), "field", F.coalesce(number, "value").alias("value"))
