"""Named queries: one callable per metric or primitive, (spark, sf_dir) -> DataFrame.

Each reads the driver tables through the fixture views with fixture
parameters. The same metric functions run on order_items/events/users files with
`shop_tables` and `default_params`.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions import label_rank, money, numbered
from basketlens.operators.facts import completed_items, completed_orders
from basketlens.operators.sequence import next_distinct_time, sequence
from basketlens.params import Params, fixture_params
from basketlens.plans import churn, cohorts, experiment, exposure, launch, metrics, mix, orders, reach, refresh, report, segments, sessions, survival, warehouse
from basketlens.plans.sql import monthly_product_metrics_sql
from basketlens.session import ensure_checkpoint_dir
from basketlens.sources.export import export_tables, read_document, write_document
from basketlens.sources.fixture import fixture_tables
from basketlens.sources.shop import write_shop_layout
from basketlens.sources.tables import ORDER_ITEM_COLUMNS, Tables, load, shop_tables
from basketlens.sources.warehouse import Layout, published_once

Metric = Callable[[Tables, Params], DataFrame]

# The driver's tables; the last name has no file, and the report says so.
EXPORT_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "no_such_table",
]


def _items_out(df: DataFrame) -> DataFrame:
    return df.select("id", "order_id", "user_id", "created_at", money("sale_price").alias("sale_price"))


def scan_projected(t: Tables, p: Params) -> DataFrame:
    return t.order_items.select(*ORDER_ITEM_COLUMNS).withColumn("sale_price", money("sale_price"))


def completed_items_q(t: Tables, p: Params) -> DataFrame:
    return _items_out(completed_items(t, p))


def items_in_window_q(t: Tables, p: Params) -> DataFrame:
    return _items_out(completed_items(t, p, p.start_date, p.end_date))


def completed_orders_q(t: Tables, p: Params) -> DataFrame:
    o = completed_orders(completed_items(t, p))
    return o.withColumn("order_value", money("order_value"))


def order_totals_by_date_q(t: Tables, p: Params) -> DataFrame:
    return launch.launch_window_order_totals(t, p).withColumn("order_value", money("order_value"))


def monthly_user_sales_q(t: Tables, p: Params) -> DataFrame:
    return mix.monthly_user_sales(t, p).select(
        "user_id", F.col("month").alias("order_month"), money("user_revenue").alias("monthly_user_revenue")
    )


def order_sequence_q(t: Tables, p: Params) -> DataFrame:
    o = completed_orders(completed_items(t, p))
    s = sequence(o, "user_id", "order_ts", "order_id")
    return s.select("user_id", "order_id", "order_ts", "order_rank", F.col("next_ts").alias("next_order_ts"))


def distinct_order_timestamps(t: Tables, p: Params) -> DataFrame:
    o = completed_orders(completed_items(t, p))
    return o.select("user_id", "order_ts").distinct()


def next_distinct_order(t: Tables, p: Params) -> DataFrame:
    o = completed_orders(completed_items(t, p))
    return next_distinct_time(o, "user_id", "order_ts")


def first_orders_q(t: Tables, p: Params) -> DataFrame:
    f = orders.first_orders(t, p)
    return f.select("user_id", "order_id", "order_ts", money("order_value").alias("order_value"), "next_order_ts")


def experiment_lift_q(t: Tables, p: Params) -> DataFrame:
    # Engines differ in the last bits of square roots and quotients.
    lift = exposure.experiment_lift(t, p)
    kept = {"metric", "ship"}
    return lift.select(*(F.col(c) if c in kept else F.round(c, 6).alias(c) for c in lift.columns))


def return_survival_q(t: Tables, p: Params) -> DataFrame:
    # Engines differ in the last bits of long products.
    s = survival.return_survival(t, p)
    return s.withColumns({c: F.round(c, 9) for c in ("survival", "std_error")})


METRICS: dict[str, Metric] = {
    # sources / primitives
    "scan_projected": scan_projected,
    "completed_items": completed_items_q,
    "items_in_window": items_in_window_q,
    "completed_orders": completed_orders_q,
    "order_totals_by_date": order_totals_by_date_q,
    "first_purchase": lambda t, p: mix.first_purchase(t, p),
    "monthly_user_sales": monthly_user_sales_q,
    "user_month_activity": churn.user_month_activity,
    "data_boundary": churn.data_boundary,
    "eligible_user_months": churn.eligible_user_months,
    "orders_in_next_90d": churn.orders_in_next_days,
    "order_sequence": order_sequence_q,
    "distinct_order_timestamps": distinct_order_timestamps,
    "next_distinct_order": next_distinct_order,
    "first_orders": first_orders_q,
    "funnel_pivot": metrics.funnel_pivot,
    "mix_full_outer": mix.mix_full_outer,
    "latest_5_months": lambda t, p: metrics.latest_months(t, p, 5),
    "revenue_threshold": segments.revenue_threshold,
    # monthly metrics (Task A / overview)
    "monthly_sales": lambda t, p: metrics.monthly_sales(t, p),
    "monthly_funnel": lambda t, p: metrics.monthly_funnel(t, p),
    "monthly_product_metrics": lambda t, p: metrics.monthly_product_metrics(t, p),
    "monthly_product_metrics_open": lambda t, p: metrics.monthly_product_metrics(t, p, end_date=None),
    "daily_product_metrics": lambda t, p: metrics.monthly_product_metrics(
        t, p, grain="day", rate_name="daily_conversion_rate"
    ),
    "overview_monthly_metrics": metrics.overview_monthly_metrics,
    # new vs returning (Task B / mix)
    "customer_mix_windowed": mix.customer_mix_windowed,
    "customer_mix_full_history": mix.customer_mix_full_history,
    "customer_mix_order_grain": lambda t, p: mix.customer_mix_order_grain(t, p, history="window"),
    "customer_mix_order_grain_all": lambda t, p: mix.customer_mix_order_grain(t, p, history="all"),
    # churn (Task C / churn section)
    "churn_90d_windowed": churn.churn_90d_windowed,
    "churn_90d_full_history": churn.churn_90d_full_history,
    "churn_vs_revenue": lambda t, p: churn.churn_vs_revenue(t, p),
    "churn_90d_floor_days": churn.churn_90d_floor_days,
    "churn_30d": churn.churn_30d,
    "churn_vs_revenue_full_months": churn.churn_vs_revenue_full_months,
    "churn_vs_revenue_lead_join": lambda t, p: churn.churn_vs_revenue(t, p, method="lead_join"),
    "churn_90d_full_history_band": lambda t, p: churn.churn_90d_full_history(t, p, method="band"),
    "session_churn_14d": churn.session_churn_14d,
    "session_churn_1d": churn.session_churn_1d,
    "user_sessions": lambda t, p: sessions.user_sessions(t, p),
    "session_gap_churn_14d": lambda t, p: sessions.session_gap_churn(t, p, horizon=14),
    "session_gap_churn_1d": lambda t, p: sessions.session_gap_churn(t, p, horizon=1),
    "return_survival": return_survival_q,
    # distinct users of any period from daily bitmaps
    "distinct_users_by_period": reach.distinct_users_by_period,
    "distinct_users_trailing_90d": reach.distinct_users_trailing,
    "distinct_users_trailing_7d": lambda t, p: reach.distinct_users_trailing(t, p, days=7),
    "revenue_churn_corr": report.revenue_churn_corr,
    # launch scenario (Task D / experiment support)
    "launch_impact": launch.launch_impact,
    "prepost_baseline": lambda t, p: launch.prepost_baseline(t, p),
    "prepost_baseline_rollup_first": launch.prepost_baseline_rollup_first,
    "order_value_bands": orders.order_value_bands,
    "first_order_repeat_by_channel": lambda t, p: orders.first_order_repeat_by_channel(t, p),
    "first_order_repeat_censored": orders.first_order_repeat_censored,
    # customers
    "customer_snapshot": lambda t, p: segments.customer_snapshot(t, p),
    "segment_split": lambda t, p: segments.segment_split(t, p),
    "segment_split_notebook": segments.segment_split_notebook,
    "customer_snapshot_notebook": lambda t, p: segments.customer_snapshot(t, p, clock="ts"),
    "cohort_retention": cohorts.cohort_retention,
    "experiment_readout": experiment.experiment_readout,
    "exposed_orders": exposure.exposed_orders_q,
    "experiment_by_exposure": exposure.experiment_by_exposure,
    "experiment_lift": experiment_lift_q,
    # report
    "analysis_context": report.analysis_context,
    "summary_kpis": report.summary_kpis,
    "dashboard_payload": report.dashboard_payload,
    "dashboard_payload_rows": report.dashboard_payload_rows,
    "mix_since_start": report.mix_since_start,
    "churn_since_start": report.churn_since_start,
    # notebook forms
    "launch_impact_notebook": lambda t, p: launch.launch_impact_notebook(t, notebook_labels(p)),
    "prepost_display": launch.prepost_display,
    "churn_90d_windowed_full_months": lambda t, p: churn.churn_90d_windowed(t, p, full_months_only=True),
    "churn_90d_full_history_full_months": lambda t, p: churn.churn_90d_full_history(t, p, full_months_only=True),
    "churn_90d_floor_days_full_months": lambda t, p: churn.churn_90d_floor_days(t, p, full_months_only=True),
    # results with the place of each row: their order is part of what is compared
    "position_overview": lambda t, p: numbered(metrics.overview_monthly_metrics(t, p), "month"),
    "head_mix": lambda t, p: numbered(newest(mix.customer_mix_full_history(t, p)), F.desc("month")),
    "head_churn": lambda t, p: numbered(newest(churn.churn_90d_full_history(t, p)), F.desc("month")),
    "position_launch_impact": lambda t, p: numbered(
        launch.launch_impact(t, p), "order_month", "period", "traffic_source", "threshold_segment"
    ),
    "position_segments": lambda t, p: numbered(segments.segment_split(t, p), label_rank("segment", segments.SEGMENTS)),
    "position_bands": lambda t, p: numbered(orders.order_value_bands(t, p), label_rank("order_band", p.band_labels)),
    "position_channels": lambda t, p: numbered(
        orders.first_order_repeat_by_channel(t, p), F.desc("customers"), "traffic_source"
    ),
}


def newest(df: DataFrame, n: int = 5) -> DataFrame:
    """The newest months first (`ORDER BY 1 DESC` and `head()`)."""
    return df.orderBy(F.desc("month")).limit(n)


def notebook_labels(p: Params) -> Params:
    """Task D's labels in the notebook (the amounts follow the threshold)."""
    amount = f"{p.threshold:.0f}"
    return p.with_(
        pre_label="1. Pre-Launch",
        post_label="2. Post-Launch",
        high_label=f"High Value (>= ${amount})",
        low_label=f"Low Value (< ${amount})",
    )


def _bind(metric: Metric) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metric(fixture_tables(spark, sf_dir), fixture_params())

    return run


def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the tables, then all with `resume`: what is there and whole is kept. The key
    digest, over the first column, is one that any engine can form from the source."""
    target = os.path.join(ensure_checkpoint_dir(spark), "exports", uuid.uuid4().hex)
    export_tables(spark, EXPORT_TABLES[::2], sf_dir, target)
    report = export_tables(spark, EXPORT_TABLES, sf_dir, target, resume=True)
    there = [r["table_name"] for r in report.filter("rows IS NOT NULL").select("table_name").collect()]
    keys = [_key_digest(load(spark, target, name)).withColumn("table_name", F.lit(name)) for name in there]
    told = report.join(reduce(DataFrame.unionByName, keys), "table_name", "left") if keys else report.withColumn("key_digest", F.lit(None).cast("long"))
    return told.select("table_name", "status", "rows", (F.col("bytes") > 0).alias("has_bytes"), "key_digest")


def _key_digest(df: DataFrame) -> DataFrame:
    first = F.col(df.columns[0]).cast("string").cast("binary")
    return df.agg(F.coalesce(F.sum(F.conv(F.substring(F.md5(first), 1, 8), 16, 10).cast("long")), F.lit(0)).alias("key_digest"))


def dashboard_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the document as a published file gives them back."""
    path = os.path.join(ensure_checkpoint_dir(spark), "documents", f"{uuid.uuid4().hex}.js")
    write_document(report.dashboard_payload(fixture_tables(spark, sf_dir), fixture_params()), path, "DASHBOARD_DATA")
    return report.document_rows(read_document(spark, path, "DASHBOARD_DATA").withColumnRenamed("document", "payload"))


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[Params, str]:
    """A store that first held the items before a day, some of the last year's missing,
    and then was brought up to date with all of them."""
    t, p = fixture_tables(spark, sf_dir), fixture_params()
    store = os.path.join(ensure_checkpoint_dir(spark), "stores", uuid.uuid4().hex)
    cut = datetime.combine(p.launch_date, datetime.min.time())
    late = (F.col("id") == 3) & (F.col("created_at") >= F.lit(cut - timedelta(days=365)).cast("timestamp_ntz"))
    known = F.coalesce((F.col("created_at") < F.lit(cut).cast("timestamp_ntz")) & ~late, F.lit(False))
    refresh.refresh(Tables(t.order_items.filter(known), t.events, t.users), p, store)
    refresh.refresh(t, p, store, t.order_items.filter(~known))
    return p, store


def refreshed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.stored_sales(spark, _refreshed(spark, sf_dir)[1])


def refreshed_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, store = _refreshed(spark, sf_dir)
    return refresh.stored_churn(spark, p, store)


def _on_shop_files(metric: Metric) -> Callable[[SparkSession, str], DataFrame]:
    """A metric over the same data in the original file layout."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metric(shop_tables(spark, write_shop_layout(fixture_tables(spark, sf_dir))), fixture_params())

    return run


def _on_catalog(metric: Callable[[Layout, Params], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A metric over the same data as catalog tables laid out by user."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metric(published_once(spark, sf_dir, lambda: fixture_tables(spark, sf_dir)), fixture_params())

    return run


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the table's columns; only they are read."""
    return load(spark, sf_dir, "events", ["user_id", "event_type"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {name: _bind(m) for name, m in METRICS.items()}
    q["export_report"] = export_report
    q["scan_events"] = scan_events
    q["dashboard_document"] = dashboard_document
    q["refreshed_sales"] = refreshed_sales
    q["refreshed_churn"] = refreshed_churn
    for name in ("scan_projected", "monthly_product_metrics", "customer_mix_windowed"):
        q[f"shop_{name}"] = _on_shop_files(METRICS[name])
    q["catalog_monthly_sales"] = _on_catalog(warehouse.catalog_monthly_sales)
    q["catalog_first_order_repeat"] = _on_catalog(warehouse.catalog_first_order_repeat)
    q["monthly_product_metrics_sql"] = lambda spark, sf_dir: monthly_product_metrics_sql(
        spark, fixture_tables(spark, sf_dir), fixture_params()
    )
    return q
