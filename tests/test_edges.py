"""Edge cases named in the survey: day 90 vs 91, ties, null users, zero
denominators, month-end orders, history before the window, recency and
threshold boundaries."""

from datetime import date, timedelta

from basketlens.plans import churn, launch, metrics, mix, orders, segments
from tests.frames import item, params, tables, ts


def _rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_churn_day_90_is_retained_day_91_is_churned(spark):
    d0 = date(2020, 1, 10)
    items = [
        item(1, 1, ts(2020, 1, 10, 9), 10),
        item(2, 1, ts(2020, 1, 10, 9) + timedelta(days=90), 10),  # exactly day 90
        item(3, 2, ts(2020, 1, 10, 9), 10),
        item(4, 2, ts(2020, 1, 10, 9) + timedelta(days=91), 10),  # day 91
        item(5, 3, ts(2020, 12, 31, 12), 10),  # pushes the data boundary out
    ]
    t, p = tables(spark, items), params()
    r = _rows(churn.churn_90d_windowed(t, p), "month")
    jan = r[date(2020, 1, 1)]
    assert jan["active_customers"] == 2
    assert jan["churned_customers_90d"] == 1
    assert jan["churn_rate_90d"] == 0.5
    # The band-join count agrees with the LEAD form.
    band = {(x["user_id"], x["month"]): x["orders_in_next_90d"] for x in churn.orders_in_next_days(t, p).collect()}
    assert band[(1, date(2020, 1, 1))] == 1 and band[(2, date(2020, 1, 1))] == 0
    assert d0 + timedelta(days=90) == date(2020, 4, 9)


def test_churn_censoring_drops_immature_months(spark):
    items = [item(1, 1, ts(2020, 11, 20), 10), item(2, 2, ts(2020, 12, 31), 10)]
    t, p = tables(spark, items), params()
    assert churn.churn_90d_windowed(t, p).count() == 0


def test_floor_days_clock_and_midnight_boundary(spark):
    items = [
        item(1, 1, ts(2020, 1, 1, 23), 10),
        item(2, 1, ts(2020, 4, 1, 22), 10),  # 90 days 23 hours later: floor = 90 -> retained
        item(3, 2, ts(2020, 1, 1, 1), 10),
        item(4, 2, ts(2020, 4, 1, 2), 10),  # 91 days 1 hour later: floor = 91 -> churned
        item(5, 3, ts(2020, 12, 31, 12), 10),
    ]
    t, p = tables(spark, items), params()
    jan = _rows(churn.churn_90d_floor_days(t, p), "month")[date(2020, 1, 1)]
    assert (jan["active_customers"], jan["churned_customers_90d"]) == (2, 1)


def test_same_timestamp_orders_tie_break(spark):
    items = [
        item(11, 1, ts(2020, 2, 1, 10), 30),
        item(10, 1, ts(2020, 2, 1, 10), 20),  # same time, lower id -> first order
        item(12, 2, ts(2020, 2, 1, 10), 50),
    ]
    users = [(1, "Search"), (2, "Search")]
    t, p = tables(spark, items, users=users), params()
    f = _rows(orders.first_orders(t, p), "user_id")
    assert f[1]["order_id"] == 10 and f[1]["next_order_ts"] == ts(2020, 2, 1, 10)
    ch = _rows(orders.first_order_repeat_by_channel(t, p), "traffic_source")["Search"]
    assert ch["customers"] == 2 and ch["repeat_90d"] == 0.5
    assert float(ch["first_order_aov"]) == 35.0


def test_null_user_events_and_zero_top_funnel(spark):
    events = [
        (None, ts(2020, 1, 5), "department"),
        (7, ts(2020, 1, 6), "purchase"),
        (8, ts(2020, 2, 6), "home"),
    ]
    items = [item(1, 7, ts(2020, 1, 6), 10), item(2, 8, ts(2020, 2, 6), 10)]
    t, p = tables(spark, items, events), params()
    f = _rows(metrics.monthly_funnel(t, p), "month")
    assert f[date(2020, 1, 1)]["top_funnel_users"] == 0  # anonymous users never count
    assert f[date(2020, 2, 1)]["top_funnel_users"] == 0  # month present, count 0
    m = _rows(metrics.monthly_product_metrics(t, p), "month")
    assert m[date(2020, 1, 1)]["monthly_conversion_rate"] is None  # 1 / 0 -> null, no error


def test_order_spanning_month_end_item_vs_order_grain(spark):
    items = [
        item(1, 1, ts(2020, 1, 31, 23), 10, item_id=1),
        item(1, 1, ts(2020, 2, 1, 6), 5, item_id=2),
    ]
    t, p = tables(spark, items), params()
    by_item = _rows(mix.customer_mix_windowed(t, p), "month")
    assert by_item[date(2020, 2, 1)]["returning_customers"] == 1  # same order seen as a later month
    by_order = _rows(mix.customer_mix_order_grain(t, p), "month")
    assert list(by_order) == [date(2020, 1, 1)] and by_order[date(2020, 1, 1)]["new_revenue"] == 15.0
    sales = _rows(metrics.monthly_sales(t, p), "month")
    assert sales[date(2020, 1, 1)]["orders"] == 1 and sales[date(2020, 2, 1)]["orders"] == 1


def test_history_before_start_window_vs_all(spark):
    items = [item(1, 1, ts(2019, 6, 1), 10), item(2, 1, ts(2020, 3, 1), 20)]
    t, p = tables(spark, items), params()
    w = _rows(mix.customer_mix_windowed(t, p), "month")[date(2020, 3, 1)]
    a = _rows(mix.customer_mix_full_history(t, p), "month")[date(2020, 3, 1)]
    assert (w["new_customers"], w["returning_customers"]) == (1, 0)
    assert (a["new_customers"], a["returning_customers"]) == (0, 1)


def test_last_window_day_is_inclusive(spark):
    items = [item(1, 1, ts(2020, 12, 31, 23, 59, 59), 10), item(2, 1, ts(2021, 1, 1, 0), 10)]
    t, p = tables(spark, items), params()
    s = _rows(metrics.monthly_sales(t, p), "month")
    assert list(s) == [date(2020, 12, 1)]


def test_recency_and_threshold_boundaries(spark):
    # Latest order in 2020-07 -> snapshot date 2020-06-30.
    snap = date(2020, 6, 30)
    items = [
        item(1, 1, ts(2020, 1, 1), 100),  # champion candidate: 3 orders, recency 0
        item(2, 1, ts(2020, 3, 1), 100),
        item(3, 1, ts(2020, 6, 30), 100),
        item(4, 2, ts(*(snap - timedelta(days=90)).timetuple()[:3]), 1),  # recency exactly 90
        item(5, 3, ts(*(snap - timedelta(days=180)).timetuple()[:3]), 1),  # recency exactly 180
        item(6, 4, ts(*(snap - timedelta(days=181)).timetuple()[:3]), 1),  # 181 -> dormant
        item(7, 5, ts(2020, 7, 15), 1),  # after the snapshot: excluded
    ]
    t, p = tables(spark, items), params()
    seg = {r["user_id"]: r["segment"] for r in segments.segmented_customers(t, p).collect()}
    assert seg == {1: "Champions", 2: "Newly acquired", 3: "At risk", 4: "Dormant"}
    thr = segments.revenue_threshold(t, p).collect()[0]["high_value_threshold"]
    # lifetime revenues 300, 1, 1, 1 -> q75 at position 2.25 -> 1 + 0.25 * 299
    assert thr == 1 + (300 - 1) * 0.25


def test_order_exactly_at_threshold(spark):
    items = [item(1, 1, ts(2020, 3, 10), 100), item(2, 2, ts(2020, 3, 20), 99.99)]
    users = [(1, "Email"), (2, "Email")]
    t, p = tables(spark, items, users=users), params()
    li = {(r["period"], r["threshold_segment"]) for r in launch.launch_impact(t, p).collect()}
    assert li == {("Pre-Launch", "At/Above $100"), ("Post-Launch", "Below $100")}
    b = _rows(launch.prepost_baseline(t, p), "period")
    assert b["Pre-launch"]["pct_orders_above_threshold"] == 1.0
    assert b["Post-launch"]["pct_orders_above_threshold"] == 0.0
    assert b["Pre-launch"]["median_order_value"] == 100.0


def test_null_customers_are_not_counted(spark):
    items = [
        item(1, 1, ts(2020, 1, 10), 10),
        item(2, None, ts(2020, 1, 12), 7),  # an anonymous order in the same month
        item(3, None, ts(2020, 2, 12), 5),
        item(4, 2, ts(2020, 12, 31), 1),
    ]
    t, p = tables(spark, items), params()
    m = _rows(mix.customer_mix_windowed(t, p), "month")
    assert (m[date(2020, 1, 1)]["active_customers"], m[date(2020, 1, 1)]["revenue_new"]) == (1, 10.0)
    assert date(2020, 2, 1) not in m
    c = _rows(churn.churn_90d_windowed(t, p), "month")
    assert c[date(2020, 1, 1)]["active_customers"] == c[date(2020, 1, 1)]["churned_customers_90d"] == 1
    v = _rows(churn.churn_vs_revenue(t, p), "month")
    assert (v[date(2020, 1, 1)]["active_customers"], v[date(2020, 1, 1)]["revenue"]) == (1, 17.0)
    assert _rows(metrics.monthly_sales(t, p), "month")[date(2020, 1, 1)]["revenue"] == 17.0


def test_horizon_zero_is_zero_days(spark):
    t, p = tables(spark, [item(1, 1, ts(2020, 1, 10), 10), item(2, 2, ts(2020, 3, 1), 1)]), params()
    assert "churn_rate_0d" in churn.churn_vs_revenue(t, p, horizon=0).columns


def test_sequence_keeps_null_customers_and_splits_a_hot_one(spark):
    from basketlens.operators.sequence import sequence

    rows = [(None, n, ts(2020, 1, 1)) for n in range(3)] + [(1, n, ts(2020, 1, 1)) for n in range(3000)]
    df = spark.createDataFrame(rows, "user_id long, order_id long, order_ts timestamp_ntz")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sequence(df, "user_id", "order_ts", "order_id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r.user_id or 0, r.order_rank) for r in got) == sorted((u or 0, n + 1) for u, n, _ in rows)
    assert all((r.next_ts is None) == (r.order_id == (2 if r.user_id is None else 2999)) for r in got)


def test_document_keeps_null_fields_and_plain_digits(spark):
    import json

    from basketlens.plans import report

    t, p = tables(spark, [item(1, 1, ts(2020, 1, 10), 12_345_678)], users=[(1, "Email")]), params()
    text = report.dashboard_payload(t, p).collect()[0]["payload"]
    doc = json.loads(text)
    assert len(doc["summary"]) == 17 and doc["summary"]["minChurnMonth"] is None
    assert "12345678.00" in text
