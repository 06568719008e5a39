"""Sources: the order_items/events/users file layout, the fixture views, export."""

import os
from datetime import date

import pandas as pd
import pytest

from __spark_entry__ import entry
from basketlens.params import default_params
from basketlens.plans import churn, metrics
from basketlens.sources import export_tables, fixture_tables, shop_tables
from basketlens.sources.export import read_document, write_document
from tests.conftest import SF001


def _write_shop_layout(tmp_path):
    utc = lambda s: pd.Timestamp(s, tz="UTC")
    items = pd.DataFrame(
        {
            "id": [1, 2, 3, 4, 5],
            "order_id": [10, 10, 11, 12, 13],
            "user_id": [100, 100, 100, 101, 102],
            "product_id": [7, 8, 7, 9, 9],
            "status": ["Complete", "Complete", "Complete", "Cancelled", "Complete"],
            "created_at": [utc("2021-03-31 23:30"), utc("2021-04-01 00:10"), utc("2021-05-02 08:00"),
                           utc("2021-03-05 10:00"), utc("2021-03-06 10:00")],
            "returned_at": [pd.NaT, pd.NaT, pd.NaT, pd.NaT, utc("2021-03-20 10:00")],
            "sale_price": [19.99, 5.01, 40.0, 12.5, 99.0],
        }
    )
    events = pd.DataFrame(
        {
            "id": [1, 2, 3],
            "user_id": [100.0, None, 101.0],
            "created_at": [utc("2021-03-01 12:00"), utc("2021-03-02 12:00"), utc("2021-03-03 12:00")],
            "event_type": ["department", "department", "purchase"],
        }
    )
    users = pd.DataFrame({"id": [100, 101, 102], "traffic_source": ["Search", "Email", "Organic"]})
    for name, df in (("order_items", items), ("events", events), ("users", users)):
        df.to_parquet(tmp_path / f"{name}.parquet", index=False)
    return str(tmp_path)


def test_shop_layout_monthly_metrics(spark, tmp_path):
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")  # pandas writes nanoseconds
    try:
        _check_shop_layout(spark, _write_shop_layout(tmp_path))
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")


def _check_shop_layout(spark, directory):
    with pytest.raises(ValueError, match="unit"):
        shop_tables(spark, directory)
    t = shop_tables(spark, directory, unit="ns")
    assert dict(t.order_items.dtypes)["sale_price"] == "decimal(18,4)"
    assert dict(t.order_items.dtypes)["created_at"] == "timestamp_ntz"
    m = {r["month"]: r for r in metrics.monthly_product_metrics(t, default_params()).collect()}
    mar, apr = m[date(2021, 3, 1)], m[date(2021, 4, 1)]
    # Cancelled and returned items are excluded; the order spanning midnight
    # of a month end counts in both months.
    assert (mar["orders"], mar["units"]) == (1, 1) and abs(mar["revenue"] - 19.99) < 1e-9
    assert (apr["orders"], apr["units"]) == (1, 1)
    # 1 known 'department' user, 1 'purchase' user in March (null user ignored).
    assert mar["monthly_conversion_rate"] == 1.0
    c = churn.churn_vs_revenue(t, default_params()).collect()
    assert c == []  # nothing has 90 days of history before the boundary


def test_fixture_view_anchors(spark):
    t = fixture_tables(spark, SF001)
    done = t.order_items.filter("status = 'Complete' AND returned_at IS NULL")
    row = done.agg({"sale_price": "sum", "order_id": "count"}).collect()[0]
    assert row["count(order_id)"] == 1337
    assert str(row["sum(sale_price)"]) == "66746425.8620"
    assert done.select("order_id").distinct().count() == 458
    assert done.select("user_id").distinct().count() == 142  # every 29th order has no known customer


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["month", "revenue", "orders", "units", "aov", "monthly_conversion_rate"]
    assert df.count() > 0


def test_export_report_counts_rows(spark, tmp_path):
    report = export_tables(spark, ["region", "nation", "no_such_table"], SF001, str(tmp_path / "out")).collect()
    rows = {r["table_name"]: (r["status"], r["rows"]) for r in report}
    assert rows == {"region": ("ok", 5), "nation": ("ok", 25), "no_such_table": ("AnalysisException", None)}
    assert all(r["seconds"] > 0 and (r["bytes"] or 0) >= 0 for r in report)


def test_cli_lists_metrics(capsys):
    from basketlens.__main__ import main

    assert main(["list"]) == 0
    names = capsys.readouterr().out.split()
    assert "segment_split" in names and "dashboard_payload" in names


def test_catalog_tables_read_registered_names(spark):
    from basketlens.params import fixture_params
    from basketlens.sources import catalog_tables

    t = fixture_tables(spark, SF001)
    t.register(prefix="cat_")
    c = catalog_tables(spark, prefix="cat_")
    p = fixture_params()
    a = metrics.monthly_product_metrics(t, p).collect()
    b = metrics.monthly_product_metrics(c, p).collect()
    assert a == b and len(a) > 0


@pytest.mark.parametrize("variable", [None, "DATA"])
def test_document_is_written_whole_and_replaced(spark, tmp_path, variable):
    path = str(tmp_path / "site" / "data.js")
    for text in ('{"a": "é; \\n"}', '{"b": [1, null, ";"]}'):
        write_document(spark.createDataFrame([(text,)], "payload string"), path, variable)
        with open(path, encoding="utf-8") as f:
            assert f.read() == (f"window.DATA = {text};\n" if variable else text)
        assert [r.document for r in read_document(spark, path, variable).collect()] == [text]
    assert [f for f in os.listdir(tmp_path / "site") if not f.startswith(".")] == ["data.js"]
