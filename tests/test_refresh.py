"""A store refreshed by what changed equals one computed from everything."""

import os
import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketlens.plans.churn import churn_90d_windowed
from basketlens.plans.metrics import monthly_sales
from basketlens.plans.refresh import ORDERS, ORDERS_SCHEMA, _read, _runs, refresh, stored_churn, stored_sales
from tests.frames import item, params, tables

P = params(start_date=None, end_date=None, horizon_days=45)


def same(spark, t, store):
    for got, want in ((stored_sales(spark, store), monthly_sales(t, P)), (stored_churn(spark, P, store), churn_90d_windowed(t, P))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def items(seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        when = datetime(2020, 1, 1) + timedelta(hours=rng.randrange(24 * 700))
        status = rng.choice(["Complete"] * 5 + ["Cancelled", None])
        out.append(item(rng.randrange(200), rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, None]), when, rng.randint(1, 90), status, item_id=i))
    return out


def files(store):
    return {os.path.relpath(os.path.join(d, f), store) for d, _, fs in os.walk(store) for f in fs if f.endswith(".parquet")}


def test_late_items_and_a_new_month(spark, tmp_path):
    store, rows = str(tmp_path / "store"), items(1)
    old = [r for r in rows if r[4] < datetime(2021, 10, 1) and not (r[0] % 40 == 0 and r[4].month in (3, 4))]
    new = [r for r in rows if r not in old]
    refresh(tables(spark, old), P, store)
    same(spark, tables(spark, old), store)
    kept = files(store)
    t = tables(spark, rows)
    done = refresh(t, P, store, tables(spark, new).order_items)
    same(spark, t, store)
    # Partitions that are neither dirty nor within reach of one keep their files.
    touched = {f"{name}/month={m.isoformat()}" for name, months in (*done.items(), (ORDERS, done["monthly_sales"])) for m in months}
    assert 0 < len(done["monthly_sales"]) < 12
    still = {f for f in kept if os.path.dirname(f) not in touched}
    assert still and still <= files(store)
    # The same run again changes no result.
    refresh(t, P, store, tables(spark, new).order_items)
    same(spark, t, store)


def test_items_that_go_take_their_month_along(spark, tmp_path):
    store, rows = str(tmp_path / "store"), items(2, 150)
    refresh(tables(spark, rows), P, store)
    last = max(r[4] for r in rows if r[3] == "Complete").replace(day=1, hour=0)
    gone = [r for r in rows if r[4] >= last or (r[4].year, r[4].month) == (2020, 5)]
    t = tables(spark, [r for r in rows if r not in gone])
    refresh(t, P, store, tables(spark, gone).order_items)
    same(spark, t, store)
    assert stored_sales(spark, store).filter(F.col("month") == date(2020, 5, 1)).count() == 0


def test_empty_source_and_nothing_changed(spark, tmp_path):
    store = str(tmp_path / "store")
    empty = tables(spark, [])
    assert refresh(empty, P, store) == {"monthly_sales": [], "monthly_churn": []}
    assert stored_sales(spark, store).count() == 0 and stored_churn(spark, P, store).count() == 0
    t = tables(spark, items(3, 60))
    refresh(t, P, store)
    assert refresh(t, P, store, t.order_items.limit(0)) == {"monthly_sales": [], "monthly_churn": []}
    same(spark, t, store)
    refresh(empty, P, store, t.order_items)  # everything went
    assert stored_sales(spark, store).count() == 0 and stored_churn(spark, P, store).count() == 0


def test_only_dirty_partitions_are_read(spark, tmp_path):
    store = str(tmp_path / "store")
    refresh(tables(spark, items(4, 100)), P, store)
    df = _read(spark, f"{store}/{ORDERS}", ORDERS_SCHEMA, [date(2020, 3, 1), date(2020, 7, 1)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ IN ", plan), plan
    assert {r.month for r in df.select("month").distinct().collect()} <= {date(2020, 3, 1), date(2020, 7, 1)}


@pytest.mark.parametrize("months, runs", [([], 0), ([date(2020, 12, 1), date(2021, 1, 1), date(2020, 2, 1)], 2)])
def test_runs_of_months(months, runs):
    assert len(_runs(months)) == runs
