"""Band counts by a sweep, distinct users by bitmaps, product-limit survival, resumable export."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from basketlens.operators.bands import count_following
from basketlens.operators.distinct import day_bitmaps, distinct_by, distinct_trailing
from basketlens.params import fixture_params
from basketlens.plans import churn, reach
from basketlens.plans.survival import product_limit, return_survival
from basketlens.sources import export_tables, fixture_tables
from basketlens.sources import export as export_module
from basketlens.sources.export import verified
from tests.conftest import SF001
from tests.frames import item, params, tables, ts

START = date(2020, 1, 1)


def at(n):
    return None if n is None else START + timedelta(days=n)


@pytest.mark.parametrize("horizon", [0, 1, 3, 10])
def test_band_counts_against_brute_force(spark, horizon):
    rng = random.Random(horizon)
    # Items with many days, close and far; user 1 holds most; nulls in every column.
    facts = [(rng.choice([1, 1, 1, 2, None]), rng.choice([*range(12), None]), rng.choice([*range(40), None])) for _ in range(400)]
    queries = [(u, m, rng.choice([*range(-5, 45), None])) for u in (1, 2, 3, None) for m in range(12)]
    q = spark.createDataFrame([(u, at(31 * m), at(d)) for u, m, d in queries], "user_id long, month date, last_day date")
    f = spark.createDataFrame([(u, at(d), i) for u, i, d in facts], "user_id long, fact_day date, fact_id long")
    got = {(r.user_id, r.month): r.n for r in count_following(q, f, horizon, "n").collect()}
    for u, m, last in queries:
        ids = {i for fu, i, d in facts if None not in (u, fu, i, d, last) and fu == u and last < d <= last + horizon}
        assert got[u, at(31 * m)] == len(ids), (u, m, last)
    assert len(got) == len(queries)


def test_band_counts_without_facts_or_queries(spark):
    q = spark.createDataFrame([(1, START, START)], "user_id long, month date, last_day date")
    f = spark.createDataFrame([], "user_id long, fact_day date, fact_id long")
    assert [r.n for r in count_following(q, f, 90, "n").collect()] == [0]
    assert count_following(q.limit(0), f, 90, "n").count() == 0


def test_band_counts_take_one_pass_and_no_copies(spark):
    t, p = fixture_tables(spark, SF001), fixture_params()
    plan = churn.orders_in_next_days(t, p)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert "lineitem.parquet" not in plan  # all from the saved (user, order, day) table


def test_bitmaps_against_brute_force(spark):
    rng = random.Random(5)
    # Ids on both sides of bucket borders, negative and huge ones; one id holds a third.
    ids = [1, 32768, 32769, 65536, 0, -1, -32768, 2**62, None]
    rows = [(rng.choice("ab"), at(rng.choice([*range(0, 60, 7), *range(100, 140), None])), rng.choice([*ids, 1, 1, 1, 1])) for _ in range(500)]
    df = spark.createDataFrame(rows, "kind string, d date, user long")
    bitmaps = day_bitmaps(df, F.col("d"), ["kind"], "user").cache()
    known = [r for r in rows if None not in r]
    got = {(r.kind, r.period_start): r.n for r in distinct_by(bitmaps, F.trunc("day", "MM"), ["kind"], "n").collect()}
    want = {}
    for k, d, u in known:
        want.setdefault((k, d.replace(day=1)), set()).add(u)
    assert got == {k: len(v) for k, v in want.items()}
    for days in (1, 8, 30):
        got = {(r.kind, r.day): r.n for r in distinct_trailing(bitmaps, days, ["kind"], "n").collect()}
        want = {
            (k, d): len({u for k2, d2, u in known if k2 == k and d - timedelta(days=days) < d2 <= d}) for k, d, _ in known
        }
        assert got == want, days


def test_bitmaps_of_nothing(spark):
    empty = day_bitmaps(spark.createDataFrame([(None, None)], "d date, user long"), F.col("d"), [], "user")
    assert distinct_by(empty, F.col("day"), [], "n").count() == 0
    assert distinct_trailing(empty, 7, [], "n").count() == 0


def test_periods_read_the_saved_bitmaps_only(spark):
    t, p = fixture_tables(spark, SF001), fixture_params()
    for df in (reach.distinct_users_by_period(t, p), reach.distinct_users_trailing(t, p)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" not in plan and "lineitem.parquet" not in plan
    assert len(t.memo) == 1


def test_product_limit_by_hand(spark):
    # Returns on day 2 (one of 5) and day 4 (one of 3); one censored on day 3, one outlasts, one at day 0.
    rows = [(2, True, 1), (3, False, 1), (4, True, 1), (9, False, 2), (0, False, 7)]
    got = {r.elapsed_days: r for r in product_limit(spark.createDataFrame(rows, "elapsed int, ended boolean, n long"), 6).collect()}
    assert [got[d].at_risk for d in range(1, 7)] == [5, 5, 4, 3, 2, 2]
    assert [got[d].returned for d in range(1, 7)] == [0, 1, 0, 1, 0, 0]
    assert got[1].survival == 1.0 and got[3].survival == pytest.approx(4 / 5)
    assert got[6].survival == pytest.approx(4 / 5 * 2 / 3)
    assert got[6].std_error == pytest.approx(4 / 5 * 2 / 3 * (1 / 20 + 1 / 6) ** 0.5)


def test_survival_when_all_return_and_when_none_is_there(spark):
    all_back = product_limit(spark.createDataFrame([(1, True, 4)], "elapsed int, ended boolean, n long"), 3).collect()
    assert [(r.elapsed_days, r.survival, r.std_error) for r in all_back] == [(1, 0.0, None)]
    assert product_limit(spark.createDataFrame([], "elapsed int, ended boolean, n long"), 3).count() == 0


def test_survival_uses_immature_user_months(spark):
    items = [item(1, 1, ts(2020, 1, 5), 10), item(2, 1, ts(2020, 2, 4), 10), item(3, 2, ts(2020, 2, 20), 10), item(4, None, ts(2020, 2, 21), 10)]
    rows = {r.elapsed_days: r for r in return_survival(tables(spark, items), params(), 40).collect()}
    # To Feb 21: user 1 is censored after 17 days, user 2 after 1; user 1 came back after 30.
    assert (rows[1].at_risk, rows[17].at_risk, rows[30].at_risk) == (3, 2, 1)
    assert rows[30].survival == 0.0 and 31 not in rows


def test_export_is_resumed_after_a_kill(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    names = ["region", "nation", "customer"]
    real, moved = export_module._move, []

    def dies_at_the_second(spark_, source, target):
        if len(moved) == 1:
            raise KeyboardInterrupt
        moved.append(target)
        real(spark_, source, target)

    monkeypatch.setattr(export_module, "_move", dies_at_the_second)
    with pytest.raises(KeyboardInterrupt):
        export_tables(spark, names, SF001, out, parallelism=1)
    monkeypatch.setattr(export_module, "_move", real)
    assert verified(spark, f"{out}/nation.parquet") is None  # written, never put in place
    rows = {r.table_name: r for r in export_tables(spark, names, SF001, out, resume=True).collect()}
    assert [rows[n].status for n in names] == ["kept", "ok", "ok"]
    assert [rows[n].rows for n in names] == [5, 25, spark.read.parquet(f"{SF001}/customer.parquet").count()]
    assert all(r.bytes > 0 and r.digest is not None for r in rows.values())
    again = {r.table_name: r for r in export_tables(spark, names, SF001, out, resume=True).collect()}
    assert {r.status for r in again.values()} == {"kept"}
    assert {n: r.digest for n, r in again.items()} == {n: r.digest for n, r in rows.items()}


@pytest.mark.parametrize("harm", ["rows", "lost", "manifest"])
def test_export_copies_a_damaged_table_again(spark, tmp_path, harm):
    out = str(tmp_path / "out")
    first = export_tables(spark, ["nation"], SF001, out).collect()[0]
    target = f"{out}/nation.parquet"
    part = next(f for f in os.listdir(target) if f.endswith(".parquet"))
    if harm == "rows":  # other rows under the same name
        spark.range(25).coalesce(1).write.parquet(str(tmp_path / "other"))
        other = next(f for f in os.listdir(tmp_path / "other") if f.endswith(".parquet"))
        os.replace(tmp_path / "other" / other, f"{target}/{part}")
        os.remove(f"{target}/.{part}.crc")
    elif harm == "lost":
        os.remove(f"{target}/{part}")
    else:
        os.remove(f"{target}/_manifest/_SUCCESS")
    row = export_tables(spark, ["nation"], SF001, out, resume=True).collect()[0]
    assert (row.status, row.rows, row.digest) == ("ok", 25, first.digest)
    assert spark.read.parquet(target).exceptAll(spark.read.parquet(f"{SF001}/nation.parquet")).count() == 0
    assert not os.listdir(f"{out}/_replaced")


def test_export_of_an_empty_table_and_of_maps(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "in" / "none.parquet"))
    spark.sql("SELECT 1 AS id, map('a', 2) AS m, array(1, NULL) AS `odd name`").write.parquet(str(tmp_path / "in" / "maps.parquet"))
    out = str(tmp_path / "out")
    for wanted in ("ok", "kept"):
        rows = {r.table_name: r for r in export_tables(spark, ["none", "maps"], str(tmp_path / "in"), out, resume=True).collect()}
        assert (rows["none"].status, rows["none"].rows, rows["none"].bytes) == (wanted, 0, 0)
        assert (rows["maps"].status, rows["maps"].rows) == (wanted, 1)
