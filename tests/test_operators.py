"""Differential and skew tests of the reusable operators against naive forms."""

import math
import random

import duckdb
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketlens.operators.bands import count_following
from basketlens.operators.quantile import exact_quantile
from basketlens.operators.sequence import first_two_orders, sequence
from basketlens.params import fixture_params
from basketlens.plans import churn
from basketlens.sources.fixture import fixture_tables
from tests.conftest import SF001


def _skewed_orders(spark, hot_orders=4000, users=200, seed=7):
    rnd = random.Random(seed)
    rows, oid = [], 0
    for u in range(users):
        n = hot_orders if u == 0 else rnd.randint(1, 4)
        for _ in range(n):
            oid += 1
            # coarse times so ties within a user are common
            rows.append((u, oid, pd.Timestamp("2020-01-01") + pd.Timedelta(hours=rnd.randint(0, 24 * 400) // 6 * 6),
                         float(rnd.randint(1, 500))))
    pdf = pd.DataFrame(rows, columns=["user_id", "order_id", "order_ts", "order_value"])
    return spark.createDataFrame(pdf).withColumn("order_ts", F.col("order_ts").cast("timestamp_ntz")).repartition(16)


def test_sequence_matches_plain_window_under_skew(spark):
    o = _skewed_orders(spark)
    got = sequence(o, "user_id", "order_ts", "order_id").select("order_id", "order_rank", "next_ts")
    w = Window.partitionBy("user_id").orderBy("order_ts", "order_id")
    exp = o.select("order_id", F.row_number().over(w).alias("order_rank"), F.lead("order_ts").over(w).alias("next_ts"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_first_two_orders_matches_window_and_limits_before_shuffle(spark):
    o = _skewed_orders(spark)
    got = first_two_orders(o)
    w = Window.partitionBy("user_id").orderBy("order_ts", "order_id")
    exp = (
        o.withColumn("rn", F.row_number().over(w))
        .withColumn("next_order_ts", F.lead("order_ts").over(w))
        .filter("rn = 1")
        .select("user_id", "order_id", "order_ts", "order_value", "next_order_ts")
    )
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_exact_quantile_matches_duckdb(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(6):
        n = [1, 2, 3, 50, 5000, 20000][g]
        for _ in range(n):
            # heavy duplicates in some groups
            v = float(rnd.randint(0, 20)) if g % 2 else rnd.random() * 1000
            rows.append((g, v))
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    df = spark.createDataFrame(pdf).repartition(8)
    con = duckdb.connect()
    con.register("t", pdf)
    for q in (0.0, 0.25, 0.5, 0.75, 0.999, 1.0):
        got = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", q, by=["g"]).collect()}
        exp = dict(con.execute(f"SELECT g, quantile_cont(v, {q}) FROM t GROUP BY g").fetchall())
        assert got == exp, (q, got, exp)
        whole = exact_quantile(df, "v", q).collect()[0]["quantile"]
        assert whole == con.execute(f"SELECT quantile_cont(v, {q}) FROM t").fetchone()[0]


def test_band_count_matches_naive_band_join(spark):
    t, p = fixture_tables(spark, SF001), fixture_params()
    got = churn.orders_in_next_days(t, p)
    em = churn.eligible_user_months(t, p).select(
        "user_id", "month", F.col("last_order_date_in_month").alias("last_day")
    )
    items = t.order_items.filter((F.col("status") == "Complete") & F.col("returned_at").isNull())
    items = items.select(
        F.col("user_id").alias("u"), F.to_date("created_at").alias("d"), "order_id"
    ).filter(F.col("d").between(p.start_date, p.end_date))
    naive = (
        em.join(items, (em.user_id == items.u) & (items.d > em.last_day) & (items.d <= F.date_add(em.last_day, 90)), "left")
        .groupBy("user_id", "month")
        .agg(F.countDistinct("order_id").alias("orders_in_next_90d"))
    )
    assert got.exceptAll(naive).count() == 0 and naive.exceptAll(got).count() == 0


def test_band_count_zero_iff_churned(spark):
    t, p = fixture_tables(spark, SF001), fixture_params()
    band = churn.orders_in_next_days(t, p).filter("user_id IS NOT NULL").groupBy("month").agg(
        F.count_if(F.col("orders_in_next_90d") == 0).alias("churned_customers_90d")
    )
    lead = churn.churn_90d_windowed(t, p).select("month", "churned_customers_90d")
    assert band.exceptAll(lead).count() == 0 and lead.exceptAll(band).count() == 0


def test_count_following_handles_long_horizons(spark):
    q = spark.createDataFrame([(1, "2020-01-01", "2020-01-31")], "user_id long, month string, last_day string").select(
        "user_id", F.to_date("month").alias("month"), F.to_date("last_day").alias("last_day")
    )
    f = spark.createDataFrame(
        [(1, "2020-05-29", 1), (1, "2020-05-30", 2), (1, "2020-01-31", 3)], "user_id long, d string, fact_id long"
    ).select("user_id", F.to_date("d").alias("fact_day"), "fact_id")
    r = count_following(q, f, 120, "n").collect()[0]["n"]
    # Jan 31 + 120 days = May 30 (2020 is a leap year): May 29 and May 30 count,
    # the fact on the query day itself does not.
    assert r == 2
    r = count_following(q, f, 119, "n").collect()[0]["n"]
    assert r == 1


def test_exact_quantile_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "g long, v double")
    assert exact_quantile(empty, "v", 0.75).collect()[0]["quantile"] is None
    assert exact_quantile(empty, "v", 0.0).collect()[0]["quantile"] is None
    assert exact_quantile(empty, "v", 0.5, by=["g"]).collect() == []
    one = spark.createDataFrame([(1, 3.5)], "g long, v double")
    assert exact_quantile(one, "v", 0.75).collect()[0]["quantile"] == 3.5


def test_exact_quantile_bracket_path_under_stress(spark):
    """Tiny accuracies force the sketch bracket on almost every case: skewed,
    heavy-duplicate and wide distributions, many quantiles. The operator
    either matches DuckDB exactly or would raise; it must never differ."""
    rng = random.Random(17)
    con = duckdb.connect()
    for case in range(8):
        n = rng.choice([200, 1000, 5000])
        kind = case % 4
        if kind == 0:
            vals = [rng.expovariate(1.0) * 1000 for _ in range(n)]
        elif kind == 1:
            vals = [float(rng.randint(0, 5)) for _ in range(n)]  # few distinct values
        elif kind == 2:
            vals = [rng.lognormvariate(0, 3) for _ in range(n)]  # very wide
        else:
            vals = [1e6 if rng.random() < 0.34 else rng.random() for _ in range(n)]  # one hot value
        pdf = pd.DataFrame({"g": [i % 3 for i in range(n)], "v": vals})
        df = spark.createDataFrame(pdf).repartition(5)
        con.register("t", pdf)
        acc = rng.choice([20, 50, 200])
        for q in (0.1, 0.5, 0.75, 0.9):
            got = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", q, by=["g"]).collect()}
            exp = dict(con.execute(f"SELECT g, quantile_cont(v, {q}) FROM t GROUP BY g").fetchall())
            # A missed bracket would pick other order statistics (or raise);
            # the last-bit tolerance only absorbs the other engine's fused
            # multiply-add in lo + (hi - lo) * frac.
            assert got.keys() == exp.keys(), (case, acc, q)
            for g in exp:
                assert math.isclose(got[g], exp[g], rel_tol=1e-12, abs_tol=1e-300), (case, acc, q, g)
