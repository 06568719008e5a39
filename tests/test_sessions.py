"""Sessions, as-of joins, exposure-based arms and the layout by user, on small frames."""

import math
import random
from datetime import datetime, timedelta
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from basketlens.operators.asof import last_before
from basketlens.operators.ranges import PART, in_ranges
from basketlens.operators.sessions import sessions
from basketlens.plans import exposure
from basketlens.plans.metrics import monthly_sales
from basketlens.plans.orders import first_order_repeat_by_channel
from basketlens.plans.sessions import session_gap_churn, user_sessions
from basketlens.plans.warehouse import catalog_first_order_repeat, catalog_monthly_sales, first_orders_with_users, user_order_months
from basketlens.sources.tables import Tables
from basketlens.sources.warehouse import large_users, publish, published
from tests.frames import item, params, tables, ts

START = ts(2020, 1, 1)


def some_events(seed, n=3000, days=90):
    """A user with a third of all events, anonymous ones, ties and a burst at one instant."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        user = 1 if rng.random() < 1 / 3 else rng.choice([None, *range(2, 40)])
        at = START + timedelta(minutes=10 * rng.randrange(days * 144))
        rows.append((user, at, rng.choice(["department", "purchase", "cart"])))
    return rows + [(1, START + timedelta(days=5), "cart")] * 500 + [(7, None, "cart")]


def slow_sessions(rows, gap):
    by_user = {}
    for user, at, _ in rows:
        if user is not None and at is not None:
            by_user.setdefault(user, []).append(at)
    out = []
    for user, times in by_user.items():
        number, start, last, n = 0, None, None, 0
        for at in sorted(times):
            if last is None or at >= last + timedelta(minutes=gap):
                if n:
                    out.append((user, number, start, last, n))
                number, start, n = number + 1, at, 0
            last, n = at, n + 1
        out.append((user, number, start, last, n))
    return sorted(out)


@pytest.mark.parametrize("gap", [1, 10, 30, 600])
def test_sessions_against_brute_force(spark, gap):
    rows = some_events(gap)
    frame = tables(spark, [], rows).events
    got = sorted(tuple(r) for r in sessions(frame, gap).select("user_id", "session_no", "started_at", "ended_at", "n_events").collect())
    assert got == slow_sessions(rows, gap)


def test_sessions_agree_with_session_windows(spark):
    frame = tables(spark, [], some_events(3)).events
    ours = sessions(frame, 30).select("user_id", "started_at", "ended_at", "n_events")
    # Windows that touch are one session there; times are whole ten minutes.
    window = F.session_window("created_at", "29 minutes")
    theirs = frame.filter("user_id is not null and created_at is not null").groupBy("user_id", window).agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count(F.lit(1)).alias("n_events")
    ).drop("session_window")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))


def test_session_churn_over_fourteen_days(spark):
    rows = [r for r in some_events(5, n=400) if r[1]]
    t, p = tables(spark, [], rows), params()
    got = {r.day: (r.eligible_users, r.churned_users) for r in session_gap_churn(t, p, 14).collect()}
    found, newest = slow_sessions(rows, 30), max(at for _, at, _ in rows)
    want = {}
    for user, day in {(s[0], s[3].date()) for s in found}:
        last = max(s[3] for s in found if s[0] == user and s[3].date() == day)
        if last + timedelta(days=14) <= newest:
            back = any(s[0] == user and last < s[2] <= last + timedelta(days=14) for s in found)
            n, churned = want.get(day, (0, 0))
            want[day] = (n + 1, churned + (not back))
    assert got == want and sum(c for _, c in want.values()) > 20


def test_sessions_of_no_events(spark):
    t, p = tables(spark, [], []), params()
    assert user_sessions(t, p).collect() == [] and session_gap_churn(t, p, 14).collect() == []


def test_large_user_is_in_many_tasks(spark):
    rows = [(1, START + timedelta(minutes=7 * i), "cart") for i in range(4000)]
    ranged = in_ranges(tables(spark, [], rows).events, "user_id", "created_at")
    sizes = [r["count"] for r in ranged.groupBy(PART).count().collect()]
    assert len(sizes) > 8 and max(sizes) < len(rows) / 4


def test_asof_join_against_brute_force(spark):
    rng = random.Random(11)
    right = [(rng.choice([None, 1, 1, 2, 3]), START + timedelta(minutes=rng.randrange(300)), rng.randrange(5)) for _ in range(300)]
    right += [(2, START + timedelta(minutes=50), n % 3) for n in range(200)] + [(3, None, 1)]
    left = [(n, rng.choice([None, 1, 1, 2, 3, 4]), START + timedelta(minutes=rng.randrange(-20, 320)), "x") for n in range(400)]
    left += [(n, 1, START + timedelta(minutes=77), "same") for n in range(1000, 1300)] + [(2000, 1, None, "x")]
    a = spark.createDataFrame(left, "id long, user_id long, at timestamp_ntz, found string")
    b = spark.createDataFrame(right, "user_id long, seen_at timestamp_ntz, kind int")
    got = {r.id: (r.user_id, r.at, r.found, r.seen_at, r.kind) for r in last_before(a, b, "user_id", "at", "seen_at", ["seen_at", "kind"]).collect()}
    assert len(got) == len(left)
    for n, user, at, found in left:
        before = [(s, k) for u, s, k in right if u is not None and u == user and s is not None and at is not None and s <= at]
        assert got[n] == (user, at, found, *max(before, default=(None, None)))


def experiment(spark, seed=2, users=120):
    rng = random.Random(seed)
    day = lambda: ts(2020, 3, 10) + timedelta(hours=rng.randrange(24 * 25))
    events = [(rng.randint(1, users), day(), rng.choice(["department", "purchase"])) for _ in range(3 * users)]
    items = [item(n, 1 if n % 3 == 0 else rng.randint(1, users), day(), rng.randint(20, 300)) for n in range(4 * users)]
    return tables(spark, items, events), events, items


def slow_users(p, events, items):
    inside = lambda at: p.exp_start <= at.date() <= p.exp_end
    first = {}
    for user, at, kind in events:
        if kind == "department" and inside(at):
            first[user] = min(at, first.get(user, at))
    out = {u: [0, 0.0] for u in first}
    for _, _, user, _, at, _, price in items:
        if inside(at) and user in first and at >= first[user]:
            out[user][0] += 1
            out[user][1] += float(price)
    return out


def test_orders_before_exposure_are_left_out(spark):
    t, events, items = experiment(spark)
    p = params()
    got = {r.user_id: [r.orders, float(r.revenue)] for r in exposure.assigned_users(t, p).collect()}
    assert got == slow_users(p, events, items)
    by_arm = exposure.experiment_by_exposure(t, p).collect()
    assert sum(r.users for r in by_arm) == len(got) and sum(r.orders for r in by_arm) == sum(n for n, _ in got.values())


def test_lift_against_plain_python(spark):
    t, events, items = experiment(spark)
    p = params()
    users = slow_users(p, events, items)
    arm = lambda u: "treatment" if ((u % 1000003) * 7919 + 13) % 100 < p.treatment_share_pct else "control"

    def weight(user, rep):
        number = int(md5(f"lift:{user}:{rep // 4}".encode()).hexdigest()[8 * (rep % 4) : 8 * (rep % 4) + 8], 16)
        return sum(number >= b for b in exposure.BOUNDS)

    def lift(metric, w):
        value = {}
        for a in ("treatment", "control"):
            mine = [(w(u), n, v) for u, (n, v) in users.items() if arm(u) == a]
            above = sum(k * ((n > 0) if metric == "conversion_rate" else v) for k, n, v in mine)
            value[a] = above / sum(k * (n if metric == "aov" else 1) for k, n, v in mine)
        return value["treatment"] - value["control"]

    for r in exposure.experiment_lift(t, p).collect():
        assert r.lift == pytest.approx(lift(r.metric, lambda u: 1))
        boot = sorted(lift(r.metric, lambda u, k=k: weight(u, k)) for k in range(200))
        assert (r.boot_low, r.boot_high) == (pytest.approx(boot[4]), pytest.approx(boot[194]))
        assert r.low < r.lift < r.high and r.ship == (r.low > 0 and r.boot_low > 0)
        # Both intervals measure the same spread.
        assert 0.6 < (r.boot_high - r.boot_low) / (r.high - r.low) < 1.6
        if r.metric == "conversion_rate":
            spread = 0
            for a in ("treatment", "control"):
                mine = [n > 0 for u, (n, _) in users.items() if arm(u) == a]
                share = sum(mine) / len(mine)
                spread += share * (1 - share) / (len(mine) - 1)
            assert r.standard_error == pytest.approx(math.sqrt(spread))


def test_bootstrap_weights_do_not_depend_on_the_layout(spark):
    t, _, _ = experiment(spark)
    users = exposure.assigned_users(t, params())
    one = sorted(map(str, exposure.bootstrap_lifts(users, 30).collect()))
    assert one == sorted(map(str, exposure.bootstrap_lifts(users.repartition(7), 30).collect()))
    weights = exposure.poisson_weights(users.limit(50), 400).agg(F.sum("weight")).first()[0] / (50 * 400)
    assert abs(weights - 1) < 0.05


def test_lift_of_an_empty_or_one_armed_experiment(spark):
    p = params()
    assert exposure.experiment_lift(tables(spark, []), p).collect() == []
    t = tables(spark, [item(1, 5, ts(2020, 3, 20), 10)], [(5, ts(2020, 3, 16), "department")])
    for r in exposure.experiment_lift(t, p).collect():
        assert (r.lift, r.standard_error, r.boot_low, r.ship) == (None, None, None, False)


def layout(spark, name):
    rng = random.Random(4)
    at = lambda: datetime(2020, 1, 1) + timedelta(hours=rng.randrange(24 * 300))
    items = []
    for n in range(900):
        user, when = 1 if n % 3 == 0 else rng.choice([None, *range(2, 60)]), at()
        items += [item(n, user, when + timedelta(hours=k), rng.randint(5, 90), item_id=k) for k in range(rng.randint(1, 3))]
    users = [(u, rng.choice(["Search", "Email", None])) for u in range(1, 58)]
    t = tables(spark, items, [], users)
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    publish(t, name, buckets=8)
    return t, published(spark, name)


def test_layout_gives_the_same_metrics(spark):
    t, tables_by_user = layout(spark, "layout_values")
    p = params()
    assert [r.user_id for r in large_users(t.order_items, 8).collect()] == [1]
    assert catalog_monthly_sales(tables_by_user, p).collect() == monthly_sales(t, p).collect()
    assert catalog_first_order_repeat(tables_by_user, p).collect() == first_order_repeat_by_channel(t, p).collect()
    assert tables_by_user.ordinary.order_items.filter("user_id = 1 or user_id is null").isEmpty()


def test_layout_computes_the_items_once(spark, tmp_path):
    rows = [item(n, n % 7 or None, ts(2020, 3, 1), n) for n in range(60)] + [item(n, 1, ts(2020, 3, 2), 5) for n in range(60, 100)]
    t = tables(spark, rows)
    given = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            given.add(batch.num_rows)
            yield batch

    source = t.order_items.mapInArrow(passed, t.order_items.schema)
    spark.sql("DROP DATABASE IF EXISTS layout_once CASCADE")
    publish(Tables(source, t.events, t.users), "layout_once", buckets=4, folder=str(tmp_path))
    assert given.value == 100
    found = published(spark, "layout_once")
    assert (found.ordinary.order_items.count(), found.large.order_items.count()) == (42, 58)
    both = found.ordinary.order_items.unionByName(found.large.order_items)
    assert sorted(map(str, both.select(*t.order_items.columns).collect())) == sorted(map(str, t.order_items.collect()))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["events", "large_users", "order_items", "order_items_large", "users"]


def test_work_by_user_needs_no_shuffle(spark):
    _, found = layout(spark, "layout_plans")
    p = params()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (user_order_months(found.ordinary, p), first_orders_with_users(found.ordinary, p)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
        shuffled = user_order_months(found.large, p)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
