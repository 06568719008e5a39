"""Registered queries against their SQL, on the smallest table."""

import pytest

from basketlens.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare, duck_views
from tests.conftest import SF001


@pytest.fixture(scope="module")
def duck():
    return duck_views(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    ok, message, _ = compare(QUERIES[name](spark, SF001), duck.execute(ORACLE_SQL[name]).fetchdf())
    assert ok, message


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", ["op4_url_rules", "op6_mixing", "op9_pseudonyms"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
