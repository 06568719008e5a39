"""Every registered query against its independent DuckDB oracle at sf0.01."""

import pytest

from basketlens.catalog import queries
from basketlens.oracle import ORACLE_SQL
from tests.compare import compare
from tests.conftest import SF01

NAMES = sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck01, name):
    df = queries()[name](spark, SF01)
    expected = duck01.execute(ORACLE_SQL[name]).fetchdf()
    ok, msg, _ = compare(df, expected)
    assert ok, f"{name}: {msg}"


def test_every_query_has_an_oracle_or_is_documented():
    missing = set(queries()) - set(ORACLE_SQL)
    assert missing <= {"dashboard_payload"}, missing
