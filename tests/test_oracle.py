"""Every registered query with an SQL oracle gives the oracle's rows, columns and types."""
import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf, con, name):
    got = compare(QUERIES[name](spark, sf), con, ORACLES[name])
    if got == "EMPTY":  # too few rows for a hit here: then the oracle must have some on the next size
        assert duck("/root/testdata/sf0.01").execute(ORACLES[name]).fetchone() is not None
    else:
        assert got == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["topic", "n", "correct", "acc", "recent_acc", "avg_sec", "available"] and df.count() > 0


def test_no_unregistered_oracle():
    assert set(ORACLES) <= set(QUERIES)
