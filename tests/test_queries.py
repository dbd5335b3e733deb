"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from suite.check import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        problem, note = difference(df, ORACLES[name], db)
        assert problem is None, problem
        assert "types" not in note, note
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
