"""Every query with SQL gives the same rows as its SQL."""

import compare
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, folder, database, name):
    got = QUERIES[name](spark, folder).toPandas()
    want = database.execute(ORACLES[name]).df()
    assert compare.compare(got, want) == ""


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "heartrate_first" in rows.columns
