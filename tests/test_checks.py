"""Every query with a SQL text must give the same rows; the others must run."""

import pytest

import __spark_entry__ as entry
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_names_and_coverage():
    names, checks = set(entry.queries()), set(entry.oracle_sql())
    assert checks <= names
    assert len(checks) > 170


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(got, connect(FOLDER).execute(entry.oracle_sql()[name]).fetch_df()) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0
