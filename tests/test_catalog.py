"""Every registered query against its SQL, on the smallest test tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
JOBS, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    problem = difference(spark, con, FOLDER, JOBS[name], SQL[name])
    # A tiny table may leave a narrow scope empty on both sides.
    assert problem in (None, "both empty"), problem


@pytest.mark.parametrize("name", sorted(set(JOBS) - set(SQL)))
def test_runs(spark, name):
    assert JOBS[name](spark, FOLDER).columns


def test_entry(spark):
    assert contract.entry(spark).columns


def test_sql_only_for_registered():
    assert set(SQL) <= set(JOBS)
