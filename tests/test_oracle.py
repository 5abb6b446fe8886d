"""Every query with an SQL oracle gives the same bag of rows and the same types."""

import re

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, connect

# the text operators have tests of their own
ORACLES = {n: q for n, q in driver.oracle_sql().items() if not re.match(r"op\d+_|pipeline", n)}
QUERIES = driver.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and df.columns == sorted(df.columns[:-1]) + df.columns[-1:]
