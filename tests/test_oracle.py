"""Every query with SQL gives the rows DuckDB gives for it."""

import __spark_entry__ as entry
import pytest
from compare import differences, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir, con):
    found = QUERIES[name](spark, sf_dir).toPandas()
    wanted = con.execute(SQL[name]).df()
    assert differences(found, wanted) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["time", "latitude", "longitude", "t2m"]
