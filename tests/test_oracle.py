"""Every registered query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import oracle
import pytest

SF = "/root/testdata/sf0.001"
QUERIES, SQLS = entry.catalog.QUERIES, entry.catalog.SQL


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    text, _, ok = oracle.check(name, spark, SF, con, QUERIES, SQLS)
    assert ok or text.startswith("ok 0 rows"), text


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
