"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQLS = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_sql(spark, name):
    problems, rows = compare(spark, FOLDER, QUERIES[name], SQLS[name])
    assert not problems
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQLS)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "lang", "hits", "pages", "documents"]
