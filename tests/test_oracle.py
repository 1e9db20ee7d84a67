"""Every query with SQL against DuckDB, at the smallest scale."""

import pytest
from oracle import differ

from boxtide.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert differ(QUERIES[name](spark, sf), SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_have_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
