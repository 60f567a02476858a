import pytest

from passbook.plans import catalogue

from .oracle import differences


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.01", catalogue.QUERIES[name], catalogue.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").columns
