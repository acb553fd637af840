"""Every relational query against its SQL in DuckDB."""

import pytest
from tests.compare import differences, views

from sprucelake.plans import catalog

ORACLE = sorted(catalog.ORACLE)


@pytest.fixture(scope="module")
def duck(sf):
    return views(sf)


@pytest.mark.parametrize("name", ORACLE)
def test_against_sql(spark, sf, duck, name):
    assert differences(catalog.QUERIES[name](spark, sf), duck, catalog.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name, source", [("null_logic", "orders"), ("order_nulls_last", "orders"), ("regex_functions", "documents")])
def test_whole_tables(spark, sf, name, source):
    assert catalog.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{source}.parquet").count()


def test_lateral_of_every_customer(spark, sf):
    asked = {r[0] for r in catalog.QUERIES["join_lateral"](spark, sf).select("c_custkey").collect()}
    assert asked == {r[0] for r in spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey").collect()}
