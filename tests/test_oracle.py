"""Every query with SQL gives the same rows and types as the SQL; the SQL check itself can fail."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from haulgrid.plans.catalog import QUERIES
from haulgrid.plans.oracle import ORACLE as SQL
from tests.compare import database, difference


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("CartesianProduct", "NestedLoop", "PythonUDF", "ArrowEval", "InPandas"))
    assert difference(df, con, SQL[name]) is None


def test_comparison_notices_a_changed_value(spark, sf, con):
    df = entry.queries()["total_by_year"](spark, sf)
    off = df.withColumn("biomass", F.col("biomass") + F.when(F.col("yr") == 1999, 1.0).otherwise(0.0))
    assert difference(off, con, SQL["total_by_year"]) is not None


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, small_sf):
    df = entry.entry(spark)
    assert df.columns == ["i", "j", "d", "b"]
    assert df.count() > 0
