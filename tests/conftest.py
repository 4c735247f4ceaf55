import os

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    path = f"{DATA}/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("test tables are absent")
    return path


@pytest.fixture(scope="session")
def small_sf():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("test tables are absent")
    return path


@pytest.fixture(scope="session")
def matrix(spark, sf):
    """All pairs of the hundred sites: the full matrix, only for fixtures of this size."""
    from haulgrid.functions.lineage import cut
    from haulgrid.plans import bindings as b

    places = b.sites(spark, sf)
    ends = places.selectExpr("idx as i", "lat as lat_i", "lon as lon_i").crossJoin(
        places.selectExpr("idx as j", "lat as lat_j", "lon as lon_j")
    )
    far = "round(100e0 * sqrt((lat_i-lat_j)*(lat_i-lat_j) + (lon_i-lon_j)*(lon_i-lon_j)) + ((i*7 + j*13) % 5), 4)"
    return cut(ends.selectExpr("i", "j", f"case when i = j then 0e0 else {far} end as d"), "matrix")


@pytest.fixture(scope="session")
def forecast(spark, sf):
    from haulgrid.functions.lineage import cut
    from haulgrid.plans import bindings as b

    return cut(b.forecast(spark, sf), "forecast")
