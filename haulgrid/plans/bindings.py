"""The planning tables as views of the given warehouse tables.

Suppliers are sites on a grid 40 cells wide, line items are what they harvest and ship, customers are
estates, embeddings are rows of a measured matrix, events are weather readings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.operators.allocation import Frontier
from haulgrid.operators.audit import forecast_rows, submission_to_solution
from haulgrid.operators.neighbours import arcs_to_few, farthest_inside, pair_distances, radius_edges
from haulgrid.operators.reshape import matrix_to_edges, union_rows
from haulgrid.schemas import BIOMASS, DEPOT, PELLET, REFINERY

YEARS = (1999, 2000)
# Degrees to distance units, and the grid the suppliers are laid out on.
UNITS_PER_DEGREE = 100.0
GRID_WIDTH, GRID_STEP, NORTH, WEST = 40, 0.07962, 24.66818, 68.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    row = F.floor(k / GRID_WIDTH).cast("int")
    return table(spark, sf, "supplier").select(
        k.alias("idx"), (F.lit(NORTH) - F.lit(GRID_STEP) * row).alias("lat"), (F.lit(WEST) + F.lit(GRID_STEP) * (k % GRID_WIDTH)).alias("lon")
    )


def _quantity() -> Column:
    return F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")


def shipped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("yr", F.year("l_shipdate").cast("int"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    return shipped(spark, sf).groupBy(F.col("l_suppkey").alias("idx"), "yr").agg(_quantity().alias("biomass"))


def forecast(spark: SparkSession, sf: str) -> DataFrame:
    return history(spark, sf).filter(F.col("yr").isin(*YEARS))


def _detour(i: Column, j: Column) -> Column:
    return (i * 7 + j * 13) % 5


def _travel(degrees: Column) -> Column:
    """Travel distance of an arc: straight line plus a detour that differs by direction."""
    far = F.round(degrees * UNITS_PER_DEGREE + _detour(F.col("i"), F.col("j")), 4)
    return F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(far)


def arcs(spark: SparkSession, sf: str, max_d: float = 60.0, starts: DataFrame | None = None) -> DataFrame:
    """All arcs up to `max_d`; the number per site depends on the radius, not on the number of sites.

    With `starts(idx)` only arcs from those sites.
    """
    places = sites(spark, sf)
    sources = None if starts is None else places.join(starts, "idx", "left_semi")
    # Travel distances are rounded to four digits, so the radius must include what rounds down.
    near = radius_edges(places, (max_d + 1e-4) / UNITS_PER_DEGREE, sources)
    return near.select("i", "j", _travel(F.col("d")).alias("d")).filter(F.col("d") <= max_d)


def diameters(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    """Largest travel distance inside each cluster. A detour is at most 4, and rounding adds less than 1e-3."""
    return farthest_inside(sites(spark, sf), labels, _travel, UNITS_PER_DEGREE, 4.001)


def arcs_to(spark: SparkSession, sf: str, ends: DataFrame) -> DataFrame:
    """The arcs of any length from all sites to the few sites `ends(idx)`."""
    return arcs_to_few(sites(spark, sf), ends).select("i", "j", _travel(F.col("d")).alias("d"))


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A measured matrix as edges: row `vec_id`, one column per component."""
    return matrix_to_edges(table(spark, sf, "embeddings"), "vec_id", "embedding")


def years(spark: SparkSession, sf: str) -> list[int]:
    """All years of the harvest and the orders, from the dates alone."""
    dates = [table(spark, sf, name).select(F.year(day).cast("int").alias("yr")).distinct() for name, day in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"))]
    return sorted(r["yr"] for r in dates[0].union(dates[1]).filter(F.col("yr").isNotNull()).distinct().collect())


def arcs_into(spark: SparkSession, sf: str, max_d: float, ends: DataFrame | None, starts: DataFrame | None = None) -> DataFrame:
    """The arcs up to `max_d` into the sites `ends(idx)`, into all without; from all sites or just from `starts(idx)`."""
    if ends is None:
        return arcs(spark, sf, max_d, starts)
    places = sites(spark, sf)
    sources = places if starts is None else places.join(starts, "idx", "left_semi")
    near = radius_edges(sources, (max_d + 1e-4) / UNITS_PER_DEGREE, places.join(ends, "idx", "left_semi"))
    turned = near.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    return turned.select("i", "j", _travel(F.col("d")).alias("d")).filter(F.col("d") <= max_d)


def frontier(spark: SparkSession, sf: str, start: float) -> Frontier:
    """Arcs of any length between all sites, for plans that ask for them plant by plant."""
    return Frontier(lambda radius, ends, sources: arcs_into(spark, sf, radius, ends, sources), sites(spark, sf).select("idx"), start, reach(spark, sf))


def frontier_from(spark: SparkSession, sf: str, starts: DataFrame, start: float) -> Frontier:
    """The same for arcs that begin at the few sites `starts(idx)`."""

    def legs(radius: float, ends: DataFrame | None, sources: DataFrame | None) -> DataFrame:
        return arcs_into(spark, sf, radius, ends, starts if sources is None else sources.join(starts, "idx", "left_semi"))

    return Frontier(legs, sites(spark, sf).select("idx"), start, reach(spark, sf))


def reach(spark: SparkSession, sf: str) -> float:
    """No arc is longer: the diagonal of the sites' box, and the detour."""
    box = sites(spark, sf).agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("lat", "lon")]).first()
    if box["min_lat"] is None:
        return 0.0
    return UNITS_PER_DEGREE * math.hypot(box["max_lat"] - box["min_lat"], box["max_lon"] - box["min_lon"]) + 4.001


def distances_of(spark: SparkSession, sf: str, flows: DataFrame) -> DataFrame:
    """Distances of just the arcs that `flows` use."""
    used = flows.filter(F.col("dst").isNotNull()).select(F.col("src").alias("i"), F.col("dst").alias("j")).distinct()
    return pair_distances(used, sites(spark, sf)).select("i", "j", _travel(F.col("d")).alias("d"))


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Submission rows that break some rules on purpose: one depot and one refinery too many are used,
    and a tax share of the biomass is lost before the pellets leave."""
    lines = shipped(spark, sf).filter(F.col("yr").isin(*YEARS))
    lines = lines.withColumn("depot", F.col("l_partkey") % 26).withColumn("refinery", F.col("l_partkey") % 6)
    kept = F.col("l_quantity").cast("decimal(18,2)") * (1 - F.col("l_tax").cast("decimal(4,2)"))
    biomass = lines.groupBy("yr", F.col("l_suppkey").alias("src"), F.col("depot").alias("dst")).agg(_quantity().alias("value"))
    pellets = lines.groupBy("yr", F.col("depot").alias("src"), F.col("refinery").alias("dst")).agg(F.sum(kept).cast("double").alias("value"))
    parts = table(spark, sf, "part")
    return union_rows(
        biomass.select(F.lit(BIOMASS).alias("data_type"), "yr", "src", "dst", "value"),
        pellets.select(F.lit(PELLET).alias("data_type"), "yr", "src", "dst", "value"),
        locations(parts, DEPOT, 25),
        locations(parts, REFINERY, 5),
        forecast_rows(forecast(spark, sf)),
    )


def locations(parts: DataFrame, kind: str, n: int) -> DataFrame:
    cells = parts.select((F.col("p_partkey") % n).alias("src")).distinct()
    return cells.select(
        F.lit(kind).alias("data_type"), F.lit(20182019).alias("yr"), "src", F.lit(None).cast("bigint").alias("dst"),
        F.lit(None).cast("double").alias("value"),
    )


def nation_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").cast("bigint").alias("cluster"))


def estates(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as named points off the grid."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("estate"),
        (F.lit(NORTH) - F.lit(0.013) * (k * 37 % 101)).alias("lat"),
        (F.lit(WEST) + F.lit(0.011) * (k * 53 % 307)).alias("lon"),
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("site"), F.col("ts").alias("time"), "event_type", "value")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.date_trunc("hour", "time").alias("time")
    exact = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    return readings(spark, sf).groupBy("site", hour).agg(exact.alias("hour_value"), F.count(F.lit(1)).alias("hour_n"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_trunc("day", "time").alias("time")
    exact = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    return readings(spark, sf).groupBy("site", day).agg(exact.alias("day_value"), F.max("value").alias("day_max"))


def weather_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record of parallel arrays per vector: a day for each component."""
    vectors = table(spark, sf, "embeddings")
    days = F.transform("embedding", lambda _, n: F.date_format(F.date_add(F.lit("2018-01-01").cast("date"), n), "yyyy-MM-dd"))
    high = F.transform("embedding", lambda v: v.cast("double"))
    low = F.transform("embedding", lambda v: v.cast("double") - 1.0)
    series = F.struct(days.alias("time"), high.alias("temperature_2m_max"), low.alias("temperature_2m_min"))
    return vectors.select(F.col("vec_id").alias("site"), series.alias("daily"))


def solution(spark: SparkSession, sf: str) -> DataFrame:
    """The flows of `flows` as solver variables."""
    return submission_to_solution(flows(spark, sf))


def variables(spark: SparkSession, sf: str) -> DataFrame:
    """Solver variables of the returned goods of every line-item route; many are zero."""
    lines = shipped(spark, sf)
    back = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0).cast("decimal(18,2)")
    routes = lines.groupBy("yr", "l_suppkey", (F.col("l_partkey") % 26).alias("depot")).agg(F.sum(back).cast("double").alias("value"))
    return routes.select(F.concat_ws("_", F.lit("b"), "yr", "l_suppkey", "depot").alias("name"), "value")


def yearly_series(spark: SparkSession, sf: str) -> DataFrame:
    """A yearly series from outside the harvest: order value."""
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("int").alias("yr")).agg(price.alias("orders_value"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Compact clusters of the site grid, 3 rows by 14 columns."""
    k = F.col("s_suppkey")
    row, col = F.floor(k / GRID_WIDTH), k % GRID_WIDTH
    cluster = F.floor(row / 3) * 3 + F.floor(col / 14)
    return table(spark, sf, "supplier").select(k.alias("idx"), cluster.cast("bigint").alias("cluster"))
