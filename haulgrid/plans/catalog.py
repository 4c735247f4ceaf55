"""The registered queries: each operator on the views of `bindings`, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulgrid.functions.lineage import cut, scratch_path
from haulgrid.operators import allocation as al
from haulgrid.operators import audit as au
from haulgrid.operators import bounds as bd
from haulgrid.operators import clustering as cl
from haulgrid.operators import filters as fi
from haulgrid.operators import neighbours as nb
from haulgrid.operators import reflow as rf
from haulgrid.operators import reshape as rs
from haulgrid.operators import stats as st
from haulgrid.operators import weather as wx
from haulgrid import params as fixed
from haulgrid.params import Params
from haulgrid.plans import bindings as b
from haulgrid.plans.supply_chain import plan_supply_chain
from haulgrid.schemas import BIOMASS, DEPOT, FORECAST, PELLET
from haulgrid.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEAR = 2000
# Arcs that plans start from, and the longest that clusters and the bound consider: their number per site depends on it.
REACH = 60.0
# The same for legs from depots to refineries.
LEGS = 150.0
# Where the values of the measured matrix are cut.
MATRIX_CUT = 0.5
P = Params(years=b.YEARS)
# Caps low enough that some plants of the line-item flows break them at sf0.01.
TIGHT = Params(years=b.YEARS, depot_cap=8_400.0, refinery_cap=36_300.0)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _year(spark: SparkSession, sf: str) -> DataFrame:
    return b.history(spark, sf).filter(F.col("yr") == YEAR).select("idx", "biomass")


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """The harvest as a stored table, for queries that read it more than once."""
    return cut(b.history(spark, sf), "history")


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    """The flows as a stored table, for queries that read them more than once."""
    return cut(b.flows(spark, sf), "flows")


def _arcs(spark: SparkSession, sf: str, max_d: float = 60.0) -> DataFrame:
    """The arcs as a stored table sorted by destination, for queries that read them more than once."""
    return cut(b.arcs(spark, sf, max_d).repartitionByRange("j").sortWithinPartitions("j"), "arcs")


def _open_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Depots that receive biomass."""
    return st.depot_load(b.flows(spark, sf), BIOMASS, "dst").select(F.col("key").alias("idx")).distinct()


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return rs.pivot_years(b.history(spark, sf), ["idx"], "yr", "biomass", b.years(spark, sf))


# Sources and sinks: each writes a file of the expected form from the tables, then reads it.


@query
def read_site_panel(spark, sf):
    wide = b.sites(spark, sf).join(_panel(spark, sf), "idx", "left").withColumnsRenamed({"idx": "Index", "lat": "Latitude", "lon": "Longitude"})
    sites, history = files.read_site_panel(spark, files.write_table(wide, scratch_path(spark, "panel"), "csv"))
    return sites.join(history, "idx")


@query
def read_distance_matrix(spark, sf):
    vectors = b.table(spark, sf, "embeddings")
    line = F.concat_ws(",", F.col("vec_id").cast("string"), F.col("embedding").cast("array<double>").cast("array<string>"))
    lines = vectors.select(line.alias("value"))
    header = spark.range(1).select(F.concat(F.lit(","), F.array_join(F.sequence(F.lit(0), F.lit(63)).cast("array<string>"), ",")).alias("value"))
    path = files.write_table(lines.union(header), scratch_path(spark, "matrix"), "text")
    return files.read_distances(spark, path)


@query
def read_forecast(spark, sf):
    orders = b.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.col("o_custkey").cast("double").alias("Latitude"),
        F.col("o_orderkey").cast("double").alias("Longitude"), F.col("o_totalprice").alias("Forecast"),
    )
    read = files.read_forecast(spark, files.write_table(orders, scratch_path(spark, "forecast"), "csv"))
    return read.select("yr", F.date_format("ts", "yyyy-MM-dd").alias("day"), "lat", "lon", "forecast")


@query
def read_estates(spark, sf):
    def dash(col):
        return F.when(F.col("c_acctbal") < 0, F.lit("-")).otherwise(col.cast("string"))

    rows = b.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("Sr.No."), F.col("c_name").alias("Estate"), F.col("c_mktsegment").alias("District"),
        F.col("c_acctbal").cast("string").alias("Size in Ha."), dash(F.col("c_acctbal")).alias("Power Supply (MVA)"),
        dash(F.col("c_nationkey") * 1.5).alias("Water Supply (MLD)"), dash(F.col("c_nationkey") * 0.5).alias("Drainage (MLD)"),
    )
    total = rows.agg(
        F.lit("TOTAL").alias("Sr.No."), F.lit("-").alias("Estate"), F.lit("-").alias("District"),
        *[F.sum(F.col(f"`{c}`").try_cast("double")).cast("string").alias(c) for c in rows.columns[3:]],
    )
    return files.read_estates(spark, files.write_table(rows.union(total), scratch_path(spark, "estates"), "csv"))


@query
def read_submission(spark, sf):
    path = files.write_submission(b.flows(spark, sf), scratch_path(spark, "submission"))
    return rounded(files.read_submission(spark, path), "value")


@query
def read_solution(spark, sf):
    path = files.write_table(b.variables(spark, sf), scratch_path(spark, "solution"), "csv")
    return files.read_solution(spark, path)


@query
def write_table(spark, sf):
    path = files.write_table(b.history(spark, sf), scratch_path(spark, "history"))
    return spark.read.parquet(path)


@query
def read_weather_json(spark, sf):
    records = b.weather_records(spark, sf)
    path = files.write_table(records, scratch_path(spark, "weather"), "json")
    schema = T.StructType([T.StructField("site", T.LongType()), records.schema["daily"]])
    return rs.flatten_series(files.read_weather(spark, path, schema), "daily", ["site"]).withColumn("time", F.date_format("time", "yyyy-MM-dd"))


# Reshape


@query
def panel_unpivot(spark, sf):
    return rs.unpivot_years(_panel(spark, sf), ["idx"], [str(y) for y in b.years(spark, sf)])


@query
def matrix_to_edges(spark, sf):
    return rs.matrix_to_edges(b.table(spark, sf, "embeddings"), "vec_id", "embedding")


@query
def forecast_pivot(spark, sf):
    orders = b.table(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    years = b.years(spark, sf)
    wide = rs.pivot_years(orders, ["o_custkey"], "yr", "o_totalprice", years)
    wide = wide.withColumnsRenamed({str(y): f"y{y}" for y in years})
    return rounded(wide, *[f"y{y}" for y in years])


@query
def dense_site_index(spark, sf):
    return rs.assign_index(b.sites(spark, sf), ["lat", "lon"], out="pos").select("pos", "idx")


@query
def recover_index(spark, sf):
    sites = b.sites(spark, sf)
    placed = b.history(spark, sf).join(sites, "idx").select("lat", "lon", "yr", "biomass")
    return rs.recover_index(placed, sites).select("idx", "yr", "biomass")


@query
def lag_forecast(spark, sf):
    history = _history(spark, sf)
    expected = rs.lag_forecast(history).withColumnRenamed("biomass", "expected")
    return history.join(expected, ["idx", "yr"])


@query
def submatrix(spark, sf):
    rich = b.table(spark, sf, "supplier").filter(F.col("s_acctbal") >= 5000).select(F.col("s_suppkey").alias("idx"))
    return rs.induced_edges(b.matrix(spark, sf), rich)


@query
def edges_from_center(spark, sf):
    return rs.edges_from(b.matrix(spark, sf), 5)


@query
def arc_adjacency(spark, sf):
    near = fi.arcs_within(_arcs(spark, sf), 50.0)

    def lists(by):
        rows = rs.adjacency(near, by, block=32)
        return rows.select(F.lit(by).alias("by"), "node", "block", F.array_join("neighbours", ",").alias("neighbours"), "n")

    return lists("i").unionByName(lists("j"))


@query
def two_hop_arcs(spark, sf):
    near = _arcs(spark, sf, 20.0)
    return rounded(rs.two_hop(near, near), "d", digits=4)


@query
def least_two_hop_arcs(spark, sf):
    near = _arcs(spark, sf, 20.0)
    return rs.least_two_hop(near, near)


@query
def union_rows(spark, sf):
    history = _history(spark, sf)
    return rs.union_rows(history.withColumn("origin", F.lit("history")), rs.lag_forecast(history))


@query
def weather_flatten(spark, sf):
    flat = rs.flatten_series(b.weather_records(spark, sf), "daily", ["site"])
    return flat.withColumn("time", F.date_format("time", "yyyy-MM-dd"))


# Filters, samples


@query
def arcs_within(spark, sf):
    return fi.arcs_within(b.arcs(spark, sf), 50.0)


@query
def arc_share_over(spark, sf):
    return rounded(fi.arc_share_over(b.matrix(spark, sf), MATRIX_CUT), "share_over")


@query
def nonzero_solution(spark, sf):
    return fi.nonzero(b.variables(spark, sf))


@query
def vars_by_pattern(spark, sf):
    hit = fi.vars_by_pattern(b.variables(spark, sf), r"b_1999_\d+_5")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query
def arcs_to_open_sites(spark, sf):
    return fi.arcs_to_open(b.arcs_to(spark, sf, _open_ids(spark, sf)), _open_ids(spark, sf))


@query
def drop_unmatched(spark, sf):
    return fi.drop_unmatched(gazetteer_lookup(spark, sf), ["lat", "lon"])


@query
def drop_sparse_columns(spark, sf):
    return fi.drop_sparse_columns(b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id", "left"))


@query
def top_n_sites(spark, sf):
    return fi.top_n_sites(b.forecast(spark, sf), 25)


@query
def even_sample(spark, sf):
    return fi.even_sample(b.sites(spark, sf), 30).select("idx")


@query
def distinct_values(spark, sf):
    return fi.distinct_values(b.arcs(spark, sf, 20.0), "j")


@query
def duplicate_arcs(spark, sf):
    return fi.duplicate_rows(b.table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"])


@query
def first_n_depots(spark, sf):
    return fi.first_n_depots(b.flows(spark, sf), 25)


# Neighbours and joins


def _mapped(spark, sf):
    return nb.nearest_cell(b.estates(spark, sf), b.sites(spark, sf))


@query
def nearest_cell(spark, sf):
    return rounded(_mapped(spark, sf), "d").select("estate", "idx", "d")


@query
def cells_with_estates(spark, sf):
    return rounded(nb.cells_with_points(b.sites(spark, sf), _mapped(spark, sf)), "lat", "lon", "lat_point", "lon_point").drop("d")


@query
def weather_daily_hourly(spark, sf):
    joined = wx.join_daily_hourly(b.daily(spark, sf), b.hourly(spark, sf))
    return joined.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query
def attach_site_measure(spark, sf):
    return nb.attach_measure(b.arcs(spark, sf, 18.0), _year(spark, sf))


@query
def gazetteer_lookup(spark, sf):
    nations = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("district"))
    customers = b.table(spark, sf, "customer").join(nations, "c_nationkey")
    asked = customers.select(F.col("c_custkey").alias("no"), F.concat(F.lit(" "), F.upper("c_name")).alias("estate"), "district")
    spots = b.estates(spark, sf).withColumnRenamed("estate", "c_custkey")
    known = customers.filter(F.col("c_acctbal") > 0).join(spots, "c_custkey").select(F.col("c_name").alias("estate"), "district", "lat", "lon")
    return rounded(nb.gazetteer_lookup(asked, known), "lat", "lon")


@query
def k_nearest(spark, sf):
    return nb.k_nearest(b.matrix(spark, sf), 5)


@query
def neighbour_candidates(spark, sf):
    return nb.neighbour_candidates(b.matrix(spark, sf), _open_ids(spark, sf), 5)


@query
def neighbour_spacing(spark, sf):
    return nb.spacing_counts(nb.neighbour_spacing(b.estates(spark, sf).withColumnRenamed("estate", "idx"), flag_over=0.02))


@query
def flow_balance_join(spark, sf):
    return rounded(au.flow_balance(b.flows(spark, sf)), "inflow", "outflow", "diff")


@query
def distance_asymmetry(spark, sf):
    return rounded(nb.distance_asymmetry(b.matrix(spark, sf)), "gap")


@query
def radius_edges(spark, sf):
    return rounded(nb.radius_edges(b.sites(spark, sf), 0.18), "d")


# Aggregations


@query
def total_by_year(spark, sf):
    return st.total_by_year(b.history(spark, sf))


@query
def describe_measure(spark, sf):
    return rounded(st.describe(b.history(spark, sf), ["biomass"]), "mean", "std", "q25", "q50", "q75")


@query
def value_counts(spark, sf):
    return st.value_counts(b.flows(spark, sf), "data_type")


@query
def site_mean(spark, sf):
    history = _history(spark, sf)
    last = st.site_mean(history, b.YEARS).withColumnRenamed("biomass", "last_two")
    return rounded(st.site_mean(history).join(last, "idx", "left"), "biomass", "last_two")


def _catchments(spark, sf):
    return nb.catchment_sum(b.arcs(spark, sf, 18.0), _year(spark, sf), 18.0)


@query
def catchment_sum(spark, sf):
    return _catchments(spark, sf)


@query
def catchment_curve(spark, sf):
    return rounded(nb.catchment_curve(b.arcs(spark, sf, 50.0), _year(spark, sf)), "radius")


@query
def catchment_band(spark, sf):
    return nb.catchment_band(_catchments(spark, sf), *fixed.CATCHMENT_BAND)


@query
def correlation_matrix(spark, sf):
    years = b.years(spark, sf)
    names = [f"y{y}" for y in years]
    wide = b.sites(spark, sf).join(_panel(spark, sf), "idx").withColumnsRenamed({str(y): f"y{y}" for y in years})
    return rounded(st.correlation_matrix(wide, ["lat", "lon", *names]), "r")


@query
def align_external_series(spark, sf):
    return st.align_series(st.total_by_year(b.history(spark, sf)), b.yearly_series(spark, sf))


@query
def minmax_by_year(spark, sf):
    return rounded(st.minmax(cut(align_external_series(spark, sf), "years"), ["biomass", "orders_value"]), "biomass", "orders_value")


@query
def histogram(spark, sf):
    return rounded(st.histogram(cut(_catchments(spark, sf), "catchments"), "biomass", 10), "lo", "hi")


@query
def busiest_depot(spark, sf):
    return st.busiest(b.flows(spark, sf))


@query
def depot_load(spark, sf):
    return rounded(st.all_loads(b.flows(spark, sf)), "load")


@query
def pareto_share(spark, sf):
    shares = st.pareto_share(st.site_mean(b.history(spark, sf)), 0.8)
    return rounded(shares, "biomass", "cum_biomass", "share")


def _profile(spark, sf):
    labels = b.nation_labels(spark, sf)
    return st.cluster_profile(b.forecast(spark, sf), labels, b.YEARS, b.diameters(spark, sf, labels))


@query
def cluster_profile(spark, sf):
    return _profile(spark, sf)


def _bounded(spark, sf):
    return st.quota_bounds(st.depot_quota(_profile(spark, sf), *fixed.DEPOT_QUOTA_OLD, "threshold"), fixed.DEPOT_QUOTA_OLD[1], b.YEARS)


@query
def coverage_share(spark, sf):
    return rounded(st.coverage_share(_bounded(spark, sf)), "covered", "covered_bounded")


@query
def refinery_load_band(spark, sf):
    return rounded(st.refinery_load_band(b.forecast(spark, sf), P), "total", "low", "high")


@query
def forecast_mae(spark, sf):
    history = _history(spark, sf)
    return rounded(au.forecast_mae(history, rs.lag_forecast(history)), "mae")


@query
def transport_cost(spark, sf):
    flows = _flows(spark, sf)
    return rounded(au.transport_cost(flows, b.distances_of(spark, sf, flows)), "cost", "unpriced", digits=4)


@query
def underuse_cost(spark, sf):
    return rounded(au.underuse_cost(_flows(spark, sf), P), "underuse", digits=4)


@query
def total_cost(spark, sf):
    flows, history = _flows(spark, sf), _history(spark, sf)
    cost = au.total_cost(flows, b.distances_of(spark, sf, flows), history, rs.lag_forecast(history), P)
    return rounded(cost, "transport", "mae", "underuse", "cost", "unpriced", digits=4)


@query
def processed_ratio(spark, sf):
    return rounded(au.processed_ratio(b.flows(spark, sf)), "processed", "forecast", "ratio")


@query
def weather_hour_day(spark, sf):
    exact = F.sum(F.col("hour_value").cast("decimal(18,4)")).cast("double").alias("day_value")
    aggs = [exact, F.max("hour_value").alias("top_hour"), F.count(F.lit(1)).alias("hours")]
    days = wx.hours_to_days(b.hourly(spark, sf), aggs)
    return days.withColumn("time", F.date_format("time", "yyyy-MM-dd"))


# Clusters


@query
def kmeans_sites(spark, sf):
    labels = cl.kmeans_sites(b.sites(spark, sf), 4).select("idx", "cluster")
    labels = cut(labels, "labels")
    profile = st.cluster_profile(b.forecast(spark, sf), labels, b.YEARS, b.diameters(spark, sf, labels))
    return st.depot_quota(profile, -1.0, 100_000, "threshold", f"total_{YEAR}")


@query
def average_linkage(spark, sf):
    return cl.average_linkage(_arcs(spark, sf, REACH), 5, radius=REACH)


@query
def linkage_checks(spark, sf):
    """What must hold of any linkage: as many clusters as asked for, all sites, each cluster named by its least site."""
    labels = cut(average_linkage(spark, sf), "labels")
    least = labels.groupBy("cluster").agg(F.min("idx").alias("least"), F.count(F.lit(1)).alias("n"))
    return least.agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("sites"), F.bool_and(F.col("least") == F.col("cluster")).alias("named_by_least"))


@query
def depot_quota(spark, sf):
    profile = _profile(spark, sf)

    def quota(lower, upper, rule, name):
        return st.depot_quota(profile, lower, upper, rule).withColumnRenamed("quota", name).select("cluster", name)

    return (
        quota(*fixed.DEPOT_QUOTA, "remainder", "depots")
        .join(quota(*fixed.DEPOT_QUOTA_OLD, "threshold", "depots_old"), "cluster")
        .join(quota(*fixed.REFINERY_QUOTA, "threshold", "refineries"), "cluster")
    )


@query
def quota_bounds(spark, sf):
    return _bounded(spark, sf).select("cluster", "quota", "min_quota", "max_quota")


@query
def intra_cluster_max(spark, sf):
    return b.diameters(spark, sf, b.nation_labels(spark, sf))


@query
def balanced_blocks(spark, sf):
    return rounded(st.balanced_blocks(st.site_mean(b.history(spark, sf)), 5), "biomass")


@query
def per_cluster_arcs(spark, sf):
    quota = st.depot_quota(_profile(spark, sf), *fixed.DEPOT_QUOTA)
    return cl.cluster_arcs(b.arcs(spark, sf, REACH), b.nation_labels(spark, sf), quota, max_d=REACH)


# Allocation


def _fills(spark, sf):
    legs = lambda radius, ends: b.arcs_into(spark, sf, radius, ends)
    return al.fill_by_radius(legs, b.sites(spark, sf).select("idx"), cut(_year(spark, sf), "year"), P.depot_cap, REACH, b.reach(spark, sf))


@query
def fill_single_depot(spark, sf):
    return _fills(spark, sf)


@query
def choose_one_depot(spark, sf):
    return rounded(al.cheapest_filling(_fills(spark, sf), P.depot_cap), "cost", digits=4)


def _scaled(spark, sf):
    """Fixed capacities; the plants that may open grow with the sites, a quarter of them and a twentieth."""
    n = b.table(spark, sf, "supplier").count()
    return Params(years=b.YEARS, max_depots=max(1, n // 4), max_refineries=max(1, n // 20))


@query
def open_depots(spark, sf):
    return al.open_depots(b.frontier(spark, sf, REACH), cut(b.forecast(spark, sf), "forecast"), _scaled(spark, sf))


def _improved(spark, sf):
    """The greedy plan, the plan after swaps, and the parameters of both."""
    p, forecast = _scaled(spark, sf), cut(b.forecast(spark, sf), "forecast")
    plants = b.frontier(spark, sf, REACH)
    plan = cut(al.open_depots(plants, forecast, p), "plan")
    paid = cut(b.distances_of(spark, sf, plan), "paid")
    return plan, cut(al.improve_depots(plan, plants, forecast, p, distances=paid), "improved"), p


@query
def improve_depots(spark, sf):
    return _improved(spark, sf)[1]


@query
def plan_improvement(spark, sf):
    """Objective of the greedy plan and of the one after swaps; plants of both."""
    plan, better, p = _improved(spark, sf)
    rows = [al.plan_objective(flows, b.distances_of(spark, sf, flows), p).withColumn("plan", F.lit(name)) for name, flows in (("greedy", plan), ("swaps", better))]
    opened = [flows.filter(F.col("data_type") == DEPOT).agg(F.count_distinct("src").alias("opened")) for flows in (plan, better)]
    each = [r.join(o) for r, o in zip(rows, opened)]
    return rounded(each[0].unionByName(each[1]).select("plan", "objective", "opened"), "objective", digits=4)


@query
def open_depots_by_cluster(spark, sf):
    forecast, labels = cut(b.forecast(spark, sf), "forecast"), b.blocks(spark, sf)
    profile = st.cluster_profile(forecast, labels, b.YEARS, b.diameters(spark, sf, labels))
    quota = cut(st.depot_quota(profile, *fixed.DEPOT_QUOTA).select("cluster", "quota"), "quota")
    return al.open_depots(b.frontier(spark, sf, REACH), forecast, P, labels, quota)


@query
def plan_status(spark, sf):
    forecast, p = cut(b.forecast(spark, sf), "forecast"), _scaled(spark, sf)
    plan = al.open_depots(b.frontier(spark, sf, REACH), forecast, p)
    return rounded(al.plan_status(plan, forecast, p), "target").select("cluster", "yr", "target", "quota", "feasible")


@query
def open_refineries(spark, sf):
    p = _scaled(spark, sf)
    depots = cut(al.open_depots(b.frontier(spark, sf, REACH), cut(b.forecast(spark, sf), "forecast"), p), "depots")
    opened = cut(depots.filter(F.col("dst").isNotNull()).select(F.col("dst").alias("idx")).distinct(), "opened")
    return depots.unionByName(al.open_refineries(b.frontier_from(spark, sf, opened, LEGS), depots, p))


def _reflowed(spark, sf):
    """The two-tier plan before and after both legs are re-flowed, over the arcs in use and those up to twice the first radius."""
    before, forecast = cut(open_refineries(spark, sf), "plan"), cut(b.forecast(spark, sf), "forecast")

    def arcs(leg):
        moved = before.filter(F.col("data_type") == leg)
        ends = cut(moved.select(F.col("dst").alias("idx")).distinct(), "ends")
        return cut(b.distances_of(spark, sf, moved).unionByName(b.arcs_into(spark, sf, 2 * REACH, ends)).distinct(), "ways")

    return before, cut(rf.reflow_plan(before, arcs(BIOMASS), arcs(PELLET), forecast), "reflowed"), forecast


@query
def reflow_plan(spark, sf):
    return _reflowed(spark, sf)[1]


@query
def plan_audit(spark, sf):
    """The audit of the two-tier plan: checked and failed rows of each constraint."""
    flows = cut(open_refineries(spark, sf).unionByName(au.forecast_rows(b.forecast(spark, sf))), "flows")
    return au.audit(flows, _scaled(spark, sf)).groupBy("constraint").agg(F.count_if(~F.col("ok")).alias("failed"))


@query
def refinery_direct(spark, sf):
    p = Params(years=b.YEARS, refinery_cap=fixed.DIRECT_CAP)
    return al.refinery_direct(b.frontier(spark, sf, REACH), cut(b.forecast(spark, sf), "forecast"), p)


@query
def allocation_bound(spark, sf):
    p, arcs, forecast = _scaled(spark, sf), _arcs(spark, sf), cut(b.forecast(spark, sf), "forecast")
    plan = cut(al.open_depots(arcs, forecast, p), "plan")
    upper = al.plan_objective(plan, arcs, p).first()["objective"]
    return al.allocation_bound(arcs, forecast, p, upper, radius=REACH)


@query
def two_tier_bound(spark, sf):
    """Bound and gap of the plan of both tiers, for plans over arcs of any length."""
    p, forecast = _scaled(spark, sf), cut(b.forecast(spark, sf), "forecast")
    flows = cut(open_refineries(spark, sf).unionByName(au.forecast_rows(forecast)), "flows")
    cost = au.total_cost(flows, b.distances_of(spark, sf, flows), forecast, forecast, p)
    upper = cost.agg(F.sum(F.col("transport") + F.col("underuse"))).first()[0]
    arcs = _arcs(spark, sf)
    return bd.two_tier_bound(arcs, arcs, forecast, p, upper, radius=REACH, leg_radius=REACH)


@query
def bound_check(spark, sf):
    """The bound is no higher than the plan, and above nothing."""
    row = allocation_bound(spark, sf)
    return row.select((F.col("bound") <= F.col("upper") + 1e-6).alias("below_plan"), F.col("gap").between(0, 1).alias("gap_is_a_share"))


@query
def model_size(spark, sf):
    return al.model_size(b.arcs(spark, sf), 50.0)


# Submission and audit


@query
def solution_to_submission(spark, sf):
    submission = au.solution_to_submission(b.solution(spark, sf), b.forecast(spark, sf))
    return rounded(submission, "value")


def _checked(check):
    # One pass over the flows lets Spark leave out the kinds a check does not use; several need a stored table.
    source = _flows if check is au.check_locations else b.flows

    def run(spark, sf):
        return rounded(check(source(spark, sf), TIGHT), "actual", "limit")

    run.__name__ = check.__name__
    return query(run)


for _check in (*au.CHECKS, au.audit):
    _checked(_check)


@query
def repair_overload(spark, sf):
    flows = _flows(spark, sf)

    def repaired(mode):
        return au.repair_overload(flows, TIGHT, mode).filter(F.col("data_type") != FORECAST).withColumn("mode", F.lit(mode))

    return rounded(repaired("shave").unionByName(repaired("scale")), "value")


@query
def flow_totals(spark, sf):
    return rounded(au.flow_totals(b.flows(spark, sf)), "biomass", "pellets")


@query
def supply_chain_plan(spark, sf):
    history = _history(spark, sf)
    planned = plan_supply_chain(
        b.arcs(spark, sf, REACH), lambda ids: b.frontier_from(spark, sf, ids, LEGS), history, _scaled(spark, sf), n_clusters=3,
        radius=REACH, diameters=lambda labels: b.diameters(spark, sf, labels), plants=b.frontier(spark, sf, REACH),
        distances=lambda flows: b.distances_of(spark, sf, flows),
    )
    return planned.report
