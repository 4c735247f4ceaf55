"""Submission rows, the constraints they must meet, and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgrid.functions.keys import data_type_of, name_part
from haulgrid.functions.lineage import cut
from haulgrid.functions.scale import lookup_join
from haulgrid.operators.stats import all_loads, depot_load
from haulgrid.params import LOCATION_YEAR, Params
from haulgrid.schemas import BIOMASS, DEPOT, FORECAST, PELLET, REFINERY


def forecast_rows(forecast: DataFrame) -> DataFrame:
    return forecast.select(
        F.lit(FORECAST).alias("data_type"), F.col("yr").cast("int").alias("yr"), F.col("idx").alias("src"),
        F.lit(None).cast("bigint").alias("dst"), F.col("biomass").alias("value"),
    )


def solution_to_submission(solution: DataFrame, forecast: DataFrame, tol: float = 0.0) -> DataFrame:
    """Rows of a submission from solver variables and the forecast; zero variables are left out."""
    name = F.col("name")
    kind = data_type_of(name)
    flow = kind.isin(BIOMASS, PELLET)
    rows = solution.filter(F.abs("value") > tol).select(
        kind.alias("data_type"),
        F.when(flow, name_part(name, 1)).otherwise(F.lit(LOCATION_YEAR)).cast("int").alias("yr"),
        F.when(flow, name_part(name, 2)).otherwise(name_part(name, 1)).alias("src"),
        F.when(flow, name_part(name, 3)).alias("dst"),
        "value",
    )
    return rows.filter(F.col("data_type").isNotNull()).unionByName(forecast_rows(forecast))


def submission_to_solution(flows: DataFrame) -> DataFrame:
    """Solver-style `name`, `value` rows of the flows and locations."""
    t = F.col("data_type")
    name = (
        F.when(t == BIOMASS, F.concat_ws("_", F.lit("b"), "yr", "src", "dst"))
        .when(t == PELLET, F.concat_ws("_", F.lit("p"), "yr", "src", "dst"))
        .when(t == DEPOT, F.concat_ws("_", F.lit("x"), "src"))
        .when(t == REFINERY, F.concat_ws("_", F.lit("r"), "src"))
    )
    value = F.when(t.isin(DEPOT, REFINERY), F.lit(1.0)).otherwise(F.col("value"))
    return flows.filter(t != FORECAST).select(name.alias("name"), value.alias("value"))


def _rows(df: DataFrame, constraint: str, yr: Column, key: Column, actual: Column, limit: Column, ok: Column) -> DataFrame:
    return df.select(
        F.lit(constraint).alias("constraint"), yr.cast("int").alias("yr"), key.cast("bigint").alias("key"),
        actual.cast("double").alias("actual"), limit.cast("double").alias("limit"), ok.alias("ok"),
    )


def _none() -> Column:
    return F.lit(None)


def check_nonnegative(flows: DataFrame, p: Params) -> DataFrame:
    """Per data type and year the least value, which must not be below zero."""
    return _nonnegative(flows.filter(F.col("value").isNotNull()).groupBy("data_type", "yr").agg(F.min("value").alias("v")))


def _nonnegative(least: DataFrame) -> DataFrame:
    name = F.concat(F.lit("C1_nonnegative_"), F.col("data_type"))
    return least.select(
        name.alias("constraint"), "yr", F.lit(None).cast("bigint").alias("key"), F.col("v").alias("actual"),
        F.lit(0.0).alias("limit"), (F.col("v") >= 0).alias("ok"),
    )


def check_site_supply(flows: DataFrame, p: Params) -> DataFrame:
    """Shipped per site and year against its forecast; a missing forecast is zero."""
    legs = flows.filter(F.col("data_type").isin(BIOMASS, FORECAST))

    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("data_type") == kind, F.col("value")).otherwise(0.0))

    sites = legs.groupBy("yr", "src").agg(
        total(BIOMASS).alias("sent"), total(FORECAST).alias("forecast"),
        F.count_if(F.col("data_type") == BIOMASS).alias("n"),
    )
    return _site_supply(sites)


def _site_supply(sites: DataFrame) -> DataFrame:
    sites = sites.filter(F.col("n") > 0)
    ok = F.col("sent") <= F.col("forecast")
    return _rows(sites, "C2_site_supply", F.col("yr"), F.col("src"), F.col("sent"), F.col("forecast"), ok)


def check_depot_capacity(flows: DataFrame, p: Params) -> DataFrame:
    """Both in-flow and out-flow of a depot against its capacity."""
    return _depot_capacity(all_loads(flows), p)


def _depot_capacity(loads: DataFrame, p: Params) -> DataFrame:
    into = (F.col("data_type") == BIOMASS) & (F.col("side") == "dst")
    out = (F.col("data_type") == PELLET) & (F.col("side") == "src")
    rows = loads.filter(into | out)
    name = F.when(into, F.lit("C3_depot_in")).otherwise(F.lit("C3_depot_out"))
    return rows.select(
        name.alias("constraint"), "yr", "key", F.col("load").alias("actual"), F.lit(p.depot_cap).alias("limit"),
        (F.col("load") <= p.depot_cap).alias("ok"),
    )


def check_refinery_capacity(flows: DataFrame, p: Params) -> DataFrame:
    return _refinery_capacity(depot_load(flows, PELLET, "dst"), p)


def _refinery_capacity(load: DataFrame, p: Params) -> DataFrame:
    return _rows(load, "C4_refinery_in", F.col("yr"), F.col("key"), F.col("load"), F.lit(p.refinery_cap), F.col("load") <= p.refinery_cap)


def check_counts(flows: DataFrame, p: Params) -> DataFrame:
    """Number of depots and refineries, and whether a cell is declared twice."""
    kinds = flows.filter(F.col("data_type").isin(DEPOT, REFINERY)).groupBy("data_type", "src")
    return _counts(kinds.agg(F.count(F.lit(1)).alias("n")), p)


def _counts(cells: DataFrame, p: Params) -> DataFrame:
    def per(kind: str) -> list[Column]:
        mine = F.col("data_type") == kind
        return [F.count_if(mine), F.coalesce(F.sum(F.when(mine, F.col("n") - 1)), F.lit(0).cast("bigint"))]

    d, r = per(DEPOT), per(REFINERY)
    counted = cells.agg(d[0].alias("d"), d[1].alias("d2"), r[0].alias("r"), r[1].alias("r2"))
    rows = F.array(*[
        F.struct(F.lit(c).alias("constraint"), F.col(v).cast("double").alias("actual"), F.lit(float(lim)).alias("limit"))
        for c, v, lim in (
            ("C5_depots", "d", p.max_depots), ("C5_depots_per_cell", "d2", 0),
            ("C6_refineries", "r", p.max_refineries), ("C6_refineries_per_cell", "r2", 0),
        )
    ])
    flat = counted.select(F.inline(rows))
    return flat.select(
        "constraint", F.lit(None).cast("int").alias("yr"), F.lit(None).cast("bigint").alias("key"), "actual", "limit",
        (F.col("actual") <= F.col("limit")).alias("ok"),
    )


def processed_ratio(flows: DataFrame) -> DataFrame:
    """Pellets processed, biomass forecast and their ratio per year."""
    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("data_type") == kind, F.col("value")).otherwise(0.0))

    years = flows.filter(F.col("data_type").isin(PELLET, FORECAST)).groupBy("yr").agg(
        total(PELLET).alias("processed"), total(FORECAST).alias("forecast")
    )
    return years.withColumn("ratio", F.try_divide("processed", "forecast"))


def check_coverage(flows: DataFrame, p: Params) -> DataFrame:
    return _coverage(processed_ratio(flows), p)


def _coverage(years: DataFrame, p: Params) -> DataFrame:
    limit = F.col("forecast") * p.min_share
    return _rows(years, "C7_coverage", F.col("yr"), _none(), F.col("processed"), limit, F.col("processed") >= limit)


def flow_balance(flows: DataFrame) -> DataFrame:
    """In-flow minus out-flow of every depot and year seen on either leg; a missing leg is zero."""
    kind = F.col("data_type")
    legs = flows.filter(kind.isin(BIOMASS, PELLET))
    depots = legs.groupBy("yr", F.when(kind == BIOMASS, F.col("dst")).otherwise(F.col("src")).alias("key")).agg(
        F.sum(F.when(kind == BIOMASS, F.col("value")).otherwise(0.0)).alias("inflow"),
        F.sum(F.when(kind == PELLET, F.col("value")).otherwise(0.0)).alias("outflow"),
    )
    return depots.withColumn("diff", F.col("inflow") - F.col("outflow"))


def check_flow_balance(flows: DataFrame, p: Params) -> DataFrame:
    return _flow_balance(flow_balance(flows), p)


def _flow_balance(depots: DataFrame, p: Params) -> DataFrame:
    gap = F.abs("diff")
    return _rows(depots, "C8_balance", F.col("yr"), F.col("key"), gap, F.lit(p.tolerance), gap <= p.tolerance)


def check_locations(flows: DataFrame, p: Params) -> DataFrame:
    """Cells that flows use without a declaration, and declarations under another year: rows that fail."""
    kind = F.col("data_type")
    plants = flows.filter(kind.isin(DEPOT, REFINERY)).select("data_type", "yr", "src")
    loads = {(leg, side): depot_load(flows, leg, side) for leg, side in ((BIOMASS, "dst"), (PELLET, "src"), (PELLET, "dst"))}
    return _locations(plants, loads, p)


def _locations(plants: DataFrame, loads: dict[tuple[str, str], DataFrame], p: Params) -> DataFrame:
    def undeclared(constraint: str, leg: str, side: str, kind: str) -> DataFrame:
        declared = plants.filter(F.col("data_type") == kind).select(F.col("src").alias("key")).distinct()
        loose = loads[leg, side].join(declared, "key", "left_anti")
        return _rows(loose, constraint, F.col("yr"), F.col("key"), F.col("load"), F.lit(0.0), F.lit(False))

    wrong_year = plants.filter(F.col("yr") != p.location_year)
    return (
        undeclared("C9_depot_in_undeclared", BIOMASS, "dst", DEPOT)
        .unionByName(undeclared("C9_depot_out_undeclared", PELLET, "src", DEPOT))
        .unionByName(undeclared("C9_refinery_undeclared", PELLET, "dst", REFINERY))
        .unionByName(_rows(wrong_year, "C9_location_year", F.col("yr"), F.col("src"), F.col("yr"), F.lit(p.location_year), F.lit(False)))
    )


CHECKS = (
    check_nonnegative, check_site_supply, check_depot_capacity, check_refinery_capacity,
    check_counts, check_coverage, check_flow_balance, check_locations,
)


# Values of the grouping id of `tally`: which of src and dst a row is not about.
BY_SOURCE, BY_DESTINATION, BY_YEAR = 1, 2, 3


def tally(flows: DataFrame) -> DataFrame:
    """Sum, least value and rows per data type and year: by source, by destination and in all (`by`), in one aggregation."""
    keys = ["data_type", "yr", "src", "dst"]
    grouped = flows.groupingSets([keys[:3], ["data_type", "yr", "dst"], keys[:2]], *keys)
    return grouped.agg(
        F.grouping_id().cast("int").alias("by"), F.sum("value").alias("load"), F.min("value").alias("least"), F.count(F.lit(1)).alias("n")
    )


def audit(flows: DataFrame, p: Params) -> DataFrame:
    """All checks as one table (constraint, yr, key, actual, limit, ok).

    The flows are read and shuffled once: the checks work on their `tally`, a stored table with a row per kind, year and node.
    """
    sums = cut(tally(flows), "tally")
    kind, by = F.col("data_type"), F.col("by")
    sources = sums.filter(by == BY_SOURCE)
    years = sums.filter(by == BY_YEAR).select("data_type", "yr", F.col("load").alias("value"), "least")

    def ends(side: str) -> DataFrame:
        rows = sums.filter(kind.isin(BIOMASS, PELLET) & (by == (BY_SOURCE if side == "src" else BY_DESTINATION)))
        return rows.select("data_type", F.lit(side).alias("side"), "yr", F.col(side).alias("key"), "load")

    loads = ends("src").unionByName(ends("dst"))

    def load(leg: str, side: str) -> DataFrame:
        return ends(side).filter(kind == leg).select("yr", "key", "load")

    def part(of: str, name: str) -> Column:
        return F.sum(F.when(kind == of, F.col("load")).otherwise(0.0)).alias(name)

    sites = sources.filter(kind.isin(BIOMASS, FORECAST)).groupBy("yr", "src").agg(
        part(BIOMASS, "sent"), part(FORECAST, "forecast"), F.coalesce(F.sum(F.when(kind == BIOMASS, F.col("n"))), F.lit(0)).alias("n")
    )
    plants = sources.filter(kind.isin(DEPOT, REFINERY)).select("data_type", "yr", "src", "n")
    # Flows in at a depot and out of it; other ends are no part of its balance.
    own = ((kind == BIOMASS) & (F.col("side") == "dst")) | ((kind == PELLET) & (F.col("side") == "src"))
    depots = loads.filter(own).groupBy("yr", "key").agg(part(BIOMASS, "inflow"), part(PELLET, "outflow"))
    repeated = plants.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    return (
        _nonnegative(years.filter(F.col("least").isNotNull()).select("data_type", "yr", F.col("least").alias("v")))
        .unionByName(_site_supply(sites))
        .unionByName(_depot_capacity(loads, p))
        .unionByName(_refinery_capacity(load(PELLET, "dst"), p))
        .unionByName(_counts(plants.groupBy("data_type", "src").agg(F.sum("n").alias("n")), p))
        .unionByName(_coverage(processed_ratio(years), p))
        .unionByName(_flow_balance(depots.withColumn("diff", F.col("inflow") - F.col("outflow")), p))
        .unionByName(_locations(repeated, {key: load(*key) for key in ((BIOMASS, "dst"), (PELLET, "src"), (PELLET, "dst"))}, p))
    )


def repair_overload(flows: DataFrame, p: Params, mode: str = "shave", shave: float = 1e-2) -> DataFrame:
    """Lower pellet flows where a depot sends more than its capacity.

    `shave` takes a fixed amount off every pellet flow of a year with an overloaded depot; `scale`
    brings only the overloaded depots down to capacity.
    """
    load = depot_load(flows, PELLET, "src")
    pellet = F.col("data_type") == PELLET
    if mode == "shave":
        years = load.groupBy("yr").agg(F.max("load").alias("top"))
        over = pellet & (F.col("top") > p.depot_cap)
        fixed = flows.join(years, "yr", "left").withColumn("value", F.when(over, F.col("value") - shave).otherwise(F.col("value")))
    elif mode == "scale":
        depots = load.filter(F.col("load") > p.depot_cap).withColumnRenamed("key", "src")
        over = pellet & F.col("load").isNotNull()
        down = F.col("value") * p.depot_cap / F.col("load")
        fixed = flows.join(depots, ["yr", "src"], "left").withColumn("value", F.when(over, down).otherwise(F.col("value")))
    else:
        raise ValueError(f"unknown repair mode {mode!r}")
    return fixed.select(*flows.columns)


def flow_totals(flows: DataFrame) -> DataFrame:
    """Biomass and pellets moved per year."""
    def total(kind: str) -> Column:
        return F.sum(F.when(F.col("data_type") == kind, F.col("value")).otherwise(0.0))

    legs = flows.filter(F.col("data_type").isin(BIOMASS, PELLET))
    return legs.groupBy("yr").agg(total(BIOMASS).alias("biomass"), total(PELLET).alias("pellets"))


def forecast_mae(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Mean absolute error per year over the sites both tables have."""
    other = forecast.select("idx", "yr", F.col("biomass").alias("expected"))
    both = actual.join(other, ["idx", "yr"])
    return both.groupBy("yr").agg(F.avg(F.abs(F.col("biomass") - F.col("expected"))).alias("mae"))


def transport_cost(flows: DataFrame, dist: DataFrame) -> DataFrame:
    """Distance times flow per year and leg, and `unpriced`, the flow over arcs that `dist` does not have.

    `dist` may be a whole matrix: it is not shuffled for a plan.
    """
    legs = flows.filter(F.col("data_type").isin(BIOMASS, PELLET))
    legs = legs.select("data_type", "yr", F.col("src").alias("i"), F.col("dst").alias("j"), "value")
    known = lookup_join(dist.select("i", "j", "d"), legs.select("i", "j").distinct(), ["i", "j"])
    paid = legs.join(known, ["i", "j"], "left")
    return paid.groupBy("yr", "data_type").agg(
        F.coalesce(F.sum(F.col("d") * F.col("value")), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("value"))), F.lit(0.0)).alias("unpriced"),
    )


def underuse_cost(flows: DataFrame, p: Params) -> DataFrame:
    """Unused capacity of all declared depots and refineries in every year that has flows or a forecast; an idle plant, and
    a year in which none is served, count fully."""
    kind = F.col("data_type")
    plants = flows.filter(kind.isin(DEPOT, REFINERY)).select("data_type", "src").distinct()
    counts = plants.groupBy().agg(
        F.sum(F.when(kind == DEPOT, p.depot_cap).otherwise(p.refinery_cap)).alias("capacity")
    )
    years = flows.filter(kind.isin(BIOMASS, PELLET, FORECAST)).select("yr").distinct()
    served = flows.filter(kind.isin(BIOMASS, PELLET)).select(
        "yr", F.when(kind == BIOMASS, F.lit(DEPOT)).otherwise(F.lit(REFINERY)).alias("data_type"), F.col("dst").alias("src"), "value"
    )
    used = served.groupBy("yr", "data_type", "src").agg(F.sum("value").alias("value"))
    used = used.join(plants, ["data_type", "src"], "left_semi").groupBy("yr").agg(F.sum("value").alias("used"))
    capacity = F.coalesce(counts.scalar(), F.lit(0.0))
    return years.join(used, "yr", "left").select("yr", (capacity - F.coalesce("used", F.lit(0.0))).alias("underuse"))


def total_cost(flows: DataFrame, dist: DataFrame, actual: DataFrame, forecast: DataFrame, p: Params) -> DataFrame:
    """Per year with flows or a forecast: weighted transport, forecast error, unused capacity, their sum, and the flow that
    has no distance and so no price."""
    moved = transport_cost(flows, dist).groupBy("yr").agg((F.sum("cost") * p.factor).alias("transport"), F.sum("unpriced").alias("unpriced"))
    parts = underuse_cost(flows, p).join(moved, "yr", "left").join(forecast_mae(actual, forecast), "yr", "left")
    parts = parts.fillna(0.0, ["transport", "mae", "unpriced"])
    return parts.select("yr", "transport", "mae", "underuse", (F.col("transport") + F.col("mae") + F.col("underuse")).alias("cost"), "unpriced")
