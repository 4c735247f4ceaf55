"""Totals, distributions, shares and quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgrid.functions.scale import column_quantiles, running_total
from haulgrid.params import Params
from haulgrid.schemas import BIOMASS, PELLET


def total_by_year(history: DataFrame) -> DataFrame:
    return history.groupBy("yr").agg(F.sum("biomass").alias("biomass"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column.

    All columns share one aggregation and the few passes of `column_quantiles`.
    """
    quartiles = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    own = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(c).alias(f"{k}_{name}") for k, c in enumerate(cols) for name, f in own.items()])

    def row(k: int, c: str) -> Column:
        q = [F.lit(quartiles[c][p]).cast("double").alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
        at = {name: F.col(f"{k}_{name}").cast("bigint" if name == "n" else "double").alias(name) for name in own}
        return F.struct(F.lit(c).alias("measure"), at["n"], at["mean"], at["std"], at["min"], *q, at["max"])

    return wide.select(F.inline(F.array(*[row(k, c) for k, c in enumerate(cols)])))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def site_mean(history: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    rows = history if years is None else history.filter(F.col("yr").isin(*years))
    return rows.groupBy("idx").agg(F.avg("biomass").alias("biomass"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in one pass, one row per ordered pair.

    A constant column correlates with nothing: null.
    """
    pairs = [(a, b) for n, a in enumerate(cols) for b in cols[n:]]

    def pearson(a: str, b: str) -> Column:
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    wide = df.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        r = F.col(f"`{a}|{b}`")
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), r.alias("r")))
    return wide.select(F.inline(F.array(*cells)))


def minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale columns to 0..1 over the whole table; a constant column becomes null."""
    limits = df.agg(*[f(c).alias(f"{p}{c}") for c in cols for p, f in (("lo_", F.min), ("hi_", F.max))])

    def scaled(c: str) -> Column:
        lo, hi = limits.select(f"lo_{c}").scalar(), limits.select(f"hi_{c}").scalar()
        return F.try_divide(F.col(c) - lo, hi - lo)

    return df.withColumns({c: scaled(c) for c in cols})


def align_series(df: DataFrame, series: DataFrame, on: str = "yr") -> DataFrame:
    return df.join(series, on)


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins between the extremes; the last bin includes its right edge.

    Empty bins appear with a count of 0. `df` is read twice, for the extremes and for the counts.
    """
    limits = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = limits.select("lo").scalar(), limits.select("hi").scalar()
    width = (hi - lo) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col(col) - lo, width)), F.lit(0))
    counted = df.filter(F.col(col).isNotNull()).groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
    counted = counted.agg(F.count(F.lit(1)).alias("n"))
    scaffold = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = scaffold.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    edge = lo + F.col("bin") * width
    return filled.select("bin", edge.alias("lo"), (edge + width).alias("hi"), "n")


def busiest(flows: DataFrame) -> DataFrame:
    """Per year the depot with the largest in-flow; the least key wins ties."""
    load = depot_load(flows, BIOMASS, "dst")
    top = F.max(F.struct(F.col("load"), (-F.col("key")).alias("neg"))).alias("top")
    return load.groupBy("yr").agg(top).select("yr", (-F.col("top.neg")).alias("depot"), F.col("top.load").alias("load"))


def depot_load(flows: DataFrame, leg: str, side: str) -> DataFrame:
    """Flow of one leg (a data type) per year and source (`src`) or destination (`dst`)."""
    rows = flows.filter(F.col("data_type") == leg)
    return rows.groupBy("yr", F.col(side).alias("key")).agg(F.sum("value").alias("load"))


def all_loads(flows: DataFrame) -> DataFrame:
    """Both ends of both legs in one aggregation: (data_type, side, yr, key, load)."""
    legs = flows.filter(F.col("data_type").isin(BIOMASS, PELLET))
    ends = legs.unpivot(["data_type", "yr", "value"], ["src", "dst"], "side", "key")
    return ends.groupBy("data_type", "side", "yr", "key").agg(F.sum("value").alias("load"))


def pareto_share(means: DataFrame, cut: float | None = None) -> DataFrame:
    """Running share of the total from the largest site down; with `cut` only shares up to it."""
    running = running_total(means, F.col("biomass"), [F.desc("biomass"), F.col("idx")], out="cum_biomass")
    total = running.agg(F.sum("biomass")).scalar()
    shares = running.select("idx", "biomass", "cum_biomass", (F.col("cum_biomass") / total).alias("share"))
    return shares if cut is None else shares.filter(F.col("share") <= cut)


def cluster_profile(forecast: DataFrame, labels: DataFrame, years: Sequence[int], diameters: DataFrame) -> DataFrame:
    """Per cluster: sites, total per year (`total_<yr>`), mean yearly total, largest inner distance."""
    per_year = [
        F.coalesce(F.sum(F.when(F.col("yr") == y, F.col("biomass"))), F.lit(0.0)).alias(f"total_{y}") for y in years
    ]
    # Per site first, so the sites of a large cluster are counted without a distinct.
    per_site = forecast.filter(F.col("yr").isin(*years)).groupBy("idx").agg(*per_year)
    sums = [F.sum(F.coalesce(F.col(f"total_{y}"), F.lit(0.0))).alias(f"total_{y}") for y in years]
    totals = labels.join(per_site, "idx", "left").groupBy("cluster").agg(F.count(F.lit(1)).alias("points"), *sums)
    mean = sum((F.col(f"total_{y}") for y in years), F.lit(0.0)) / len(years)
    return totals.withColumn("mean_total", mean).join(diameters, "cluster", "left")


def depot_quota(profile: DataFrame, lower: float, upper: float, rule: str = "remainder", col: str = "mean_total") -> DataFrame:
    """Plants per cluster from its total.

    `remainder`: one per `upper`, plus one more for a rest of at least `lower`; `threshold`: none up
    to `lower`, else one more than the total holds whole `upper`s.
    """
    v = F.col(col)
    if rule == "remainder":
        quota = F.greatest(F.floor((v - lower) / upper) + 1, F.lit(0).cast("bigint"))
    elif rule == "threshold":
        quota = F.when(v > lower, F.floor(v / upper) + 1).otherwise(F.lit(0).cast("bigint"))
    else:
        raise ValueError(f"unknown quota rule {rule!r}")
    return profile.withColumn("quota", quota.cast("bigint"))


def quota_bounds(profile: DataFrame, upper: float, years: Sequence[int], min_share: float = 0.8) -> DataFrame:
    """Least and greatest plant count the two yearly totals allow."""
    totals = [F.col(f"total_{y}") for y in years]
    return profile.withColumn(
        "min_quota", F.ceil(F.greatest(*totals) * min_share / upper).cast("bigint")
    ).withColumn("max_quota", F.floor(F.least(*totals) / upper).cast("bigint"))


def coverage_share(bounded: DataFrame) -> DataFrame:
    """Share of biomass in clusters with a plant, and in those whose bounds also agree."""
    v, has = F.col("mean_total"), F.col("quota") > 0
    fits = has & (F.col("min_quota") <= F.col("max_quota"))

    def share(cond: Column) -> Column:
        return F.try_divide(F.sum(F.when(cond, v).otherwise(0.0)), F.sum(v))

    return bounded.agg(share(has).alias("covered"), share(fits).alias("covered_bounded"))


def refinery_load_band(forecast: DataFrame, p: Params) -> DataFrame:
    """Total mean forecast and the load range of each of the refineries."""
    total = F.sum("biomass") / len(p.years)
    rows = forecast.filter(F.col("yr").isin(*p.years)).agg(total.alias("total"))
    n = p.max_refineries
    return rows.select("total", (F.col("total") * p.min_share / n).alias("low"), (F.col("total") / n).alias("high"))


def balanced_blocks(means: DataFrame, n: int) -> DataFrame:
    """Sites from the largest down in n blocks of about equal total; none is left out."""
    running = running_total(means, F.col("biomass"), [F.desc("biomass"), F.col("idx")])
    target = running.agg(F.sum("biomass")).scalar() / n
    block = F.least(F.floor(F.try_divide(F.col("before"), target)), F.lit(n - 1)).cast("int")
    return running.select("idx", "biomass", block.alias("block"))
