"""Arc reductions, solution filters and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.schemas import BIOMASS


def arcs_within(dist: DataFrame, max_d: float) -> DataFrame:
    return dist.filter(F.col("d") <= max_d)


def arc_share_over(dist: DataFrame, max_d: float) -> DataFrame:
    """Arcs kept at `max_d`, share of arcs beyond it, and the largest distance."""
    over = F.when(F.col("d") > max_d, 1.0).otherwise(0.0)
    return dist.agg(
        F.count_if(F.col("d") <= max_d).alias("arcs_within"),
        F.avg(over).alias("share_over"),
        F.max("d").alias("max_d"),
    )


def nonzero(solution: DataFrame, tol: float = 0.0) -> DataFrame:
    return solution.filter(F.abs("value") > tol)


def vars_by_pattern(solution: DataFrame, pattern: str) -> DataFrame:
    """Variables whose whole name matches `pattern`."""
    return solution.filter(F.col("name").rlike(f"^(?:{pattern})$"))


def arcs_to_open(arcs: DataFrame, open_ids: DataFrame, side: str = "j") -> DataFrame:
    """Arcs that end (`j`) or start (`i`) at one of the open sites in `open_ids.idx`."""
    return arcs.join(open_ids.select(F.col("idx").alias(side)), side, "left_semi").select(*arcs.columns)


def drop_unmatched(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def drop_sparse_columns(df: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Keep the columns with at least floor(rows * min_share) values, counted in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    ).first()
    need = int(counts["_rows"] * min_share)
    return df.select(*[c for c in df.columns if counts[c] >= need])


def top_n_sites(forecast: DataFrame, n: int) -> DataFrame:
    """The n sites with the largest total over the years of `forecast`."""
    totals = forecast.groupBy("idx").agg(F.sum("biomass").alias("total"))
    return totals.orderBy(F.desc("total"), "idx").limit(n)


def even_sample(sites: DataFrame, n: int) -> DataFrame:
    """Sites at the n indices that divide 0..max evenly, truncated to whole indices."""
    if n < 2:
        return sites.filter(F.col("idx") == 0)
    top = sites.agg(F.max("idx")).first()[0] or 0
    step = top / (n - 1)
    near = F.ceil(F.try_divide(F.col("idx"), F.lit(step)))
    hit = F.col("idx") == top
    for k in (near - 1, near, near + 1):
        hit = hit | (F.floor(k * F.lit(step)) == F.col("idx")) & (k >= 0) & (k < n - 1)
    return sites.filter(hit)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of rows that repeat an earlier row in `cols`."""
    per_key = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def first_n_depots(flows: DataFrame, n: int) -> DataFrame:
    """The n depots that receive the most biomass."""
    load = flows.filter(F.col("data_type") == BIOMASS).groupBy(F.col("dst").alias("idx"))
    return load.agg(F.sum("value").alias("received")).orderBy(F.desc("received"), "idx").limit(n)
