"""Wide panels, matrices, parallel arrays and keyed solutions as long tables, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgrid.functions.scale import running_total, split_join


def unpivot_years(df: DataFrame, id_cols: Sequence[str], years: Sequence[str], value: str = "biomass") -> DataFrame:
    """One row per id and year column; `yr` is an int whatever the headers were."""
    long = df.unpivot(list(id_cols), list(years), "yr", value)
    return long.withColumn("yr", F.col("yr").cast("int"))


def pivot_years(
    df: DataFrame, keys: Sequence[str], year: str, value: str, years: Sequence[int]
) -> DataFrame:
    """One column per year holding the mean of the key's duplicates."""
    wide = df.groupBy(*keys).pivot(year, list(years)).agg(F.avg(value))
    return wide.select(*keys, *[F.col(str(y)) for y in years])


def matrix_to_edges(df: DataFrame, row: str, values: str) -> DataFrame:
    """Edges (i, j, d) of a matrix held as one array of distances per row."""
    return df.select(
        F.col(row).cast("bigint").alias("i"), F.posexplode(values).alias("j", "d")
    ).select("i", F.col("j").cast("bigint").alias("j"), F.col("d").cast("double").alias("d"))


def assign_index(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """0-based position of each row in the order of `order`, which must be unique."""
    ranked = running_total(df, F.lit(1).cast("bigint"), [F.col(c) for c in order], out="_rank", before=out)
    return ranked.drop("_rank")


def recover_index(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Give rows keyed by (lat, lon) the index their coordinates have in `sites`."""
    return df.join(sites.select("idx", "lat", "lon"), ["lat", "lon"])


def lag_forecast(history: DataFrame, lag: int = 2) -> DataFrame:
    """Naive forecast: the value of year y serves as the forecast of y + lag."""
    return history.select("idx", (F.col("yr") + lag).cast("int").alias("yr"), "biomass")


def induced_edges(dist: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows and columns of the matrix restricted to the `idx` values in `ids`."""
    rows = ids.select(F.col("idx").alias("i")).distinct()
    cols = ids.select(F.col("idx").alias("j")).distinct()
    return dist.join(rows, "i", "left_semi").join(cols, "j", "left_semi").select(*dist.columns)


def edges_from(dist: DataFrame, center: int) -> DataFrame:
    return dist.filter(F.col("i") == center)


def adjacency(arcs: DataFrame, by: str = "i", block: int = 1024) -> DataFrame:
    """Sorted neighbour lists of every node, by source (`i`) or by destination (`j`).

    Lists are split in blocks of `block` consecutive neighbour ids, so the array in a row is bounded
    however many neighbours one node has.
    """
    other = "j" if by == "i" else "i"
    return (
        arcs.groupBy(by, F.floor(F.col(other) / block).alias("block"))
        .agg(F.sort_array(F.collect_list(other)).alias("neighbours"), F.count(F.lit(1)).alias("n"))
        .withColumnRenamed(by, "node")
    )


def two_hop(arcs_ij: DataFrame, arcs_jk: DataFrame) -> DataFrame:
    """Every path i -> j -> k with the distance of both legs."""
    first = arcs_ij.select("i", "j", F.col("d").alias("d_ij"))
    second = arcs_jk.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("d").alias("d_jk"))
    return split_join(first, second, ["j"]).select(
        "i", "j", "k", (F.col("d_ij") + F.col("d_jk")).alias("d")
    )


def least_two_hop(arcs_ij: DataFrame, arcs_jk: DataFrame, digits: int = 4) -> DataFrame:
    """The shortest path i -> j -> k of every pair (i, k): `i, k, j, d`; the least j of equals.

    A min-plus product: the join's paths go straight into minima per pair within their task, so what is shuffled is bounded by the
    pairs that a task meets and not by the paths over a hub, whose two sides `two_hop` cuts into blocks.
    """
    paths = two_hop(arcs_ij, arcs_jk).select("i", "k", F.struct(F.round("d", digits).alias("d"), "j").alias("way"))
    return paths.groupBy("i", "k").agg(F.min("way").alias("best")).select("i", "k", "best.j", "best.d")


def union_rows(*tables: DataFrame) -> DataFrame:
    """Append like tables by column name; a column a table lacks is null."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def flatten_series(df: DataFrame, series: str, keys: Sequence[str]) -> DataFrame:
    """One row per time step of a struct of parallel arrays that has a `time` array.

    A record without the arrays gives no rows.
    """
    fields = df.schema[series].dataType.names
    step = F.explode(F.arrays_zip(*[F.col(f"{series}.{f}").alias(f) for f in fields]))
    flat = df.select(*keys, step.alias("_step"))

    def field(name: str) -> Column:
        value = F.col(f"_step.{name}")
        return (F.to_timestamp(value) if name == "time" else value).alias(name)

    return flat.select(*keys, *[field(f) for f in fields])
