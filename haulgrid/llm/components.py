"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.common import ONE_TASK, forget, store


def _rows(df: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
    """One row (`v`, `u`) for each of the pairs of every row; no union, so a single partition stays one."""
    made = F.explode(F.array(*[F.struct(v.alias("v"), u.alias("u")) for v, u in pairs]))
    return df.select(made.alias("_e")).select("_e.v", "_e.u")


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with the least of its node `v` and the node's neighbours. Sorted and merged: a broadcast would take more than 1 MB of
    the driver at every step, however few the edges, and one task needs no shuffle for it."""
    return edges.join(edges.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m")).hint("merge"), "v")


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node that has an edge in `edges` (`a`, `b` longs); the root is the least node reachable.

    Every step is a grouping with map-side combining and an equi-join, written to the shared folder; a node with very many
    edges is the skewed side of that join, which adaptive execution splits. The steps end when the stars stand still.
    """
    spark = edges.sparkSession
    pairs = edges.filter("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    path, state = store(pairs, "edges"), None
    v, u, m = F.col("v"), F.col("u"), F.col("m")
    while True:
        now = spark.read.schema("v long, u long").parquet(path)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        now = now.coalesce(1) if mark[0] <= ONE_TASK else now
        if mark == state or not mark[0]:
            return _rows(now, (v, u), (u, u)).distinct().select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = mark
        large = _rows(_with_least(_rows(now, (v, u), (u, v))), (F.greatest(v, u), m), (v, m)).filter(v != u)
        # A merge join of two single partitions no longer counts as one: without this all that follows it would be shuffled.
        large = (large.coalesce(1) if mark[0] <= ONE_TASK else large).distinct()
        small = _rows(_with_least(large), (u, m), (v, m)).filter(v != u)
        new = store((small.coalesce(1) if mark[0] <= ONE_TASK else small).distinct(), "stars")
        forget(spark, path)
        path = new
