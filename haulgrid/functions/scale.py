"""Exact operators whose work stays spread when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.functions.lineage import cut

# At most this many keys can each hold more than 1/HOT_KEYS of the rows.
HOT_KEYS = 10_000
# Rows, and bytes as stored, of a lookup table that is still broadcast: about 100 MB of a few numbers each.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def running_total(
    df: DataFrame,
    value: Column,
    order_by: Sequence[Column],
    keys: Sequence[str] = (),
    out: str = "running",
    before: str = "before",
    ranges: int | None = None,
) -> DataFrame:
    """Add inclusive (`out`) and exclusive (`before`) running sums of `value` in a total order.

    Equal to a window with `keys` as partition, but the rows are range-partitioned on
    (`keys`, `order_by`), so neither a global order nor one large key ends in a single task:
    each range adds the totals of the ranges before it to its own local window. There are `ranges` of them, by default as
    many as the session has shuffle partitions: give more where the input is so large that one would not fit a task.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        df.withColumn("_range_value", value)
        .repartitionByRange(ranges, *[F.col(k) for k in keys], *order_by)
        .withColumn("_range", F.spark_partition_id()),
        "ranged",
    )
    # One row per range (and key): the window below sees at most `ranges` rows of a key.
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("_range_value").alias("_range_sum"))
        .select(*keys, "_range", F.coalesce(F.sum("_range_sum").over(earlier), F.lit(0)).alias("_range_start"))
    )
    local = Window.partitionBy(*keys, "_range").orderBy(*order_by)
    local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(starts, [*keys, "_range"])
        .withColumn(out, F.col("_range_start") + F.sum("_range_value").over(local))
        .withColumn(before, F.col(out) - F.col("_range_value"))
        .drop("_range", "_range_start", "_range_value")
    )


def lookup_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], stored: bool = False, weight: Column | None = None
) -> DataFrame:
    """Inner join of a large table with a lookup table of a few narrow columns.

    The lookup table is written and counted: up to BROADCAST_ROWS rows and BROADCAST_BYTES it is broadcast and `big` is
    not shuffled, beyond that both sides are. `stored` tells that it is a written table already;
    `weight` is what a row counts for if it holds a collection.
    """
    table = small if stored else cut(small, "lookup")
    rows = table.count() if weight is None else table.agg(F.sum(weight)).first()[0] or 0
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return big.join(F.broadcast(table) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table, list(on))


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))


def _cuts(counts: DataFrame, on: Sequence[str], block: int, name: str) -> DataFrame:
    share = counts.agg(F.sum("_n") / HOT_KEYS).scalar()
    size = F.greatest(F.lit(float(block)), F.coalesce(share, F.lit(0.0)))
    return counts.filter(F.col("_n") > size).select(
        *on, F.ceil(F.col("_n") / size).cast("int").alias(name)
    )


def split_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    block: int = 5_000,
    counts: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Inner many-to-many equi-join that cuts hot keys into blocks on both sides.

    A key with more than `block` rows on a side is hashed into blocks of about that size there, and
    the other side is repeated once per block, so one key becomes many block pairs. The table of
    hot keys holds at most 2 * HOT_KEYS rows, which is what makes it safe to broadcast. `counts` are the
    `key_counts` of both sides, for callers that know a cheaper way to them.
    """
    on = list(on)
    n_left, n_right = counts or (key_counts(left, on), key_counts(right, on))
    hot = F.broadcast(_cuts(n_left, on, block, "_lcut").join(_cuts(n_right, on, block, "_rcut"), on, "full_outer"))

    def blocks(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        cuts_own, cuts_other = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        return (
            df.join(hot, on, "left")
            .withColumn(mine, F.pmod(F.xxhash64(*df.columns), cuts_own).cast("int"))
            .withColumn(theirs, F.explode(F.sequence(F.lit(0), cuts_other - 1)))
            .drop("_lcut", "_rcut")
        )

    cut_left = blocks(left, "_lcut", "_rcut", "_lblock", "_rblock")
    cut_right = blocks(right, "_rcut", "_lcut", "_rblock", "_lblock")
    return cut_left.join(cut_right, [*on, "_lblock", "_rblock"]).drop("_lblock", "_rblock")


def quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row (`prob`, `value`) per probability.

    Works on the value counts in sorted ranges, so no task ever holds all the values.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v"))
    ranked = running_total(counts.agg(F.count(F.lit(1)).alias("n")), F.col("n"), [F.col("v")])
    total = ranked.agg(F.sum("n")).scalar()
    wanted = F.array(*[F.lit(float(q)) for q in probs])
    place = F.col("prob") * (total - 1)

    def reaches(position: Column) -> Column:
        return (F.col("before") <= position) & (position < F.col("running"))

    at = ranked.select("v", "before", "running", F.explode(wanted).alias("prob"))
    at = at.filter(reaches(F.floor(place)) | reaches(F.ceil(place)))
    low = F.max(F.when(reaches(F.floor(place)), F.col("v")))
    high = F.max(F.when(reaches(F.ceil(place)), F.col("v")))
    part = F.col("prob") * (total - 1) - F.floor(F.col("prob") * (total - 1))
    return at.groupBy("prob").agg(low.alias("low"), high.alias("high")).select(
        "prob", (F.col("low") + (F.col("high") - F.col("low")) * part).alias("value")
    )


# Classes of doubles for the first histogram: one per sign and binary exponent, about 4,300 in all.
_ENDS = 4_000


def _exponent_class(v: Column) -> Column:
    """A class that never falls as `v` rises: sign and binary exponent, infinities and NaN beyond the others."""
    level = F.floor(F.log2(F.abs(v))) + 1_100
    signed = F.when(v < 0, -level).otherwise(level)
    ends = F.when(F.isnan(v), F.lit(_ENDS + 1)).when(F.abs(v) == float("inf"), F.signum(v) * _ENDS)
    return F.when(v == 0, F.lit(0)).otherwise(F.coalesce(ends, signed)).cast("int")


def column_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], bins: int = 1 << 14, settle: int = 200_000
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles with linear interpolation of many columns at once, as doubles: {column: {prob: value}}.

    Selection by histograms instead of a sort: the first counts sign and exponent of every value of every column, each
    later one cuts the ranges around the wanted ranks into `bins` equal parts, and once a range holds at most `settle` rows its
    values are counted one by one. Every pass reads the table once for all columns; three do for most data, and each pass
    narrows a range by `bins`, so the number is bounded by the bits of a double. Only the ranges around the wanted ranks
    (columns times probabilities, known before) come to the driver, and of the first pass at most 4,300 rows a column.
    NaN counts as the largest value; a column without values has null quantiles.
    """
    pair = [F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(cols)]
    values = df.select(F.inline(F.array(*pair))).filter(F.col("v").isNotNull())
    edges = (F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    classes = values.groupBy("k", _exponent_class(F.col("v")).alias("class")).agg(*edges)
    of_column: dict[int, list] = {}
    for r in sorted(classes.collect(), key=lambda r: (r["k"], r["class"])):
        of_column.setdefault(r["k"], []).append(r)

    # What holds a wanted rank: (least value, greatest value, rows before, rows).
    ranges: dict[tuple[int, int], tuple[float, float, int, int]] = {}
    total = {k: sum(r["n"] for r in rows) for k, rows in of_column.items()}
    places = {(k, q): q * (n - 1) for k, n in total.items() for q in probs}
    for (k, _), place in places.items():
        for rank in {math.floor(place), math.ceil(place)}:
            before = 0
            for r in of_column[k]:
                if rank < before + r["n"]:
                    ranges[k, rank] = (r["lo"], r["hi"], before, r["n"])
                    break
                before += r["n"]

    while True:
        wide = [(k, rank, *span) for (k, rank), span in ranges.items() if span[0] < span[1]]
        if not wide:
            break
        one_by_one = max(w[5] for w in wide) <= settle
        sought = df.sparkSession.createDataFrame(wide, "k int, rank bigint, lo double, hi double, before bigint, n bigint")
        spans = F.broadcast(sought.select("k", "lo", "hi", "before").distinct())
        inside = values.join(spans, "k").filter(F.col("v").between(F.col("lo"), F.col("hi")))
        part = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("double")
        cells = inside.groupBy("k", F.col("before").alias("start"), (F.col("v") if one_by_one else part).alias("cell")).agg(*edges)
        # A window sees the cells of one range: `bins` of them, or at most `settle` values.
        order = Window.partitionBy("k", "start").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = cells.withColumn("to", F.col("start") + F.sum("n").over(order))
        ranks = F.broadcast(sought.select("k", F.col("before").alias("start"), "rank"))
        hit = summed.join(ranks, ["k", "start"]).filter((F.col("rank") < F.col("to")) & (F.col("rank") >= F.col("to") - F.col("n")))
        for r in hit.select("k", "rank", "lo", "hi", (F.col("to") - F.col("n")).alias("before"), "n").collect():
            ranges[r["k"], r["rank"]] = (r["lo"], r["hi"], r["before"], r["n"])
    out: dict[str, dict[float, float | None]] = {c: dict.fromkeys(probs) for c in cols}
    for (k, q), place in places.items():
        low, high = ranges[k, math.floor(place)][0], ranges[k, math.ceil(place)][0]
        out[cols[k]][q] = low if low == high else low + (high - low) * (place - math.floor(place))
    return out
