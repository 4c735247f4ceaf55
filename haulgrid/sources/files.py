"""Readers and writers of the text files the planning data comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulgrid.functions.keys import year_of
from haulgrid.functions.lineage import cut
from haulgrid.operators.reshape import unpivot_years
from haulgrid.schemas import FORECAST_FILE, SOLUTION, SUBMISSION_FILE


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV: one line is read, no schema inference over the data."""
    return spark.read.option("header", True).csv(path).columns


def _by_name(spark: SparkSession, path: str, wanted: T.StructType) -> DataFrame:
    """The columns of `wanted`, found by the names in the header in whatever order; other columns are left out."""
    names = _header(spark, path)
    missing = [f.name for f in wanted if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in wanted}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in names])
    return spark.read.schema(schema).option("header", True).csv(path).select(*kinds)


def read_site_panel(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sites and long history of a CSV with Index, Latitude, Longitude and one column per year."""
    names = _header(spark, path)
    kinds = {"Index": T.LongType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in names])
    wide = spark.read.schema(schema).option("header", True).csv(path)
    sites = wide.select(F.col("Index").alias("idx"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"))
    years = [c for c in names if c.isdigit()]
    history = unpivot_years(wide.select(F.col("Index").alias("idx"), *years), ["idx"], years)
    return sites, history


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """Edges (i, j, d) of a CSV matrix whose first column is the row index and whose header has the column indices.

    Lines are split into arrays, so a matrix of thousands of columns needs no thousand-column plan. A blank cell is a
    missing distance; an index or a distance that is no number is refused.
    """
    cells = F.split("value", ",")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    head = lines.filter(F.trim(F.get(cells, 0)) == "").first()
    if head is None:
        raise ValueError(f"{path} has no header, a line with an empty first field")
    labels = [int(c) for c in head["value"].split(",")[1:]]
    rows = lines.filter(F.col("value") != head["value"])
    data = rows.select(F.trim(F.get(cells, 0)).alias("row"), F.slice(cells, 2, F.size(cells) - 1).alias("ds"))

    def number(text: Column, kind: str) -> Column:
        bad = F.raise_error(F.concat(F.lit("not a number: "), text))
        return F.coalesce(text.try_cast(kind), bad.cast(kind))

    edges = data.select(number(F.col("row"), "bigint").alias("i"), F.posexplode("ds").alias("at", "text"))
    d = F.when(F.trim("text") != "", number(F.col("text"), "double"))
    return edges.select("i", F.get(F.lit(labels), F.col("at")).cast("bigint").alias("j"), d.alias("d"))


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Dated forecast rows (ts, yr, lat, lon, forecast)."""
    rows = _by_name(spark, path, FORECAST_FILE)
    return rows.select(
        F.to_timestamp("Date").alias("ts"), year_of(F.col("Date")).alias("yr"), F.col("Latitude").alias("lat"),
        F.col("Longitude").alias("lon"), F.col("Forecast").alias("forecast"),
    )


def read_estates(spark: SparkSession, path: str) -> DataFrame:
    """Industry estates; `-` is null and the TOTAL line is left out."""
    kinds = [("no", T.StringType()), ("estate", T.StringType()), ("district", T.StringType()), ("size_ha", T.DoubleType()),
             ("power_mva", T.DoubleType()), ("water_mld", T.DoubleType()), ("drainage_mld", T.DoubleType())]
    schema = T.StructType([T.StructField(c, kind) for c, kind in kinds])
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "-").csv(path)
    return rows.filter(F.col("no") != "TOTAL").withColumn("no", F.col("no").cast("int"))


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Submission rows as flows, columns by name; blank keys and values are null."""
    rows = _by_name(spark, path, SUBMISSION_FILE)
    return rows.select(
        "data_type", F.col("year").alias("yr"), F.col("source_index").cast("bigint").alias("src"),
        F.col("destination_index").cast("bigint").alias("dst"), "value",
    )


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    return _by_name(spark, path, SOLUTION)


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON arrays as texts, one row (`file`, `record`) each, however large an array: `path` may name many files.

    Files are cut at every `}`, so splits of one file are read by many tasks wherever Spark can read them. Which pieces make up a
    record follows from two things that add up over the splits of a file: whether a piece starts inside a string (the parity
    of the quotes before it) and how deep it starts (braces outside strings). Every split sums up both cases of the first on its
    own, a window over one row per split carries them on, and pieces meet by the place where their record starts. Elements
    that are no objects are left out.
    """
    block = F.col("_metadata.file_block_start")
    raw = spark.read.option("lineSep", "}").text(path)
    at = F.monotonically_increasing_id()
    pieces = cut(raw.select(F.col("_metadata.file_path").alias("file"), block.alias("block"), at.alias("at"), "value"), "pieces")

    # An escape is never split, as no escape has a brace; without escapes every quote opens or closes a string.
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))

    def net(inside: bool) -> Column:
        """How much deeper it is after the piece and its brace, when the piece starts outside or inside a string."""
        text = F.regexp_replace(plain, '^[^"]*+"?', "") if inside else plain
        bare = F.regexp_replace(F.regexp_replace(text, '"[^"]*+"', ""), '"[^"]*+$', "")
        # All of a piece without a quote lies inside the string it starts in.
        opened = F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))
        return (opened - F.when((quotes + int(inside)) % 2 == 0, 1).otherwise(0)).cast("bigint")

    own = Window.partitionBy("file", "block").orderBy("at")
    upto, ahead = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.lit(0).cast("bigint")
    counted = pieces.select("file", "block", "at", quotes.alias("q"), net(False).alias("out"), net(True).alias("in"))
    # `odd`: the piece starts inside a string if its split starts outside one.
    odd = counted.withColumn("odd", F.coalesce(F.sum("q").over(upto), none) % 2)
    both = odd.select(
        "file", "block", "at", "q", "odd", F.when(F.col("odd") == 0, F.col("out")).otherwise(F.col("in")).alias("net0"),
        F.when(F.col("odd") == 0, F.col("in")).otherwise(F.col("out")).alias("net1"),
    )
    both = cut(both.drop("odd"), "depths")
    splits = both.groupBy("file", "block").agg(F.sum("q").alias("q"), F.sum("net0").alias("net0"), F.sum("net1").alias("net1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("odd", F.coalesce(F.sum("q").over(earlier), none) % 2)
    net_split = F.when(F.col("odd") == 0, F.col("net0")).otherwise(F.col("net1"))
    splits = splits.withColumn("net", net_split).withColumn("deep", F.coalesce(F.sum("net").over(earlier), none))
    step = F.when(F.col("odd") == 0, F.col("net0")).otherwise(F.col("net1"))
    deep = both.join(splits.select("file", "block", "odd", "deep"), ["file", "block"]).withColumn("net", step)
    after = F.col("deep") + F.sum("net").over(ahead)
    levels = deep.withColumn("after", after).withColumn("before", F.col("after") - F.col("net"))
    # A record starts where nothing is open and ends where nothing is open again.
    levels = cut(levels.select("file", "block", "at", "before", F.when(F.col("before") == 0, F.col("at")).alias("first")), "levels")
    carried = levels.filter(F.col("first").isNotNull()).groupBy("file", "block").agg(F.max("at").alias("last"))
    all_splits = levels.select("file", "block").distinct().join(carried, ["file", "block"], "left")
    all_splits = all_splits.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    started = levels.join(all_splits, ["file", "block"])
    first = F.coalesce(F.last("first", ignorenulls=True).over(ahead), F.col("carried"))
    placed = started.select("file", "block", "at", first.alias("first"))
    whole = pieces.join(placed, ["file", "block", "at"]).groupBy("file", "first")
    parts = whole.agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["value"]), "}")
    record = F.regexp_replace(joined, r"^[^{]*+", "")
    # What follows the last record of a file has no brace.
    return parts.select("file", record.alias("record")).filter(F.col("record") != "").withColumn("record", F.concat("record", F.lit("}")))


def read_weather(spark: SparkSession, path: str, schema: T.StructType, one_array: bool = False) -> DataFrame:
    """Weather records, one JSON object per line, or with `one_array` one array of them per file.

    `schema` names the series and must hold the site key: records are never matched by their order.
    A failed call's `{}` reads as a record of nulls. An array is read by as many tasks as its file has splits
    (`array_records`).
    """
    if not one_array:
        return spark.read.schema(schema).json(path)
    return array_records(spark, path).select(F.from_json("record", schema).alias("_r")).select("_r.*")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a result as one table directory, replacing an earlier one."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_distances(dist: DataFrame, path: str, by: str = "j") -> str:
    """Store edges once, sorted by destination or source, so that scans for a few sites skip the rest."""
    return write_table(dist.repartitionByRange(by, "d").sortWithinPartitions(by, "d"), path)


def write_submission(flows: DataFrame, path: str) -> str:
    named = flows.select(
        F.col("yr").alias("year"), "data_type", F.col("src").alias("source_index"), F.col("dst").alias("destination_index"), "value"
    )
    return write_table(named, path, "csv")
