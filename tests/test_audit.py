"""Each constraint fails on its own violation only; keys and files round-trip."""

import json
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulgrid.operators import audit as au
from haulgrid.operators import filters as fi
from haulgrid.operators import reshape as rs
from haulgrid.operators import stats as st
from haulgrid.params import Params
from haulgrid.schemas import BIOMASS, DEPOT, FLOWS, FORECAST, PELLET, REFINERY
from haulgrid.sources import files

P = Params(depot_cap=20.0, refinery_cap=30.0, max_depots=2, max_refineries=1)
GOOD = [
    (FORECAST, 2018, 0, None, 12.0), (FORECAST, 2018, 1, None, 10.0),
    (FORECAST, 2019, 0, None, 10.0), (FORECAST, 2019, 1, None, 10.0),
    (BIOMASS, 2018, 0, 5, 12.0), (BIOMASS, 2018, 1, 6, 8.0),
    (BIOMASS, 2019, 0, 5, 10.0), (BIOMASS, 2019, 1, 6, 10.0),
    (PELLET, 2018, 5, 9, 12.0), (PELLET, 2018, 6, 9, 8.0),
    (PELLET, 2019, 5, 9, 10.0), (PELLET, 2019, 6, 9, 10.0),
    (DEPOT, 20182019, 5, None, None), (DEPOT, 20182019, 6, None, None), (REFINERY, 20182019, 9, None, None),
]


def _swap(old, *new):
    assert old in GOOD
    return [r for r in GOOD if r != old] + list(new)


BAD = {
    "nothing": (GOOD, set()),
    "negative": (GOOD + [(BIOMASS, 2018, 1, 5, -1e-4), (BIOMASS, 2018, 1, 5, 1e-4)], {"C1_nonnegative_biomass_demand_supply"}),
    "site": (_swap((FORECAST, 2019, 0, None, 10.0), (FORECAST, 2019, 0, None, 9.0)), {"C2_site_supply"}),
    "no forecast": (_swap((FORECAST, 2019, 1, None, 10.0), (FORECAST, 2019, 2, None, 10.0)), {"C2_site_supply"}),
    "depot": (_swap((BIOMASS, 2018, 1, 6, 8.0), (BIOMASS, 2018, 1, 5, 8.2)), {"C3_depot_in", "C8_balance"}),
    "depot out": (_swap((PELLET, 2018, 5, 9, 12.0), (PELLET, 2018, 5, 9, 20.5)), {"C3_depot_out", "C8_balance"}),
    "refinery": (GOOD + [(PELLET, 2018, 5, 9, 11.0), (PELLET, 2018, 5, 9, -11.0), (PELLET, 2018, 6, 9, 12.0)],
                 {"C1_nonnegative_pellet_demand_supply", "C4_refinery_in", "C8_balance"}),
    "depots": (GOOD + [(DEPOT, 20182019, 7, None, None)], {"C5_depots"}),
    "refineries": (GOOD + [(REFINERY, 20182019, 8, None, None)], {"C6_refineries"}),
    "same cell": (GOOD + [(DEPOT, 20182019, 5, None, None)], {"C5_depots_per_cell"}),
    "coverage": ([r for r in GOOD if not (r[1] == 2019 and r[3] in (6, 9) and r[2] in (1, 6))], {"C7_coverage"}),
    "balance": (_swap((PELLET, 2019, 6, 9, 10.0), (PELLET, 2019, 6, 9, 9.9)), {"C8_balance"}),
    "one leg only": ([r for r in GOOD if r != (PELLET, 2018, 6, 9, 8.0)] , {"C7_coverage", "C8_balance"}),
    "undeclared": (_swap((DEPOT, 20182019, 6, None, None)), {"C9_depot_in_undeclared", "C9_depot_out_undeclared"}),
    "location year": (_swap((DEPOT, 20182019, 6, None, None), (DEPOT, 2018, 6, None, None)), {"C9_location_year"}),
}


@pytest.mark.parametrize("case", sorted(BAD))
def test_violations(spark, case):
    rows, expected = BAD[case]
    checks = au.audit(spark.createDataFrame(rows, FLOWS), P)
    assert {r.constraint for r in checks.filter("not ok").collect()} == expected


def test_failed_rows_name_year_and_key(spark):
    rows, _ = BAD["site"]
    failed = au.audit(spark.createDataFrame(rows, FLOWS), P).filter("not ok").collect()
    assert [(r.yr, r.key, r.actual, r.limit) for r in failed] == [(2019, 0, 10.0, 9.0)]


def test_costs(spark):
    flows = spark.createDataFrame(GOOD, FLOWS)
    dist = spark.createDataFrame([(0, 5, 1.0), (1, 6, 2.0), (5, 9, 3.0), (6, 9, 4.0)], "i bigint, j bigint, d double")
    actual = spark.createDataFrame([(0, 2018, 13.0), (1, 2018, 7.0), (0, 2019, 10.0), (1, 2019, 10.0)], "idx bigint, yr int, biomass double")
    forecast = spark.createDataFrame([(0, 2018, 12.0), (1, 2018, 10.0), (0, 2019, 10.0), (1, 2019, 10.0)], "idx bigint, yr int, biomass double")
    got = {r.yr: r for r in au.total_cost(flows, dist, actual, forecast, P).collect()}
    assert got[2018].transport == pytest.approx(0.001 * (12 + 16 + 36 + 32))
    assert got[2018].mae == 2.0 and got[2019].mae == 0.0
    # Two depots of 20 and a refinery of 30, of which 20 + 20 are used on each leg.
    assert got[2018].underuse == pytest.approx(70 - 40)
    assert got[2018].cost == pytest.approx(got[2018].transport + 2 + 30)


def test_idle_plants_count_fully(spark):
    flows = spark.createDataFrame(GOOD + [(DEPOT, 20182019, 7, None, None)], FLOWS)
    assert {r.underuse for r in au.underuse_cost(flows, P).collect()} == {50.0}


def test_solution_round_trip(spark):
    flows = spark.createDataFrame(GOOD, FLOWS)
    forecast = flows.filter(F.col("data_type") == FORECAST).select(F.col("src").alias("idx"), "yr", F.col("value").alias("biomass"))
    back = au.solution_to_submission(au.submission_to_solution(flows), forecast)
    places = F.when(F.col("data_type").isin(DEPOT, REFINERY), F.lit(None)).otherwise(F.col("value"))
    got = back.withColumn("value", places).select(*flows.columns)
    assert got.exceptAll(flows).isEmpty() and flows.exceptAll(got).isEmpty()


def test_bad_names_are_left_out_and_zeros_dropped(spark):
    solution = spark.createDataFrame([("b_2018_3_5", 2.0), ("b_2018_3_51", 0.0), ("x_5", 1.0), ("junk", 1.0), ("q_1", 1.0)], "name string, value double")
    none = spark.createDataFrame([], "idx bigint, yr int, biomass double")
    got = sorted((r.data_type, r.yr, r.src, r.dst) for r in au.solution_to_submission(solution, none).collect())
    assert got == [(BIOMASS, 2018, 3, 5), (DEPOT, 20182019, 5, None)]
    assert fi.vars_by_pattern(solution, r"b_2018_\d+_5").count() == 1


def test_repair(spark):
    rows = _swap((PELLET, 2018, 5, 9, 12.0), (PELLET, 2018, 5, 9, 20.005))
    flows = spark.createDataFrame(rows, FLOWS)
    shaved = au.repair_overload(flows, P)
    assert au.check_depot_capacity(shaved, P).filter("not ok").isEmpty()
    assert shaved.filter(f"data_type = '{PELLET}' and yr = 2019 and value <> 10").isEmpty()
    scaled = au.repair_overload(flows, P, "scale").filter(f"data_type = '{PELLET}' and yr = 2018")
    assert sorted(round(r.value, 9) for r in scaled.collect()) == [8.0, 20.0]


ESTATES = """Sr.No.,Estate,District,Size in Ha.,Power Supply (MVA),Water Supply (MLD),Drainage (MLD)
1,North Park,Alpha,1.80,0.50,2.70,0.00
2,"Mill, Old",Beta,0.90,-,-,-
3,Harbour,Beta,25.37,2.20,0.76,0190
TOTAL,-,-,28.07,2.70,3.46,190.00
"""


def test_read_estates(spark, tmp_path):
    (tmp_path / "e.csv").write_text(ESTATES)
    rows = {r.no: r for r in files.read_estates(spark, str(tmp_path / "e.csv")).collect()}
    assert sorted(rows) == [1, 2, 3]
    assert rows[2].estate == "Mill, Old" and rows[2].power_mva is None and rows[3].drainage_mld == 190.0


def test_read_panel_and_matrix(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Index,Latitude,Longitude,2010,2011\n0,24.5,71.25,8.5,\n1,24.5,71.5,24.0,28.5\n")
    sites, history = files.read_site_panel(spark, str(tmp_path / "p.csv"))
    assert sorted(tuple(r) for r in sites.collect()) == [(0, 24.5, 71.25), (1, 24.5, 71.5)]
    assert {(r.idx, r.yr): r.biomass for r in history.collect()} == {(0, 2010): 8.5, (0, 2011): None, (1, 2010): 24.0, (1, 2011): 28.5}
    (tmp_path / "d.csv").write_text(",0,1\n0,0.0,11.3\n1,11.7,0.0\n")
    assert {(r.i, r.j): r.d for r in files.read_distances(spark, str(tmp_path / "d.csv")).collect()} == {
        (0, 0): 0.0, (0, 1): 11.3, (1, 0): 11.7, (1, 1): 0.0}


def test_stored_distances_keep_all_edges(spark, tmp_path):
    dist = spark.range(2000).selectExpr("id % 40 as i", "id div 40 as j", "cast(id % 7 as double) as d")
    stored = spark.read.parquet(files.write_distances(dist, str(tmp_path / "dist")))
    assert stored.count() == 2000 and stored.exceptAll(dist).isEmpty()
    assert "PushedFilters: [IsNotNull(j), EqualTo(j,3)]" in stored.filter("j = 3")._jdf.queryExecution().toString()


def test_read_submission_with_blanks(spark, tmp_path):
    (tmp_path / "s.csv").write_text("year,data_type,source_index,destination_index,value\n20182019,depot_location,1256,,\n2018,biomass_demand_supply,3,1256.0,7.5\n")
    assert {tuple(r) for r in files.read_submission(spark, str(tmp_path / "s.csv")).collect()} == {
        ("depot_location", 20182019, 1256, None, None), ("biomass_demand_supply", 2018, 3, 1256, 7.5)}


def test_read_forecast_and_index(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Date,Latitude,Longitude,Forecast\n2018-01-01,20.5,70.5,4\n2018-07-01,20.5,70.5,6\n2019-01-01,20.0,70.5,3\n")
    wide = rs.pivot_years(files.read_forecast(spark, str(tmp_path / "f.csv")), ["lat", "lon"], "yr", "forecast", [2018, 2019])
    got = rs.assign_index(wide, ["lat", "lon"]).orderBy("idx").collect()
    assert [(r.idx, r.lat, r["2018"], r["2019"]) for r in got] == [(0, 20.0, None, 3.0), (1, 20.5, 5.0, None)]


def test_weather_files_skip_failed_calls(spark, tmp_path):
    good = {"site": 4, "daily": {"time": ["2018-01-01", "2018-01-02"], "rain_sum": [1.5, None]}}
    (tmp_path / "w.json").write_text(json.dumps([good, {}]))
    daily = T.StructType([T.StructField("time", T.ArrayType(T.StringType())), T.StructField("rain_sum", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([T.StructField("site", T.LongType()), T.StructField("daily", daily)])
    flat = rs.flatten_series(files.read_weather(spark, str(tmp_path / "w.json"), schema, one_array=True), "daily", ["site"])
    assert [(r.site, str(r.time)[:10], r.rain_sum) for r in flat.orderBy("time").collect()] == [(4, "2018-01-01", 1.5), (4, "2018-01-02", None)]


def test_one_large_array_is_read_in_splits(spark, tmp_path):
    """Braces, quotes and backslashes in strings, nested objects, long and empty records, cut at every few hundred bytes."""
    odd = ["plain", "}", "{{", '"', "\\", '\\"}', "a}b{c\"d", "\n}", "", '{"site": 9}', "ü}漢", "x" * 900 + "}" * 40, "[{]"]
    rows = [{"site": k, "note": odd[k % len(odd)], "deep": {"name}": odd[(k * 7) % len(odd)], "list": [{"v": k}, {"v": None}]}} for k in range(400)]
    rows[17] = rows[230] = {}
    for name, layout in (("a.json", {"indent": 2}), ("b.json", {"ensure_ascii": False}), ("c.json", {"separators": (",", ":")})):
        (tmp_path / name).write_text(json.dumps(rows, **layout), encoding="utf-8")
    (tmp_path / "d.json").write_text("[]\n")
    schema = "site bigint, note string, deep struct<`name}`: string, list: array<struct<v: bigint>>>"
    kind = T._parse_datatype_string(schema)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        for name in ("a.json", "b.json", "c.json"):
            got = files.read_weather(spark, str(tmp_path / name), kind, one_array=True).collect()
            want = spark.read.schema(kind).option("multiLine", True).json(str(tmp_path / name)).collect()
            assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 400
        records = files.array_records(spark, str(tmp_path))
        assert {r.file.rsplit("/", 1)[1]: r["count"] for r in records.groupBy("file").count().collect()} == {"a.json": 400, "b.json": 400, "c.json": 400}
        assert {json.dumps(json.loads(r.record)) for r in records.collect()} == {json.dumps(r) for r in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_small_statistics(spark):
    df = spark.createDataFrame([(n, float(v)) for n, v in enumerate([0, 1, 2, 2, 10])], "idx bigint, biomass double")
    bins = {r.bin: r.n for r in st.histogram(df, "biomass", 5).collect()}
    assert bins == {0: 2, 1: 2, 2: 0, 3: 0, 4: 1}
    flat = spark.createDataFrame([(1, 3.0), (2, 3.0)], "idx bigint, biomass double")
    assert {r.bin: r.n for r in st.histogram(flat, "biomass", 2).collect()} == {0: 2, 1: 0}
    assert [r.biomass for r in st.minmax(flat, ["biomass"]).collect()] == [None, None]
    blocks = st.balanced_blocks(df, 3)
    assert blocks.count() == 5 and {r.block for r in blocks.collect()} <= {0, 1, 2}
    sparse = spark.createDataFrame([(1, None), (2, None), (3, 1)], "a int, b int")
    assert fi.drop_sparse_columns(sparse).columns == ["a", "b"]
    assert fi.drop_sparse_columns(sparse, 0.7).columns == ["a"]
    sample = fi.even_sample(spark.range(101).withColumnRenamed("id", "idx"), 4)
    assert sorted(r.idx for r in sample.collect()) == [0, 33, 66, 100]
    lists = rs.adjacency(spark.createDataFrame([(0, j, 1.0) for j in range(10)], "i bigint, j bigint, d double"), block=4)
    assert {r.block: r.neighbours for r in lists.collect()} == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}


def test_costs_have_no_holes(spark):
    """A year without served plants, one with a forecast only, and a flow over an arc without a distance."""
    p = Params(years=(2018, 2019), depot_cap=20.0, refinery_cap=5.0)
    flows = spark.createDataFrame([
        (BIOMASS, 2018, 1, 2, 10.0), (BIOMASS, 2018, 3, 2, 2.0), (BIOMASS, 2019, 1, 9, 4.0), (FORECAST, 2020, 1, None, 5.0), (DEPOT, 20182019, 2, None, None),
    ], FLOWS)
    dist = spark.createDataFrame([(1, 2, 3.0)], "i long, j long, d double")
    under = {r.yr: r.underuse for r in au.underuse_cost(flows, p).collect()}
    assert under == {2018: 8.0, 2019: 20.0, 2020: 20.0}
    paid = {r.yr: (r.cost, r.unpriced) for r in au.transport_cost(flows, dist).collect()}
    assert paid == {2018: (30.0, 2.0), 2019: (0.0, 4.0)}
    none = spark.createDataFrame([], "idx long, yr int, biomass double")
    total = {r.yr: (round(r.cost, 6), r.unpriced) for r in au.total_cost(flows, dist, none, none, p).collect()}
    assert total == {2018: (8.03, 2.0), 2019: (20.0, 4.0), 2020: (20.0, 0.0)}


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "s.csv").write_text("data_type,value,destination_index,source_index,extra,year\nbiomass_forecast,2.5,,7,x,2018\n")
    assert [tuple(r) for r in files.read_submission(spark, str(tmp_path / "s.csv")).collect()] == [("biomass_forecast", 2018, 7, None, 2.5)]
    (tmp_path / "f.csv").write_text("Forecast,Longitude,Date,Latitude\n5.5,70.0,2018-01-01,20.0\n")
    row = files.read_forecast(spark, str(tmp_path / "f.csv")).first()
    assert (row.yr, row.lat, row.lon, row.forecast) == (2018, 20.0, 70.0, 5.5)
    (tmp_path / "bad.csv").write_text("Date,Latitude\n2018-01-01,20.0\n")
    with pytest.raises(ValueError, match="Longitude"):
        files.read_forecast(spark, str(tmp_path / "bad.csv"))


def test_matrix_labels_come_from_the_header(spark, tmp_path):
    (tmp_path / "d.csv").write_text(",40,7\n40,0.0,1.5\n7,,0.0\n")
    got = {(r.i, r.j): r.d for r in files.read_distances(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {(40, 40): 0.0, (40, 7): 1.5, (7, 40): None, (7, 7): 0.0}
    (tmp_path / "bad.csv").write_text(",40,7\n40,0.0,far\n")
    with pytest.raises(Exception, match="not a number"):
        files.read_distances(spark, str(tmp_path / "bad.csv")).collect()


@pytest.mark.parametrize("case", ["nothing", "location year", "one leg only", "same cell"])
def test_audit_from_the_tally_equals_the_checks(spark, case):
    """Also with rows of no value, without a destination, and plants declared twice under a wrong year."""
    odd = [(BIOMASS, 2018, 0, 5, None), (BIOMASS, 2018, 3, None, 1.0), (DEPOT, 2018, 5, None, None), (DEPOT, 2018, 5, None, None)]
    flows = spark.createDataFrame(BAD[case][0] + odd, FLOWS).coalesce(1)
    both = [sorted(map(str, df.withColumn("actual", F.round("actual", 9)).collect()))
            for df in (au.audit(flows, P), reduce(DataFrame.unionByName, [check(flows, P) for check in au.CHECKS]))]
    assert both[0] == both[1]


def test_tally_reads_flows_once(spark):
    plan = au.tally(spark.createDataFrame(GOOD, FLOWS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and plan.count("Expand") == 1
