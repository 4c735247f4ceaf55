"""Spatial operators against brute force, on crowded and coincident points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulgrid.operators import filters as fi
from haulgrid.operators import neighbours as nb
from haulgrid.plans import bindings as b


def _points(seed, n):
    """A third of the points crowd in one spot, some coincide, the rest spread out."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if k % 3 == 0:
            out.append((k, 1 + rng.random() * 1e-4, 2 + rng.random() * 1e-4))
        elif k % 3 == 1 and out:
            out.append((k, *out[rng.randrange(len(out))][1:]))
        else:
            out.append((k, rng.uniform(-5, 5), rng.uniform(-5, 5)))
    return out


def _brute(points, sites, other_only=False):
    xy = np.array([s[1:] for s in sites])
    out = {}
    for p in points:
        d = np.sqrt((p[1] - xy[:, 0]) ** 2 + (p[2] - xy[:, 1]) ** 2)
        if other_only:
            d = np.where(d == 0, np.inf, d)
        best = int(d.argmin())
        out[p[0]] = (sites[best][0], d[best])
    return out


def test_nearest_cell(spark):
    sites, points = _points(1, 900), _points(2, 400) + [(900, 60.0, -40.0)]
    got = nb.nearest_cell(
        spark.createDataFrame(points, "p bigint, lat double, lon double"), spark.createDataFrame(sites, "idx bigint, lat double, lon double")
    ).collect()
    want = _brute(points, sites)
    assert len(got) == len(points)
    for r in got:
        assert (r.idx, r.d) == (want[r.p][0], pytest.approx(want[r.p][1], abs=1e-12))


def test_neighbour_spacing_skips_coincident_sites(spark):
    sites = _points(5, 700)
    got = nb.neighbour_spacing(spark.createDataFrame(sites, "idx bigint, lat double, lon double"), 0.01).collect()
    want = _brute(sites, sites, other_only=True)
    assert len(got) == len(sites)
    for r in got:
        assert r.spacing == pytest.approx(want[r.idx][1], abs=1e-12)
        assert r.flagged == (r.spacing > 0.01)


@pytest.mark.parametrize("r", [0.3, 2.0])
def test_radius_edges(spark, r):
    sites = _points(7, 240)
    df = spark.createDataFrame(sites, "idx bigint, lat double, lon double")
    want = {(p[0], q[0]) for p in sites for q in sites if np.hypot(p[1] - q[1], p[2] - q[2]) <= r}
    assert {(e.i, e.j) for e in nb.radius_edges(df, r).collect()} == want
    some = nb.radius_edges(df, r, df.filter("idx < 20"))
    assert {(e.i, e.j) for e in some.collect()} == {e for e in want if e[0] < 20}


def test_k_nearest_excludes_self_by_key(spark):
    dist = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (0, 2, 5.0), (1, 0, 0.0), (1, 1, 0.0), (1, 2, 3.0)], "i bigint, j bigint, d double")
    got = {(r.i, r.rank): r.j for r in nb.k_nearest(dist, 2).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2}


def test_curve_meets_the_single_sums(spark, sf):
    arcs, year = b.arcs(spark, sf, 50.0), b.history(spark, sf).filter("yr = 2000").select("idx", "biomass")
    curve = nb.catchment_curve(arcs, year)
    full = nb.catchment_sum(arcs, year, 50.0)
    off = curve.filter("point = 19").join(full.withColumnRenamed("biomass", "b"), "center").filter("biomass <> b")
    assert off.isEmpty()
    assert curve.groupBy("center").count().filter("count <> 20").isEmpty()


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, sf, matrix):
    top = _plan(nb.k_nearest(matrix, 3))
    assert "WindowGroupLimit" in top
    semi = _plan(fi.arcs_to_open(matrix, spark.range(3).withColumnRenamed("id", "idx")))
    assert "BroadcastHashJoin" in semi and "LeftSemi" in semi
    year = b.history(spark, sf).filter("yr = 2000").select("idx", "biomass")
    assert "LessThanOrEqual(d,18.0)" in _plan(nb.catchment_sum(matrix, year, 18.0))
    assert "CartesianProduct" not in _plan(b.arcs(spark, sf)) and "NestedLoop" not in _plan(b.arcs(spark, sf))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp" in _plan(b.history(spark, sf)).replace("_ntz", "")


def test_spacing_of_the_grid(spark, sf):
    row = nb.spacing_counts(nb.neighbour_spacing(b.sites(spark, sf)), 5).filter("not flagged").agg(F.sum("n")).first()
    assert row[0] == 100


def test_farthest_inside_equals_all_pairs(spark):
    rng = random.Random(12)
    spots = []
    for k in range(900):
        c = k % 4
        spots.append((k, c, rng.gauss(0, 1) if c else rng.random() * 1e-3, rng.gauss(5 * c, 0.2) if c < 3 else 7.0))
    spots.append((900, 9, 1.0, 1.0))
    rows = spark.createDataFrame(spots, "idx long, cluster long, lat double, lon double")

    def travel(d):
        return 100 * d + (F.col("i") * 7 + F.col("j") * 13) % 5

    got = {r.cluster: r.max_inner for r in nb.farthest_inside(rows.select("idx", "lat", "lon"), rows.select("idx", "cluster"), travel, 100.0, 4.0).collect()}
    for c in (0, 1, 2, 3):
        own = [s for s in spots if s[1] == c]
        want = max(100 * math.hypot(a[2] - b[2], a[3] - b[3]) + (a[0] * 7 + b[0] * 13) % 5 for a in own for b in own)
        assert got[c] == pytest.approx(want, abs=1e-9)
    assert got[9] == (900 * 20) % 5


@pytest.mark.parametrize("depth", [2, 3])
def test_farthest_inside_of_narrow_and_diagonal_clusters(spark, depth):
    """Pairs of cells whose children stand in the other order than they do."""
    rng = random.Random(depth)
    spots = [(-1, rng.uniform(0, 16), rng.uniform(0, 16)) for _ in range(900)] + [(-1, 0.0, 0.0), (-1, 16.0, 16.0)]
    spots += [(-1, 9.05 + rng.uniform(0, 0.9), 9.05 + rng.uniform(0, 0.9)) for _ in range(60 if depth == 3 else 0)]
    spots += [(0, 0.95, 0.05), (0, 0.05, 3.95)] + [(0, 0.5 + rng.uniform(-0.02, 0.02), rng.uniform(1.5, 2.5)) for _ in range(12)]
    for c in range(1, 41):
        x, y, turned = rng.uniform(0, 12), rng.uniform(0, 12), c % 3
        for _ in range(4):
            a, b = rng.uniform(0, 4), rng.uniform(0, 0.9)
            spots.append((c, *((x + b, y + a) if turned == 0 else (x + a, y + b) if turned == 1 else (x + a, y + 4 - a + b / 9))))
    rows = spark.createDataFrame([(k, *s) for k, s in enumerate(spots)], "idx long, cluster long, lat double, lon double")
    sites, labels = rows.select("idx", "lat", "lon"), rows.select("idx", "cluster")
    assert nb._with_cells(sites)[1] >= 2
    got = {r.cluster: r.max_inner for r in nb.farthest_inside(sites, labels).collect()}
    want = {c: max(math.hypot(p[1] - q[1], p[2] - q[2]) for p in own for q in own) for c in range(-1, 41) for own in [[s for s in spots if s[0] == c]]}
    assert got == pytest.approx(want, abs=1e-9)


def _fullest(celled):
    return celled.groupBy("cx", "cy").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("shape", ["spot and outlier", "nested spots", "line", "one latitude"])
def test_no_cell_holds_more_than_a_leaf(spark, shape):
    rng = random.Random(11)
    n = 4000
    if shape == "spot and outlier":
        spots = [(rng.random() * 1e-9, rng.random() * 1e-9) for _ in range(n - 1)] + [(80.0, 170.0)]
    elif shape == "nested spots":
        spots = [(rng.random() * 10.0 ** -(k % 12), rng.random() * 10.0 ** -(k % 12)) for k in range(n)]
    elif shape == "line":
        spots = [(k * 1e-3, k * 1e-3) for k in range(n)]
    else:
        spots = [(5.0, k * 1e-3) for k in range(n)]
    sites = spark.createDataFrame([(k, *s) for k, s in enumerate(spots)], "idx bigint, lat double, lon double")
    celled, depth = nb._with_cells(sites)
    assert celled.count() == n and _fullest(celled) <= nb.LEAF
    assert celled.agg(F.max("cx"), F.max("cy"), F.min("cx"), F.min("cy")).first()[:2] < (4**depth, 4**depth)
    if shape != "line":
        assert depth <= 4


def test_a_million_sites_in_one_spot_and_one_outlier(spark):
    spot = spark.range(1_000_000).select(F.col("id").alias("idx"), (F.rand(3) * 1e-6).alias("lat"), (F.rand(4) * 1e-6).alias("lon"))
    celled, depth = nb._with_cells(spot.union(spark.createDataFrame([(1_000_000, 80.0, 170.0)])))
    assert _fullest(celled) <= nb.LEAF and depth <= 5


def test_nearest_cell_with_an_outlier(spark):
    rng = random.Random(12)
    sites = [(k, rng.random() * 1e-9, rng.random() * 1e-9) for k in range(1500)] + [(1500, 80.0, 170.0)]
    points = [(k, rng.random() * 2e-9, rng.random() * 2e-9) for k in range(200)] + [(200, 79.0, 1.0), (201, 81.0, 171.0)]
    got = nb.nearest_cell(
        spark.createDataFrame(points, "p bigint, lat double, lon double"), spark.createDataFrame(sites, "idx bigint, lat double, lon double")
    ).collect()
    want = _brute(points, sites)
    assert {r.p: pytest.approx(want[r.p][1], abs=1e-12) for r in got} == {r.p: r.d for r in got} and len(got) == len(points)


def test_no_sites(spark):
    none = spark.createDataFrame([], "idx bigint, lat double, lon double")
    assert nb.neighbour_spacing(none).count() == 0
    assert nb.nearest_cell(spark.createDataFrame([(1, 2.0, 3.0)], "p bigint, lat double, lon double"), none).count() == 0


def test_arcs_to_few(spark):
    sites = spark.createDataFrame([(k, float(k % 7), float(k // 7)) for k in range(50)], "idx long, lat double, lon double")
    ends = spark.createDataFrame([(3,), (9,), (9,), (41,)], "idx long")
    got = {(r.i, r.j): r.d for r in nb.arcs_to_few(sites, ends, block=2).collect()}
    assert got == {(i, j): math.hypot(i % 7 - j % 7, i // 7 - j // 7) for i in range(50) for j in (3, 9, 41)}
    assert nb.arcs_to_few(sites, ends.limit(0)).count() == 0


def test_a_gazetteer_with_a_name_twice(spark):
    estates = spark.createDataFrame([(1, "A", "x"), (2, "B", "x")], "no int, estate string, district string")
    known = spark.createDataFrame([("a", "X", 1.0, 2.0), (" A ", "x", 3.0, 4.0)], "estate string, district string, lat double, lon double")
    assert [(r.no, r.lat) for r in nb.gazetteer_lookup(estates, known).orderBy("no").collect()] == [(1, 3.0), (2, None)]
