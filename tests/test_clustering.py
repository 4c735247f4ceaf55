"""Average linkage against a sequential brute force; k-means centres."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulgrid.operators import clustering as cl
from haulgrid.plans import bindings as b


def _sequential(d):
    """Merge the closest pair of clusters until one is left, by mean member distance."""
    groups = {k: [k] for k in range(len(d))}
    merges = []
    while len(groups) > 1:
        keys = sorted(groups)
        mean, lo, hi = min(
            (np.mean([d[x][y] for x in groups[p] for y in groups[q]]), p, q) for n, p in enumerate(keys) for q in keys[n + 1:]
        )
        groups[lo] = groups[lo] + groups.pop(hi)
        merges.append((mean, lo, hi, frozenset(groups[lo])))
    return merges


def _labels_after(merges, n, k):
    label = list(range(n))
    for _, lo, hi, _ in merges[: n - k]:
        label = [lo if x == hi else x for x in label]
    return label


@pytest.fixture(scope="module")
def instance(spark):
    rng = random.Random(11)
    xy = np.array([(rng.random(), rng.random()) for _ in range(40)])
    d = np.round(100 * np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), 4)
    dist = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(40) for j in range(40)], "i bigint, j bigint, d double")
    return d, dist, cl.cut(cl.linkage_merges(dist), "log")


def test_same_tree(instance):
    d, _, log = instance
    want = _sequential(d)
    got = sorted((r.height, r.lo, r.hi) for r in log.collect())
    assert [(lo, hi) for _, lo, hi in got] == [(lo, hi) for _, lo, hi, _ in want]
    assert [h for h, _, _ in got] == pytest.approx([m[0] for m in want], abs=1e-6)


@pytest.mark.parametrize("k", [1, 3, 5, 25, 40])
def test_same_cuts(spark, instance, k):
    d, _, log = instance
    ids = spark.range(40).withColumnRenamed("id", "idx")
    got = {r.idx: r.cluster for r in cl.cut_tree(ids, log, k).collect()}
    assert [got[n] for n in range(40)] == _labels_after(_sequential(d), 40, k)


def test_rounds_of_few_pairs_shuffle_nothing_and_spread_ones_merge_the_same(spark, instance, monkeypatch):
    d, dist, log = instance
    plans, write = [], cl.cut

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(cl, "cut", seen)
    cl.linkage_merges(dist)
    assert len(plans) > 2 and not any("Exchange" in plan for plan in plans[1:])
    monkeypatch.setattr(cl, "ONE_TASK", 0)
    assert sorted(cl.linkage_merges(dist).collect()) == sorted(log.collect())


def test_equal_distances_take_few_rounds(spark):
    """A line of equally spaced sites, each knowing its neighbours only."""
    line = spark.range(256).selectExpr("id as i", "id + 1 as j", "1e0 as d").filter("j < 256")
    log = cl.linkage_merges(line)
    assert log.count() == 255 and log.agg(F.max("round")).first()[0] < 24


@pytest.mark.parametrize("how", ["mean", "max"])
def test_asymmetric_input(spark, how):
    dist = spark.createDataFrame([(0, 1, 2.0), (1, 0, 4.0), (0, 2, 9.0), (2, 0, 9.0), (1, 2, 8.0), (2, 1, 8.0)], "i bigint, j bigint, d double")
    first = cl.linkage_merges(dist, how).orderBy("height").first()
    assert (first.lo, first.hi, first.height) == (0, 1, {"mean": 3.0, "max": 4.0}[how])


def test_kmeans_is_stable_and_local(spark, sf):
    one, two = (cl.kmeans_sites(b.sites(spark, sf), 4, seed=0) for _ in range(2))
    assert sorted(one.collect()) == sorted(two.collect())
    centers = one.groupBy("cluster").agg(F.avg("lat").alias("clat"), F.avg("lon").alias("clon")).collect()
    assert len(centers) == 4
    for r in one.collect():
        near = min(centers, key=lambda c: (c.clat - r.lat) ** 2 + (c.clon - r.lon) ** 2)
        own = next(c for c in centers if c.cluster == r.cluster)
        gap = lambda c: (c.clat - r.lat) ** 2 + (c.clon - r.lon) ** 2
        assert gap(own) <= gap(near) + 1e-6


def test_linkage_of_arcs_cut_at_a_radius(instance):
    """Exact average linkage on min(d, radius), though only arcs up to the radius are given."""
    d, dist, _ = instance
    radius = 30.0
    want = _sequential(np.minimum(d, radius))
    log = cl.cut(cl.linkage_merges(dist.filter(F.col("d") <= radius), radius=radius), "log")
    got = sorted((r.height, r.lo, r.hi) for r in log.collect())
    below = [m for m in want if m[0] < radius - 1e-9]
    assert [(lo, hi) for _, lo, hi in got[: len(below)]] == [(lo, hi) for _, lo, hi, _ in below]
    assert [h for h, _, _ in got[: len(below)]] == pytest.approx([m[0] for m in below], abs=1e-6)


def test_unconnected_parts_reach_the_number_of_clusters(spark):
    arcs = [(a, b, 1.0) for k in (0, 10, 20, 30) for a in range(k, k + 3) for b in range(k, k + 3)]
    dist = spark.createDataFrame(arcs, "i bigint, j bigint, d double")
    for n in (1, 2, 4, 6):
        got = {r.idx: r.cluster for r in cl.average_linkage(dist, n, radius=5.0).collect()}
        assert len(got) == 12 and len(set(got.values())) == n
        assert all(c == min(i for i in got if got[i] == c) for c in got.values())
