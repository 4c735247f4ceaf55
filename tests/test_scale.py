"""Running sums, split joins and quantiles against the plain forms, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from haulgrid.functions import lineage
from haulgrid.functions.scale import column_quantiles, quantiles, running_total, split_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 6), n, rng.randrange(10), rng.randrange(100)) for n in range(3000)]
    return spark.createDataFrame(rows, "k bigint, id bigint, o bigint, v bigint")


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_total_equals_window(skewed, keys):
    got = running_total(skewed, F.col("v"), [F.desc("o"), F.col("id")], keys=keys)
    plain = Window.partitionBy(*keys).orderBy(F.desc("o"), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("running", F.sum("v").over(plain)).withColumn("before", F.col("running") - F.col("v"))
    cols = ["k", "id", "running", "before"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_split_join_equals_join(spark, skewed):
    left = skewed.filter("id < 600").select("k", F.col("id").alias("a"))
    right = skewed.filter("id >= 2700").select("k", F.col("id").alias("b"))
    got = split_join(left, right, ["k"], block=10)
    assert sorted(got.select("k", "a", "b").collect()) == sorted(left.join(right, "k").select("k", "a", "b").collect())


def test_split_join_spreads_a_hot_key(spark, skewed):
    left = skewed.select("k", F.col("id").alias("a"))
    right = skewed.filter("id < 50").select("k", F.col("id").alias("b"))
    plan = split_join(left, right, ["k"], block=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "_lblock" in plan and "_rblock" in plan


def test_quantiles_equal_numpy(skewed):
    values = [r.v for r in skewed.select("v").collect()]
    got = {r.prob: r.value for r in quantiles(skewed, "v", [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]).collect()}
    for prob, value in got.items():
        assert value == pytest.approx(np.quantile(values, prob))
    assert len(got) == 6


def _many_columns():
    rng = np.random.default_rng(5)
    n = 3000
    return {
        "even": rng.random(n), "wide": rng.choice([-1.0, 1.0], n) * 10.0 ** rng.integers(-300, 300, n), "copies": rng.integers(0, 3, n) * 1.5,
        "one": np.full(n, 7.25), "near": 1.0 + np.arange(n) * 2.0**-52, "hot": np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)),
        "ends": np.where(rng.random(n) < 0.1, np.inf, np.where(rng.random(n) < 0.1, -np.inf, rng.normal(size=n))),
    }


@pytest.mark.parametrize("bins, settle", [(1 << 14, 200_000), (4, 3)])
def test_quantiles_of_many_columns_equal_numpy(spark, bins, settle):
    cols = _many_columns()
    rows = [tuple(float(x) for x in row) + (None,) for row in zip(*cols.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", none double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = column_quantiles(df, [*cols, "none"], probs, bins, settle)
    for c, values in cols.items():
        ordered = np.sort(values)
        for p in probs:
            low, high = ordered[int(np.floor(p * 2999))], ordered[int(np.ceil(p * 2999))]
            want = low if low == high else low + (high - low) * (p * 2999 - np.floor(p * 2999))
            assert got[c][p] == want, (c, p)
    assert got["none"] == dict.fromkeys(probs)
    assert column_quantiles(df.limit(0), ["even"], [0.5]) == {"even": {0.5: None}}


def test_quantiles_take_the_same_passes_for_many_columns(spark):
    """Jobs do not grow with the number of columns."""
    df = spark.range(5000).select(*[((F.col("id") * (k + 3)) % 4999 / 7).alias(f"c{k}") for k in range(30)])
    groups = []
    for cols in (df.columns[:1], df.columns):
        spark.sparkContext.setJobGroup(f"quantiles-{len(cols)}", "")
        got = column_quantiles(df, cols, [0.25, 0.5, 0.75])
        groups.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"quantiles-{len(cols)}")))
        assert len(got) == len(cols)
    assert groups[1] <= groups[0] + 2


def test_cut_uses_the_session_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    cut = lineage.cut(spark.range(5))
    assert all(folder in f for f in cut.inputFiles())
    assert cut.count() == 5


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "yarn"
        applicationId = "app"

        @staticmethod
        def getCheckpointDir():
            return None

    class Conf:
        @staticmethod
        def get(key, default=None):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session)
