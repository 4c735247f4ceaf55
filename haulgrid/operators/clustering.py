"""Site clusters: k-means on coordinates and average linkage on distances."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.functions.lineage import cut, forget, scratch_path
from haulgrid.functions.scale import BROADCAST_ROWS, lookup_join, running_total
from haulgrid.params import CLUSTER_RADIUS

# Distances are summed as whole numbers of this fraction, so sums do not depend on their order.
UNIT = 10_000
# Up to this many pairs (a few MB) a round of linkage runs in one task, which saves its shuffles; beyond, it is spread.
ONE_TASK = 200_000


def kmeans_sites(sites: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k-means labels on (lat, lon)."""
    points = VectorAssembler(inputCols=["lat", "lon"], outputCol="features").transform(sites)
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(points)
    return model.transform(points).select("idx", F.col("cluster").cast("bigint").alias("cluster"), "lat", "lon")


def _undirected(dist: DataFrame, symmetric: str) -> DataFrame:
    """Pairs a < b with their distance as a whole number; `symmetric` resolves the two directions."""
    if symmetric == "upper":
        pairs = dist.filter(F.col("i") < F.col("j")).select(F.col("i").alias("a"), F.col("j").alias("b"), "d")
    else:
        resolve = {"mean": F.avg, "max": F.max}[symmetric]
        both = dist.filter(F.col("i") != F.col("j"))
        pairs = both.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(resolve("d").alias("d"))
    whole = F.round(F.col("d") * UNIT).cast("bigint")
    one = F.lit(1).cast("bigint")
    return pairs.select("a", "b", whole.alias("s"), one.alias("n"), one.alias("size_a"), one.alias("size_b"))


def linkage_merges(dist: DataFrame, symmetric: str = "upper", radius: float | None = None) -> DataFrame:
    """Merge log (round, height, lo, hi) of average linkage; cluster `hi` joins `lo`, named by least member.

    Each round merges every pair of clusters that are each other's nearest at once; average linkage
    allows this without changing the tree (Murtagh 1983; Sumengen et al. 2021). With `radius` a pair of sites
    without an arc counts as that far apart, and longer arcs do as well: the linkage of min(d, radius), exact though only
    near pairs are stored, because the sizes of two clusters tell how many pairs are missing. Without, missing pairs do
    not count. Equal means are taken in a scrambled order of the pairs: in the order of their ids, a line of equally
    spaced sites would merge one pair per round. The log is one folder, to which every round adds.
    """
    spark = dist.sparkSession
    near = dist if radius is None else dist.withColumn("d", F.least("d", F.lit(float(radius))))
    pairs = cut(_undirected(near, symmetric), "pairs")
    # Merges of a round are at most half the sites.
    few = pairs.select(F.explode(F.array("a", "b"))).distinct().count() <= BROADCAST_ROWS
    log, rounds = scratch_path(spark, "merges"), 0
    while n_pairs := pairs.count():
        single = n_pairs <= ONE_TASK
        now = pairs.coalesce(1) if single else pairs
        all_pairs = F.col("size_a") * F.col("size_b")
        mean = F.col("s") / F.col("n") if radius is None else (F.col("s") + (all_pairs - F.col("n")) * round(radius * UNIT)) / all_pairs
        size = F.col("size_a") + F.col("size_b")
        ends = now.select(mean.alias("height"), "a", "b", size.alias("size"), F.explode(F.array("a", "b")).alias("end"))
        if few and not single:
            # The least of a struct is found by sorting, that of a number by hashing: only what has the least height of an end is sorted.
            least = ends.groupBy("end").agg(F.min("height").alias("least"))
            ends = ends.join(F.broadcast(least), "end").filter(F.col("height") <= F.col("least"))
        chosen = ends.groupBy("end").agg(F.min(F.struct("height", F.xxhash64("a", "b"), "a", "b", "size")).alias("m"))
        merges = chosen.groupBy("m").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") == 2)
        merges = merges.select(F.lit(rounds).alias("round"), F.col("m.height") / UNIT, F.col("m.a").alias("lo"), F.col("m.b").alias("hi"), F.col("m.size").alias("size"))
        merges.toDF("round", "height", "lo", "hi", "size").write.parquet(f"{log}/round={rounds}-")
        done = spark.read.schema("round int, height double, lo bigint, hi bigint, size bigint").parquet(f"{log}/round={rounds}-")
        done = done.coalesce(1) if single else done
        rounds += 1
        moved = done.select(F.explode(F.array("lo", "hi")).alias("node"), F.col("lo").alias("into"), F.col("size").alias("grown"))
        renamed = now
        for end in ("a", "b"):
            into = moved.withColumnRenamed("node", end)
            renamed = renamed.join(into.hint("merge") if single else F.broadcast(into) if few else into, end, "left")
            renamed = renamed.withColumns({end: F.coalesce("into", end), f"size_{end}": F.coalesce("grown", f"size_{end}")}).drop("into", "grown")
        turned = F.col("a") > F.col("b")
        before = pairs
        pairs = cut(
            renamed.filter(F.col("a") != F.col("b"))
            .withColumns({"size_a": F.when(turned, F.col("size_b")).otherwise(F.col("size_a")), "size_b": F.when(turned, F.col("size_a")).otherwise(F.col("size_b"))})
            .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b")),
            "pairs",
        )
        forget(before)
    if not rounds:
        return spark.createDataFrame([], "round int, height double, lo bigint, hi bigint")
    return spark.read.parquet(*[f"{log}/round={k}-" for k in range(rounds)]).select("round", "height", "lo", "hi")


def cut_tree(ids: DataFrame, merges: DataFrame, n_clusters: int) -> DataFrame:
    """Labels after the ids - n_clusters lowest merges; a cluster is named by its least member.

    Of equally high merges the one of the earlier round comes first, so no merge precedes its parts. Clusters that no
    merge connects are all equally far apart: the first of them by name join until `n_clusters` are left.
    """
    order = [F.col("height"), F.col("round"), F.col("lo"), F.col("hi")]
    ranked = running_total(merges, F.lit(1).cast("bigint"), order, out="rank")
    keep, known = ids.count() - n_clusters, merges.count()
    parent = ranked.filter(F.col("rank") <= keep).select(F.col("hi").alias("idx"), F.col("lo").alias("cluster"))
    labels = cut(
        ids.select("idx").join(parent, "idx", "left").withColumn("cluster", F.coalesce("cluster", "idx")), "labels"
    )
    # Follow the pointers two at a time until none moves.
    while True:
        nxt = labels.select(F.col("idx").alias("cluster"), F.col("cluster").alias("next"))
        jumped = cut(
            labels.join(nxt, "cluster").select("idx", F.col("next").alias("cluster"), (F.col("next") != F.col("cluster")).alias("moved")),
            "labels",
        )
        labels = jumped.select("idx", "cluster")
        if jumped.filter("moved").isEmpty():
            break
    if keep <= known:
        return labels
    roots = running_total(labels.select("cluster").distinct(), F.lit(1).cast("bigint"), [F.col("cluster")], out="rank")
    joined = roots.filter(F.col("rank") <= keep - known + 1).select("cluster")
    least = joined.agg(F.min("cluster")).first()[0]
    return lookup_join(labels, roots.withColumn("into", F.when(F.col("rank") <= keep - known + 1, F.lit(least)).otherwise(F.col("cluster"))).select("cluster", "into"), ["cluster"]).select("idx", F.col("into").alias("cluster"))


def average_linkage(dist: DataFrame, n_clusters: int, symmetric: str = "upper", radius: float | None = None) -> DataFrame:
    """Labels (idx, cluster) of average linkage on precomputed distances, cut at `n_clusters`.

    `radius` is the distance that pairs without an arc have (see `linkage_merges`): give it where `dist` is cut.
    """
    ids = cut(dist.select(F.explode(F.array("i", "j")).alias("idx")).distinct(), "ids")
    return cut_tree(ids, linkage_merges(dist, symmetric, radius), n_clusters)


def _inner_arcs(dist: DataFrame, labels: DataFrame) -> DataFrame:
    """Arcs with both ends in one cluster. Each arc meets at most one label per end."""
    ends, stored = dist, cut(labels.select("idx", "cluster"), "labels")
    for side in ("i", "j"):
        own = stored.select(F.col("idx").alias(side), F.col("cluster").alias(f"c_{side}"))
        ends = lookup_join(ends, own, [side], stored=True)
    same = ends.filter(F.col("c_i") == F.col("c_j"))
    return same.select(F.col("c_i").alias("cluster"), "i", "j", "d")


def intra_max(dist: DataFrame, labels: DataFrame) -> DataFrame:
    return _inner_arcs(dist, labels).groupBy("cluster").agg(F.max("d").alias("max_inner"))


def cluster_arcs(dist: DataFrame, labels: DataFrame, quota: DataFrame, max_d: float = CLUSTER_RADIUS) -> DataFrame:
    """All subproblems in one table: arcs up to `max_d` inside the clusters that have a non-zero quota."""
    served = quota.filter(F.col("quota") > 0).select("cluster")
    return _inner_arcs(dist.filter(F.col("d") <= max_d), labels).join(served, "cluster", "left_semi")
