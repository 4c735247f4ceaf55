"""Neighbour, range and catchment queries over coordinates and distance edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.functions.keys import degree_distance
from haulgrid.functions.lineage import cut
from haulgrid.functions.scale import key_counts, lookup_join, running_total, split_join
from haulgrid.params import CURVE_POINTS, CURVE_RADIUS, SPACING_FLAG

# Nearest-location descent: 4 x 4 children per cell, at most this many locations in a last cell.
LEAF = 32
# Levels with at most 16 ** 4 = 65,536 cells are broadcast, deeper ones are shuffled.
BROADCAST_LEVELS = 4


def _with_cells(locations: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """Add the last cell (`cx`, `cy`) of each location, store the table, and return it with the number of levels.

    Cells split the ranks of the locations by latitude and by longitude, four by four a level, so every row and every column
    of cells holds an equal share however the locations crowd. A cell of level k lies in a row that holds n / 4**k of n
    locations: no cell has more than `leaf` once 4**k >= n / leaf, and the depth is the least that meets it.
    """
    ranked = running_total(locations, F.lit(1), [F.col("lat"), F.col("lon"), F.col("idx")], out="_to", before="cx")
    ranked = running_total(ranked.drop("_to"), F.lit(1), [F.col("lon"), F.col("lat"), F.col("idx")], out="_to", before="cy")
    ranked = cut(ranked.drop("_to"), "ranked")
    n = ranked.count()
    finest = 1
    while leaf * 4**finest < n:
        finest += 1

    def cell(rank: str, levels: int) -> Column:
        return F.floor(F.col(rank) * F.lit(4**levels).cast("bigint") / F.lit(max(n, 1))).cast("bigint").alias(rank)

    depth = finest
    if finest > 1:
        full = ranked.groupBy(cell("cx", finest), cell("cy", finest)).count()
        level = full.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(finest))))
        up = (2 * (finest - F.col("level"))).cast("int")
        shifted = [F.call_function("shiftright", F.col(c), up).alias(c) for c in ("cx", "cy")]
        sums = level.groupBy("level", *shifted).agg(F.sum("count").alias("n"))
        fullest = sums.groupBy("level").agg(F.max("n").alias("n")).filter(F.col("n") <= leaf)
        depth = fullest.agg(F.min("level")).first()[0] or finest
    celled = ranked.withColumns({c: F.shiftright(cell(c, finest), 2 * (finest - depth)) for c in ("cx", "cy")})
    return cut(celled, "celled"), depth


def _box_distance(near: bool) -> Column:
    """Least or greatest distance from the point (`plat`, `plon`) to a cell's bounding box."""
    axes = []
    for p, lo, hi in (("plat", "lat_lo", "lat_hi"), ("plon", "lon_lo", "lon_hi")):
        below, above = F.col(lo) - F.col(p), F.col(p) - F.col(hi)
        if near:
            axes.append(F.greatest(below, above, F.lit(0.0)))
        else:
            axes.append(F.greatest(F.abs(below), F.abs(above)))
    return F.sqrt(axes[0] * axes[0] + axes[1] * axes[1])


def nearest_location(points: DataFrame, locations: DataFrame, other_only: bool = False) -> DataFrame:
    """Nearest location (`idx`, `d`) of every distinct point (`plat`, `plon`); least idx wins ties.

    `locations(idx, lat, lon)` must have distinct coordinates. All points descend the cells together,
    four by four per level: a cell survives for a point if it can hold something at least as
    near as the nearest cell is certain to. The candidates per point stay few wherever the locations
    crowd. With `other_only` a location equal to the point does not count.
    """
    celled, depth = _with_cells(locations)
    found = points
    for level in range(1, depth + 1):
        shift = 2 * (depth - level)
        cells = celled.groupBy(
            F.shiftright("cx", shift).alias("kx"), F.shiftright("cy", shift).alias("ky")
        ).agg(
            F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"),
            F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"), F.count(F.lit(1)).alias("n"),
        )
        if level == 1:
            # At most 16 cells, as one array.
            first = cells.agg(F.collect_list(F.struct(*cells.columns))).scalar()
            step = found.select("plat", "plon", F.inline(first))
        else:
            cells = cells.withColumn("cx", F.shiftright("kx", 2)).withColumn("cy", F.shiftright("ky", 2))
            step = found.join(F.broadcast(cells) if level <= BROADCAST_LEVELS else cells, ["cx", "cy"])
        if other_only:
            inside = F.col("plat").between(F.col("lat_lo"), F.col("lat_hi")) & F.col("plon").between(
                F.col("lon_lo"), F.col("lon_hi")
            )
            certain = F.when(inside & (F.col("n") < 2), F.lit(None)).otherwise(_box_distance(near=False))
        else:
            certain = _box_distance(near=False)
        step = step.withColumn("far", F.min(certain).over(Window.partitionBy("plat", "plon")))
        reach = F.coalesce(F.col("far") * (1 + 1e-12) + 1e-12, F.lit(float("inf")))
        found = step.filter(_box_distance(near=True) <= reach).select(
            "plat", "plon", F.col("kx").alias("cx"), F.col("ky").alias("cy")
        )
    d = degree_distance(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    pairs = found.join(celled, ["cx", "cy"]).withColumn("d", d)
    if other_only:
        pairs = pairs.filter((F.col("lat") != F.col("plat")) | (F.col("lon") != F.col("plon")))
    best = pairs.groupBy("plat", "plon").agg(F.min(F.struct("d", "idx")).alias("best"))
    return best.select("plat", "plon", "best.idx", "best.d")


def farthest_inside(
    sites: DataFrame, labels: DataFrame, travel: Callable[[Column], Column] | None = None, scale: float = 1.0, extra: float = 0.0
) -> DataFrame:
    """Largest distance between two sites of a cluster, exact and without all pairs: `cluster, max_inner`.

    `travel` makes the distance of an arc from the straight line `d` of (`i`, `j`), at least `scale` times it and at most
    `extra` more, so a measure that differs by direction works as well. All clusters descend a grid together, in pairs of
    cells: a pair is kept only if it can hold something at least as far apart as some pair of sites of the cluster is certain to
    be. A bounding box touches a site on every side, which makes the certain distances.
    """
    placed = sites.join(labels.select("idx", "cluster"), "idx")
    celled, depth = _with_cells(placed.select("cluster", "idx", "lat", "lon"))
    pairs = None
    for level in range(1, depth + 1):
        shift = 2 * (depth - level)
        cells = celled.groupBy("cluster", F.shiftright("cx", shift).alias("x"), F.shiftright("cy", shift).alias("y")).agg(
            F.min("lat").alias("n"), F.max("lat").alias("s"), F.min("lon").alias("w"), F.max("lon").alias("e")
        )

        def side(name: str) -> DataFrame:
            kept = cells.select("cluster", *[F.col(c).alias(f"{c}_{name}") for c in ("x", "y", "n", "s", "w", "e")])
            return kept.withColumns({f"px_{name}": F.shiftright(f"x_{name}", 2), f"py_{name}": F.shiftright(f"y_{name}", 2)})

        if pairs is None:
            pairs = side("a").join(side("b"), "cluster")
        else:
            pairs = pairs.join(side("a"), ["cluster", "px_a", "py_a"]).join(side("b"), ["cluster", "px_b", "py_b"])
        # Of two children of one cell either order would come; children of different cells come in one order alone.
        apart = (F.col("px_a") != F.col("px_b")) | (F.col("py_a") != F.col("py_b"))
        pairs = pairs.filter(apart | (F.struct("x_a", "y_a") <= F.struct("x_b", "y_b")))
        lat = F.greatest(F.abs(F.col("s_a") - F.col("n_b")), F.abs(F.col("s_b") - F.col("n_a")))
        lon = F.greatest(F.abs(F.col("e_a") - F.col("w_b")), F.abs(F.col("e_b") - F.col("w_a")))
        bounded = pairs.withColumn("most", F.sqrt(lat * lat + lon * lon) * scale + extra).withColumn("least", F.greatest(lat, lon) * scale)
        bounded = cut(bounded, "cell-pairs")
        certain = bounded.groupBy("cluster").agg(F.max("least").alias("certain"))
        kept = bounded.join(certain, "cluster").filter(F.col("most") * (1 + 1e-12) + 1e-12 >= F.col("certain"))
        pairs = kept.select("cluster", *[F.col(f"{c}_{side_}").alias(f"p{c}_{side_}") for side_ in ("a", "b") for c in ("x", "y")])
    ends = [celled.select("cluster", F.col("cx").alias(f"px_{n}"), F.col("cy").alias(f"py_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in ("idx", "lat", "lon")]) for n in ("a", "b")]
    met = pairs.join(ends[0], ["cluster", "px_a", "py_a"]).join(ends[1], ["cluster", "px_b", "py_b"])
    straight = degree_distance(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    both = [met.select("cluster", F.col(f"idx_{i}").alias("i"), F.col(f"idx_{j}").alias("j"), straight.alias("d")) for i, j in (("a", "b"), ("b", "a"))]
    arcs = both[0].unionByName(both[1])
    far = F.col("d") if travel is None else travel(F.col("d"))
    return arcs.groupBy("cluster").agg(F.max(far).alias("max_inner"))


def arcs_to_few(sites: DataFrame, ends: DataFrame, block: int = 1_000) -> DataFrame:
    """All (i, j, d) from every site to each of a few `ends(idx)`, d in degrees: as many rows as the result needs.

    The ends travel in arrays of at most `block` places, one per row of a small table.
    """
    places = sites.join(ends.select("idx").distinct(), "idx", "left_semi")
    numbered = running_total(places, F.lit(1), [F.col("idx")], out="_n").withColumn("_block", F.floor((F.col("_n") - 1) / block))
    place = F.struct(F.col("idx").alias("j"), F.col("lat").alias("lat_j"), F.col("lon").alias("lon_j"))
    blocks = cut(numbered.groupBy("_block").agg(F.collect_list(place).alias("_ends")), "ends")
    last = blocks.agg(F.max("_block")).first()[0]
    starts = sites.select(F.col("idx").alias("i"), F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(last if last is not None else 0).cast("bigint"))
    starts = starts.withColumn("_block", F.explode(numbers))
    met = lookup_join(starts, blocks, ["_block"], stored=True, weight=F.size("_ends")).select("i", "lat_i", "lon_i", F.inline("_ends"))
    return met.select("i", "j", degree_distance(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j")).alias("d"))


def _locations(df: DataFrame) -> DataFrame:
    known = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return known.groupBy("lat", "lon").agg(F.min("idx").alias("idx")).select("idx", "lat", "lon")


def nearest_cell(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Map each row of `points(lat, lon, …)` to its nearest site (`idx`, `d`), in degrees.

    Copies of a coordinate are looked up once.
    """
    where = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    where = where.select(F.col("lat").alias("plat"), F.col("lon").alias("plon")).distinct()
    nearest = nearest_location(where, _locations(sites))
    return points.join(
        nearest, (points["lat"] == nearest["plat"]) & (points["lon"] == nearest["plon"])
    ).select(*[points[c] for c in points.columns], "idx", "d")


def cells_with_points(sites: DataFrame, mapped: DataFrame) -> DataFrame:
    """Sites that points were mapped to, one row per point; point columns `lat`, `lon` get `_point`."""
    points = mapped.withColumnsRenamed({"lat": "lat_point", "lon": "lon_point"})
    joined = sites.join(points, "idx", "left")
    return joined.filter(F.col("lat_point").isNotNull())


def neighbour_spacing(sites: DataFrame, flag_over: float = SPACING_FLAG) -> DataFrame:
    """Distance from each site to the nearest site elsewhere, and whether it exceeds `flag_over`."""
    places = _locations(sites)
    where = places.select(F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    nearest = nearest_location(where, places, other_only=True).select("plat", "plon", F.col("d").alias("spacing"))
    return sites.join(
        nearest, (sites["lat"] == nearest["plat"]) & (sites["lon"] == nearest["plon"])
    ).select(sites["idx"], "spacing", (F.col("spacing") > flag_over).alias("flagged"))


def spacing_counts(spacing: DataFrame, digits: int = 6) -> DataFrame:
    rounded = F.round("spacing", digits).alias("spacing")
    return spacing.groupBy(rounded, "flagged").agg(F.count(F.lit(1)).alias("n"))


def radius_edges(sites: DataFrame, r: float, sources: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of sites at most `r` degrees apart, each site with itself included.

    With `sources(idx, lat, lon)` only pairs that start at one of them.

    Sites meet in the cells of a grid of side `r`: one side in its own cell, the other in the nine
    around it. Crowded cells are cut in blocks by `split_join`.
    """
    side = r * (1 + 1e-9)
    cx, cy = F.floor(F.col("lat") / side).alias("cx"), F.floor(F.col("lon") / side).alias("cy")
    cell = ["cx", "cy"]

    def spread(df: DataFrame, *keep: str) -> DataFrame:
        """Each row in its own cell and in the eight around it."""
        step = F.array(*[F.lit(k).cast("bigint") for k in (-1, 0, 1)])
        rows = df.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
        return rows.select(*keep, (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))

    starts = sites if sources is None else sources
    left = starts.select(F.col("idx").alias("i"), F.col("lat").alias("lat_i"), F.col("lon").alias("lon_i"), cx, cy)
    right = sites.select(F.col("idx").alias("j"), F.col("lat").alias("lat_j"), F.col("lon").alias("lon_j"), cx, cy)
    # The spread side's rows per cell follow from those of the plain cells.
    arriving = spread(key_counts(left, cell), "_n").groupBy(*cell).agg(F.sum("_n").alias("_n"))
    pairs = split_join(spread(left, "i", "lat_i", "lon_i"), right, cell, counts=(arriving, key_counts(right, cell)))
    d = degree_distance(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j"))
    return pairs.withColumn("d", d).filter(F.col("d") <= r).select("i", "j", "d")


def k_nearest(dist: DataFrame, n: int) -> DataFrame:
    """The n nearest others of every row i, ranked from 1. A row is left out by key, not by rank."""
    order = Window.partitionBy("i").orderBy("d", "j")
    ranked = dist.filter(F.col("i") != F.col("j")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n)


def neighbour_candidates(dist: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """The seeds and the n nearest neighbours of each, without repeats."""
    starts = seeds.select(F.col("idx").alias("i")).distinct()
    near = k_nearest(dist.join(starts, "i", "left_semi"), n)
    return near.select(F.col("j").alias("idx")).union(seeds.select("idx")).distinct()


def distance_asymmetry(dist: DataFrame) -> DataFrame:
    """Pairs i < j with the distance of both directions, from one aggregation of the arcs."""
    there, back = (F.max(F.when(cond, F.col("d"))) for cond in (F.col("i") < F.col("j"), F.col("i") > F.col("j")))
    pairs = dist.filter(F.col("i") != F.col("j")).groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    both = pairs.agg(there.alias("d"), back.alias("d_back")).filter(F.col("d").isNotNull() & F.col("d_back").isNotNull())
    return both.select(
        F.col("a").alias("i"), F.col("b").alias("j"), "d", "d_back", F.abs(F.col("d") - F.col("d_back")).alias("gap")
    )


def attach_measure(edges: DataFrame, measure: DataFrame, on: str = "j") -> DataFrame:
    """Attach `measure(idx, …)` to the edges by site key."""
    return lookup_join(edges, measure.withColumnRenamed("idx", on), [on])


def pair_distances(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """Degree distance of given (i, j) pairs by looking up both ends, without a matrix."""
    ends = pairs
    for side in ("i", "j"):
        ends = ends.join(
            sites.select(F.col("idx").alias(side), F.col("lat").alias(f"lat_{side}"), F.col("lon").alias(f"lon_{side}")),
            side,
        )
    d = degree_distance(F.col("lat_i"), F.col("lon_i"), F.col("lat_j"), F.col("lon_j"))
    return ends.select(*pairs.columns, d.alias("d"))


def catchment_sum(dist: DataFrame, measure: DataFrame, r: float) -> DataFrame:
    """Per centre i, the biomass of all sites j with d(i, j) <= r."""
    near = attach_measure(dist.filter(F.col("d") <= r), measure)
    return near.groupBy(F.col("i").alias("center")).agg(F.sum("biomass").alias("biomass"))


def catchment_curve(dist: DataFrame, measure: DataFrame, max_r: float = CURVE_RADIUS, points: int = CURVE_POINTS) -> DataFrame:
    """Catchment sums at evenly spaced radii from 0 to `max_r`, one row per centre and radius.

    Every arc counts once, at the first radius that covers it; a centre's few sums per radius are then added up.
    """
    step = max_r / (points - 1)
    radii = [k * step for k in range(points - 1)] + [max_r]
    near = attach_measure(dist.filter(F.col("d") <= max_r), measure)
    steps = F.array(*[F.lit(r) for r in radii])
    # The quotient may be off by one at a radius itself.
    guess = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.ceil(F.col("d") / step))).cast("int")
    lower = (guess > 0) & (F.col("d") <= F.get(steps, guess - 1))
    point = F.when(lower, guess - 1).when(F.col("d") > F.get(steps, guess), guess + 1).otherwise(guess)
    sums = near.groupBy(F.col("i").alias("center"), point.alias("point")).agg(F.sum("biomass").alias("biomass"))
    own = sums.groupBy("center").agg(F.collect_list(F.struct("point", "biomass")).alias("_sums"))
    rows = own.select("center", "_sums", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    covered = F.filter("_sums", lambda x: x["point"] <= F.col("point"))
    total = F.aggregate(F.array_sort(covered), F.lit(0.0), lambda acc, x: acc + F.coalesce(x["biomass"], F.lit(0.0)))
    return rows.select("center", "point", F.get(steps, F.col("point")).alias("radius"), total.alias("biomass"))


def catchment_band(catchments: DataFrame, lo: float, hi: float) -> DataFrame:
    """Flags per centre: catchment inside [lo, hi], and above lo."""
    b = F.col("biomass")
    return catchments.select("center", "biomass", b.between(lo, hi).alias("in_band"), (b > lo).alias("above"))


def gazetteer_lookup(estates: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates of estates by name and district, compared without case and outer blanks.

    A gazetteer that has a name twice gives its northernmost, then easternmost place: an estate never multiplies.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_e", F.lower(F.trim("estate"))).withColumn("_d", F.lower(F.trim("district")))

    best = keyed(gazetteer).groupBy("_e", "_d").agg(F.max(F.struct("lat", "lon")).alias("_at"))
    places = best.select("_e", "_d", "_at.lat", "_at.lon")
    return keyed(estates).join(places, ["_e", "_d"], "left").drop("_e", "_d")
