"""Neighbours: k nearest, within a radius, density clusters on a graph of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locspark.operators.graph import connected, written
from locspark.operators.ordered import in_order, with_numbers
from locspark.operators.quadtree import nearest, points_of


def _cells(side: Column | float) -> list[Column]:
    return [F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")]


def _around(points: DataFrame) -> DataFrame:
    """Each point in its own cell and the eight about it."""
    step = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    return points.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy")).drop("dx", "dy")


def _distance() -> Column:
    return F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))


def knn(locs: DataFrame, k: int) -> DataFrame:
    """(movie_id, loc_id, other_id, distance, rank): the k nearest others of each point; ties by id. See `quadtree`."""
    return nearest(locs, k)


def mean_neighbor_distance(locs: DataFrame, k_neighbors: int = 10) -> DataFrame:
    """(movie_id, loc_id, mean_distance) over the min(k, n) - 1 nearest others; 0 for a point alone, null for rows without a place."""
    near = knn(locs, k_neighbors - 1).groupBy("movie_id", "loc_id").agg(F.avg("distance").alias("mean_distance"))
    alone = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"), 0.0)
    return locs.select("movie_id", "loc_id", "x", "y").join(near, ["movie_id", "loc_id"], "left").select("movie_id", "loc_id", F.coalesce("mean_distance", alone).alias("mean_distance"))


def local_density(locs: DataFrame, k_neighbors: int = 10) -> DataFrame:
    """(movie_id, loc_id, density): 1 / (mean distance + 1e-6); 1 in movies of fewer than k points; null for rows without a place."""
    d = written(mean_neighbor_distance(locs, k_neighbors))
    n = d.groupBy("movie_id").agg(F.count("mean_distance").alias("n"))
    return d.join(n, "movie_id").select("movie_id", "loc_id", F.when(F.col("n") < k_neighbors, 1.0).otherwise(1 / (F.col("mean_distance") + 1e-6)).alias("density"))


def knee_eps(locs: DataFrame, eps_base: float = 5.0, min_samples: int = 3) -> DataFrame:
    """(movie_id, eps): where the sorted k-distances bend most, within half and twice eps_base; eps_base for 20 points or fewer. Runs jobs when called."""
    k = max(min_samples, 4)
    d = knn(locs, k - 1).filter(F.col("rank") == k - 1).select("movie_id", "distance")
    rows = with_numbers(in_order(d, "movie_id", ["distance"]), "movie_id", "i")
    # each distance is the first, second and third of three in a row
    three = rows.select("movie_id", "distance", "i", F.explode(F.array(*(F.lit(s) for s in range(3)))).alias("s")).groupBy("movie_id", (F.col("i") - F.col("s")).alias("i"))
    three = three.agg(*(F.max(F.when(F.col("s") == s, F.col("distance"))).alias(f"d{s}") for s in range(3))).filter("d0 is not null and d2 is not null")
    best = three.groupBy("movie_id").agg(F.max_by("d1", F.struct(F.col("d2") - 2 * F.col("d1") + F.col("d0"), -F.col("i"))).alias("knee"))
    n = locs.groupBy("movie_id").agg(F.count("*").alias("n"))
    return n.join(best, "movie_id", "left").select("movie_id", F.when((F.col("n") <= 20) | F.col("knee").isNull(), eps_base).otherwise(F.least(F.lit(2 * eps_base), F.greatest(F.lit(eps_base / 2), "knee"))).alias("eps"))


def eps_neighbors(locs: DataFrame, eps: float | DataFrame) -> DataFrame:
    """(movie_id, loc_id, other_id, distance) of all pairs no farther than eps, each both ways and each point with itself."""
    p = locs.select("movie_id", "loc_id", "x", "y")
    p = p.withColumn("eps", F.lit(float(eps))) if not isinstance(eps, DataFrame) else p.join(eps, "movie_id")
    p = p.select("*", *_cells(F.col("eps")))
    others = p.select("movie_id", F.col("loc_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy")
    return _around(p).join(others, ["movie_id", "cx", "cy"]).withColumn("distance", _distance()).filter("distance <= eps").select("movie_id", "loc_id", "other_id", "distance")


def _apart(near: bool) -> Column:
    """The least (or largest) distance that points of two boxes can have."""
    side = lambda a, b, c, d: F.greatest(F.lit(0.0), F.col(c) - F.col(b), F.col(a) - F.col(d)) if near else F.greatest(F.col(d) - F.col(a), F.col(b) - F.col(c))
    dx, dy = side("ax", "bx", "oax", "obx"), side("ay", "by", "oay", "oby")
    return F.sqrt(dx * dx + dy * dy)


#: Neighbour cells of a cell within two steps, itself too, and one of each two opposite ones.
_BLOCK = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]
_HALF = [(dx, dy) for dx, dy in _BLOCK if (dx, dy) > (0, 0)]


def _moved(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Each row once for each step, its cell moved by it."""
    step = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps)))
    return df.withColumn("step", step).withColumn("cx", F.col("cx") + F.col("step.dx")).withColumn("cy", F.col("cy") + F.col("step.dy")).drop("step")


def _cell_links(core: DataFrame) -> DataFrame:
    """(movie_id, loc_id, other_id): cells of core places, by their names, that hold two core places within eps.

    Cells are compared by the boxes about their places in each of 4 x 4 parts: one pair of boxes wholly within eps is witness
    enough, pairs that begin farther apart can't be one; only where neither holds are places compared, those near the
    other box.
    """
    at = ["movie_id", "cx", "cy"]
    boxes = core.groupBy(*at, "name", "part", "eps").agg(F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by"))
    others = boxes.select(*at, F.col("name").alias("other"), F.col("part").alias("opart"), *(F.col(c).alias(f"o{c}") for c in ("ax", "bx", "ay", "by")))
    met = _moved(boxes, _HALF).join(others, at).withColumn("near", _apart(True)).withColumn("far", _apart(False)).filter("near <= eps")
    pairs = written(met.groupBy("movie_id", "name", "other", "eps").agg(F.bool_or(F.col("far") <= F.col("eps")).alias("sure"), F.collect_list(F.struct("part", "opart")).alias("parts")))  # at most 256 pairs of parts
    open_ = pairs.filter("not sure").select("movie_id", "name", "other", "eps", F.explode("parts").alias("p")).select("movie_id", "name", "other", "eps", "p.part", "p.opart")
    mine = core.select("movie_id", "name", "part", "x", "y")
    theirs = core.select("movie_id", F.col("name").alias("other"), F.col("part").alias("opart"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    found = open_.join(mine, ["movie_id", "name", "part"]).join(theirs, ["movie_id", "other", "opart"]).filter(_distance() <= F.col("eps")).select("movie_id", "name", "other").distinct()
    return pairs.filter("sure").select("movie_id", "name", "other").union(found).toDF("movie_id", "loc_id", "other_id")


def dbscan(locs: DataFrame, eps: float | DataFrame = 5.0, min_samples: int = 3) -> DataFrame:
    """`locs` with cluster_id: density clusters numbered by their smallest core id, -1 for noise. Runs jobs when called.

    A point with min_samples points within eps, itself included, is a core point; core points within eps are of one
    cluster; another point within eps of a core point is of the first such cluster. eps: a number, or (movie_id, eps).

    Points of one place are worked on as one. Cells are eps / sqrt 2 wide, so all points of a cell are neighbours: a cell of
    min_samples points has core points only, and cells with core points are the nodes of the graph. Only places of
    emptier cells look at the places about them, of which a crowded cell has few enough about it; no pairs are kept.
    Rows without a place or id are noise, as are rows of a movie without an eps; rows of one id are one point (`points_of`).
    """
    p = points_of(locs)
    p = p.withColumn("eps", F.lit(float(eps))) if not isinstance(eps, DataFrame) else p.join(eps.select("movie_id", F.col("eps").cast("double").alias("eps")), "movie_id").filter("eps > 0")
    side, at = F.col("eps") / 2**0.5 * (1 - 1e-9), ["movie_id", "cx", "cy"]
    places = p.groupBy("movie_id", "x", "y", "eps").agg(F.count("*").alias("n"), F.min("loc_id").alias("id")).select("*", *_cells(side))
    places = written(places.withColumn("part", F.least(F.lit(3), F.floor((F.col("x") / side - F.col("cx")) * 4)) * 4 + F.least(F.lit(3), F.floor((F.col("y") / side - F.col("cy")) * 4))))
    crowds = places.groupBy(at).agg(F.sum("n").alias("held"))
    placed = written(places.join(crowds, at))
    few = _moved(placed.filter(F.col("held") < min_samples).select("id", "x", "y", "eps", *at), _BLOCK)
    near = few.join(placed.select(*at, F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("n").alias("m")), at).filter(_distance() <= F.col("eps"))
    alone = near.groupBy("movie_id", "id").agg(F.sum("m").alias("m")).filter(F.col("m") >= min_samples).select("movie_id", "id")
    core = placed.filter(F.col("held") >= min_samples).unionByName(placed.filter(F.col("held") < min_samples).join(alone, ["movie_id", "id"], "left_semi"))
    core = written(core.join(core.groupBy(at).agg(F.min("id").alias("name")), at))
    names = connected(_cell_links(core))
    named = written(core.join(names.select("movie_id", F.col("loc_id").alias("name"), "root"), ["movie_id", "name"], "left").select("id", "x", "y", *at, F.coalesce("root", "name").alias("root")))
    rim = few.join(named.select("movie_id", "id"), ["movie_id", "id"], "left_anti")
    rim = rim.join(named.select(*at, F.col("x").alias("ox"), F.col("y").alias("oy"), "root"), at).filter(_distance() <= F.col("eps")).groupBy("movie_id", "x", "y").agg(F.min("root").alias("root"))
    number = with_numbers(in_order(named.select("movie_id", "root").distinct(), "movie_id", ["root"]), "movie_id")
    labels = named.select("movie_id", "x", "y", "root").union(rim).join(number.select("movie_id", "root", (F.col("number") - 1).cast("int").alias("cluster_id")), ["movie_id", "root"])
    points = p.select("movie_id", "loc_id", "x", "y").join(labels.drop("root"), ["movie_id", "x", "y"]).select("movie_id", "loc_id", "cluster_id")
    return locs.drop("cluster_id").join(points, ["movie_id", "loc_id"], "left").fillna(-1, ["cluster_id"])
