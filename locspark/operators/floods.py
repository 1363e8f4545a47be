"""Grey opening by tiles with borders; h-maxima and watershed on a spanning forest of pixels; segmentations by them; Ward sub-clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locspark.operators import images
from locspark.operators.forest import merged, pixel_edges, pixel_id
from locspark.operators.graph import written
from locspark.operators.images import _STEPS, KEY, TILE


def _placed(pixels: DataFrame, key: str) -> DataFrame:
    return pixels.filter(F.col(key).isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def _slide(a: np.ndarray, half: int, axis: int, low: bool) -> np.ndarray:
    """The least (or largest) of 2 * half + 1 neighbours along an axis, in steps that double."""
    edge, best = (np.inf, np.minimum) if low else (-np.inf, np.maximum)
    wide = np.pad(a, [(half, half) if i == axis else (0, 0) for i in (0, 1)], constant_values=edge)
    cut = lambda m, lo, n: m[lo : lo + n] if axis == 0 else m[:, lo : lo + n]
    size, done = 2 * half + 1, 1
    while done * 2 <= size:
        n = wide.shape[axis] - done
        wide, done = best(cut(wide, 0, n), cut(wide, done, n)), done * 2
    n = a.shape[axis]
    return best(cut(wide, 0, n), cut(wide, size - done, n))


def _disk_best(a: np.ndarray, radius: int, low: bool) -> np.ndarray:
    edge, best = (np.inf, np.minimum) if low else (-np.inf, np.maximum)
    out = np.full(a.shape, edge)
    for dy in range(-radius, radius + 1):
        if abs(dy) < a.shape[0]:
            row = _slide(a, int((radius * radius - dy * dy) ** 0.5), 1, low)
            if dy < 0:
                out[-dy:] = best(out[-dy:], row[:dy])
            else:
                out[: a.shape[0] - dy] = best(out[: a.shape[0] - dy], row[dy:])
    return out


def _opened(table: pa.Table, radius: int, side: int) -> pa.Table:
    """The opening of one tile, from its pixels and those within twice the radius about it."""
    ty, tx, height, width = (table[c][0].as_py() for c in ("ty", "tx", "height", "width"))
    top, left = max(0, ty * side - 2 * radius), max(0, tx * side - 2 * radius)
    a = np.zeros((min(height, (ty + 1) * side + 2 * radius) - top, min(width, (tx + 1) * side + 2 * radius) - left))
    y, x = table["y"].to_numpy(), table["x"].to_numpy()
    a[y - top, x - left] = table["value"].to_numpy()
    out = _disk_best(_disk_best(a, radius, True), radius, False)
    own = np.flatnonzero((y // side == ty) & (x // side == tx))
    return pa.table([table["key"].take(pa.array(own)), table["y"].take(pa.array(own)), table["x"].take(pa.array(own)), pa.array(out[y[own] - top, x[own] - left])], names=["key", "y", "x", "value"])


def opening(pixels: DataFrame, radius: int = 30, key: str = KEY, side: int | None = None) -> DataFrame:
    """The least over a disk, then the largest: the image without its white top hat. Beyond the edges there is nothing; pixels that the table lacks are 0.

    By tiles of an image, each with a border of twice the radius, beyond which no pixel bears on the tile; so a large image is
    many tasks.
    """
    side, types = side or max(256, 4 * radius), dict(pixels.dtypes)
    p = pixels.join(images.image_sizes(pixels, key), key).select(F.col(key).alias("key"), "y", "x", F.col("value").cast("double").alias("value"), "height", "width")
    tiles = lambda c, size: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - 2 * radius, F.lit(0)) / side), F.floor(F.least(F.col(c) + 2 * radius, F.col(size) - 1) / side)))
    met = p.withColumn("ty", tiles("y", "height")).withColumn("tx", tiles("x", "width"))
    found = met.groupBy("key", "ty", "tx").applyInArrow(lambda t: _opened(t, radius, side), f"key {types[key]}, y {types['y']}, x {types['x']}, value double")
    return found.withColumnRenamed("key", key)


def top_hat(pixels: DataFrame, radius: int = 30, key: str = KEY) -> DataFrame:
    low = opening(pixels, radius, key).withColumnRenamed("value", "low")
    return pixels.join(low, [key, "y", "x"]).select(key, "y", "x", (F.col("value") - F.col("low")).alias("value"))


def h_maxima(pixels: DataFrame, h: DataFrame, key: str = KEY, side: int = TILE) -> DataFrame:
    """(key, y, x) of maxima that rise by h or more over every way to a higher pixel. Runs jobs when called.

    h: (key, h); images with h <= 0 or none have no rows. Pixels without a place or value, or that the table lacks, are no way.
    Parts of the spanning forest grow over passes that lie less than h below their top; what is as high as a part's top counts.
    """
    p = _placed(pixels.join(h, key).filter("h > 0"), key)
    p = written(p.select(key, "y", "x", F.col("value").cast("double").alias("value"), pixel_id().alias("node"), (F.col("value") - F.col("h") * (1 - 1e-9)).cast("double").alias("bound")))
    parts = merged(p.select(key, F.col("node").alias("id"), "bound"), pixel_edges(p, _STEPS[8], key), key, side).select(key, F.col("id").alias("node"), F.col("bound").alias("top"))
    return p.join(parts, [key, "node"]).filter("bound = top").select(key, "y", "x")


def watershed(surface: DataFrame, markers: DataFrame, mask: DataFrame, key: str = KEY, side: int = TILE) -> DataFrame:
    """(key, y, x, label): a flood of the mask over the surface from markers (key, y, x, label). Runs jobs when called.

    The flood's parts are the trees of the minimum spanning forest that is rooted in the markers, over edge neighbours: a pixel
    has the marker to which its highest point on the way is lowest. Of equal ways the lower neighbour counts, then the pair
    of pixels that is first in raster order. Parts without a marker get no label; labels are over 0, of two markers in one
    place the smallest counts; pixels without a place or value are no part of the mask.
    """
    at = [key, "y", "x"]
    seeds = markers.filter("label > 0").groupBy(at).agg(F.min("label").cast("long").alias("marker"))
    p = _placed(mask.select(at).distinct().join(surface.select(*at, (-F.col("value").cast("double")).alias("value")), at), key).join(seeds, at, "left")
    p = written(p.select(*at, "value", F.coalesce(-F.col("marker"), pixel_id()).alias("node"), F.when(F.col("marker").isNotNull(), float("inf")).otherwise(float("-inf")).alias("bound")))
    nodes = p.select(key, F.col("node").alias("id"), "bound").distinct()
    parts = merged(nodes, pixel_edges(p, _STEPS[4], key), key, side).filter("root < 0").select(key, F.col("id").alias("node"), (-F.col("root")).alias("label"))
    return p.join(parts, [key, "node"]).select(*at, "label")


def segment_by_distance(pixels: DataFrame, small: int = 10, key: str = KEY) -> DataFrame:
    """Labels: smooth, Otsu, drop small parts, fill holes, flood from the maxima of the distance to the background."""
    smooth, sizes = written(images.gaussian_smooth(pixels, 1.0, key)), written(images.image_sizes(pixels, key))
    mask = written(images.fill_holes(images.otsu_mask(smooth, small, key), sizes, key))
    distance = written(images.distance_transform(mask, sizes, key).withColumnRenamed("distance", "value"))
    grid = images.grid(sizes, key).select(key, "y", "x").join(distance, [key, "y", "x"], "left").fillna(0.0, ["value"])
    top = images.local_maxima(grid, 3, sizes.select(key, F.lit(2.0).alias("threshold")), key=key)
    markers = top.withColumn("label", F.row_number().over(W.partitionBy(key).orderBy(F.desc("value"), "y", "x")))
    return watershed(distance.withColumn("value", -F.col("value")), markers, mask, key)


def segment_by_h_maxima(pixels: DataFrame, radius: int = 30, least: int = 100, nuclei: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """Labels: scale to 1, open, flood the Otsu mask from maxima of a tenth of the 90th percentile, drop small ones; with nuclei only those centred in one, numbered anew.

    Without maxima an image's labels are the parts of its mask.
    """
    p = written(opening(images.normalize_image(pixels, key=key), radius, key))
    h = images.percentile_threshold(p, 90, key).select(key, (F.col("threshold") * 0.1).alias("h"))
    seeds = written(images.label_components(written(h_maxima(p, h, key)), 8, key))
    mask = written(images.threshold_mask(p, images.otsu_threshold(p, key=key), key))
    flood = watershed(p.withColumn("value", -F.col("value")), seeds, mask, key)
    plain = images.label_components(mask, 8, key).join(seeds.select(key).distinct(), key, "left_anti")
    labels = flood.unionByName(plain.select(key, "y", "x", F.col("label").cast("long").alias("label")))
    large = labels.groupBy(key, "label").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(key, "label")
    labels = written(labels.join(large, [key, "label"], "left_semi").select(key, "y", "x", "label"))
    if nuclei is None:
        return labels
    centres = labels.groupBy(key, "label").agg(F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"))
    inside = images.speckles_in_nuclei(centres, nuclei, key).select(key, "label", "new_label")
    return labels.join(inside, [key, "label"]).select(key, "y", "x", F.col("new_label").cast("long").alias("label"))


def ward(points: np.ndarray, parts: int) -> np.ndarray:
    """Part of each point after merging, by Ward's rule, down to `parts`; numbered by first point. Memory grows with the points only.

    Follows chains of nearest neighbours: two parts that are each other's nearest merge. The merges, in order of their
    heights, are those of the greedy rule.
    """
    n = len(points)
    centre, size, live = points.astype(float).copy(), np.ones(n), np.ones(n, bool)
    merges, chain = [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(live)))
        while True:
            a = chain[-1]
            cost = size * size[a] / (size + size[a]) * ((centre - centre[a]) ** 2).sum(1)
            cost[~live] = np.inf
            cost[a] = np.inf
            b = int(np.argmin(cost))
            if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        height = float(cost[b])
        a, b = sorted((a, b))
        merges.append((height, a, b))
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        live[b] = False
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - parts]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    roots = np.array([root(i) for i in range(n)])
    return np.unique(roots, return_inverse=True)[1]


def subcluster(locs: DataFrame, levels: int = 2, min_size: int = 2) -> DataFrame:
    """`locs` with sub_cluster_id: 0 for noise and for clusters of fewer than 2 * min_size, else Ward's parts, numbered by smallest id.

    A cluster is worked on by one task, with two numbers a point.
    """

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("loc_id")
        parts = min(levels, len(pdf) // min_size)
        part = ward(pdf[["x", "y"]].to_numpy(), parts) if len(pdf) >= 2 * min_size and parts > 1 else np.zeros(len(pdf), int)
        return pd.DataFrame({"movie_id": pdf["movie_id"], "loc_id": pdf["loc_id"], "sub_cluster_id": part.astype("int32")})

    p = locs.filter("cluster_id <> -1 and x is not null and y is not null").select("movie_id", "cluster_id", "loc_id", "x", "y")
    found = p.groupBy("movie_id", "cluster_id").applyInPandas(of, "movie_id int, loc_id long, sub_cluster_id int")
    return locs.drop("sub_cluster_id").join(found, ["movie_id", "loc_id"], "left").fillna(0, ["sub_cluster_id"])
