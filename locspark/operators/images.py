"""Operators on images as tables of pixels (image_id, y, x, value), and on labels (image_id, y, x, label)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locspark.operators.graph import connected, written

KEY = "image_id"
_PIXEL = 1 << 20  # y * _PIXEL + x orders pixels by raster


def image_sizes(pixels: DataFrame, key: str = KEY) -> DataFrame:
    return pixels.groupBy(key).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def _in_tiles(pixels: DataFrame, sizes: DataFrame, border: int, side: int, key: str) -> DataFrame:
    """Pixels within their image as (key, ty, tx, y, x, .., height, width), once for each tile that they are within `border` of."""
    p = pixels.join(sizes, key).filter("y >= 0 and x >= 0 and y < height and x < width")
    tiles = lambda c, size: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - border, F.lit(0)) / side), F.floor(F.least(F.col(c) + border, F.col(size) - 1) / side)))
    return p.withColumnRenamed(key, "key").withColumn("ty", tiles("y", "height")).withColumn("tx", tiles("x", "width"))


def _frame(table: pa.Table, border: int, side: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Of a tile's table, by axis: the tile's first pixel and end, that of the tile with its border, the image's size; and its pixels' places therein."""
    axes = []
    for t, size in (("ty", "height"), ("tx", "width")):
        at, n = table[t][0].as_py() * side, table[size][0].as_py()
        axes.append((at, min(n, at + side), max(0, at - border), min(n, at + side + border), n))
    return axes, table["y"].to_numpy() - axes[0][2], table["x"].to_numpy() - axes[1][2]


def _given(table: pa.Table, axes: list, on: np.ndarray) -> list[pa.Array]:
    """Key and places of the pixels of a tile that are on."""
    y, x = np.nonzero(on)
    return [pa.array([table["key"][0].as_py()] * len(y), table.schema.field("key").type), pa.array(y + axes[0][0], table.schema.field("y").type), pa.array(x + axes[1][0], table.schema.field("x").type)]


def _blur(a: np.ndarray, on: np.ndarray, known: np.ndarray, sigma: float, axes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    taps /= taps.sum()
    for axis in (1, 0):
        first, end, low, _, n = axes[axis]
        at = np.clip(np.arange(first - radius, end + radius), 0, n - 1) - low
        cut = [tuple(slice(k, k + end - first) if i == axis else slice(None) for i in (0, 1)) for k in range(len(taps))]
        a, on, known = (m.take(at, axis) for m in (a, on, known))
        a, on, known = sum(a[c] * w for c, w in zip(cut, taps)), np.logical_or.reduce([on[c] for c in cut]), np.logical_or.reduce([known[c] for c in cut])
    return a, on, known


def _smooth_tile(table: pa.Table, sigmas: list[float], border: int, side: int) -> pa.Table:
    axes, y, x = _frame(table, border, side)
    shape = tuple(high - low for _, _, low, high, _ in axes)
    value, null = table["value"].to_numpy(), table["value"].is_null().to_numpy()
    a, on, known = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
    np.add.at(a, (y, x), np.where(null, 0.0, value))
    on[y, x] = True
    known[y[~null], x[~null]] = True
    out = [_blur(a, on, known, s, axes) for s in sigmas]
    both = np.logical_and.reduce([o for _, o, _ in out])
    return pa.table([*_given(table, axes, both), *(pa.array(v[both], mask=~k[both]) for v, _, k in out)], names=["key", "y", "x", *(f"s{i}" for i in range(len(sigmas)))])


def _smoothed(pixels: DataFrame, sigmas: list[float], key: str) -> DataFrame:
    """(key, y, x, s0, s1, ..): Gaussians cut at 4 sigma, edge pixels repeated, by tiles with borders of the widest one. Runs jobs when called.

    Pixels that the table lacks give nothing; rows are where all of them have a pixel in reach.
    """
    p = written(pixels.select(key, "y", "x", F.col("value").cast("double").alias("value")).dropna(subset=[key, "y", "x"]))
    border, types = int(4 * max(sigmas) + 0.5), dict(p.dtypes)
    side = max(256, 4 * border)
    met = _in_tiles(p, written(image_sizes(p, key)), border, side, key)
    columns = ", ".join(f"s{i} double" for i in range(len(sigmas)))
    return met.groupBy("key", "ty", "tx").applyInArrow(lambda t: _smooth_tile(t, sigmas, border, side), f"key {types[key]}, y {types['y']}, x {types['x']}, {columns}").withColumnRenamed("key", key)


def gaussian_smooth(pixels: DataFrame, sigma: float, key: str = KEY) -> DataFrame:
    """A Gaussian, cut at 4 sigma, edge pixels repeated. Runs jobs when called."""
    return _smoothed(pixels, [sigma], key).withColumnRenamed("s0", "value")


def resize_image(pixels: DataFrame, height: int, width: int, key: str = KEY) -> DataFrame:
    """Each image on a grid of the given size: a Gaussian of (factor - 1) / 2 against aliasing, then linear interpolation, edges mirrored.

    Both are one table of weights an axis, so an axis is one join and one sum. Its size is that of the weights, not of
    the images.
    """
    sizes = image_sizes(pixels, key)

    def along(p: DataFrame, axis: str, size: str, n: int) -> DataFrame:
        other = "x" if axis == "y" else "y"
        f = F.col(size) / F.lit(float(n))
        sigma = F.greatest((f - 1) / 2, F.lit(0.0))
        w = sizes.select(size).distinct().withColumn("sigma", sigma).withColumn("out", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        w = w.withColumn("at", (F.col("out") + 0.5) * f - 0.5).withColumn("radius", (4 * F.col("sigma") + 0.5).cast("int"))
        w = w.withColumn("tap", F.explode(F.array(F.floor("at"), F.floor("at") + 1))).withColumn("near", 1 - F.abs(F.col("at") - F.col("tap"))).filter("near > 0")
        w = w.withColumn("d", F.explode(F.sequence(-F.col("radius"), F.col("radius")))).withColumn("g", F.when(F.col("sigma") > 0, F.exp(-F.col("d") * F.col("d") / (2 * F.col("sigma") * F.col("sigma")))).otherwise(1.0))
        w = w.withColumn("g", F.col("near") * F.col("g") / F.sum("g").over(W.partitionBy(size, "out", "tap")))
        turn = F.greatest(2 * F.col(size) - 2, F.lit(1))
        place = F.pmod(F.col("tap") + F.col("d"), turn)
        w = w.groupBy(size, "out", F.least(place, turn - place).cast("int").alias(axis)).agg(F.sum("g").alias("w"))
        return p.join(sizes.select(key, size), key).join(w, [size, axis]).groupBy(key, other, F.col("out").alias(axis)).agg(F.sum(F.col("value") * F.col("w")).alias("value"))

    return along(along(pixels.select(key, "y", "x", "value"), "x", "width", width), "y", "height", height).select(key, "y", "x", "value")


def dog_enhance(pixels: DataFrame, key: str = KEY) -> DataFrame:
    """Difference of Gaussians, the finest half added, negative values cut to 0. Runs jobs when called."""
    f, m, c = (F.col(f"s{i}") for i in range(3))
    return _smoothed(pixels, [0.5, 1.5, 3.0], key).select(key, "y", "x", F.greatest(F.lit(0.0), m - c + 0.5 * (f - m)).alias("value"))


def normalize_image(pixels: DataFrame, bits16: bool = False, key: str = KEY) -> DataFrame:
    top = F.max("value").over(W.partitionBy(key))
    v = F.when(top > 0, F.col("value") / top).otherwise(F.col("value"))
    return pixels.withColumn("value", F.when(top > 0, (v * 65535).cast("int")).otherwise(0) if bits16 else v)


def percentile_threshold(pixels: DataFrame, p: float, key: str = KEY) -> DataFrame:
    return pixels.groupBy(key).agg(F.percentile("value", p / 100).alias("threshold"))


def otsu_threshold(pixels: DataFrame, bins: int = 256, key: str = KEY) -> DataFrame:
    """(key, threshold): the bin centre that parts the histogram with most variance between the classes, the first of equals."""
    bounds = pixels.groupBy(key).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    v = pixels.join(bounds, key)
    number = F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.floor((F.col("value") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)) * bins), F.lit(bins - 1)))
    h = v.groupBy(key, "a", "b", number.alias("bin")).agg(F.count("*").alias("n")).withColumn("c", F.col("a") + (F.col("b") - F.col("a")) * (F.col("bin") + 0.5) / bins)
    # an empty bin has the same classes as the one before it, so only bins with pixels can be the first best
    by = W.partitionBy(key).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumn("w1", F.sum("n").over(by)).withColumn("s1", F.sum(F.col("n") * F.col("c")).over(by))
    whole = W.partitionBy(key)
    h = h.withColumn("w2", F.sum("n").over(whole) - F.col("w1")).withColumn("s2", F.sum(F.col("n") * F.col("c")).over(whole) - F.col("s1"))
    gain = F.col("w1") * F.col("w2") * F.pow(F.col("s1") / F.col("w1") - F.col("s2") / F.nullif(F.col("w2"), F.lit(0)), F.lit(2.0))
    best = h.filter("w2 > 0").groupBy(key).agg(F.max_by("c", F.struct(F.round(gain, 6), -F.col("bin"))).alias("threshold"))
    return bounds.join(best, key, "left").select(key, F.coalesce("threshold", "a").alias("threshold"))


def threshold_mask(pixels: DataFrame, thresholds: DataFrame, key: str = KEY) -> DataFrame:
    return pixels.join(thresholds, key).filter("value > threshold").select(key, "y", "x")


def local_maxima(pixels: DataFrame, distance: int, thresholds: DataFrame, border: int | None = None, key: str | list[str] = KEY) -> DataFrame:
    """Pixels over the threshold that are the largest within `distance` either way, off the border; of equals the first in raster order."""
    keys = [key] if isinstance(key, str) else key
    border = distance if border is None else border
    top = F.struct("value", (-(F.col("y") * _PIXEL + F.col("x"))).alias("at"))
    rows = pixels.withColumn("best", F.max(top).over(W.partitionBy(*keys, "y").orderBy("x").rangeBetween(-distance, distance)))
    both = rows.withColumn("best", F.max("best").over(W.partitionBy(*keys, "x").orderBy("y").rangeBetween(-distance, distance)))
    size = W.partitionBy(*keys)
    both = both.withColumn("h", F.max("y").over(size)).withColumn("w", F.max("x").over(size))
    own = (F.col("best.value") == F.col("value")) & (F.col("best.at") == -(F.col("y") * _PIXEL + F.col("x")))
    inside = (F.col("y") >= border) & (F.col("x") >= border) & (F.col("y") <= F.col("h") - border) & (F.col("x") <= F.col("w") - border)
    return both.join(thresholds, keys).filter(own & inside & (F.col("value") > F.col("threshold"))).select(*keys, "y", "x", "value")


#: Side of a tile in which parts are labelled at once, and pixels that a task works on at once.
TILE, STRETCH = 128, 500_000
_STEPS = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def _least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for n nodes and the links between a and b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _tile_parts(batches: Iterator[pa.RecordBatch], steps: list[tuple[int, int]], side: int) -> Iterator[pa.RecordBatch]:
    """Pixels (key, y, x) in order of tiles, rows and columns; with each the first pixel of its part of the tile."""

    def parts(table: pa.Table) -> pa.RecordBatch:
        key, y, x = (c.to_numpy().astype(np.int64) for c in table.columns)
        new = np.ones(len(y), bool)
        for i, c in enumerate((key, y // side, x // side)):
            new[1:] = (new[1:] if i else False) | (c[1:] != c[:-1])
        ly, lx, tile = y % side, x % side, np.cumsum(new) * side * side
        code = tile + ly * side + lx
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for dy, dx in steps:
            inside = np.flatnonzero((ly + dy < side) & (lx + dx < side) & (lx + dx >= 0))
            want = code[inside] + dy * side + dx
            at = np.minimum(np.searchsorted(code, want), len(code) - 1)
            hit = code[at] == want
            a.append(inside[hit])
            b.append(at[hit])
        first = _least_labels(np.concatenate(a), np.concatenate(b), len(code))
        return pa.record_batch([*table.combine_chunks().to_batches()[0].columns, pa.array(y[first] * _PIXEL + x[first])], names=["key", "y", "x", "node"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(w.num_rows for w in waiting) >= STRETCH:
            table = pa.Table.from_batches(waiting).combine_chunks()
            tiles = np.stack([table["key"].to_numpy(), table["y"].to_numpy() // side, table["x"].to_numpy() // side], 1)
            last = np.flatnonzero((tiles != tiles[-1]).any(1))  # the last tile may go on
            if len(last):
                yield parts(table.slice(0, int(last[-1]) + 1))
                waiting = table.slice(int(last[-1]) + 1).to_batches()
    if sum(w.num_rows for w in waiting):
        yield parts(pa.Table.from_batches(waiting))


def label_components(mask: DataFrame, neighbors: int = 8, key: str = KEY, side: int = TILE) -> DataFrame:
    """(key, y, x, label): connected components, numbered in raster order of their first pixels. Runs jobs when called.

    Written pixels are a few bytes each on disk, by which Spark would take millions of them for a small table and send them
    through the driver; joins of pixels and of parts are therefore hinted as merges.

    Two levels: parts within tiles by one pass of a task over its tiles, then only the links of parts over the borders of
    tiles go through `connected`, whose rounds and tables follow the number of such parts, not of pixels.
    """
    kinds, steps = dict(mask.dtypes), _STEPS[neighbors]
    tile = lambda c: F.floor(F.col(c) / side)
    p = mask.select(F.col(key).alias("key"), "y", "x").filter("key is not null and y is not null and x is not null")
    order = ["key", tile("y"), tile("x")]
    found = p.repartition(*order).sortWithinPartitions(*order, "y", "x").mapInArrow(lambda b: _tile_parts(b, steps, side), f"key {kinds[key]}, y {kinds['y']}, x {kinds['x']}, node long")
    found = written(found)
    rim = found.filter((F.pmod("y", F.lit(side)).isin(0, side - 1)) | F.pmod("x", F.lit(side)).isin(0, side - 1))
    moved = rim.select("key", "node", tile("y").alias("ty"), tile("x").alias("tx"), F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps))).alias("n"))
    moved = moved.select("key", "node", "ty", "tx", "n.y", "n.x").filter((tile("y") != F.col("ty")) | (tile("x") != F.col("tx")))
    links = written(moved.join(rim.select("key", "y", "x", F.col("node").alias("other")).hint("merge"), ["key", "y", "x"]).select("key", F.col("node").alias("loc_id"), F.col("other").alias("other_id")).distinct())
    if links.isEmpty():
        rooted = found.withColumn("root", F.col("node"))
    else:
        names = connected(links, "key").select("key", F.col("loc_id").alias("node"), "root")
        rooted = found.join(names.hint("merge"), ["key", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    number = rooted.select("key", "root").distinct().withColumn("label", F.row_number().over(W.partitionBy("key").orderBy("root")))
    return rooted.join(number.hint("merge"), ["key", "root"]).select(F.col("key").alias(key), "y", "x", "label")


def relabel(labels: DataFrame, key: str = KEY) -> DataFrame:
    number = labels.select(key, "label").distinct().withColumn("new", F.row_number().over(W.partitionBy(key).orderBy("label")))
    return labels.join(number, [key, "label"]).select(key, "y", "x", F.col("new").alias("label"))


def filter_regions_by_area(labels: DataFrame, least: int = 100, most: int | None = 10000, key: str = KEY) -> DataFrame:
    """Labels of regions whose area is in the range, numbered anew in the same order."""
    size = labels.groupBy(key, "label").agg(F.count("*").alias("area"))
    keep = size.filter(F.col("area") >= least if most is None else F.col("area").between(least, most))
    return relabel(labels.join(keep.select(key, "label"), [key, "label"], "left_semi"), key)


def remove_small(mask: DataFrame, least: int, neighbors: int = 4, key: str = KEY) -> DataFrame:
    """The mask without components of fewer than `least` pixels."""
    labels = written(label_components(mask, neighbors, key))
    keep = labels.groupBy(key, "label").agg(F.count("*").alias("area")).filter(F.col("area") >= least)
    return labels.join(keep, [key, "label"], "left_semi").select(key, "y", "x")


def grid(sizes: DataFrame, key: str) -> DataFrame:
    return sizes.select(key, "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))


def fill_holes(mask: DataFrame, sizes: DataFrame, key: str = KEY) -> DataFrame:
    """The mask with the background components that don't touch the border."""
    empty = grid(sizes, key).join(mask.hint("merge"), [key, "y", "x"], "left_anti")
    labels = written(label_components(written(empty), 4, key)).hint("merge").join(sizes, key)
    open_ = labels.filter("y = 0 or x = 0 or y = height - 1 or x = width - 1").select(key, "label").distinct()
    return mask.select(key, "y", "x").union(labels.join(open_, [key, "label"], "left_anti").select(key, "y", "x"))


def _widened(a: np.ndarray, radius: int) -> np.ndarray:
    """What a disk about each marked pixel covers, by running counts along rows."""
    height, width = a.shape
    count = np.pad(a.astype(np.int32), ((radius, radius), (radius + 1, radius))).cumsum(1)
    out = np.zeros(a.shape, bool)
    for dy in range(-radius, radius + 1):
        half, rows = math.isqrt(radius * radius - dy * dy), count[radius + dy : radius + dy + height]
        out |= rows[:, radius + 1 + half : radius + 1 + half + width] > rows[:, radius - half : radius - half + width]
    return out


def _closed_tile(table: pa.Table, radius: int, side: int) -> pa.Table:
    axes, y, x = _frame(table, 2 * radius, side)
    a = np.zeros(tuple(high - low for _, _, low, high, _ in axes), bool)
    a[y, x] = True
    wide = _widened(a, radius)
    closed = wide & ~_widened(~wide, radius)
    return pa.table(_given(table, axes, closed[tuple(slice(first - low, end - low) for first, end, low, _, _ in axes)]), names=["key", "y", "x"])


def binary_closing(mask: DataFrame, radius: int, sizes: DataFrame, key: str = KEY, side: int | None = None) -> DataFrame:
    """Dilation, then erosion, with a disk; pixels beyond the image never stop the erosion. By tiles with borders of twice the radius."""
    side, types = side or max(256, 8 * radius), dict(mask.dtypes)
    met = _in_tiles(mask.select(key, "y", "x"), sizes, 2 * radius, side, key)
    return met.groupBy("key", "ty", "tx").applyInArrow(lambda t: _closed_tile(t, radius, side), f"key {types[key]}, y {types['y']}, x {types['x']}").withColumnRenamed("key", key)


def envelope(g: np.ndarray) -> np.ndarray:
    """Of rows of distances along columns (-1: none) the squared distances in the plane: least of (x - v)**2 + g[v]**2 over v.

    The lower envelope of these parabolas is built for all rows side by side, a column at a time: a parabola pushes out
    those at the end of its row's stack that it lies under from where they begin. Then each column is read off the stack.
    Work is linear in the width.
    """
    rows, width = g.shape
    stack, begin, top = np.zeros((rows, width), np.int64), np.zeros((rows, width)), np.full(rows, -1)
    f = g.astype(float) ** 2
    for x in range(width):
        todo = np.flatnonzero(g[:, x] >= 0)
        while len(todo):
            t = top[todo]
            v = stack[todo, np.maximum(t, 0)]
            cross = np.where(t >= 0, ((f[todo, x] + x * x) - (f[todo, v] + v * v)) / np.maximum(2 * (x - v), 1), -np.inf)
            out = (t >= 0) & (cross <= begin[todo, np.maximum(t, 0)])
            stay = todo[~out]
            top[stay] += 1
            stack[stay, top[stay]] = x
            begin[stay, top[stay]] = cross[~out]
            top[todo[out]] -= 1
            todo = todo[out]
    best, at = np.full((rows, width), np.inf), np.zeros(rows, np.int64)
    some = np.flatnonzero(top >= 0)
    for x in range(width):
        while True:
            on = some[(at[some] < top[some]) & (begin[some, np.minimum(at[some] + 1, width - 1)] < x)]
            if not len(on):
                break
            at[on] += 1
        v = stack[some, at[some]]
        best[some, x] = (x - v) ** 2 + f[some, v]
    return best


def _nearest_in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's distances along columns (-1: none) the distances in the plane; rows of one width side by side."""
    for batch in batches:
        lists = batch.column(2)
        size, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        at, out = np.cumsum(size) - size, np.empty(len(values))
        for width in np.unique(size).tolist():
            own = np.flatnonzero(size == width)
            for a in range(0, len(own), max(1, 2_000_000 // max(width, 1))):
                place = at[own[a : a + max(1, 2_000_000 // max(width, 1))], None] + np.arange(width)
                out[place] = np.sqrt(envelope(values[place]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.append(at, len(values)).astype(np.int32), pa.array(out))], names=["key", "y", "distance"])


def distance_transform(mask: DataFrame, sizes: DataFrame, key: str = KEY) -> DataFrame:
    """(key, y, x, distance) of mask pixels to the nearest pixel off the mask: by columns, then within each row. No rows of images that are all mask."""
    whole = grid(sizes, key).select(key, "y", "x").join(mask.select(key, "y", "x", F.lit(True).alias("on")), [key, "y", "x"], "left")
    up, down = W.partitionBy(key, "x").orderBy("y"), W.partitionBy(key, "x").orderBy(F.desc("y"))
    zero = F.when(F.col("on").isNull(), F.col("y"))
    g = whole.withColumn("g", F.coalesce(F.least(F.col("y") - F.last(zero, True).over(up), F.last(zero, True).over(down) - F.col("y")), F.lit(-1)))
    rows = g.groupBy(key, "y").agg(F.array_sort(F.collect_list(F.struct("x", "g"))).alias("p")).select(F.col(key).alias("key"), "y", F.col("p.g").alias("g"))
    kinds = rows.schema
    near = rows.mapInArrow(_nearest_in_rows, f"key {kinds['key'].dataType.simpleString()}, y {kinds['y'].dataType.simpleString()}, distance array<double>")
    pixels = near.select(F.col("key").alias(key), "y", F.posexplode("distance").alias("x", "distance")).filter("distance < double('infinity')")
    return pixels.join(mask.select(key, "y", "x"), [key, "y", "x"], "left_semi").select(key, "y", "x", "distance")


def region_props(labels: DataFrame, pixels: DataFrame, key: str = KEY) -> DataFrame:
    """By label: area, centroid, box (ends open), mean intensity, perimeter, circularity."""
    by = [key, "label"]
    g = labels.join(pixels.select(key, "y", "x", "value"), [key, "y", "x"], "left").groupBy(by).agg(
        F.count("*").alias("area"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"), F.min("y").alias("min_row"), F.min("x").alias("min_col"), (F.max("y") + 1).alias("max_row"), (F.max("x") + 1).alias("max_col"), F.avg("value").alias("mean_intensity"))
    round_ = F.when(F.col("perimeter") > 0, 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).otherwise(0.0)
    return g.join(perimeter(labels, key), by, "left").fillna(0.0, ["perimeter"]).withColumn("circularity", round_)


def _neighbors(df: DataFrame, steps: list[tuple[int, int]], key: str) -> DataFrame:
    """For each labelled pixel how many of the given neighbours have its label."""
    moved = df.select(key, "label", F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps))).alias("n")).select(key, "label", "n.y", "n.x")
    return df.join(moved.groupBy(key, "label", "y", "x").agg(F.count("*").alias("k")), [key, "label", "y", "x"], "left").fillna(0, ["k"])


EDGES, CORNERS = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def perimeter(labels: DataFrame, key: str = KEY) -> DataFrame:
    """(key, label, perimeter): border pixels weighed by how their border neighbours lie."""
    p = labels.select(key, "label", "y", "x")
    border = _neighbors(p, EDGES, key).filter("k < 4").drop("k")
    e = _neighbors(border, EDGES, key).withColumnRenamed("k", "e")
    c = _neighbors(border, CORNERS, key).withColumnRenamed("k", "c")
    code = 1 + 2 * F.col("e") + 10 * F.col("c")
    # fixed values: weights of the neighbour codes
    weight = F.when(code.isin(5, 7, 15, 17, 25, 27), 1.0).when(code.isin(21, 33), math.sqrt(2)).when(code.isin(13, 23), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return e.join(c, [key, "label", "y", "x"]).groupBy(key, "label").agg(F.sum(weight).alias("perimeter"))


def label_boundaries(labels: DataFrame, sizes: DataFrame, key: str = KEY) -> DataFrame:
    """Outer boundary: background pixels of the image that share an edge with a label. sizes: (key, height, width)."""
    moved = labels.select(key, F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in EDGES))).alias("n")).select(key, "n.y", "n.x").distinct()
    inside = moved.join(sizes, key).filter("y >= 0 and x >= 0 and y < height and x < width").select(key, "y", "x")
    return inside.join(labels, [key, "y", "x"], "left_anti")


def speckles_in_nuclei(regions: DataFrame, nuclei: DataFrame, key: str = KEY) -> DataFrame:
    """Regions whose truncated centroid lies in a nucleus, numbered anew in label order."""
    mask = nuclei.select(key, F.col("y").alias("cy"), F.col("x").alias("cx"))
    own = regions.withColumn("cy", F.col("centroid_y").cast("int")).withColumn("cx", F.col("centroid_x").cast("int")).join(mask, [key, "cy", "cx"], "left_semi").drop("cy", "cx")
    return own.withColumn("new_label", F.row_number().over(W.partitionBy(key).orderBy("label")))


def region_report(nuclei: DataFrame, speckles: DataFrame, key: str = KEY) -> DataFrame:
    """By image, from the region tables: numbers, means and deviations, speckles for each nucleus (null without any)."""
    a = nuclei.groupBy(key).agg(F.count("*").alias("n_nuclei"))
    b = speckles.groupBy(key).agg(F.count("*").alias("n_speckles"), F.avg("area").alias("mean_area"), F.stddev_pop("area").alias("std_area"), F.avg("mean_intensity").alias("mean_intensity"), F.stddev_pop("mean_intensity").alias("std_intensity"))
    return a.join(b, key, "full").fillna(0, ["n_nuclei", "n_speckles"]).withColumn("speckles_per_nucleus", F.col("n_speckles") / F.nullif("n_nuclei", F.lit(0)))


def otsu_mask(smooth: DataFrame, small: int, key: str = KEY) -> DataFrame:
    """Pixels over Otsu's threshold, without parts of fewer than `small`, as a written table."""
    mask = written(threshold_mask(smooth, otsu_threshold(smooth, key=key), key))
    return written(remove_small(mask, small, 4, key))


def segment_speckles(pixels: DataFrame, small: int = 50, closing: int = 2, least: int = 100, most: int = 10000, key: str = KEY) -> DataFrame:
    """Labels: smooth, Otsu, drop small parts, close, components within the area range. Steps that are read twice are written once."""
    sizes = written(image_sizes(pixels, key))
    smooth = written(gaussian_smooth(pixels, 1.0, key))
    mask = written(binary_closing(otsu_mask(smooth, small, key), closing, sizes, key))
    return filter_regions_by_area(written(label_components(mask, 8, key)), least, most, key)


def segment_nuclei(pixels: DataFrame, least: int = 5000, closing: int = 3, key: str = KEY) -> DataFrame:
    """Labels: normalise, smooth, Otsu, drop small parts, close, fill holes, components. Steps that are read twice are written once."""
    sizes = written(image_sizes(pixels, key))
    smooth = written(gaussian_smooth(normalize_image(pixels, key=key), 1.5, key))
    mask = written(binary_closing(otsu_mask(smooth, least, key), closing, sizes, key))
    return label_components(written(fill_holes(mask, sizes, key)), 8, key)
