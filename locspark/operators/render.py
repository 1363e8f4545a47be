"""Super-resolution images as sparse pixel tables (movie_id, y, x, value)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locspark.functions.scalars import or_default, render_sigma, render_weight
from locspark.operators.graph import written


def viewport(locs: DataFrame, height: int, width: int) -> DataFrame:
    """Localizations within the image, its edges excluded."""
    return locs.filter((F.col("x") > 0) & (F.col("x") < width) & (F.col("y") > 0) & (F.col("y") < height))


def render_bounds_check(locs: DataFrame, height: int, width: int, oversampling: int = 5) -> DataFrame:
    """Localizations on the super-resolution grid, its low edges included."""
    sx, sy = F.col("x") * oversampling, F.col("y") * oversampling
    return locs.filter((sx >= 0) & (sx < width * oversampling) & (sy >= 0) & (sy < height * oversampling))


def crop_center(image: DataFrame, height: int, width: int) -> DataFrame:
    q = min(height, width) // 4
    return image.filter(F.col("y").between(height // 2 - q, height // 2 + q - 1) & F.col("x").between(width // 2 - q, width // 2 + q - 1))


#: Side of a tile of the image, kernels of a tile that one task adds up, pixels of kernels that are worked out at once, and
#: pixels beyond which a kernel is worked out over the whole tile.
TILE, CROWD, PIXELS, WIDE = 256, 200_000, 2_000_000, 600

KERNEL = ["movie_id", "ty", "tx", "salt", "y0", "y1", "x0", "x1", "cy", "cx", "sy", "sx", "a"]


def _add_up(value: np.ndarray, boxes: np.ndarray, y0, y1, x0, x1, cy, cx, sy, sx, a) -> None:
    """Adds kernels to a square of pixels, and marks their boxes by differences. Kernels of like size are worked out side by side."""
    side = len(boxes) - 1
    np.add.at(boxes, (y0, x0), 1)
    np.add.at(boxes, (y1, x1), 1)
    np.add.at(boxes, (y0, x1), -1)
    np.add.at(boxes, (y1, x0), -1)
    size = (y1 - y0) * (x1 - x0)
    wide, order, at, grid = np.flatnonzero(size > WIDE), np.lexsort((x1 - x0, y1 - y0)), 0, np.arange(side)
    for k in range(0, len(wide), max(1, PIXELS // side)):  # as rows of the whole square, with zeros outside their boxes
        own = wide[k : k + max(1, PIXELS // side), None]
        fy = np.where((grid >= y0[own]) & (grid < y1[own]), a[own] * np.exp(-((grid - cy[own]) ** 2) / (2 * sy[own] * sy[own])), 0.0)
        fx = np.where((grid >= x0[own]) & (grid < x1[own]), np.exp(-((grid - cx[own]) ** 2) / (2 * sx[own] * sx[own])), 0.0)
        value += (fy.T @ fx).ravel()
    order = order[size[order] <= WIDE]
    while at < len(order):
        area = np.maximum.accumulate((y1 - y0)[order[at:]]) * np.maximum.accumulate((x1 - x0)[order[at:]]) * np.arange(1, len(order) - at + 1)
        own = order[at : at + max(1, int(np.searchsorted(area, PIXELS)))]
        at += len(own)
        ys, xs = y0[own, None] + np.arange((y1 - y0)[own].max()), x0[own, None] + np.arange((x1 - x0)[own].max())
        dy, dx = ys - cy[own, None], xs - cx[own, None]
        fy = np.where(ys < y1[own, None], a[own, None] * np.exp(-dy * dy / (2 * (sy * sy)[own, None])), 0.0)
        fx = np.where(xs < x1[own, None], np.exp(-dx * dx / (2 * (sx * sx)[own, None])), 0.0)
        place = np.minimum(ys, side - 1)[:, :, None] * side + np.minimum(xs, side - 1)[:, None, :]
        value += np.bincount(place.ravel(), (fy[:, :, None] * fx[:, None, :]).ravel(), side * side)


def _taps(sigma: float) -> list[float]:
    """Weights of a Gaussian cut at 4 sigma; the one weight 1 for none."""
    radius = int(4 * sigma + 0.5)
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) if d else 1.0 for d in range(-radius, radius + 1)]
    return [k / sum(kernel) for k in kernel]


def _blurred(value: np.ndarray, on: np.ndarray, taps: list[float], corner: tuple[int, int], size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A tile and its marks after a blur, from those with a border of the blur's radius; mirrored at the image's edges."""
    for axis in (1, 0):
        n, span = size[axis], value.shape[axis]
        turned = (np.arange(span) + corner[axis]) % (2 * n)
        at = np.clip(np.where(turned < n, turned, 2 * n - 1 - turned) - corner[axis], 0, span - 1)  # out of range only beyond what is given out
        value, on = value.take(at, axis), on.take(at, axis)
        cut = [tuple(slice(k, k + TILE) if i == axis else slice(None) for i in (0, 1)) for k in range(len(taps))]
        value, on = sum(value[c] * k for c, k in zip(cut, taps)), np.logical_or.reduce([on[c] for c in cut])
        beyond = tuple(slice(max(0, n - corner[axis] - len(taps) // 2), None) if i == axis else slice(None) for i in (0, 1))
        on[beyond] = False
    return value, on


def _tiles(batches: Iterator[pa.RecordBatch], taps: list[float] = (1.0,), tops: bool = False) -> Iterator[pa.RecordBatch]:
    """The pixels of each tile whose kernels come one after the other: one tile is held at a time.

    Columns after the kernels' own: the image's height and width, for a blur by `taps`, and what values are divided by.
    tops: only the largest value of each tile.
    """
    now, value, boxes, radius = None, None, None, len(taps) // 2
    side = TILE + 2 * radius

    def pixels() -> pa.RecordBatch:
        (movie, ty, tx, _), (h, w, top) = now, rest
        v, on = value.reshape(side, side), np.cumsum(np.cumsum(boxes, 0), 1)[:side, :side] > 0
        if radius:
            v, on = _blurred(v, on, taps, (ty * TILE - radius, tx * TILE - radius), (h, w))
        y, x = np.nonzero(on)
        if tops:
            y, x, given = y[:1], x[:1], v[on].max(keepdims=True, initial=-np.inf)[: len(y)]
        else:
            given = v[on]
        if top is not None:
            with np.errstate(divide="ignore", invalid="ignore"):
                given = given / top
        return pa.record_batch([pa.array(np.full(len(y), movie)), pa.array(y + ty * TILE), pa.array(x + tx * TILE), pa.array(given)], names=["movie_id", "y", "x", "value"])

    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        keys = np.stack(columns[:4], 1)
        heads = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))) if len(keys) else []
        for a, z in zip(heads, [*heads[1:], len(keys)]):
            if now != tuple(keys[a].tolist()):
                if now is not None:
                    yield pixels()
                now, value, boxes = tuple(keys[a].tolist()), np.zeros(side * side), np.zeros((side + 1, side + 1), np.int64)
                rest = [c[a] for c in columns[13:]] + [None] * (16 - len(columns))
            y0, y1, x0, x1, cy, cx, sy, sx, amplitude = (c[a:z] for c in columns[4:13])
            top, left = now[1] * TILE - radius, now[2] * TILE - radius
            clip = lambda c, o: np.clip(c - o, 0, side)
            _add_up(value, boxes, clip(y0, top), clip(y1, top), clip(x0, left), clip(x1, left), cy - top, cx - left, sy, sx, amplitude)
    if now is not None:
        yield pixels()


def _splat(points: DataFrame, lo_y: Column, hi_y: Column, lo_x: Column, hi_x: Column, height: int | Column, width: int | Column, sigma: float = 0.0, scaled: bool = False) -> DataFrame:
    """Adds up a * exp(-((x - cx)**2 / 2 sx**2 + (y - cy)**2 / 2 sy**2)) over the pixels lo .. hi (hi excluded) of each point. Runs jobs when called.

    Tiles are the key: a kernel goes to the tiles that it meets, mostly one to four, whose kernels one task adds up, a tile
    at a time, so that each pixel is given out once, in whatever order the points come. Tiles with over `CROWD` kernels are
    split by a salt, and their pixels added up again. Only kernels are shuffled, pixels of split tiles apart.

    sigma: a Gaussian over the image, cut at 4 sigma and mirrored at its edges; a tile's kernels are those that meet it with
    a border of the blur's radius. scaled: each movie is divided by its largest value, which a pass of its own finds.
    """
    taps, sizes = _taps(sigma), [c if isinstance(c, Column) else F.lit(c) for c in (height, width)]
    clip = lambda c, n: F.greatest(F.lit(0), F.least(n, c)).cast("long")
    p = written(points.select(F.col("movie_id").cast("long").alias("movie_id"), clip(lo_y, sizes[0]).alias("y0"), clip(hi_y, sizes[0]).alias("y1"), clip(lo_x, sizes[1]).alias("x0"), clip(hi_x, sizes[1]).alias("x1"), *(F.col(c).cast("double") for c in ("cy", "cx", "sy", "sx", "a")), *(c.cast("long").alias(n) for c, n in zip(sizes, "hw"))))  # else the filter below goes down to the source and grows with each step
    over = lambda lo, hi, n, r=len(taps) // 2: F.explode(F.sequence(F.expr(f"greatest({lo} - {r}, 0) div {TILE}"), F.expr(f"(least({hi} + {r}, {n}) - 1) div {TILE}")))
    met = p.filter("y0 < y1 and x0 < x1").dropna().withColumn("ty", over("y0", "y1", "h")).withColumn("tx", over("x0", "x1", "w"))
    tile = ["movie_id", "ty", "tx"]
    parts = F.ceil(F.col("n") / CROWD).cast("long")
    crowded = written(met.groupBy(tile).agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select(*tile, parts.alias("parts")))
    split = not crowded.isEmpty()
    kind, by = points.schema["movie_id"].dataType, [*tile, "salt"]

    def drawn(kernels: DataFrame, rest: list[str], tops: bool) -> DataFrame:
        return kernels.select(*KERNEL, *rest).repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda b: _tiles(b, taps, tops), "movie_id long, y long, x long, value double")

    def image(kernels: DataFrame, rest: list[str], tops: bool = False) -> DataFrame:
        light = (kernels.join(crowded, tile, "left_anti") if split else kernels).withColumn("salt", F.lit(0).cast("long"))
        out = drawn(light, rest, tops)
        if split:
            heavy = kernels.join(crowded, tile).withColumn("salt", F.pmod(F.xxhash64("cy", "cx", "sy", "sx", "a"), F.col("parts")))
            out = out.union(drawn(heavy, rest, False).groupBy("movie_id", "y", "x").agg(F.sum("value").alias("value")))
        return out

    if scaled:
        top = written(image(met, ["h", "w"], True).groupBy("movie_id").agg(F.max("value").alias("top")))
        out = image(met.join(top, "movie_id"), ["h", "w", "top"])
    else:
        out = image(met, ["h", "w"])
    return out.select(F.col("movie_id").cast(kind), F.col("y").cast("int"), F.col("x").cast("int"), "value")


def render_gaussian_pdf(locs: DataFrame, height: int, width: int, oversampling: int = 5, min_blur: float = 0.1) -> DataFrame:
    """Each localization as a normal density of its precision, over three deviations."""
    lpx = or_default("x_error", 0.5)
    lpy = F.coalesce(F.col("y_error"), lpx)
    p = viewport(locs, height, width).select("movie_id", (F.col("x") * oversampling).alias("cx"), (F.col("y") * oversampling).alias("cy"), (F.greatest(lpx, F.lit(min_blur)) * oversampling).alias("sx"), (F.greatest(lpy, F.lit(min_blur)) * oversampling).alias("sy"))
    p = p.withColumn("a", 1 / (2 * math.pi * F.col("sx") * F.col("sy")))
    centred = p.withColumns({"cy": F.col("cy") - 0.5, "cx": F.col("cx") - 0.5})  # a pixel counts at its middle
    low = lambda c, s, sign: (F.col(c) + 0.5 + sign * 3 * F.col(s)).cast("int")
    return _splat(centred, low("cy", "sy", -1), low("cy", "sy", 1) + 1, low("cx", "sx", -1), low("cx", "sx", 1) + 1, height * oversampling, width * oversampling)


def render_gaussian_peak(locs: DataFrame, height: int, width: int, mode: str = "precision", oversampling: int = 5) -> DataFrame:
    """Kernels of peak one (or photons / 1000 in mode photon), the image divided by its largest value."""
    n = or_default("photons", 1000.0)
    sigma = {"precision": F.greatest(or_default("x_error", 0.5) * oversampling, F.lit(0.5)), "photon": F.greatest(F.lit(0.5), F.least(F.lit(3.0), oversampling / F.sqrt(F.greatest(n, F.lit(1e-9)) / 1000))), "fixed": F.lit(oversampling * 0.5)}[mode]
    p = render_bounds_check(locs, height, width, oversampling).select("movie_id", (F.col("x") * oversampling).alias("cx"), (F.col("y") * oversampling).alias("cy"), sigma.alias("s"), (n / 1000 if mode == "photon" else F.lit(1.0)).alias("a"))
    p = p.withColumn("r", (3 * F.col("s")).cast("int") + 1).withColumn("ix", F.col("cx").cast("int")).withColumn("iy", F.col("cy").cast("int"))
    p = p.withColumns({"sy": F.col("s"), "sx": F.col("s")})
    return _splat(p, F.col("iy") - F.col("r"), F.col("iy") + F.col("r") + 1, F.col("ix") - F.col("r"), F.col("ix") + F.col("r") + 1, height * oversampling, width * oversampling, scaled=True)


def render_histogram(locs: DataFrame, height: int, width: int, oversampling: int = 5) -> DataFrame:
    return viewport(locs, height, width).groupBy("movie_id", (F.col("y") * oversampling).cast("int").alias("y"), (F.col("x") * oversampling).cast("int").alias("x")).agg(F.count("*").cast("double").alias("value"))


def sparse_smooth(image: DataFrame, sigma: float, sizes: DataFrame) -> DataFrame:
    """A Gaussian, cut at 4 sigma, over a sparse image: each pixel gives to those about it, mirrored at the edges. sizes: (movie_id, h, w)."""
    radius = int(4 * sigma + 0.5)
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    taps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(k / sum(kernel)).alias("k")) for d, k in zip(range(-radius, radius + 1), kernel)))
    for axis, other, size in (("x", "y", "w"), ("y", "x", "h")):
        turned = F.pmod(F.col(axis) + F.col("t.d"), 2 * F.col(size))
        p = image.join(sizes, "movie_id").withColumn("t", F.explode(taps))
        image = p.groupBy("movie_id", other, F.when(turned < F.col(size), turned).otherwise(2 * F.col(size) - 1 - turned).cast("int").alias(axis)).agg(F.sum(F.col("value") * F.col("t.k")).alias("value"))
    return image.select("movie_id", "y", "x", "value")


def render_histogram_smooth(locs: DataFrame, height: int, width: int, oversampling: int = 5, sigma: float = 0.5) -> DataFrame:
    """Counts on the super-resolution grid, smoothed, divided by the largest."""
    at = lambda c: F.floor(F.col(c) * oversampling)
    one = lambda *names: [F.lit(1.0).alias(c) for c in names]
    p = render_bounds_check(locs, height, width, oversampling).select("movie_id", at("y").alias("cy"), at("x").alias("cx"), *one("sy", "sx", "a"))
    return _splat(p, F.col("cy"), F.col("cy") + 1, F.col("cx"), F.col("cx") + 1, height * oversampling, width * oversampling, sigma, scaled=True)


def render_set(locs: DataFrame, height: int, width: int, oversampling: int = 5) -> DataFrame:
    """(mode, movie_id, y, x, value): precision, photon and histogram images, each scaled to 16 bits."""
    made = {"precision": render_gaussian_peak(locs, height, width, "precision", oversampling), "photon": render_gaussian_peak(locs, height, width, "photon", oversampling), "histogram": render_histogram_smooth(locs, height, width, oversampling)}
    out = None
    for mode, image in made.items():
        one = image.select(F.lit(mode).alias("mode"), "movie_id", "y", "x", F.floor(F.col("value") * 65535 + 1e-6).cast("int").alias("value"))
        out = one if out is None else out.union(one)
    return out


def render_weighted(locs: DataFrame, padding: float = 5.0, pixel_size: float = 10.0, sr_pixel_size: float = 2.0, blur_sigma: float = 0.5) -> DataFrame:
    """Weighted kernels over the bounds of each movie, cut at five deviations (less than 4e-6 of the peak is left out), then a blur."""
    scale = pixel_size / sr_pixel_size
    bounds = written(locs.groupBy("movie_id").agg((F.min("x") - padding).alias("bx"), (F.min("y") - padding).alias("by"), F.ceil((F.max("x") - F.min("x") + 2 * padding) * scale).cast("int").alias("w"), F.ceil((F.max("y") - F.min("y") + 2 * padding) * scale).cast("int").alias("h")))
    p = locs.join(bounds, "movie_id").select("movie_id", "w", "h", ((F.col("x") - F.col("bx")) * scale).alias("cx"), ((F.col("y") - F.col("by")) * scale).alias("cy"), render_sigma(pixel_size, sr_pixel_size).alias("s"), render_weight().alias("a"))
    p = p.withColumns({"sy": F.col("s"), "sx": F.col("s")})
    r = (5 * F.col("s")).cast("int") + 1
    lo = lambda c: F.col(c).cast("int") - r
    hi = lambda c: F.col(c).cast("int") + r + 1
    return _splat(p, lo("cy"), hi("cy"), lo("cx"), hi("cx"), F.col("h"), F.col("w"), max(0.0, blur_sigma * scale))
