"""Localizations from movies: one row a frame, each frame on its own, so nothing is shuffled and streams of frames work too.

frames: (movie_id, frame, height, width, pixels array<double> by raster). Frames with null or no pixels give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locspark.functions.scalars import localization_precision

LOCS = "movie_id int, frame int, peak int, x double, y double, x_error double, y_error double, photons double, intensity double, background double"
FITTED = "movie_id int, frame int, group_id int, x double, y double, x_error double, y_error double, photons double, amplitude double, sigma double, background double, n_emitters int, chi_squared double, r_squared double"


def frame_background(pixels: DataFrame, n_sigma: float = 5.0) -> DataFrame:
    """By frame: the lower quartile, the deviation of what lies below it, and their threshold (null if nothing does)."""
    by = ["movie_id", "frame"]
    low = pixels.groupBy(by).agg(F.percentile("value", 0.25).alias("background"))
    below = pixels.join(low, by).groupBy(*by, "background").agg(F.stddev_pop(F.when(F.col("value") < F.col("background"), F.col("value"))).alias("noise"))
    return below.withColumn("threshold", F.col("background") + n_sigma * F.col("noise"))


def robust_background(pixels: DataFrame) -> DataFrame:
    """By frame: the median of its lowest quarter of pixels, at least 1; 1 for fewer than four pixels."""
    by = W.partitionBy("movie_id", "frame")
    low = pixels.withColumn("r", F.row_number().over(by.orderBy("value", "y", "x"))).withColumn("n", F.count("*").over(by))
    return low.groupBy("movie_id", "frame").agg(F.greatest(F.lit(1.0), F.coalesce(F.median(F.when(F.col("r") <= F.floor(F.col("n") / 4), F.col("value"))), F.lit(1.0))).alias("background"))


def _blur(image: np.ndarray, sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    weights /= weights.sum()
    for axis in (0, 1):
        n, wide = image.shape[axis], np.pad(image, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        image = sum(w * np.take(wide, range(i, i + n), axis) for i, w in enumerate(weights))
    return image


def peaks(image: np.ndarray, distance: int, threshold: float, border: int) -> np.ndarray:
    """(y, x) of the pixels over the threshold that are first within `distance` either way, the largest first, of equals by raster."""
    rank = np.empty(image.size, np.int64)
    rank[np.argsort(-image, axis=None, kind="stable")] = np.arange(image.size, 0, -1)
    rank = rank.reshape(image.shape)
    best = rank
    for axis in (0, 1):
        n, wide = image.shape[axis], np.pad(best, [(distance, distance) if a == axis else (0, 0) for a in (0, 1)])
        best = np.max([np.take(wide, range(i, i + n), axis) for i in range(2 * distance + 1)], 0)
    own = (best == rank) & (image > threshold)
    inside = np.zeros_like(own)
    inside[border : image.shape[0] - border, border : image.shape[1] - border] = True
    found = np.argwhere(own & inside)
    return found[np.argsort(-rank[tuple(found.T)])]


def _window(image: np.ndarray, y: int, x: int, half: int) -> tuple[int, int, np.ndarray]:
    top, left = max(0, y - half), max(0, x - half)
    return top, left, image[top : y + half + 1, left : x + half + 1]


def _centroid(window: np.ndarray) -> tuple[float, float]:
    ys, xs = np.indices(window.shape)
    return float((ys * window).sum() / window.sum()), float((xs * window).sum() / window.sum())


def _by_frame(frames: DataFrame, schema: str, of: Callable[[np.ndarray], Iterator[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for movie, frame, h, w, raw in batch.itertuples(index=False):
                if raw is not None and len(raw):
                    rows = [(movie, frame, *r) for r in of(np.asarray(raw, float).reshape(int(h), int(w)))]
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    return frames.select("movie_id", "frame", "height", "width", "pixels").mapInPandas(run, schema)


def localize_centroid(frames: DataFrame, spot_size: int = 3, min_photons: float = 100.0, percentile: float = 99.5) -> DataFrame:
    """Peaks of the smoothed frame over its percentile; the centre of mass of the raw window about each."""

    def of(image):
        smooth = _blur(image, 1.0).round(9)
        for k, (y, x) in enumerate(peaks(smooth, spot_size, np.percentile(smooth, percentile), spot_size)):
            top, left, window = _window(image, y, x, spot_size)
            total = float(window.sum())
            if total >= min_photons and total > 0:
                cy, cx = _centroid(window)
                error = float(np.clip(1 / np.sqrt(total / 1000), 0.1, 2.0))
                yield k, left + cx, top + cy, error, error, total, float(window.max()), 0.0

    return _by_frame(frames, LOCS, of)


def localize_bgsub(frames: DataFrame, half_window: int = 4, min_intensity: float = 100.0, n_sigma: float = 5.0, max_frames: int = 1000) -> DataFrame:
    """Peaks of the raw frame over its background; centre of mass after the window's own lower quartile is taken off. First 1000 frames of a movie."""

    def of(image):
        low = np.percentile(image, 25)
        below = image[image < low]
        if not len(below):
            return
        for k, (y, x) in enumerate(peaks(image, 3, low + n_sigma * below.std(), 5)):
            top, left, window = _window(image, y, x, half_window)
            ground = float(np.percentile(window, 25))
            light = np.maximum(window - ground, 0)
            total = float(light.sum())
            if total >= min_intensity and total > 0:
                cy, cx = _centroid(light)
                error = float(np.clip(1.2 / np.sqrt(total / 100), 0.05, 2.0))
                yield k, left + cx, top + cy, error, error, total, float(window.max()), ground

    return _by_frame(frames.filter(F.col("frame") < max_frames), LOCS, of)


def grouped(points: np.ndarray, reach: float) -> list[np.ndarray]:
    """Greedy groups of points in order: the first that is free takes all free ones within reach of it."""
    free, out = np.ones(len(points), bool), []
    for i in range(len(points)):
        if free[i]:
            own = np.flatnonzero(free & (((points - points[i]) ** 2).sum(1) <= reach * reach))
            own = np.concatenate(([i], own[own != i]))
            free[own] = False
            out.append(own)
    return out


def group_peaks(found: DataFrame, max_distance: float = 5.0) -> DataFrame:
    """(movie_id, frame, group_id, rank, y, x) of peaks (movie_id, frame, y, x, value), the largest first, of equals by raster."""
    schema = "movie_id int, frame int, group_id int, rank int, y int, x int"

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "y", "x"], ascending=[False, True, True])
        at = pdf[["y", "x"]].to_numpy()
        rows = [(g, r, *map(int, at[i])) for g, own in enumerate(grouped(at, max_distance)) for r, i in enumerate(own)]
        out = pd.DataFrame(rows, columns=["group_id", "rank", "y", "x"])
        return out.assign(movie_id=pdf["movie_id"].iloc[0], frame=pdf["frame"].iloc[0])[["movie_id", "frame", "group_id", "rank", "y", "x"]]

    return found.select("movie_id", "frame", "y", "x", "value").groupBy("movie_id", "frame").applyInPandas(of, schema)


def _low_quarter(image: np.ndarray) -> float:
    low = np.sort(image, axis=None)[: image.size // 4]
    return max(1.0, float(np.median(low))) if len(low) else 1.0


def fit_spots(window: np.ndarray, starts: np.ndarray, sigma_range: tuple[float, float] = (0.8, 3.0), rounds: int = 1000):
    """Bounded least squares of a background and a Gaussian a start: (parameters, their covariance or None, squared error).

    Parameters: background, then amplitude, y, x, sigma of each. Steps are damped until they lower the error, and cut to
    the bounds. None if pixels don't outnumber parameters.
    """
    ys, xs = (a.ravel().astype(float) for a in np.indices(window.shape))
    data, k = window.ravel(), len(starts)
    if data.size <= 1 + 4 * k:
        return None
    ground = _low_quarter(window)
    p = np.concatenate([[ground], *([max(window[y, x] - ground, 10.0), y, x, 1.2] for y, x in starts)])
    lo = np.array([0.0] + [10.0, -2.0, -2.0, sigma_range[0]] * k)
    hi = np.array([np.inf] + [np.inf, window.shape[0] + 2.0, window.shape[1] + 2.0, sigma_range[1]] * k)

    def model(p):
        a, y, x, s = (p[1 + i :: 4][:, None] for i in range(4))
        dy, dx = ys - y, xs - x
        bell = np.exp(-(dy * dy + dx * dx) / (2 * s * s))
        slopes = np.stack([bell, a * bell * dy / s**2, a * bell * dx / s**2, a * bell * (dy * dy + dx * dx) / s**3], 1)
        return p[0] + (a * bell).sum(0), np.vstack([np.ones((1, data.size)), slopes.reshape(4 * k, -1)]).T

    fit, slope = model(p)
    error, damp = float(((data - fit) ** 2).sum()), 1e-3
    for _ in range(rounds):
        normal = slope.T @ slope
        step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), slope.T @ (data - fit), rcond=None)[0]
        new = np.clip(p + step, lo, hi)
        fit2, slope2 = model(new)
        error2 = float(((data - fit2) ** 2).sum())
        if error2 < error:
            done = error - error2 <= 1e-10 * error
            p, fit, slope, error, damp = new, fit2, slope2, error2, max(damp / 5, 1e-12)
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    normal = slope.T @ slope
    if np.linalg.cond(normal) > 1e14:
        return p, None, error
    return p, np.linalg.inv(normal) * error / (data.size - len(p)), error


def localize_grouped(frames: DataFrame, method: str = "fit", detection_threshold: float = 5.0, min_distance: int = 2, max_emitters: int = 10, fitting_window: int = 7, sigma_range: tuple[float, float] = (0.8, 3.0)) -> DataFrame:
    """Peaks of the enhanced frame, near ones in groups, each group fitted as a sum of Gaussians.

    Where a fit isn't possible (or with method centroid): the weighted centre of 5 x 5 pixels about each peak, errors
    0.2, chi squared 999. Errors are 0.1 where the fit has no covariance. At most ten emitters a group, the brightest.
    The columns are those that filters and clusters read: figures of the group's fit as cluster_*, and sigma_x and sigma_y alike.
    """
    half = fitting_window // 2

    def plain(image, own, ground):
        for y, x in own:
            top, left, w = _window(image, y, x, 2)
            cy, cx = _centroid(w) if w.sum() > 0 else (y - top, x - left)
            yield left + cx, top + cy, 0.2, 0.2, max(float(w.sum()) - ground * w.size, 50.0), max(float(image[y, x]) - ground, 0.0), 1.2, ground, len(own), 999.0, 0.0

    def fitted(image, own):
        cy, cx = (int(v) for v in own.mean(0))
        top, left, window = _window(image, cy, cx, half)
        own = own[:max_emitters]
        starts = np.clip(own - [top, left], 0, np.array(window.shape) - 1)
        fit = fit_spots(window, starts, sigma_range) if method == "fit" else None
        if fit is None:
            yield from plain(image, own, _low_quarter(window))
            return
        p, covariance, error = fit
        spread = np.sqrt(np.abs(np.diag(covariance))) if covariance is not None else np.full(len(p), 0.1)
        total = float(((window - window.mean()) ** 2).sum())
        for i in range(len(own)):
            a, y, x, s = (float(v) for v in p[1 + 4 * i : 5 + 4 * i])
            yield left + x, top + y, float(spread[3 + 4 * i]), float(spread[2 + 4 * i]), max(a * 2 * np.pi * s * s, 50.0), a, s, float(p[0]), len(own), error / (window.size - len(p)), 1 - error / total if total > 0 else 0.0

    def of(image):
        below = image[image < np.percentile(image, 25)]
        if not len(below):
            return
        fine, mid, coarse = (_blur(image, s) for s in (0.5, 1.5, 3.0))
        enhanced = np.maximum(0, mid - coarse + 0.5 * (fine - mid)).round(9)
        found = peaks(enhanced, min_distance, _low_quarter(image) + detection_threshold * below.std(), 3)
        for g, own in enumerate(grouped(found, fitting_window / 2)):
            yield from ((g, *r) for r in fitted(image, found[own]))

    found = _by_frame(frames, FITTED, of)
    names = {"n_emitters": "cluster_n_molecules", "chi_squared": "cluster_chi_squared", "r_squared": "cluster_r_squared"}
    return found.withColumnsRenamed(names).withColumns({"sigma_x": F.col("sigma"), "sigma_y": F.col("sigma"), "localization_precision": localization_precision(F.col("x_error"), F.col("y_error"))}).drop("sigma")


def fit_quality(windows: DataFrame, fits: DataFrame, emitters: DataFrame, key: str = "group_id") -> DataFrame:
    """(key, chi_squared, r_squared) of fits (key, background) with emitters (key, x, y, sigma, amplitude) over the pixels (key, y, x, value).

    chi squared is null where pixels don't outnumber parameters; r squared is 0 over constant pixels. A fit without
    emitters is its background.
    """
    e = emitters.select(key, F.col("x").alias("ex"), F.col("y").alias("ey"), "sigma", "amplitude")
    light = F.col("amplitude") * F.exp(-((F.col("x") - F.col("ex")) * (F.col("x") - F.col("ex")) + (F.col("y") - F.col("ey")) * (F.col("y") - F.col("ey"))) / (2 * F.col("sigma") * F.col("sigma")))
    model = windows.join(e, key, "left").groupBy(key, "y", "x", "value").agg(F.coalesce(F.sum(light), F.lit(0.0)).alias("light"), F.count("amplitude").alias("k"))
    rest = F.col("value") - F.col("background") - F.col("light")
    g = model.join(fits.select(key, "background"), key).groupBy(key).agg(F.sum(rest * rest).alias("ss"), F.count("*").alias("n"), F.max("k").alias("k"), (F.var_pop("value") * F.count("*")).alias("total"))
    free = F.col("n") - 1 - 4 * F.col("k")
    return g.select(key, F.when(free > 0, F.col("ss") / free).alias("chi_squared"), F.when(F.col("total") > 0, 1 - F.col("ss") / F.col("total")).otherwise(0.0).alias("r_squared"))
