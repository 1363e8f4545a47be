"""Aggregates over localizations and clusters, histograms."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locspark.functions.scalars import or_default
from locspark.operators.ordered import in_order, with_previous


def localization_summary(locs: DataFrame) -> DataFrame:
    return locs.groupBy("movie_id").agg(F.count("*").alias("n"), F.avg("localization_precision").alias("mean_precision"), F.stddev_pop("localization_precision").alias("std_precision"), F.avg("photons").alias("mean_photons"), F.stddev_pop("photons").alias("std_photons"))


def _in_any_order(exact: Callable[[Column], Column], plain: Callable[[Column], Column], value: Column) -> Column:
    """An aggregate that is the same for any order of rows: of the decimals that the numbers read as, to 22 places.

    Sums of doubles depend on their order in the last bits, and so does a mean that lies halfway between two figures.
    Where 22 places are too few or 38 digits too short (largest number under 1e-5 or over 1e11, NaN, sums from 1e16 on),
    doubles are added up.
    """
    v = value.cast("double")
    fits = F.max(F.abs(v)).between(1e-5, 1e11)
    return F.when(fits, F.coalesce(exact(v.try_cast("decimal(38,22)")).cast("double"), plain(v))).otherwise(plain(v))


def _total(value: Column) -> Column:
    return _in_any_order(F.try_sum, F.sum, value)


def _mean(value: Column) -> Column:
    return _in_any_order(F.try_avg, F.avg, value)


def cluster_properties(locs: DataFrame, pixel_size: float = 10.0) -> DataFrame:
    """By movie and cluster: place, extent, density, photons, quality, times, compactness.

    Sums and means don't depend on the order of rows (`_in_any_order`); std_photons does, in its last bits.
    """
    by = ["movie_id", "cluster_id"]
    own = locs.filter("cluster_id <> -1")
    photons, quality, precision = or_default("photons", 0.0), or_default("quality_score", 0.5), or_default("localization_precision", 10.0)
    g = own.groupBy(by).agg(
        F.count("*").alias("n_molecules"), _mean(F.col("x")).alias("mean_x"), _mean(F.col("y")).alias("mean_y"), (F.max("x") - F.min("x")).alias("x_extent"), (F.max("y") - F.min("y")).alias("y_extent"),
        _total(photons).alias("total_photons"), _mean(photons).alias("mean_photons"), F.stddev_pop(photons).alias("std_photons"), _mean(quality).alias("mean_quality"), _mean(precision).alias("mean_precision"),
        (F.max("frame") - F.min("frame") + 1).alias("frame_span"),
    )
    g = g.withColumn("area", F.col("x_extent") * F.col("y_extent")).withColumn("area_nm2", F.col("area") * pixel_size**2).withColumn("radius", F.sqrt(F.col("area") / math.pi)).withColumn("radius_nm", F.col("radius") * pixel_size)
    g = g.withColumn("density", F.col("n_molecules") / F.greatest("area", F.lit(1.0))).withColumn("density_um2", F.col("density") * (1000 / pixel_size) ** 2).withColumn("temporal_density", F.col("n_molecules") / F.greatest("frame_span", F.lit(1)))
    away = F.sqrt((F.col("x") - F.col("mean_x")) * (F.col("x") - F.col("mean_x")) + (F.col("y") - F.col("mean_y")) * (F.col("y") - F.col("mean_y")))
    compact = own.join(g.select(*by, "mean_x", "mean_y"), by).groupBy(by).agg((_mean(away) * pixel_size).alias("compactness_nm"))
    return g.join(compact, by)


def cluster_stats(locs: DataFrame) -> DataFrame:
    size = locs.groupBy("movie_id", "cluster_id").agg(F.count("*").alias("n"))
    own = F.when(F.col("cluster_id") != -1, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col("cluster_id") == -1, F.col("n"))), F.lit(0))
    return size.groupBy("movie_id").agg(F.count(own).alias("n_clusters"), noise.alias("n_noise"), (noise / F.sum("n")).alias("noise_fraction"), F.min(own).alias("min_size"), F.max(own).alias("max_size"), F.avg(own).alias("mean_size"))


def cluster_table(locs: DataFrame) -> DataFrame:
    g = locs.filter("cluster_id <> -1").groupBy("movie_id", "cluster_id").agg(F.count("*").alias("n"), F.avg(or_default("photons", 1000.0)).alias("mean_photons"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    return g.withColumn("density", F.col("n") / F.greatest("area", F.lit(1.0)))


def cluster_ellipses(locs: DataFrame) -> DataFrame:
    return locs.filter("cluster_id <> -1").groupBy("movie_id", "cluster_id").agg(F.count("*").alias("n"), F.avg("x").alias("center_x"), F.avg("y").alias("center_y"), (4 * F.stddev_pop("x")).alias("width"), (4 * F.stddev_pop("y")).alias("height")).filter("n >= 3").drop("n")


def cluster_lifetimes(locs: DataFrame) -> DataFrame:
    return locs.filter("cluster_id <> -1").groupBy("movie_id", "cluster_id").agg(F.count("*").alias("size"), (F.max("frame") - F.min("frame") + 1).alias("lifetime"))


def locs_per_frame(locs: DataFrame) -> DataFrame:
    return locs.groupBy("movie_id", "frame").agg(F.count("*").alias("n"))


def top_clusters(locs: DataFrame, n: int = 10) -> DataFrame:
    """Rows of the n smallest cluster ids of each movie."""
    ids = locs.filter("cluster_id <> -1").select("movie_id", "cluster_id").distinct()
    first = ids.withColumn("r", F.row_number().over(W.partitionBy("movie_id").orderBy("cluster_id"))).filter(F.col("r") <= n).drop("r")
    return locs.join(first, ["movie_id", "cluster_id"], "left_semi")


def cluster_frames(locs: DataFrame, n: int = 10) -> DataFrame:
    return top_clusters(locs, n).groupBy("movie_id", "cluster_id", "frame").agg(F.count("*").alias("n"))


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> tuple[Column, Column, Column]:
    """Bin number and edges; one value alone gets half a unit to either side, and the last bin is closed."""
    a, b = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    return F.least(F.floor((value - a) / (b - a) * bins), F.lit(bins - 1)), a, b


def histogram(df: DataFrame, column: str, bins: int, key: str = "movie_id") -> DataFrame:
    """(key, bin, lo, hi, n) of all bins between the key's smallest and largest value, empty ones too."""
    v = df.filter(F.col(column).isNotNull()).select(key, F.col(column).cast("double").alias("v"))
    bounds = v.groupBy(key).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    number, a, b = _bin(F.col("v"), F.col("a"), F.col("b"), bins)
    n = v.join(bounds, key).groupBy(key, number.alias("bin")).agg(F.count("*").alias("n"))
    grid = bounds.select(key, a.alias("a"), b.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(n, [key, "bin"], "left").select(key, "bin", (F.col("a") + (F.col("b") - F.col("a")) / bins * F.col("bin")).alias("lo"), (F.col("a") + (F.col("b") - F.col("a")) / bins * (F.col("bin") + 1)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram2d(df: DataFrame, first: str, second: str, bins: int = 30, key: str = "movie_id") -> DataFrame:
    """(key, bin_1, bin_2, n) of the bins that aren't empty."""
    v = df.select(key, F.col(first).cast("double").alias("v"), F.col(second).cast("double").alias("w")).dropna()
    bounds = v.groupBy(key).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.min("w").alias("c"), F.max("w").alias("d"))
    return v.join(bounds, key).groupBy(key, _bin(F.col("v"), F.col("a"), F.col("b"), bins)[0].alias("bin_1"), _bin(F.col("w"), F.col("c"), F.col("d"), bins)[0].alias("bin_2")).agg(F.count("*").alias("n"))


def photon_boxplot(locs: DataFrame, n: int = 10) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 quartile distances, and the number of values beyond."""
    by = ["movie_id", "cluster_id"]
    own = top_clusters(locs, n).select(*by, or_default("photons", 0.0).alias("v"))
    q = own.groupBy(by).agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    inside = F.col("v").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return own.join(q, by).groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.count_if(~inside).alias("n_fliers"))


def image_bounds(locs: DataFrame, padding: float = 5.0) -> DataFrame:
    return locs.groupBy("movie_id").agg((F.min("x") - padding).alias("x_min"), (F.max("x") + padding).alias("x_max"), (F.min("y") - padding).alias("y_min"), (F.max("y") + padding).alias("y_max"))


def dataset_summary(locs: DataFrame) -> DataFrame:
    noise = F.count_if(F.col("cluster_id") == -1)
    clusters = F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id")))
    g = locs.groupBy("movie_id").agg(F.count("*").alias("n"), clusters.alias("n_clusters"), noise.alias("n_noise"), F.sum("photons").alias("total_photons"), F.avg("photons").alias("mean_photons"), F.avg(or_default("quality_score", 0.5)).alias("mean_quality"))
    return g.withColumn("noise_percent", 100 * F.col("n_noise") / F.col("n")).withColumn("mean_cluster_size", (F.col("n") - F.col("n_noise")) / F.nullif("n_clusters", F.lit(0)))


def frame_intervals(locs: DataFrame) -> DataFrame:
    """(movie_id, loc_id, gap): frames since the row before it, in order of frame and id. Runs jobs when called."""
    rows = with_previous(in_order(locs.select("movie_id", "loc_id", "frame"), "movie_id", ["frame", "loc_id"]), "movie_id", ["frame"])
    return rows.select("movie_id", "loc_id", (F.col("frame") - F.col("previous.frame")).alias("gap")).filter("gap is not null")


def rank_in_cluster(locs: DataFrame) -> DataFrame:
    return locs.filter("cluster_id <> -1").select("movie_id", "loc_id", "cluster_id", (F.row_number().over(W.partitionBy("movie_id", "cluster_id").orderBy("loc_id")) - 1).alias("rank"))


def validate_temporal(locs: DataFrame, min_size: int = 2, max_density: float = 0.5, max_simultaneous: int = 5) -> DataFrame:
    """`locs`, with clusters that are too small, or too dense in time and too many at once, turned to noise."""
    by = ["movie_id", "cluster_id"]
    own = locs.filter("cluster_id <> -1")
    at_once = own.groupBy(*by, "frame").agg(F.count("*").alias("n")).groupBy(by).agg(F.max("n").alias("most"))
    g = own.groupBy(by).agg(F.count("*").alias("n"), (F.max("frame") - F.min("frame") + 1).alias("span")).join(at_once, by)
    bad = g.filter((F.col("n") < min_size) | ((F.col("n") / F.col("span") > max_density) & (F.col("most") > F.least(F.lit(max_simultaneous), F.floor(F.col("n") / 2))))).select(*by, F.lit(True).alias("bad"))
    return locs.join(bad, by, "left").withColumn("cluster_id", F.when(F.col("bad"), -1).otherwise(F.col("cluster_id"))).drop("bad")


def attach_cluster_labels(locs: DataFrame, labels: DataFrame) -> DataFrame:
    return locs.drop("cluster_id", "sub_cluster_id").join(labels.select("movie_id", "loc_id", "cluster_id", "sub_cluster_id"), ["movie_id", "loc_id"], "left").fillna({"cluster_id": -1, "sub_cluster_id": 0})
