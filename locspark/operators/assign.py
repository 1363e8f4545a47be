"""Assignment of localizations to speckles of a label image, and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_movie(labels: DataFrame) -> list[str]:
    """movie_id, if the labels are of an image for each movie rather than of one for all."""
    return ["movie_id"] if "movie_id" in labels.columns else []


def assign_to_speckles(locs: DataFrame, labels: DataFrame, height: int, width: int, mode: str = "trunc") -> DataFrame:
    """`locs` with location and speckle_id.

    trunc: pixels by truncation; whatever is out of bounds is background. round: pixels by rounding half to even; out of
    bounds is out_of_bounds with speckle_id -1. Null, infinite and NaN coordinates are out of bounds. labels: sparse,
    (x, y, label > 0), of one image for all movies, or with a movie_id. Spark broadcasts the labels only if they are small.
    """
    cut = (lambda c: F.rint(c).try_cast("int")) if mode == "round" else (lambda c: c.try_cast("int"))
    p = locs.withColumn("px", cut(F.col("x"))).withColumn("py", cut(F.col("y")))
    inside = (F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)
    marks = labels.filter("label > 0").select(*_by_movie(labels), F.col("x").alias("px"), F.col("y").alias("py"), F.col("label").cast("int").alias("label"))
    hit = F.col("label").isNotNull() & inside
    out = F.when(hit, "nuclear_speckle")
    if mode == "round":
        out = out.when(~F.coalesce(inside, F.lit(False)), "out_of_bounds")
        number = F.when(hit, F.col("label")).when(~F.coalesce(inside, F.lit(False)), -1).otherwise(0)
    else:
        number = F.when(hit, F.col("label")).otherwise(0)
    return p.join(marks, [*_by_movie(labels), "px", "py"], "left").withColumn("location", out.otherwise("background")).withColumn("speckle_id", number).drop("px", "py", "label")


def enrichment_density(assigned: DataFrame, labels: DataFrame, height: int, width: int) -> DataFrame:
    """By movie: localizations per pixel in speckles over those in the background; 0 without either area, infinite without background ones."""
    by = _by_movie(labels)
    area = labels.filter("label > 0").groupBy(*by).agg(F.count("*").alias("speckle_area"))
    n = assigned.groupBy("movie_id").agg(F.count_if(F.col("location") == "nuclear_speckle").alias("n_speckle"), F.count_if(F.col("location") != "nuclear_speckle").alias("n_background"))
    both = (n.join(area, by, "left") if by else n.join(area)).fillna(0, ["speckle_area"]).withColumn("background_area", F.lit(height * width) - F.col("speckle_area"))
    dense = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    value = F.when((F.col("speckle_area") == 0) | (F.col("background_area") == 0), 0.0).when(F.col("n_background") == 0, float("inf")).otherwise(dense("n_speckle", "speckle_area") / F.nullif(dense("n_background", "background_area"), F.lit(0.0)))
    return both.select("movie_id", "n_speckle", "n_background", "speckle_area", "background_area", value.alias("enrichment"))


def enrichment_counts(assigned: DataFrame) -> DataFrame:
    n = assigned.groupBy("movie_id").agg(F.count("*").alias("total"), F.count_if(F.col("location") == "nuclear_speckle").alias("n_speckle"), F.count_if(F.col("location") == "background").alias("n_background"))
    return n.withColumn("enrichment", F.col("n_speckle") / F.greatest("n_background", F.lit(1))).withColumn("speckle_percent", 100 * F.col("n_speckle") / F.col("total"))


def speckle_stats(assigned: DataFrame, labels: DataFrame, molecules: bool = False) -> DataFrame:
    """By movie and label of its image, also those without molecules: count, photons, and on request the ids.

    Labels without a movie_id are of one image that all movies share, so each movie has a row for each of them.
    """
    own = labels.filter("label > 0").select(*_by_movie(labels), F.col("label").alias("speckle_id")).distinct()
    movies = assigned.select("movie_id").distinct()
    grid = own.join(movies, "movie_id", "left_semi") if _by_movie(labels) else own.join(movies)
    more = [F.sort_array(F.collect_list("loc_id")).alias("molecules")] if molecules else []
    found = assigned.filter("speckle_id > 0").groupBy("movie_id", "speckle_id").agg(F.count("*").alias("molecule_count"), F.sum("photons").alias("total_photons"), *more)
    out = grid.join(found, ["movie_id", "speckle_id"], "left").fillna(0, ["molecule_count", "total_photons"])
    return out.withColumn("molecules", F.coalesce("molecules", F.expr("cast(array() as array<bigint>)"))) if molecules else out


def points_by_location(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("movie_id", "location").agg(F.count("*").alias("n"))


def located_points(assigned: DataFrame) -> DataFrame:
    """The points of each category, as they are plotted: place, and photons over frames."""
    return assigned.select("movie_id", "location", "loc_id", "x", "y", "frame", "photons")
