"""Row filters and the filter cascade; reject reasons in the order of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locspark.functions.scalars import MAX_CHI2, MAX_ELLIPTICITY, MAX_PHOTONS, MAX_PRECISION, MAX_SIGMA, MIN_MOLECULES, MIN_PHOTONS, MIN_SIGMA, ellipticity, mean_sigma, or_default, quality_score
from locspark.operators.graph import written
from locspark.operators.spatial import knn
from locspark.operators.temporal import temporal_runs


def rules() -> dict[str, list[tuple[str, Column]]]:
    """Of each row-local filter the reject reasons, in order."""
    n, molecules, chi = or_default("photons", 0.0), F.coalesce("cluster_n_molecules", F.lit(1)), or_default("cluster_chi_squared", 0.0)
    return {
        "photons": [("low", n < MIN_PHOTONS), ("high", n > MAX_PHOTONS)],
        "precision": [("precision", or_default("localization_precision", 100.0) > MAX_PRECISION)],
        "psf_shape": [("sigma", ~mean_sigma().between(MIN_SIGMA, MAX_SIGMA)), ("ellipticity", ellipticity() > MAX_ELLIPTICITY)],
        "cluster_quality": [("molecules", molecules < MIN_MOLECULES), ("chi_squared", chi > MAX_CHI2)],
    }


def first_reason(*steps: str) -> Column:
    """The first rule that rejects the row, as step:reason; null if none does."""
    own = rules()
    return F.coalesce(*(F.when(c, f"{s}:{r}") for s in steps or own for r, c in own[s]), F.lit(None).cast("string"))


def apply_filter(locs: DataFrame, step: str) -> DataFrame:
    return locs.filter(first_reason(step).isNull())


def spatial_outliers(locs: DataFrame, k_neighbors: int = 10, threshold: float = 3.0) -> DataFrame:
    """Rows with a column outlier: mean distance of the min(k, n - 1) - 1 nearest others over `threshold` population deviations from the movie's mean, either way. Runs jobs when called.

    In movies of fewer than ten points there are none. Rows without a place are none, and have no part in the mean.
    """
    of = F.avg("distance")
    d = written(knn(locs, k_neighbors - 1).groupBy("movie_id", "loc_id").agg(of.alias("whole"), ((F.sum("distance") - F.max("distance")) / F.nullif(F.count("*") - 1, F.lit(0))).alias("but_last")))
    n = d.groupBy("movie_id").agg(F.count("*").alias("n"))
    d = d.join(n, "movie_id").select("movie_id", "loc_id", "n", F.when(F.col("n") <= k_neighbors, F.col("but_last")).otherwise(F.col("whole")).alias("mean_distance"))
    stats = d.groupBy("movie_id").agg(F.avg("mean_distance").alias("m"), F.stddev_pop("mean_distance").alias("s"))
    far = F.when((F.col("n") >= 10) & (F.col("s") > 0), F.abs(F.col("mean_distance") - F.col("m")) / F.col("s") > threshold).otherwise(False)
    marked = d.join(stats, "movie_id").select("movie_id", "loc_id", far.alias("outlier"))
    return locs.join(marked, ["movie_id", "loc_id"], "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)))


def temporal_rejects(locs: DataFrame, max_frames: int = 5, tolerance: float = 2.0) -> DataFrame:
    """Rows with a column rejected: in a run of over `max_frames` localizations in frames without a gap, near the run's first."""
    runs = temporal_runs(locs, gap=1, exact_gap=True, distance=tolerance)
    long = runs.groupBy("movie_id", "run_id").agg((F.count("*") > max_frames).alias("rejected"))
    return locs.join(runs.select("movie_id", "loc_id", "run_id").join(long, ["movie_id", "run_id"]).drop("run_id"), ["movie_id", "loc_id"])


def _survivors(locs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the row-local filters with a column outlier, and those that are none with a column rejected; each written once, as it is read twice."""
    spatial = written(spatial_outliers(written(locs.filter(first_reason().isNull()))))
    return spatial, written(temporal_rejects(spatial.filter("not outlier").drop("outlier")))


def cascade_and_funnel(locs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What all six filters keep, with the quality score, and (movie_id, step, n): how many rows each reason rejects, and how many stay. Runs jobs when called."""
    spatial, last = _survivors(locs)
    own = locs.select("movie_id", first_reason().alias("step")).filter("step is not null")
    out = own.union(spatial.filter("outlier").select("movie_id", F.lit("spatial:outlier"))).union(last.select("movie_id", F.when(F.col("rejected"), "temporal:run").otherwise("kept")))
    return last.filter("not rejected").drop("rejected").withColumn("quality_score", quality_score()), out.groupBy("movie_id", "step").agg(F.count("*").alias("n"))


def filter_cascade(locs: DataFrame) -> DataFrame:
    """All six filters in order, then the quality score."""
    return cascade_and_funnel(locs)[0]


def filter_funnel(locs: DataFrame) -> DataFrame:
    """(movie_id, step, n): how many rows each reason rejects, and how many stay."""
    return cascade_and_funnel(locs)[1]
