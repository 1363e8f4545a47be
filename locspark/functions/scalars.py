"""Column expressions on localizations."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in file names that tell the channel; the marker's win.
MARKER_WORDS = ("marker", "speckle", "sc35", "u2af", "srsf", "hnrnp", "malat", "son", "cy3", "alexa", "red", "ch1", "c1")
DAPI_WORDS = ("dapi", "hoechst", "nucleus", "nuclear", "blue", "ch2", "c2")
# Limits of the quality rules.
MIN_PHOTONS, MAX_PHOTONS, MAX_PRECISION, MIN_SIGMA, MAX_SIGMA, MAX_ELLIPTICITY, MIN_MOLECULES, MAX_CHI2 = 50.0, 50000.0, 20.0, 0.5, 3.0, 2.0, 2, 10.0


def or_default(name: str, value: float) -> Column:
    return F.coalesce(F.col(name), F.lit(value))


def classify_channel(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("|".join(MARKER_WORDS)), "marker").when(low.rlike("|".join(DAPI_WORDS)), "dapi").otherwise("other")


def precision_from_photons(photons: Column, rule: str = "sum") -> Column:
    """Localization precision in pixels from photons, the largest for none; rule "sum" or "background"."""
    over = lambda a, n: a / F.nullif(F.sqrt(photons / n), F.lit(0.0))
    if rule == "sum":
        return F.greatest(F.lit(0.1), F.least(F.lit(2.0), over(1.0, 1000)))
    return F.greatest(F.lit(0.05), F.least(F.lit(2.0), over(1.2, 100)))


def localization_precision(x_error: Column, y_error: Column, pixel_size: float = 10.0) -> Column:
    """Nanometres."""
    return F.sqrt(x_error * x_error + y_error * y_error) * pixel_size


def emitter_photons(amplitude: Column, sigma: Column) -> Column:
    return F.greatest(amplitude * (2 * math.pi) * sigma * sigma, F.lit(50.0))


def mean_sigma() -> Column:
    return (or_default("sigma_x", 1.0) + or_default("sigma_y", 1.0)) / 2


def ellipticity() -> Column:
    a, b = or_default("sigma_x", 1.0), or_default("sigma_y", 1.0)
    return F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0))


def quality_score() -> Column:
    """Product of five factors in 0 .. 1: photons, precision, width, shape, fit."""
    n, p, chi = or_default("photons", 0.0), or_default("localization_precision", 100.0), or_default("cluster_chi_squared", 1.0)
    span = MAX_PHOTONS - MIN_PHOTONS
    ideal = (1000.0 - MIN_PHOTONS) / span
    photons = F.when(n < MIN_PHOTONS, 0.1).when(n > MAX_PHOTONS, 0.5).otherwise(1 - F.abs((n - MIN_PHOTONS) / span - ideal))
    width = F.when(mean_sigma().between(MIN_SIGMA, MAX_SIGMA), 1.0).otherwise(0.3)
    shape = F.when(ellipticity() <= MAX_ELLIPTICITY, 1 - (ellipticity() - 1) / (MAX_ELLIPTICITY - 1)).otherwise(0.1)
    fit = F.when(chi <= MAX_CHI2, 1 - chi / MAX_CHI2).otherwise(0.2)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), photons * F.greatest(F.lit(0.0), 1 - p / MAX_PRECISION) * width * shape * fit))


def render_weight() -> Column:
    n, p = or_default("photons", 1000.0), or_default("localization_precision", 10.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), n / 1000)) * F.greatest(F.lit(0.1), F.least(F.lit(3.0), 20 / F.greatest(p, F.lit(1.0))))


def render_sigma(pixel_size: float = 10.0, sr_pixel_size: float = 2.0) -> Column:
    return (or_default("sigma_x", 1.2) + or_default("sigma_y", 1.2)) / 2 * (pixel_size / sr_pixel_size)


def render_format() -> list[Column]:
    """x, y, lpx, lpy, photons, frame in the storage types of a record array, with defaults."""
    lpx = or_default("x_error", 0.5)
    return [F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), lpx.cast("float").alias("lpx"), F.coalesce(F.col("y_error"), lpx).cast("float").alias("lpy"), or_default("photons", 1000.0).cast("float").alias("photons"), F.coalesce(F.col("frame"), F.lit(0)).cast("int").alias("frame")]
