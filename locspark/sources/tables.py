"""Reading and writing localizations and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locspark.functions.scalars import classify_channel

_D, _I = T.DoubleType(), T.IntegerType()
LOCALIZATION = T.StructType([T.StructField("movie_id", _I), T.StructField("loc_id", T.LongType()), T.StructField("frame", _I)] + [T.StructField(n, _D) for n in ("x", "y", "photons", "sigma_x", "sigma_y", "x_error", "y_error", "amplitude", "background")] + [T.StructField("cluster_n_molecules", _I)] + [T.StructField(n, _D) for n in ("cluster_chi_squared", "cluster_r_squared", "localization_precision", "quality_score")] + [T.StructField("cluster_id", _I), T.StructField("sub_cluster_id", _I)])
IMAGE_FILE = r"(?i)\.(tif|tiff|png|jpg|nd2|czi)$"


def with_schema(locs: DataFrame, fill: bool = False) -> DataFrame:
    """The columns of a localization table, in order; missing ones null, or 0 with fill."""
    have = set(locs.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType) for f in LOCALIZATION]
    return locs.select(*((F.coalesce(c, F.lit(0).cast(f.dataType)) if fill else c).alias(f.name) for c, f in zip(cols, LOCALIZATION)))


def read_localizations(spark: SparkSession, path: str) -> DataFrame:
    return with_schema(spark.read.parquet(path))


def write_localizations(locs: DataFrame, path: str, csv: bool = False) -> None:
    """Listed fields only, by movie; numbers that are missing are 0."""
    out = with_schema(locs, fill=True).write
    out.option("header", True).csv(path) if csv else out.partitionBy("movie_id").parquet(path)


def write_bundle(path: str, **tables: DataFrame) -> None:
    """Each table in a folder of its name."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def localization_metadata(locs: DataFrame, parameters: dict | None = None) -> DataFrame:
    pairs = [F.lit(str(x)) for kv in sorted((parameters or {}).items()) for x in kv]
    return locs.groupBy("movie_id").agg(
        F.count("*").alias("n_localizations"), (F.max("frame") + 1).alias("n_frames"), F.min("photons").alias("min_photons"), F.max("photons").alias("max_photons"),
        F.min("quality_score").alias("min_quality"), F.max("quality_score").alias("max_quality"), F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("n_clusters"),
    ).withColumn("parameters", F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)"))


FRAME = "movie_id int, frame int, height int, width int, pixels array<double>"


def read_frame_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Frames as a stream: files of rows (`FRAME`) in a folder, also those that come later. The localizers take it as they take a table, as they keep no state from frame to frame."""
    return spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_stream(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """A stream's rows added to a table; by default all that is there, then the query ends. checkpoint: a folder that all machines share."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).outputMode("append").start(path)


def frames_to_pixels(frames: DataFrame) -> DataFrame:
    """(movie_id, frame, y, x, value) of frames with row-major pixel arrays."""
    return frames.select("movie_id", "frame", "width", F.posexplode("pixels").alias("i", "value")).select("movie_id", "frame", F.expr("cast(i div width as int)").alias("y"), (F.col("i") % F.col("width")).alias("x"), "value")


def pixels_to_frames(pixels: DataFrame) -> DataFrame:
    """One row for each frame; a frame is one image and fits a row."""
    g = pixels.groupBy("movie_id", "frame").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.array_sort(F.collect_list(F.struct("y", "x", "value"))).alias("p"))
    return g.select("movie_id", "frame", "height", "width", F.col("p.value").alias("pixels"))


def image_catalog(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct image files by name, with their channel."""
    name = F.element_at(F.split(F.col(column), "/"), -1)
    return paths.select(name.alias("name")).filter(F.col("name").rlike(IMAGE_FILE)).distinct().withColumn("channel", classify_channel(F.col("name")))


def select_channel(pixels: DataFrame, how: str = "first") -> DataFrame:
    """One channel of images with a column channel: the first, or the mean of all."""
    if how == "first":
        return pixels.filter("channel = 0").drop("channel")
    return pixels.groupBy("image_id", "y", "x").agg(F.avg("value").alias("value"))
