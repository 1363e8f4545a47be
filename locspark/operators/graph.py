"""Connected components by smallest id, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; in local mode, where it is unset, a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        at = _own_dirs[app] = _own_dirs.get(app) or "file://" + tempfile.mkdtemp(prefix="locspark-")
    return at


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(links: DataFrame, key: str = "movie_id") -> DataFrame:
    """(key, loc_id, root): the smallest id of the component of each linked node, within each key.

    links: (key, loc_id, other_id). Nodes point to smaller ones; each round every node takes the root of what it points
    to and of its neighbours, so rounds are few even for long chains.
    """
    both = written(links.select(key, "loc_id", "other_id").union(links.select(key, F.col("other_id"), F.col("loc_id"))).distinct())
    root = written(both.groupBy(key, "loc_id").agg(F.least(F.col("loc_id"), F.min("other_id")).alias("root")))
    while True:
        of = root.select(key, F.col("loc_id").alias("other_id"), F.col("root").alias("r"))
        low = both.join(of, [key, "other_id"]).groupBy(key, "loc_id").agg(F.min("r").alias("m"))
        near = root.join(low, [key, "loc_id"]).select(key, "loc_id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        # a smaller root found by one node is offered to its old root, and all follow their root's root
        offer = near.groupBy(key, F.col("old").alias("loc_id")).agg(F.min("root").alias("offer"))
        hooked = near.join(offer, [key, "loc_id"], "left").select(key, "loc_id", "old", F.least("root", F.coalesce("offer", "root")).alias("root"))
        jump = hooked.select(key, F.col("loc_id").alias("root"), F.col("root").alias("next"))
        new = written(hooked.join(jump, [key, "root"], "left").select(key, "loc_id", "old", F.coalesce("next", "root").alias("root")))
        if new.filter("old <> root").isEmpty():
            return new.select(key, "loc_id", "root")
        root = new.select(key, "loc_id", "root")
