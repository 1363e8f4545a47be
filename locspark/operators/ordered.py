"""Order across partitions: rows in one order by key, spread by ranges of it, with what a range needs of those before carried forward.

A key of any number of rows is spread over all partitions; windows run over one key's rows of one partition, and over tables
that have a row for each key and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locspark.operators.graph import written


def in_order(df: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """`df` in order of key, then `order`, as a written table with the columns part and place: the partition of a row, and a number that rises in the order. Runs jobs when called."""
    by = [F.col(key), *order]
    return written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))


def _before(key: str) -> W:
    return W.partitionBy(key).orderBy("part")


def with_numbers(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """`rows` (of `in_order`) with the number of each within its key, from 1."""
    parts = rows.groupBy(key, "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    parts = parts.select(F.col(key).alias("_key"), F.col("part").alias("_part"), (F.coalesce(F.sum("n").over(_before(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("first") + 1).alias("_shift"))
    return rows.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part"))).withColumn(name, F.col("place") + F.col("_shift")).drop("_key", "_part", "_shift")


def with_previous(rows: DataFrame, key: str, columns: list[str], name: str = "previous") -> DataFrame:
    """`rows` (of `in_order`) with a struct of the given columns of the row before it of its key; null for the first."""
    own = F.struct(*columns)
    parts = rows.groupBy(key, "part").agg(F.max_by(own, "place").alias("last"))
    parts = parts.select(F.col(key).alias("_key"), F.col("part").alias("_part"), F.lag("last").over(_before(key)).alias("_carried"))
    inside = rows.withColumn(name, F.lag(own).over(W.partitionBy(key, "part").orderBy("place")))
    both = inside.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")))
    return both.withColumn(name, F.coalesce(name, "_carried")).drop("_key", "_part", "_carried")


def last_mark(rows: DataFrame, key: str, mark: Column, name: str) -> DataFrame:
    """`rows` (of `in_order`) with the place of the last marked row of its key, up to and with itself; null before the first."""
    place = F.when(mark, F.col("place"))
    parts = rows.groupBy(key, "part").agg(F.max(place).alias("last"))
    parts = parts.select(F.col(key).alias("_key"), F.col("part").alias("_part"), F.max("last").over(_before(key).rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    inside = rows.withColumn(name, F.max(place).over(W.partitionBy(key, "part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    both = inside.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")))
    return both.withColumn(name, F.coalesce(name, "_carried")).drop("_key", "_part", "_carried")
