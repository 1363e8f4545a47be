"""Connected components of a table of links, by alternating large-star and small-star steps, after a local reduction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.llm.common import written

_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components, one a node but the smallest of each: (node, smallest)."""
    nodes, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduces the links of a partition, a bounded number of them at a time."""
    a, b, waiting = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        waiting += batch.num_rows
        if waiting > 2_000_000:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.record_batch([pa.array(x), pa.array(y)], schema=_PAIR)
            a, b, waiting = [], [], 0
    if waiting:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        yield pa.record_batch([pa.array(x), pa.array(y)], schema=_PAIR)


#: A key with more than one row in so many is hot; there can't be more of them than that.
HOT_KEYS = 1000


def with_least(rows: DataFrame, key: str, value: str, total: int | None = None) -> DataFrame:
    """`rows`, a written table, with the columns least and n: the smallest value of their key, and how many rows it has.

    Rows of hot keys look theirs up in a broadcast table of at most `HOT_KEYS` rows, so none of them makes a task large.
    total: the number of rows, or more than that.
    """
    total = rows.count() if total is None else total
    least = rows.groupBy(key).agg(F.min(value).alias("least"), F.count("*").alias("n"))
    hot = F.broadcast(least.filter(F.col("n") * HOT_KEYS > total))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(least.filter(F.col("n") * HOT_KEYS <= total), key))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of `links` (two long columns) but the smallest of a component, which is its name.

    Links with a null end and links of a node to itself count for nothing.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b and a is not null and b is not null")
    counted = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = written(edges.mapInArrow(_local, "a long, b long"))
    state = counted(edges)
    while True:
        # large star: larger neighbours of a node go to its smallest neighbour
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        large = with_least(both, "u", "v", 2 * state[0]).filter("v > u").select(F.col("v").alias("a"), F.least("least", "u").alias("b")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        own = with_least(written(large), "a", "b", 2 * state[0])
        small = own.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("x")).select("x.a", "x.b")
        edges = written(small.filter("a <> b").distinct())
        now = counted(edges)
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
