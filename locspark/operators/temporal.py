"""Greedy runs over localizations sorted by frame, without a walk: sure breaks over the whole order, then anchors by pointer doubling.

Rows lie in order of movie, frame and id over all partitions (see `ordered`). Where a row can't go on with any run that
holds the row before it, an island ends; islands are whole in one task, so a movie spreads by its islands. Within islands each
row finds the first row that would break a run anchored at it: blocks of rows of doubling length are skipped as long as
the box about them fits. The rows that are anchors are those that the island's first row reaches by these pointers, which are
doubled until all are found. All islands of a task are worked on side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.operators.ordered import in_order, last_mark, with_numbers, with_previous

#: Rows that a task works on at once, besides a longer island, and the longest block that is skipped, as a power of two.
STRETCH, SKIP = 200_000, 12


def first_breaks(ends: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray, gap: int | None, distance: float, closed: bool) -> np.ndarray:
    """For each row the first later one, or the end of its island, that doesn't lie within `distance` of it (at `distance` too if closed) and `gap` frames, if given."""
    n = len(ends)
    levels = min(SKIP, int((ends - np.arange(n)).max(initial=1)).bit_length())
    boxes = [(x, x, y, y)]
    for k in range(levels - 1):
        half = 1 << k
        shift = lambda a: np.concatenate((a[half:], a[-1:].repeat(min(half, n))))  # noqa: B023, E731
        low_x, high_x, low_y, high_y = boxes[-1]
        boxes.append((np.minimum(low_x, shift(low_x)), np.maximum(high_x, shift(high_x)), np.minimum(low_y, shift(low_y)), np.maximum(high_y, shift(high_y))))
    boxes = [np.stack(c) for c in zip(*boxes)]
    at, k = np.arange(1, n + 1), np.zeros(n, np.int64)
    rows = np.flatnonzero(at < ends)
    while len(rows):
        j, level = at[rows], k[rows]
        stop = j + (1 << level)
        fits = stop <= ends[rows]
        low_x, high_x, low_y, high_y = (b[level, j] for b in boxes)
        dx, dy = np.maximum(np.abs(low_x - x[rows]), np.abs(high_x - x[rows])), np.maximum(np.abs(low_y - y[rows]), np.abs(high_y - y[rows]))
        away = np.sqrt(dx * dx + dy * dy)
        fits &= away <= distance if closed else away < distance
        if gap is not None:
            fits &= frame[np.minimum(stop, n) - 1] - frame[rows] <= gap
        at[rows] = np.where(fits, stop, j)
        k[rows] = np.where(fits, np.minimum(level + 1, levels - 1), level - 1)
        rows = rows[(k[rows] >= 0) & (at[rows] < ends[rows])]
    return at


def reached(starts: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which rows the starts reach by pointers to later rows (or to the end), which are doubled each round."""
    mark = np.zeros(len(following) + 1, bool)
    mark[starts] = True
    jump = np.append(following, len(following))
    while True:
        before = int(mark.sum())
        mark[jump[mark]] = True
        jump = jump[jump]
        if int(mark.sum()) == before:
            return mark[:-1]


def run_starts(island: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray, gap: int | None, distance: float, closed: bool) -> np.ndarray:
    """For each row the index of its run's first; rows of an island stand together, in order."""
    n = len(island)
    starts = np.flatnonzero(np.concatenate(([True], island[1:] != island[:-1]))) if n else np.zeros(0, np.int64)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    anchor = reached(starts, first_breaks(ends, frame, x, y, gap, distance, closed))
    return np.maximum.accumulate(np.where(anchor, np.arange(n), 0))


def _runs(batches: Iterator[pa.RecordBatch], gap: int | None, distance: float, closed: bool) -> Iterator[pa.RecordBatch]:
    """Rows (movie_id, loc_id, island, frame, x, y) in order of islands, a stretch of whole islands at a time."""

    def cut(table: pa.Table) -> pa.RecordBatch:
        movie, ids, island, frame, x, y = (c.to_numpy() for c in table.columns)
        first = run_starts(island, frame, x, y, gap, distance, closed)
        return pa.record_batch([pa.array(movie), pa.array(ids), pa.array(ids[first])], names=["movie_id", "loc_id", "run_id"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= STRETCH:
            table = pa.Table.from_batches(waiting).combine_chunks()
            island = table["island"].to_numpy()
            last = int(np.searchsorted(island, island[-1]))  # the last island may go on
            if last:
                yield cut(table.slice(0, last))
                waiting = table.slice(last).to_batches()
    if waiting:
        yield cut(pa.Table.from_batches(waiting))


def temporal_runs(locs: DataFrame, gap: int, exact_gap: bool, distance: float) -> DataFrame:
    """(movie_id, loc_id, run_id): rows in order of frame and id, cut into runs; run_id is the id of the run's first. Runs jobs when called.

    exact_gap: a row goes on with the run if its frame is the row before's plus `gap` and it lies nearer than `distance`
    to the run's first; else if its frame is at most the first's plus `gap` and it lies within `distance` of the first.
    A null frame counts as 0; a row without a place (null or NaN) is a run of its own.
    """
    kind = locs.schema["movie_id"].dataType.simpleString()
    p = locs.select("movie_id", F.col("loc_id").cast("long").alias("loc_id"), F.coalesce(F.col("frame").cast("long"), F.lit(0)).alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = with_previous(in_order(p, "movie_id", ["frame", "loc_id"]), "movie_id", ["frame", "x", "y"])
    step, dx, dy = F.col("frame") - F.col("previous.frame"), F.col("x") - F.col("previous.x"), F.col("y") - F.col("previous.y")
    sure = (step != gap if exact_gap else step > gap) | (F.sqrt(dx * dx + dy * dy) > 2 * distance + 1e-9)
    islands = last_mark(rows.withColumn("sure", F.coalesce(sure, F.lit(True))), "movie_id", F.col("sure"), "island")
    # places of different movies differ, so islands do
    spread = islands.select("movie_id", "loc_id", "island", "frame", "x", "y", "place").repartition("island").sortWithinPartitions("island", "place").drop("place")
    return spread.mapInArrow(lambda b: _runs(b, None if exact_gap else gap, distance, not exact_gap), f"movie_id {kind}, loc_id long, run_id long")


def temporal_link(locs: DataFrame, temporal_window: int = 10, spatial_precision: float = 2.0, min_size: int = 2) -> DataFrame:
    """(movie_id, temporal_cluster_id, loc_id): groups of at least min_size, numbered in order of their first rows."""
    runs = temporal_runs(locs, gap=temporal_window, exact_gap=False, distance=spatial_precision)
    size = runs.groupBy("movie_id", "run_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    first = size.join(locs.select("movie_id", F.col("loc_id").alias("run_id"), "frame"), ["movie_id", "run_id"])
    number = with_numbers(in_order(first, "movie_id", ["frame", "run_id"]), "movie_id", "number")
    return runs.join(number.select("movie_id", "run_id", (F.col("number") - 1).alias("temporal_cluster_id")), ["movie_id", "run_id"]).select("movie_id", "temporal_cluster_id", "loc_id")
