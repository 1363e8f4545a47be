"""The k nearest others by a quadtree by count: cells split until they hold a few k points.

1. Points are put in order of movie and Z-order code over all partitions, so a cell's points stand side by side. Each task
   splits its stretch of that order into the largest cells that hold at most `leaf` points; a cell that a stretch cuts in
   two is two leaves. Of points in one place only the first k + 1 by id can be anyone's k nearest, so only these are leaves'
   points, and any number of points in one place costs no more than its length.
2. A leaf's points all have k others within its parent's width, which has more than `leaf` points. So a leaf asks the cells
   that meet its box, grown by that: cells of its own level, below which all smaller leaves are found, and the cells above
   these, which can be larger leaves.
3. The leaves found are taken in order of how far away their farthest point can be; when they hold k + 1 points the rest is
   known to be no nearer than that, and leaves that begin farther away are dropped.
4. What is left of the leaves goes to the asking ones, which pick the k nearest; ties by id.

Work is of the order of n / leaf leaves and their few neighbours, however the points lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locspark.operators.graph import written

#: Levels of the tree: coordinates are whole numbers of this many bits within a movie's square.
DEPTH = 31
#: Points that a task splits into leaves at once, and pairs of points that it compares at once.
STRETCH, PAIRS = 200_000, 2_000_000


def points_of(locs: DataFrame) -> DataFrame:
    """(movie_id, loc_id, x, y): places that are numbers; of rows of one id in a movie that of the smallest x, then y."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    p = locs.select("movie_id", F.col("loc_id").cast("long").alias("loc_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = p.filter(finite("x") & finite("y") & F.col("movie_id").isNotNull() & F.col("loc_id").isNotNull())
    return p.groupBy("movie_id", "loc_id").agg(F.min(F.struct("x", "y")).alias("at")).select("movie_id", "loc_id", "at.x", "at.y")


def _interleaved(c: Column) -> Column:
    """The bits of a number, each followed by a 0."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def z_ordered(points: DataFrame) -> DataFrame:
    """(movie, unit, z, ix, iy, x, y, loc_id) in order of movie, z and place over all partitions. unit: the width of one step of ix."""
    area = points.groupBy("movie_id").agg(F.min("x").alias("ox"), F.min("y").alias("oy"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))
    unit = F.when(F.col("extent") > 0, F.col("extent") / (1 << DEPTH)).otherwise(1.0)
    step = lambda c, o: F.least(F.floor((F.col(c) - F.col(o)) / F.col("unit")), F.lit((1 << DEPTH) - 1)).cast("long")
    p = points.join(area, "movie_id").withColumn("unit", unit).withColumn("ix", step("x", "ox")).withColumn("iy", step("y", "oy"))
    z = _interleaved(F.col("ix")).bitwiseOR(F.shiftleft(_interleaved(F.col("iy")), 1))
    order = ["movie", "z", "x", "y", "loc_id"]
    return p.select(F.col("movie_id").cast("long").alias("movie"), "unit", z.alias("z"), "ix", "iy", "x", "y", "loc_id").repartitionByRange(*order).sortWithinPartitions(*order)


LEAVES = "leaf boolean, number long, movie long, level int, cx long, cy long, n int, ax double, bx double, ay double, by double, lx long, hx long, ly long, hy long, ids array<long>, xs array<double>, ys array<double>"


def _bits(v: np.ndarray) -> np.ndarray:
    """How many bits numbers of up to 62 bits have."""
    high, low = v >> 31, v & ((1 << 31) - 1)
    return np.where(high > 0, 31 + np.frexp(high.astype(float))[1], np.frexp(low.astype(float))[1])


def _last_best(a: np.ndarray, back: int) -> np.ndarray:
    """The largest of each number and the `back` before it, in steps that double."""
    done = 1
    while done <= back:
        step = min(done, back + 1 - done)
        a = np.maximum(a, np.concatenate((np.full(min(step, len(a)), -1), a[:-step])))
        done += step
    return a


def _runs(*columns: np.ndarray) -> np.ndarray:
    """For each row if it differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _within(new: np.ndarray) -> np.ndarray:
    """The number of each row within its run."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def split(movie: np.ndarray, z: np.ndarray, leaf: int) -> np.ndarray:
    """The level of the largest cell about each point that holds at most `leaf` of them, for points in Z-order."""
    deepest = np.full(len(z), -1)
    if len(z) > leaf:
        a, b = z[:-leaf], z[leaf:]
        deepest[: len(a)] = np.where(movie[:-leaf] == movie[leaf:], (2 * DEPTH - _bits(a ^ b)) // 2, -1)
    return np.minimum(1 + _last_best(deepest, leaf), DEPTH)


def _stretch(movie, unit, z, ix, iy, x, y, ids, k: int, leaf: int, first: int) -> list[pa.RecordBatch]:
    """The leaves of a stretch, and its asking groups: the leaf's points and all others in their places, in pieces."""
    near = np.flatnonzero(_within(_runs(movie, x, y)) <= k)  # the first k + 1 of each place
    level = split(movie[near], z[near], leaf)
    new = _runs(movie[near], level, z[near] >> 2 * (DEPTH - level))
    new |= _within(new) % leaf == 0  # the smallest cells can't be split any more
    number = np.cumsum(new) - 1
    of = number[np.searchsorted(near, np.arange(len(z)), "right") - 1]
    asks = _runs(of)
    asks |= _within(asks) % (8 * leaf) == 0
    out = []
    for is_leaf, rows, starts, lv, size in ((True, near, np.flatnonzero(new), level[new], None), (False, np.arange(len(z)), np.flatnonzero(asks), level[new][of[asks]], np.bincount(number)[of[asks]])):
        n = np.diff(np.append(starts, len(rows)))
        box = lambda c, f: f.reduceat(c[rows], starts)  # noqa: B023, E731
        head = rows[starts]
        side = unit[head] * 2.0 ** (DEPTH - lv)
        if is_leaf:
            grow = np.zeros(len(starts), np.int64)
        else:
            reach = np.where(size > k, side, np.where(lv > 0, 2 * side, np.inf)) * 2**0.5
            grow = np.minimum(np.ceil(reach / unit[head]) + 1, 1 << DEPTH).astype(np.int64)
        low, high = lambda c: np.maximum(box(c, np.minimum) - grow, 0), lambda c: np.minimum(box(c, np.maximum) + grow, (1 << DEPTH) - 1)  # noqa: B023
        lists = [pa.ListArray.from_arrays(np.append(starts, len(rows)).astype(np.int32), pa.array(c[rows])) for c in (ids, x, y)]
        columns = [
            pa.array(np.full(len(starts), is_leaf)), first + np.arange(len(starts)), movie[head], lv.astype(np.int32), ix[head] >> (DEPTH - lv), iy[head] >> (DEPTH - lv), n.astype(np.int32),
            box(x, np.minimum), box(x, np.maximum), box(y, np.minimum), box(y, np.maximum), low(ix), high(ix), low(iy), high(iy), *lists,
        ]
        out.append(pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[f.split()[0] for f in LEAVES.split(", ")]))
    return out


def _leaves(batches: Iterator[pa.RecordBatch], k: int, leaf: int) -> Iterator[pa.RecordBatch]:
    first, waiting, n = TaskContext.get().partitionId() << 40, [], 0

    def cut() -> Iterator[pa.RecordBatch]:
        nonlocal first
        if n:
            columns = pa.Table.from_batches(waiting).columns
            yield from _stretch(*(c.to_numpy() for c in columns), k, leaf, first)
            first += 2 * n

    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= STRETCH:
            yield from cut()
            waiting, n = [], 0
    yield from cut()


def _meeting(tree: DataFrame, k: int) -> DataFrame:
    """(ask, leaf): the leaves that can hold one of the k nearest of an asking group."""
    leaves, asks = tree.filter("leaf"), tree.filter("not leaf")
    own, up = F.array(F.lit(True), F.lit(False)), F.array(F.lit(True))
    found = leaves.select(F.col("number").alias("other"), "movie", "level", "cx", "cy", F.col("n").alias("m"), *(F.col(c).alias(f"o{c}") for c in ("ax", "bx", "ay", "by")), F.explode(F.sequence(F.lit(0), F.col("level"))).alias("j"))
    found = found.withColumn("below", F.explode(F.when(F.col("j") == F.col("level"), own).otherwise(up)))
    found = found.select("other", "m", "oax", "obx", "oay", "oby", "movie", "j", "below", F.expr("shiftright(cx, level - j)").alias("cx"), F.expr("shiftright(cy, level - j)").alias("cy"))
    wide = asks.select("number", "movie", "level", "ax", "bx", "ay", "by", "lx", "hx", "ly", "hy", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("j"))
    cells = lambda lo, hi: F.explode(F.sequence(F.expr(f"shiftright({lo}, {DEPTH} - j)"), F.expr(f"shiftright({hi}, {DEPTH} - j)")))
    wide = wide.withColumn("cx", cells("lx", "hx")).withColumn("cy", cells("ly", "hy")).withColumn("below", F.col("j") == F.col("level")).drop("level", "lx", "hx", "ly", "hy")
    apart = lambda a, b, c, d: F.greatest(F.lit(0.0), F.col(c) - F.col(b), F.col(a) - F.col(d))
    across = lambda a, b, c, d: F.greatest(F.col(d) - F.col(a), F.col(b) - F.col(c))
    length = lambda f: F.sqrt(f("ax", "bx", "oax", "obx") * f("ax", "bx", "oax", "obx") + f("ay", "by", "oay", "oby") * f("ay", "by", "oay", "oby"))
    pairs = wide.join(found, ["movie", "below", "j", "cx", "cy"]).select(F.col("number").alias("ask"), "other", "m", length(apart).alias("near"), length(across).alias("far"))
    so_far = F.sum("m").over(W.partitionBy("ask").orderBy("far", "other").rowsBetween(W.unboundedPreceding, 0))
    bound = F.min(F.when(F.col("held") > k, F.col("far"))).over(W.partitionBy("ask"))
    return pairs.withColumn("held", so_far).withColumn("bound", bound).filter("bound is null or near <= bound * (1 + 1e-9)").select("ask", "other")


def _pick(table: pa.Table, k: int) -> pa.Table:
    """The k nearest others of the points of each asking group, from the leaves that came to it."""
    table = table.take(np.lexsort((~table["asking"].to_numpy(), table["ask"].to_numpy())))
    ask, asking, movie = table["ask"].to_numpy(), table["asking"].to_numpy(), table["movie"].to_numpy()
    lists = [table[c].combine_chunks() for c in ("ids", "xs", "ys")]
    at = np.append(0, np.cumsum(lists[0].value_lengths().to_numpy()))
    ids, xs, ys = (c.flatten().to_numpy() for c in lists)
    heads = np.flatnonzero(_runs(ask))
    out = []
    for a, z in zip(heads, np.append(heads[1:], len(ask))):
        if not asking[a]:
            continue
        mine, others = slice(at[a], at[a + 1]), slice(at[a + 1], at[z])
        m = others.stop - others.start
        rows = max(1, PAIRS // max(m, 1))
        for lo in range(mine.start, mine.stop, rows):
            own = slice(lo, min(lo + rows, mine.stop))
            dx, dy = xs[own, None] - xs[None, others], ys[own, None] - ys[None, others]
            d = np.sqrt(dx * dx + dy * dy)
            d[ids[own, None] == ids[None, others]] = np.inf
            most = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if m > k else np.inf
            r, c = np.nonzero((d <= most) & (d < np.inf))
            order = np.lexsort((ids[others][c], d[r, c], r))
            r, c = r[order], c[order]
            rank = _within(_runs(r)) if len(r) else r
            r, c, rank = r[rank < k], c[rank < k], rank[rank < k]
            out.append((np.full(len(r), movie[a]), ids[own][r], ids[others][c], d[r, c], rank + 1))
    kinds = (np.int64, np.int64, np.int64, np.float64, np.int64)
    joined = [np.concatenate([x[i] for x in out]).astype(t) if out else np.zeros(0, t) for i, t in enumerate(kinds)]
    return pa.table([pa.array(c) for c in joined], names=["movie", "loc_id", "other_id", "distance", "rank"])


def nearest(locs: DataFrame, k: int, leaf: int | None = None) -> DataFrame:
    """(movie_id, loc_id, other_id, distance, rank): the k nearest others of each point of its movie; ties by id. Runs jobs when called.

    Rows without a place (null, NaN, infinite), id or movie have no neighbours and are none. Rows of one id in a movie are one
    point, with the smallest x, then y. Points in one place are each other's neighbours at distance 0. Points of a movie of
    fewer than k + 1 have all others.
    """
    leaf = leaf or max(4 * k, 32)
    kind = locs.schema["movie_id"].dataType
    tree = written(z_ordered(points_of(locs)).mapInArrow(lambda b: _leaves(b, k, leaf), LEAVES))
    meeting = _meeting(tree, k)
    held = tree.filter("leaf").select(F.col("number").alias("other"), "movie", "ids", "xs", "ys")
    shipped = meeting.join(held, "other").select("ask", F.lit(False).alias("asking"), "movie", "ids", "xs", "ys")
    asked = tree.filter("not leaf").select(F.col("number").alias("ask"), F.lit(True).alias("asking"), "movie", "ids", "xs", "ys")
    spark = locs.sparkSession
    n = tree.agg(F.sum(F.when(~F.col("leaf"), F.col("n")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 50_000)
    both = asked.union(shipped).withColumn("bucket", F.pmod(F.xxhash64("ask"), F.lit(buckets)))
    found = both.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _pick(t, k), "movie long, loc_id long, other_id long, distance double, rank long")
    return found.select(F.col("movie").cast(kind).alias("movie_id"), "loc_id", "other_id", "distance", "rank")
