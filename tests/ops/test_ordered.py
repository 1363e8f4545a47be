import random
import time

import numpy as np
import pytest

from locspark.operators import stats, temporal
from locspark.operators.ordered import in_order, last_mark, with_numbers, with_previous


def test_numbers_and_previous_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), k * 7919 % 1009, k) for k in range(1009)] + [(5, 1, 0)]
    df = in_order(spark.createDataFrame(rows, "movie_id int, frame int, loc_id long").repartition(7), "movie_id", ["frame"])
    want = {}
    for m in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == m)
        want |= {(m, i): (n + 1, own[n - 1][0] if n else None) for n, (_, i) in enumerate(own)}
    got = {(r.movie_id, r.loc_id): (r.number, r.previous.frame if r.previous else None) for r in with_previous(with_numbers(df, "movie_id"), "movie_id", ["frame"]).collect()}
    assert got == want
    for r in last_mark(df, "movie_id", df.frame % 50 == 0, "mark").join(df.select("place", df.frame.alias("marked")), "place", "left").collect():
        assert r.mark is None or r.mark <= r.place


def walk(rows, gap, exact, distance):
    """The runs of one movie, row by row."""
    out, a, before = {}, None, None
    for i, f, x, y in sorted(rows, key=lambda r: (r[1] or 0, r[0])):
        f = f or 0
        ok = a is not None and None not in (x, y, a[2], a[3])
        if ok:
            far = ((x - a[2]) ** 2 + (y - a[3]) ** 2) ** 0.5
            ok = (f - before == gap and far < distance) if exact else (f - a[1] <= gap and far <= distance)
        if not ok:
            a = (i, f, x, y)
        out[i], before = a[0], f
    return out


@pytest.mark.parametrize("exact", [True, False])
def test_runs_against_a_walk(spark, exact):
    rng = random.Random(3)
    rows, want = [], {}
    for m, (n, spread, step) in enumerate([(400, 1.5, 1), (300, 0.7, 1), (300, 3.0, 2), (50, 0.0, 1), (1, 1.0, 1), (200, 1.2, 0)]):
        f, own = 0, []
        for i in range(n):
            f += step if rng.random() < 0.9 else rng.randrange(4)
            own.append((i, f if i % 61 else None, None if rng.random() < 0.02 else i * 0.01 + rng.random() * spread, rng.random() * spread))
        rows += [(m, *r) for r in own]
        want |= {(m, i): a for i, a in walk(own, 1 if exact else 10, exact, 2.0).items()}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "movie_id int, loc_id long, frame int, x double, y double")
    got = {(r.movie_id, r.loc_id): r.run_id for r in temporal.temporal_runs(df, 1 if exact else 10, exact, 2.0).collect()}
    assert got == want


def test_runs_in_small_stretches(spark, monkeypatch):
    batches = [temporal.pa.record_batch([np.zeros(50, np.int32), np.arange(k, k + 50), np.arange(k, k + 50) // 30, np.arange(k, k + 50), np.zeros(50), np.zeros(50)], names=["movie_id", "loc_id", "island", "frame", "x", "y"]) for k in range(0, 500, 50)]
    monkeypatch.setattr(temporal, "STRETCH", 70)
    got = np.concatenate([b.column(2).to_numpy() for b in temporal._runs(iter(batches), 10, 2.0, True)])
    assert got.tolist() == [k // 30 * 30 + k % 30 // 11 * 11 for k in range(500)]


def test_long_runs_take_no_walk():
    n = 300_000
    zero = np.zeros(n)
    began = time.time()
    assert temporal.run_starts(zero, np.arange(n), zero, zero, None, 2.0, False).max() == 0
    assert (temporal.run_starts(zero, np.arange(n), zero, zero, 10, 2.0, True) == np.arange(n) // 11 * 11).all()
    assert time.time() - began < 20


def test_frame_intervals_of_no_rows(spark):
    assert stats.frame_intervals(spark.createDataFrame([], "movie_id int, loc_id long, frame int")).collect() == []
