import math
import random
import time

import numpy as np
import pytest

from locspark.operators import filters, spatial
from locspark.operators.quadtree import nearest, split

SCHEMA = "movie_id int, loc_id long, x double, y double"


def brute(rows, k):
    place = {}
    for m, i, x, y in rows:
        if None not in (m, i, x, y) and math.isfinite(x) and math.isfinite(y):
            place[m, i] = min(place.get((m, i), (x, y)), (x, y))
    out = []
    for (m, i), (x, y) in place.items():
        near = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for (n, j), (a, b) in place.items() if n == m and j != i)[:k]
        out += [(m, i, j, d, r + 1) for r, (d, j) in enumerate(near)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(0, i, rng.random() * 100, rng.random() * 100) for i in range(300)]
    rows += [(0, 1000 + i, 50 + rng.random() * 1e-3, 50 + rng.random() * 1e-3) for i in range(300)]  # dense within sparse
    rows += [(1, i, 7.0, 7.0) for i in range(100)] + [(1, 200, 9e5, -1e6), (1, 201, 9e5, -1e6)]  # one place and two far away
    rows += [(2, i, float(i % 5), float(i % 7)) for i in range(120)]  # ties
    rows += [(3, 1, 0.0, 0.0), (4, 1, 0.0, 0.0), (4, 2, 3.0, 4.0), (5, 1, 1e-300, 0.0), (5, 2, 0.0, 1e-300), (5, 3, 0.0, 0.0)]
    rows += [(2, 500, None, 1.0), (2, 501, float("nan"), 1.0), (2, 502, 1.0, float("inf")), (None, 1, 1.0, 1.0), (2, None, 1.0, 1.0), (2, 3, 50.0, 50.0), (2, 3, 3.0, 3.0), (2, 3, None, 3.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "leaf"), [(3, None), (9, 40), (1, 4), (5, 5)])
def test_against_brute_force(spark, k, leaf):
    rows = corpus(k)
    got = sorted((r.movie_id, r.loc_id, r.other_id, r.distance, r.rank) for r in nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), k, leaf).collect())
    assert got == brute(rows, k)


def test_no_rows(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), 3).collect() == [] and nearest(spark.createDataFrame([(1, 1, None, None)], SCHEMA), 3).collect() == []


def test_split_by_count():
    z = np.array([0, 1, 2, 3, 16, 1 << 61])
    assert split(np.zeros(6), z, 6).tolist() == [0] * 6
    assert split(np.zeros(6), z, 4).tolist() == [29] * 5 + [1] or split(np.zeros(6), z, 4).tolist()[-1] == 1
    assert split(np.array([0, 0, 1, 1]), np.array([5, 5, 5, 5]), 1).tolist() == [31] * 4


def test_a_crowd_in_one_spot(spark):
    """Far more points than a cell holds, in one place and close by, with two far away: candidates stay linear."""
    n = 100_000
    p = spark.range(n).selectExpr("cast(id % 2 as int) as movie_id", "id as loc_id", "if(id % 2 = 0, 5.0d, 5 + id * 1e-9d) as x", "if(id % 2 = 0, 5.0d, 5 + (id * 7919 % 100003) * 1e-9d) as y")
    p = p.union(spark.createDataFrame([(m, n + i, 1e4 * (i + 1), 3.0) for m in (0, 1) for i in (0, 1)], SCHEMA)).repartition(8)
    began = time.time()
    rows = nearest(p, 5).groupBy("movie_id").count().collect()
    assert sorted((r.movie_id, r["count"]) for r in rows) == [(0, 5 * (n // 2 + 2)), (1, 5 * (n // 2 + 2))] and time.time() - began < 60


def test_filters_end_on_missing_places(spark):
    rows = [(0, i, float(i % 6), float(i // 6)) for i in range(30)] + [(0, 99, None, 1.0), (0, 98, None, None)]
    locs = spark.createDataFrame(rows, SCHEMA)
    got = {r.loc_id: r.outlier for r in filters.spatial_outliers(locs).collect()}
    assert len(got) == 32 and not got[99] and not got[98]
    d = {r.loc_id: r.density for r in spatial.local_density(locs).collect()}
    assert len(d) == 32 and all((x is None) == (i > 90) for i, x in d.items())
    assert spatial.knee_eps(locs).count() == 1
