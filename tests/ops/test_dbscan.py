import math
import random
import time

import pytest

from locspark.operators import spatial

SCHEMA = "movie_id int, loc_id long, x double, y double, cluster_id int"


def brute(rows, eps, min_samples):
    out = {}
    for m in {r[0] for r in rows}:
        p = {i: (x, y) for n, i, x, y in rows if n == m and None not in (x, y) and math.isfinite(x)}
        near = {i: [j for j, b in p.items() if math.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])) <= eps] for i, a in p.items()}
        core = {i for i in p if len(near[i]) >= min_samples}
        root = {i: i for i in core}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i in core:
            for j in near[i]:
                if j in core:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        number = {r: k for k, r in enumerate(sorted({find(i) for i in core}))}
        for n, i, x, y in rows:
            if n == m:
                roots = [find(i)] if i in core else sorted(find(j) for j in near.get(i, []) if j in core)
                out[m, i] = number[roots[0]] if roots else -1
    return out


@pytest.mark.parametrize(("eps", "min_samples"), [(1.0, 3), (2.5, 5), (0.4, 1)])
def test_against_brute_force(spark, eps, min_samples):
    rng = random.Random(min_samples)
    rows = [(0, i, rng.uniform(-10, 10), rng.uniform(-10, 10)) for i in range(250)] + [(1, i, float(i % 15) * eps, float(i // 15)) for i in range(120)]
    rows += [(2, i, rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for i in range(150)] + [(2, 200 + i, rng.gauss(0, 3), rng.gauss(0, 3)) for i in range(100)]
    rows += [(3, i, 1.0, 1.0) for i in range(20)] + [(3, 30, None, 1.0), (3, 31, float("nan"), 1.0), (4, 1, 0.0, 0.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    got = {(r.movie_id, r.loc_id): r.cluster_id for r in spatial.dbscan(df, eps, min_samples).collect()}
    assert got == brute(rows, eps, min_samples)
    by_movie = spark.createDataFrame([(m, eps) for m in range(4)], "movie_id int, eps double")
    assert {(r.movie_id, r.loc_id): r.cluster_id for r in spatial.dbscan(df, by_movie, min_samples).collect()} == got | {(4, 1): -1}


def test_a_crowd_keeps_no_pairs(spark):
    """10^5 points within one eps, half of them in one place, and a few beside them."""
    n = 100_000
    p = spark.range(n).selectExpr("cast(0 as int) as movie_id", "id as loc_id", "if(id % 2 = 0, 5.0d, 5 + (id * 31 % 99991) * 1e-5) as x", "if(id % 2 = 0, 5.0d, 5 + (id * 7919 % 100003) * 1e-5) as y")
    p = p.union(spark.createDataFrame([(0, n, 8.0, 5.0), (0, n + 1, 40.0, 5.0)], "movie_id int, loc_id long, x double, y double"))
    began = time.time()
    assert {r.cluster_id: r["count"] for r in spatial.dbscan(p, 2.5).groupBy("cluster_id").count().collect()} == {0: n + 1, -1: 1} and time.time() - began < 60


def test_no_rows(spark):
    assert spatial.dbscan(spark.createDataFrame([], SCHEMA)).collect() == []
