"""Helpers on arrays against brute force, and their operators on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locspark.operators import floods, localize, render


def greedy_ward(points, parts):
    groups = [[i] for i in range(len(points))]

    def cost(a, b):
        d = points[a].mean(0) - points[b].mean(0)
        return len(a) * len(b) / (len(a) + len(b)) * (d @ d)

    while len(groups) > parts:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda ij: cost(groups[ij[0]], groups[ij[1]]))
        groups[j] += groups.pop(i)
    groups.sort(key=min)
    return [next(k for k, g in enumerate(groups) if i in g) for i in range(len(points))]


@pytest.mark.parametrize("n, parts", [(2, 2), (5, 2), (30, 2), (40, 5)])
def test_ward_equals_greedy_merging(n, parts):
    points = np.random.default_rng(n).normal(size=(n, 2))
    assert floods.ward(points, parts).tolist() == greedy_ward(points, parts)


def test_ward_of_equal_points():
    assert sorted(set(floods.ward(np.zeros((6, 2)), 2).tolist())) == [0, 1]


def test_disk_filters():
    a = np.random.default_rng(1).integers(0, 50, (17, 13)).astype(float)
    for r in (0, 1, 3, 20):
        for low in (True, False):
            got = floods._disk_best(a, r, low)
            for y in range(17):
                for x in range(13):
                    inside = [a[v, u] for v in range(17) for u in range(13) if (v - y) ** 2 + (u - x) ** 2 <= r * r]
                    assert got[y, x] == (min(inside) if low else max(inside)), r


def highest_pass(a, y, x):
    """The highest level at which a way leads from a pixel to a higher one; -inf without any."""
    for level in sorted(set(a[a <= a[y, x]].tolist()), reverse=True):
        seen, todo = {(y, x)}, [(y, x)]
        while todo:
            v, u = todo.pop()
            if a[v, u] > a[y, x]:
                return level
            for p in ((v + i, u + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and p not in seen and a[p] >= level:
                    seen.add(p)
                    todo.append(p)
    return -np.inf


@pytest.mark.parametrize("side", [3, 256])
def test_h_maxima(spark, side):
    a = np.random.default_rng(3).integers(0, 9, (9, 8)).astype(float)
    rows = [(0, y, x, float(a[y, x])) for y in range(9) for x in range(8)]
    pixels = spark.createDataFrame(rows, "image_id int, y int, x int, value double")
    got = {(r.y, r.x) for r in floods.h_maxima(pixels, spark.createDataFrame([(0, 3.0)], "image_id int, h double"), side=side).collect()}
    assert got == {(y, x) for y in range(9) for x in range(8) if a[y, x] - highest_pass(a, y, x) >= 3}
    assert not floods.h_maxima(pixels, spark.createDataFrame([(0, 0.0)], "image_id int, h double")).count()


def image(spark, a, name="value"):
    return spark.createDataFrame([(0, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], f"image_id int, y int, x int, {name} double")


def flood(spark, surface, markers, mask, side=256):
    seeds = spark.createDataFrame([(0, int(y), int(x), int(markers[y, x])) for y, x in np.argwhere(markers)], "image_id int, y int, x int, label int")
    on = image(spark, mask).filter("value > 0").select("image_id", "y", "x")
    out = np.zeros(surface.shape, int)
    for r in floods.watershed(image(spark, surface), seeds, on, side=side).collect():
        out[r.y, r.x] = r.label
    return out.tolist()


def plain_flood(surface, markers, mask):
    """Edge after edge in the stated order: two parts of which at most one has a marker become one."""
    part = {(int(y), int(x)): {(int(y), int(x))} for y, x in np.argwhere(mask > 0)}
    label = {p: int(markers[p]) for p in part}
    edges = sorted((max(surface[p], surface[q]), min(surface[p], surface[q]), p, q) for p in part for q in ((p[0], p[1] + 1), (p[0] + 1, p[1])) if q in part)
    for _, _, p, q in edges:
        if part[p] is not part[q] and not (label[p] and label[q]):
            new, name = part[p] | part[q], label[p] or label[q]
            for r in new:
                part[r], label[r] = new, name
    return [[label.get((y, x), 0) for x in range(surface.shape[1])] for y in range(surface.shape[0])]


def test_flood_meets_at_the_ridge(spark):
    surface = np.array([[0, 1, 2, 5, 2, 1, 0]], float)
    markers = np.array([[1, 0, 0, 0, 0, 0, 2]])
    assert flood(spark, surface, markers, np.ones((1, 7))) == [[1, 1, 1, 1, 2, 2, 2]]
    assert flood(spark, surface, markers, np.array([[1, 1, 0, 1, 1, 1, 1]])) == [[1, 1, 0, 2, 2, 2, 2]]


@pytest.mark.parametrize("seed, values, side", [(1, 4, 5), (2, 1000, 5), (3, 1, 256), (4, 9, 256)])
def test_flood_is_the_forest_of_markers(spark, seed, values, side):
    rng = np.random.default_rng(seed)
    surface, mask = rng.integers(0, values, (14, 11)).astype(float), (rng.random((14, 11)) < 0.8).astype(int)
    markers = np.where(rng.random((14, 11)) < 0.06, rng.integers(1, 6, (14, 11)), 0)
    assert flood(spark, surface, markers, mask, side) == plain_flood(surface, markers, mask)


def test_floods_of_odd_tables(spark):
    p = image(spark, np.arange(12.0).reshape(3, 4))
    h = spark.createDataFrame([(0, 2.0)], "image_id int, h double")
    odd = p.unionByName(spark.createDataFrame([(0, None, 1, 5.0), (0, 1, 9, None), (0, 2, 9, float("nan")), (None, 0, 0, 99.0)], p.schema))
    assert [(r.y, r.x) for r in floods.h_maxima(odd.withColumn("top", F.lit(1)), h).collect()] == [(2, 3)]
    flat = image(spark, np.full((3, 4), 7.0))
    assert floods.h_maxima(flat, h).count() == 12 and floods.h_maxima(p.limit(0), h).count() == 0
    seeds = spark.createDataFrame([(0, 0, 0, 3), (0, 0, 0, 2), (0, 2, 3, 0)], "image_id int, y int, x int, label int")
    assert {r.label for r in floods.watershed(odd, seeds, odd.union(odd)).collect()} == {2} and floods.watershed(odd, seeds, p).count() == 12
    assert floods.watershed(p, seeds.limit(0), p).count() == floods.watershed(p.limit(0), seeds, p).count() == 0


def test_fit_finds_planted_spots(spark):
    ys, xs = np.indices((40, 40))
    spots = [(12.3, 14.6, 200.0, 1.3), (27.8, 25.1, 350.0, 1.1)]
    image = 5 + (xs * 7 + ys * 3) % 4 * 0.25 + sum(a * np.exp(-((ys - y) ** 2 + (xs - x) ** 2) / (2 * s * s)) for y, x, a, s in spots)
    frames = spark.createDataFrame([(1, 0, 40, 40, image.ravel().tolist()), (1, 1, 40, 40, None), (1, 2, 0, 0, [])], "movie_id int, frame int, height int, width int, pixels array<double>")
    got = sorted(localize.localize_grouped(frames).collect(), key=lambda r: r.y)
    assert len(got) == 2 and all(r.frame == 0 and r.cluster_n_molecules == 1 and r.cluster_r_squared > 0.99 for r in got)
    for r, (y, x, a, s) in zip(got, spots):
        assert abs(r.y - y) < 0.05 and abs(r.x - x) < 0.05 and abs(r.sigma_x - s) < 0.05 and abs(r.sigma_y - s) < 0.05 and abs(r.amplitude - a) < 0.05 * a
    plain = localize.localize_grouped(frames, "centroid").collect()
    assert {r.cluster_chi_squared for r in plain} == {999.0} and {r.x_error for r in plain} == {0.2}
    assert localize.localize_centroid(frames.limit(0)).collect() == []


def test_constant_frame_has_no_peaks(spark):
    flat = spark.createDataFrame([(0, 0, 8, 8, [3.0] * 64)], "movie_id int, frame int, height int, width int, pixels array<double>")
    assert localize.localize_bgsub(flat).count() == localize.localize_grouped(flat).count() == localize.localize_centroid(flat).count() == 0


def test_groups_are_not_transitive():
    assert [g.tolist() for g in localize.grouped(np.array([[0, 0], [0, 3], [0, 6]]), 3.5)] == [[0, 1], [2]]


def test_blur_of_a_sparse_image_keeps_its_sum(spark):
    image = spark.createDataFrame([(0, 0, 0, 2.0), (0, 3, 4, 1.0)], "movie_id int, y int, x int, value double")
    out = render.sparse_smooth(image, 1.5, spark.createDataFrame([(0, 4, 5)], "movie_id int, h int, w int")).collect()
    assert abs(sum(r.value for r in out) - 3) < 1e-9 and all(0 <= r.y < 4 and 0 <= r.x < 5 for r in out)
