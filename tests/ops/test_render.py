import re

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from locspark.operators import render


def plain(points, height, width):
    image, on = np.zeros((height, width)), np.zeros((height, width), bool)
    for x, y, s, a in points:
        r = int(3 * s) + 1
        y0, y1, x0, x1 = max(0, int(y) - r), min(height, int(y) + r + 1), max(0, int(x) - r), min(width, int(x) + r + 1)
        dy, dx = np.arange(y0, y1) - y, np.arange(x0, x1) - x
        image[y0:y1, x0:x1] += a * np.outer(np.exp(-dy * dy / (2 * s * s)), np.exp(-dx * dx / (2 * s * s)))
        on[y0:y1, x0:x1] = True
    return {(y, x): image[y, x] for y, x in zip(*map(np.ndarray.tolist, np.nonzero(on)))}


def splatted(spark, points, height, width):
    df = spark.createDataFrame([(m, *p) for m, p in points], "movie_id int, cx double, cy double, s double, a double").withColumns({"sy": F.col("s"), "sx": F.col("s")})
    r = (3 * F.col("s")).cast("int") + 1
    lo = lambda c: F.col(c).cast("int") - r
    return render._splat(df, lo("cy"), lo("cy") + 2 * r + 1, lo("cx"), lo("cx") + 2 * r + 1, height, width)


def test_tiles_against_a_plain_image(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = [(int(m), (float(x), float(y), float(s), float(a))) for m, x, y, s, a in zip(rng.integers(0, 2, 300), rng.uniform(-5, 605, 300), rng.uniform(-5, 505, 300), rng.uniform(0.3, 9, 300), rng.uniform(0.5, 2, 300))]
    points += [(0, (256.0, 256.0, 100.0, 1.0)), (1, (-900.0, 3.0, 2.0, 1.0))]
    for crowd in (200_000, 20):
        monkeypatch.setattr(render, "CROWD", crowd)
        rows = splatted(spark, points, 500, 600).collect()
        got = {(r.movie_id, r.y, r.x): r.value for r in rows}
        assert len(got) == len(rows)
        for m in (0, 1):
            want = plain([p for n, p in points if n == m], 500, 600)
            assert {k[1:] for k in got if k[0] == m} == set(want) and all(abs(got[m, *k] - v) < 1e-9 for k, v in want.items())
    assert splatted(spark, [(0, (None, 1.0, 1.0, 1.0))], 9, 9).collect() == []


def test_each_pixel_is_given_out_once_in_any_order(spark):
    """20,000 points on 500 spots of a large image, spot after spot in each frame."""
    spots = [(100 + k * 7919 % 9800 + 0.5, 100 + k * 104729 % 9800 + 0.5) for k in range(500)]
    kernels = pa.RecordBatch.from_pylist([dict(zip(render.KERNEL, (0, int(y) // 256, int(x) // 256, 0, int(y) - 8, int(y) + 9, int(x) - 8, int(x) + 9, y, x, 2.0, 2.0, 1.0))) for _ in range(40) for x, y in spots])
    order = np.lexsort([kernels.column(i).to_numpy() for i in (2, 1)])
    out = sum(b.num_rows for b in render._tiles(iter([kernels.take(pa.array(order))])))
    assert out <= 500 * 17 * 17


def test_blur_within_tiles_against_a_blur_of_all_pixels(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sizes = spark.createDataFrame([(0, 520, 300), (1, 259, 7), (2, 3, 4)], "movie_id int, h int, w int")
    rows = [(int(m), float(x), float(y), float(s), 1.0) for m, x, y, s in zip(rng.integers(0, 3, 200), rng.uniform(0, 300, 200), rng.uniform(0, 520, 200), rng.uniform(0.3, 6, 200))]
    df = spark.createDataFrame(rows + [(m, 1.5, 1.5, 1.0, 1.0) for m in (0, 1, 2)], "movie_id int, cx double, cy double, s double, a double").withColumns({"sy": F.col("s"), "sx": F.col("s")}).join(sizes, "movie_id")
    lo = lambda c: F.col(c).cast("int") - 4
    bounds = (lo("cy"), lo("cy") + 9, lo("cx"), lo("cx") + 9, F.col("h"), F.col("w"))
    plain = render._splat(df, *bounds)
    for sigma in (0.5, 2.5):
        want = {(r.movie_id, r.y, r.x): r.value for r in render.sparse_smooth(plain, sigma, sizes).collect()}
        top = {m: max(v for k, v in want.items() if k[0] == m) for m in (0, 1, 2)}
        for crowd in (200_000, 20):
            monkeypatch.setattr(render, "CROWD", crowd)
            for scaled in (False, True):
                got = {(r.movie_id, r.y, r.x): r.value for r in render._splat(df, *bounds, sigma, scaled).collect()}
                assert set(got) == set(want) and all(abs(got[k] - v / (top[k[0]] if scaled else 1)) < 1e-12 for k, v in want.items())


def test_only_kernels_are_shuffled(spark):
    df = spark.createDataFrame([(0, i, 10.0 + i, 20.0, 500.0, 1.0, 1.0, 0.2, 0.2, 5.0, 0) for i in range(9)], "movie_id int, loc_id long, x double, y double, photons double, sigma_x double, sigma_y double, x_error double, y_error double, localization_precision double, frame int")
    for image in (render.render_weighted(df), render.render_gaussian_peak(df, 64, 64), render.render_histogram_smooth(df, 64, 64), render.render_set(df, 64, 64)):
        plan = image._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange hash", plan)) == plan.count("MapInArrow")
