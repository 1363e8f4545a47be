import time

import numpy as np
import pytest

from locspark.operators import images


def flood(mask, eight):
    label, n = np.zeros(mask.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    for y, x in np.argwhere(mask):
        if label[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        label[y, x] = n
        while stack:
            a, b = stack.pop()
            for dy, dx in steps:
                c, d = a + dy, b + dx
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not label[c, d]:
                    label[c, d] = n
                    stack.append((c, d))
    return label


@pytest.mark.parametrize("neighbors", [4, 8])
def test_labels_over_many_tiles(spark, neighbors):
    rng = np.random.default_rng(neighbors)
    masks = [rng.random((70, 90)) < p for p in (0.35, 0.5, 0.6, 0.0)]
    spiral = np.zeros((60, 60), bool)
    for k in range(0, 30, 4):
        spiral[k, k : 60 - k] = spiral[59 - k, k : 60 - k] = spiral[k : 60 - k, 59 - k] = True
        spiral[k + 4 : 60 - k, k] = True
        spiral[k + 4, k : k + 4] = True
    masks.append(spiral)
    rows = [(i, int(y), int(x)) for i, m in enumerate(masks) for y, x in np.argwhere(m)] + [(None, 1, 1), (0, None, 1)]
    df = spark.createDataFrame(rows, "image_id int, y int, x int").repartition(5)
    for side in (16, 128):
        got = {(r.image_id, r.y, r.x): r.label for r in images.label_components(df, neighbors, side=side).collect()}
        want = {(i, int(y), int(x)): int(flooded[y, x]) for i, flooded in enumerate(flood(m, neighbors == 8) for m in masks) for y, x in np.argwhere(flooded)}
        assert got == want


def test_parts_in_small_stretches(monkeypatch):
    mask = np.random.default_rng(0).random((40, 40)) < 0.5
    at = np.argwhere(mask)
    at = at[np.lexsort((at[:, 1], at[:, 0], at[:, 1] // 8, at[:, 0] // 8))]
    batches = [images.pa.record_batch([np.zeros(len(c), np.int32), c[:, 0].astype(np.int32), c[:, 1].astype(np.int32)], names=["key", "y", "x"]) for c in np.array_split(at, 11)]
    whole = [images.pa.Table.from_batches(list(images._tile_parts(iter(batches), images._STEPS[8], 8))).to_pylist()]
    monkeypatch.setattr(images, "STRETCH", 100)
    assert images.pa.Table.from_batches(list(images._tile_parts(iter(batches), images._STEPS[8], 8))).to_pylist() == whole[0]


def test_envelope():
    rng = np.random.default_rng(1)
    for width in (1, 2, 9, 40):
        g = rng.integers(-1, 12, (50, width))
        g[0] = -1
        x = np.arange(width)
        want = np.where(g[:, None, :] < 0, np.inf, (x[:, None] - x) ** 2 + g[:, None, :].astype(float) ** 2).min(2)
        assert (images.envelope(g) == want).all()
    wide = np.full((1, 10_000), 10_000)
    wide[0, 5] = 0
    began = time.time()
    assert images.envelope(wide)[0, -1] == min((9999 - 5) ** 2, 10_000**2) and time.time() - began < 2


def test_opening_over_many_tiles(spark):
    from locspark.operators import floods

    rng = np.random.default_rng(8)
    shapes = [(70, 55), (20, 90), (5, 5)]
    pictures = [rng.integers(0, 50, s).astype(float) for s in shapes]
    df = spark.createDataFrame([(i, int(y), int(x), float(a[y, x])) for i, a in enumerate(pictures) for y, x in np.argwhere(a >= 0)], "image_id int, y int, x int, value double").repartition(4)
    for radius, side in ((3, 13), (9, 16), (3, None)):
        got = {(r.image_id, r.y, r.x): r.value for r in floods.opening(df, radius, side=side).collect()}
        for i, a in enumerate(pictures):
            best = a
            for low in (True, False):
                wide = np.full(np.array(a.shape) + 2 * radius, np.inf if low else -np.inf)
                wide[radius:-radius, radius:-radius] = best
                cuts = [wide[radius + dy : radius + dy + a.shape[0], radius + dx : radius + dx + a.shape[1]] for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
                best = (np.min if low else np.max)(cuts, 0)
            assert all(got[i, y, x] == best[y, x] for y, x in np.argwhere(a >= 0).tolist())
        assert len(got) == sum(a.size for a in pictures)


def test_blurs_over_many_tiles(spark, monkeypatch):
    """Images of several tiles, with a null, lacking pixels and a row twice; edge pixels repeated."""
    rng = np.random.default_rng(3)
    pictures = [rng.integers(0, 50, s).astype(float) for s in ((300, 270), (5, 3), (1, 1))]
    rows = [(i, int(y), int(x), float(a[y, x])) for i, a in enumerate(pictures) for y, x in np.argwhere(a >= 0)]
    df = spark.createDataFrame(rows, "image_id int, y int, x int, value double").repartition(4)

    def blur(a, sigma):
        r = int(4 * sigma + 0.5)
        k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
        for axis in (0, 1):
            a = np.apply_along_axis(lambda row: np.convolve(np.pad(row, r, "edge"), k / k.sum(), "valid"), axis, a)
        return a

    got = {(r.image_id, r.y, r.x): r.value for r in images.dog_enhance(df).collect()}
    assert len(got) == len(rows)
    for i, a in enumerate(pictures):
        f, m, c = (blur(a, s) for s in (0.5, 1.5, 3.0))
        want = np.maximum(0, m - c + 0.5 * (f - m))
        assert all(abs(got[i, y, x] - want[y, x]) < 1e-9 for y, x in np.argwhere(a >= 0).tolist())
    few = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 0, 2.0), (0, 0, 20, None), (0, 0, 40, 5.0)], "image_id int, y int, x int, value double")
    out = {r.x: r.value for r in images.gaussian_smooth(few, 0.5).collect()}
    assert set(out) == {0, 1, 2, 18, 19, 20, 21, 22, 38, 39, 40} and {x for x, v in out.items() if v is None} == set(range(18, 23)) and abs(sum(v for x, v in out.items() if x < 9) - 3 * (1 + 0)) < 1


def test_three_blurs_take_one_pass(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0)], "image_id int, y int, x int, value double")
    assert images.dog_enhance(df)._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_pixels_and_parts_are_not_broadcast(spark):
    mask = spark.createDataFrame([(0, y, x) for y in range(5) for x in range(5) if (y, x) != (2, 2)], "image_id int, y int, x int")
    sizes = spark.createDataFrame([(0, 5, 5)], "image_id int, height int, width int")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    filled = images.fill_holes(mask, sizes)
    assert filled.count() == 25 and "SortMergeJoin [image_id" in plan(filled)
    assert "BroadcastHashJoin" not in plan(images.label_components(mask))


def test_closing_over_many_tiles(spark):
    rng = np.random.default_rng(4)
    masks = [rng.random((70, 45)) < 0.15, rng.random((9, 3)) < 0.4, np.ones((2, 2), bool)]
    sizes = spark.createDataFrame([(i, *m.shape) for i, m in enumerate(masks)], "image_id int, height int, width int")
    df = spark.createDataFrame([(i, int(y), int(x)) for i, m in enumerate(masks) for y, x in np.argwhere(m)], "image_id int, y int, x int")
    for radius, side in ((2, 16), (5, 20), (3, None)):
        disk = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
        got = sorted((r.image_id, r.y, r.x) for r in images.binary_closing(df, radius, sizes, side=side).collect())
        want = []
        for i, m in enumerate(masks):
            h, w = m.shape
            wide = {(y + dy, x + dx) for y, x in np.argwhere(m).tolist() for dy, dx in disk if 0 <= y + dy < h and 0 <= x + dx < w}
            want += [(i, y, x) for y, x in wide if all((y + dy, x + dx) in wide for dy, dx in disk if 0 <= y + dy < h and 0 <= x + dx < w)]
        assert got == sorted(want)
    assert images.binary_closing(df, 3, sizes)._jdf.queryExecution().executedPlan().toString().count("Join") == 1  # pixels meet their image's size and nothing else
