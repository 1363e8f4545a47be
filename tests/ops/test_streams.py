import numpy as np
from pyspark.sql import functions as F

from locspark.operators import images, localize
from locspark.sources import tables


def frames(spark, n=6):
    ys, xs = np.indices((32, 32))
    rng = np.random.default_rng(4)
    rows = []
    for k in range(n):
        image = 5 + (xs * 7 + ys * 3 + k) % 4 + sum(200 * np.exp(-((ys - y) ** 2 + (xs - x) ** 2) / 3.0) for y, x in rng.uniform(8, 24, (2, 2)))
        rows.append((k // 3, k % 3, 32, 32, image.ravel().tolist()))
    return spark.createDataFrame(rows + [(9, 0, 32, 32, None)], tables.FRAME)


def test_localizers_agree_on_a_stream(spark, tmp_path):
    frames(spark).repartition(4).write.parquet(str(tmp_path / "frames"))
    whole = spark.read.parquet(str(tmp_path / "frames"))
    for name in ("localize_centroid", "localize_bgsub", "localize_grouped"):
        of = getattr(localize, name)
        stream = of(tables.read_frame_stream(spark, str(tmp_path / "frames"), files_per_batch=1))
        assert stream.isStreaming
        query = tables.write_stream(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
        assert query.awaitTermination(120) and not query.exception()
        want = sorted(map(str, of(whole).collect()))
        assert want and sorted(map(str, spark.read.parquet(str(tmp_path / name)).select(stream.columns).collect())) == want
    # files that come later are read by the next run, and only these
    frames(spark).filter("movie_id = 0").withColumn("movie_id", F.lit(50)).write.mode("append").parquet(str(tmp_path / "frames"))
    tables.write_stream(localize.localize_centroid(tables.read_frame_stream(spark, str(tmp_path / "frames"))), str(tmp_path / "localize_centroid"), str(tmp_path / "localize_centroid-checkpoint")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "localize_centroid"))
    assert got.filter("movie_id = 50").count() == got.filter("movie_id = 0").count() > 0


def test_rules_that_the_tables_never_meet(spark):
    late = frames(spark).withColumn("frame", F.col("frame") + 999)
    assert {r.frame for r in localize.localize_bgsub(late).collect()} == {999} and {r.frame for r in localize.localize_bgsub(late, max_frames=1001).collect()} == {999, 1000}
    ys, xs = np.indices((32, 32))
    image = 5 + (xs * 7 + ys * 3) % 4 * 0.25 + sum(a * np.exp(-((ys - y) ** 2 + (xs - x) ** 2) / 1.2) for y, x, a in ((15, 15, 300), (15, 18, 250), (18, 15, 200), (12, 15, 150)))
    crowd = spark.createDataFrame([(1, 0, 32, 32, image.ravel().tolist())], tables.FRAME)
    every, two = (sorted((r.cluster_n_molecules, r.amplitude) for r in localize.localize_grouped(crowd, max_emitters=k, detection_threshold=1.0).collect()) for k in (10, 2))
    assert len(every) >= 3 and every[-1][0] >= 3 and max(n for n, _ in two) == 2 and len(two) < len(every)
    channels = spark.createDataFrame([(0, c, y, x, float(10 * c + y)) for c in (0, 1) for y in (0, 1) for x in (0, 1)], "image_id int, channel int, y int, x int, value double")
    assert sorted((r.y, r.x, r.value) for r in tables.select_channel(channels).collect()) == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 1.0), (1, 1, 1.0)]
    square = spark.createDataFrame([(0, 1, y, x) for y in range(5, 15) for x in range(5, 15)], "image_id int, label int, y int, x int")
    r = images.region_props(square, square.selectExpr("image_id", "y", "x", "1.0d as value")).first()
    assert r.perimeter == 36 and abs(r.circularity - 4 * np.pi * 100 / 36**2) < 1e-12
