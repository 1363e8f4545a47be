from pyspark.sql import functions as F

from locspark.functions import scalars
from locspark.operators import assign, filters, images, spatial, stats, temporal
from locspark.sources import fixtures, tables

LOCS = "movie_id int, loc_id long, frame int, x double, y double, photons double"


def locs(spark, rows):
    return spark.createDataFrame(rows, LOCS)


def test_round_half_to_even_and_truncation(spark):
    df = locs(spark, [(0, i, 0, x, 0.0, 1.0) for i, x in enumerate([-0.9, -0.5, 0.5, 1.5, 2.5, 3.4, 3.5])])
    labels = spark.createDataFrame([(2, 0, 5)], "x int, y int, label int")
    cut = {r.loc_id: r.speckle_id for r in assign.assign_to_speckles(df, labels, 4, 4).collect()}
    near = {r.loc_id: (r.location, r.speckle_id) for r in assign.assign_to_speckles(df, labels, 4, 4, "round").collect()}
    assert cut == {0: 0, 1: 0, 2: 0, 3: 0, 4: 5, 5: 0, 6: 0}
    assert [near[i][1] for i in range(7)] == [-1, 0, 0, 5, 5, 0, -1] and near[6][0] == "out_of_bounds"


def test_runs_of_five_and_six(spark):
    df = locs(spark, [(0, i, i, 1.0, 1.0, 100.0) for i in range(5)] + [(0, 10 + i, 20 + i, 1.0, 1.0, 100.0) for i in range(6)] + [(1, 0, 3, None, 1.0, 1.0)])
    gone = {r.loc_id for r in filters.temporal_rejects(df.filter("movie_id = 0")).filter("rejected").collect()}
    assert gone == set(range(10, 16))
    assert temporal.temporal_link(df.filter("movie_id = 0")).count() == 11


def test_few_equal_and_duplicate_points(spark):
    df = locs(spark, [(0, i, 0, 1.0, 1.0, 1.0) for i in range(12)] + [(1, 0, 0, 5.0, 5.0, 1.0)])
    assert {r.mean_distance for r in spatial.mean_neighbor_distance(df).collect()} == {0.0}
    assert not filters.spatial_outliers(df).filter("outlier").count()
    assert sorted((r.movie_id, r.cluster_id) for r in spatial.dbscan(df, 1.0).collect()) == [(0, 0)] * 12 + [(1, -1)]


def test_empty_tables(spark):
    none = locs(spark, [])
    assert spatial.knn(none, 3).collect() == spatial.dbscan(none).collect() == filters.filter_cascade(tables.with_schema(none)).collect() == []
    assert stats.histogram(none, "photons", 5).collect() == []


def test_nulls_take_defaults(spark):
    row = spark.createDataFrame([(0, 1, None, None, None, None)], LOCS)
    wide = tables.with_schema(row)
    assert wide.select(filters.first_reason()).first()[0] == "photons:low"
    assert tables.with_schema(row, fill=True).first().photons == 0.0


def test_precision_without_photons(spark):
    df = locs(spark, [(0, i, 0, 1.0, 1.0, n) for i, n in enumerate([0.0, 1000.0, None])])
    for rule, want in (("sum", [2.0, 1.0, 2.0]), ("background", [2.0, 1.2 / 10**0.5, 2.0])):
        assert [r[0] for r in df.orderBy("loc_id").select(scalars.precision_from_photons(F.col("photons"), rule)).collect()] == want


def test_constant_histogram_and_image(spark):
    df = locs(spark, [(0, i, 0, 1.0, 1.0, 7.0) for i in range(3)])
    bins = stats.histogram(df, "photons", 4).orderBy("bin").collect()
    assert [b.n for b in bins] == [0, 0, 3, 0] and (bins[0].lo, bins[3].hi) == (6.5, 7.5)
    flat = spark.range(25).select(F.lit(0).alias("image_id"), (F.col("id") / 5).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("x"), F.lit(3.0).alias("value"))
    assert images.otsu_threshold(flat).first().threshold == 3.0
    assert images.threshold_mask(flat, images.otsu_threshold(flat)).count() == 0


def test_long_chain_is_one_component(spark):
    snake = spark.range(300).select(F.lit(0).alias("image_id"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"))
    assert images.label_components(snake).select("label").distinct().count() == 1


def test_coordinates_that_are_no_numbers(spark):
    df = locs(spark, [(0, i, 0, x, 0.0, 1.0) for i, x in enumerate([float("nan"), float("inf"), None, 1e300, 2.0])])
    labels = spark.createDataFrame([(2, 0, 5)], "x int, y int, label int")
    assert [r.speckle_id for r in assign.assign_to_speckles(df, labels, 4, 4).orderBy("loc_id").collect()] == [0, 0, 0, 0, 5]
    assert [r.location for r in assign.assign_to_speckles(df, labels, 4, 4, "round").orderBy("loc_id").collect()] == ["out_of_bounds"] * 4 + ["nuclear_speckle"]


def test_labels_of_each_movie(spark):
    df = locs(spark, [(0, 0, 0, 1.0, 1.0, 2.0), (1, 1, 0, 1.0, 1.0, 3.0)])
    labels = spark.createDataFrame([(0, 1, 1, 7), (1, 0, 0, 8)], "movie_id int, x int, y int, label int")
    placed = assign.assign_to_speckles(df, labels, 4, 4)
    assert {(r.movie_id, r.speckle_id) for r in placed.collect()} == {(0, 7), (1, 0)}
    assert {(r.movie_id, r.speckle_area, r.n_speckle) for r in assign.enrichment_density(placed, labels, 4, 4).collect()} == {(0, 1, 1), (1, 1, 0)}
    assert {(r.movie_id, r.speckle_id, r.molecule_count, tuple(r.molecules)) for r in assign.speckle_stats(placed, labels, molecules=True).collect()} == {(0, 7, 1, (0,)), (1, 8, 0, ())}


def test_tables_come_back(spark, tmp_path):
    df = tables.with_schema(locs(spark, [(0, 1, 2, 1.5, 2.5, None), (3, 4, 5, 6.0, 7.0, 8.0)]))
    tables.write_localizations(df, f"file://{tmp_path}/locs")
    back = tables.read_localizations(spark, f"file://{tmp_path}/locs")
    assert back.columns == df.columns and {(r.movie_id, r.loc_id, r.frame, r.x, r.photons, r.sigma_x) for r in back.collect()} == {(0, 1, 2, 1.5, 0.0, 0.0), (3, 4, 5, 6.0, 8.0, 0.0)}
    tables.write_localizations(df, f"file://{tmp_path}/csv", csv=True)
    rows = spark.read.option("header", True).option("inferSchema", True).csv(f"file://{tmp_path}/csv")
    assert rows.columns == df.columns and sorted(r.photons for r in rows.collect()) == [0.0, 8.0]
    tables.write_bundle(f"file://{tmp_path}/bundle", locs=df, sizes=df.select("loc_id"))
    assert spark.read.parquet(f"file://{tmp_path}/bundle/sizes").count() == 2
    found = df.select("movie_id", "loc_id").withColumn("cluster_id", F.lit(9)).withColumn("sub_cluster_id", F.lit(1)).filter("loc_id = 1")
    assert {(r.loc_id, r.cluster_id, r.sub_cluster_id) for r in stats.attach_cluster_labels(df, found).collect()} == {(1, 9, 1), (4, -1, 0)}


def test_distance_transform_of_a_wide_row(spark):
    mask = spark.range(1, 400).select(F.lit(0).alias("image_id"), F.lit(1).alias("y"), F.col("id").cast("int").alias("x"))
    sizes = spark.createDataFrame([(0, 2, 401)], "image_id int, height int, width int")
    assert {round(r.distance, 9) for r in images.distance_transform(mask, sizes).collect()} == {1.0}
    tall = spark.createDataFrame([(0, 1, 401)], "image_id int, height int, width int")
    own = mask.withColumn("y", F.lit(0))
    assert {(r.x, r.distance) for r in images.distance_transform(own, tall).collect()} == {(x, float(min(x, 400 - x))) for x in range(1, 400)}


def test_fitted_emitters_go_through_the_cascade(spark):
    from locspark.jobs.workloads import numbered
    from locspark.operators import localize

    spots = F.lit(0.0)
    for cy, cx in ((20, 20), (20, 24), (40, 40)):
        spots = spots + 300 * F.exp(-((F.col("y") - cy) * (F.col("y") - cy) + (F.col("x") - cx) * (F.col("x") - cx)) / 2.0)
    grid = spark.range(64 * 64).select(F.lit(0).alias("movie_id"), F.lit(0).alias("frame"), (F.col("id") / 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x")).withColumn("value", 5.0 + (F.col("x") * 7 + F.col("y") * 13) % 5 + spots)
    found = numbered(localize.localize_grouped(tables.pixels_to_frames(grid)))
    assert set(found.columns) >= {"cluster_n_molecules", "cluster_chi_squared", "cluster_r_squared", "localization_precision", "sigma_x", "sigma_y"}
    rows, kept = found.collect(), {r.loc_id for r in filters.filter_cascade(found).collect()}
    # fewer than ten rows have no spatial outliers, one frame has no runs: what stays is what the row rules let through
    good = {r.loc_id for r in rows if 50 <= r.photons <= 50_000 and r.localization_precision <= 20 and 0.5 <= r.sigma_x <= 3 and r.cluster_n_molecules >= 2 and r.cluster_chi_squared <= 10}
    assert kept == good and len(rows) >= 2


def test_cluster_means_in_any_order(spark):
    """Means that lie halfway between two figures: sums of doubles miss them by the order of rows."""
    from fractions import Fraction

    rows = [(c, i, (7 * i * i + 3 * c * i) % 11 / 10, (c * 37 + 131) % 190 + (i * (5 + c) % 17 - 8) / 10) for c in range(40) for i in range(64)]
    exact = lambda c, at: float(sum(Fraction(str(r[at])) for r in rows if r[0] == c) / 64)
    want = {c: (exact(c, 2), exact(c, 3)) for c in range(40)}
    ways = [rows, rows[::-1], sorted(rows, key=lambda r: r[2]), sorted(rows, key=lambda r: -r[3])]
    assert any(sum(r[2] for r in way if r[0] == c) / 64 != want[c][0] for way in ways for c in range(40))
    seen = []
    for i, way in enumerate(ways):
        df = spark.createDataFrame([(0, c, n, n, q, x, 1.5) for c, n, q, x in way], "movie_id int, cluster_id int, loc_id long, frame int, quality_score double, x double, y double")
        df = df.withColumn("photons", F.col("x") * 7).withColumn("localization_precision", F.col("x") / 3).coalesce(1 + 2 * (i % 2))
        got = {r.cluster_id: r for r in stats.cluster_properties(df).drop("std_photons").collect()}
        assert {c: (r.mean_quality, r.mean_x) for c, r in got.items()} == want
        seen.append(got)
    assert all(s == seen[0] for s in seen)


def test_cluster_means_beyond_decimals(spark):
    """Numbers out of the range of decimals are added up as doubles; rows without a number don't count for a mean."""
    nan, inf = float("nan"), float("inf")
    cases = {0: [1e300, 3e300], 1: [1e-200, 3e-200], 2: [nan, 1.0], 3: [inf, 1.0], 4: [None, 2.0], 5: [None, None], 6: [0.0, -0.0], 7: [1e11] * 100_001, 8: [-4e15, 4e15], 9: [-2.5, 1e-30]}
    df = spark.createDataFrame([(0, c, i, i, v, 1.0, v, 0.5, 1.0) for c, vs in cases.items() for i, v in enumerate(vs)], "movie_id int, cluster_id int, loc_id long, frame int, x double, y double, photons double, quality_score double, localization_precision double")
    got = {r.cluster_id: (r.mean_x, r.total_photons) for r in stats.cluster_properties(df).collect()}
    assert str(got.pop(2)) == "(nan, nan)"
    assert got == {0: (2e300, 4e300), 1: (2e-200, 4e-200), 3: (inf, inf), 4: (2.0, 2.0), 5: (None, 0.0), 6: (0.0, 0.0), 7: (1e11, 1.00001e16), 8: (0.0, 0.0), 9: (-1.25, -2.5)}


def test_views_of_a_large_table_are_not_crossed_by_partitions(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # less than what Spark takes the events of the smallest tables for
    try:
        for name in ("marker_pixels", "dapi_pixels", "frame_pixels", "labels_image"):
            plan = fixtures.view(spark, "/root/testdata/sf0.001", name)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
