"""Queries over the given tables, by name, and the same in SQL.

Figures are rounded to six places in both, as sums of floats depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locspark.functions import scalars as S
from locspark.jobs import workloads
from locspark.operators import assign, filters, floods, images, localize, render, spatial, stats, temporal
from locspark.sources import tables
from locspark.sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIZE = 256


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) if t in ("double", "float") else F.col(c).cast("long") if t in ("int", "smallint") else F.col(c)).alias(c) for c, t in df.dtypes))


def query(sql: str | None, *views: str, round_: bool = True):
    """Registers a function of the named views under its name, with its SQL."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(*(view(spark, sf_dir, v) for v in views)) if views else f(spark, sf_dir)
            return rounded(out) if round_ else out

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


_QUALITY = """least(1.0, greatest(0.0, (CASE WHEN photons < 50 THEN 0.1 WHEN photons > 50000 THEN 0.5 ELSE 1 - abs((photons - 50) / 49950.0 - 950.0 / 49950.0) END) * greatest(0.0, 1 - localization_precision / 20)
 * (CASE WHEN (sigma_x + sigma_y) / 2 BETWEEN 0.5 AND 3.0 THEN 1.0 ELSE 0.3 END) * (CASE WHEN greatest(sigma_x, sigma_y) / least(sigma_x, sigma_y) <= 2 THEN 1 - (greatest(sigma_x, sigma_y) / least(sigma_x, sigma_y) - 1) ELSE 0.1 END)
 * (CASE WHEN cluster_chi_squared <= 10 THEN 1 - cluster_chi_squared / 10 ELSE 0.2 END)))"""
_REASON = """CASE WHEN photons < 50 THEN 'photons:low' WHEN photons > 50000 THEN 'photons:high' WHEN localization_precision > 20 THEN 'precision:precision' WHEN NOT (sigma_x + sigma_y) / 2 BETWEEN 0.5 AND 3.0 THEN 'psf_shape:sigma'
 WHEN greatest(sigma_x, sigma_y) / least(sigma_x, sigma_y) > 2 THEN 'psf_shape:ellipticity' WHEN cluster_n_molecules < 2 THEN 'cluster_quality:molecules' WHEN cluster_chi_squared > 10 THEN 'cluster_quality:chi_squared' END"""


@query("t AS (SELECT row_number() OVER () AS i, url FROM pages) SELECT url, CASE WHEN regexp_matches(lower(url), '" + "|".join(S.MARKER_WORDS) + "') THEN 'marker' WHEN regexp_matches(lower(url), '" + "|".join(S.DAPI_WORDS) + "') THEN 'dapi' ELSE 'other' END AS channel FROM t")
def classify_channel(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", S.classify_channel(F.col("url")).alias("channel"))


_NAMES = "'dir/cell' || (event_id % 500) || CASE event_id % 4 WHEN 0 THEN '_DAPI.tif' WHEN 1 THEN '_sc35.TIF' WHEN 2 THEN '_ch2.nd2' ELSE '.txt' END"


@query(f"n AS (SELECT DISTINCT split_part({_NAMES}, '/', 2) AS name FROM events) SELECT name, CASE WHEN contains(name, 'sc35') THEN 'marker' WHEN contains(name, 'DAPI') OR contains(name, 'ch2') THEN 'dapi' ELSE 'other' END AS channel FROM n WHERE NOT contains(name, '.txt')")
def image_catalog(spark, sf_dir):
    return tables.image_catalog(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_NAMES).alias("path")))


@query("t AS (SELECT * FROM locs) SELECT loc_id, CAST(x AS FLOAT)::DOUBLE AS x, CAST(y AS FLOAT)::DOUBLE AS y, CAST(x_error AS FLOAT)::DOUBLE AS lpx, CAST(y_error AS FLOAT)::DOUBLE AS lpy, CAST(photons AS FLOAT)::DOUBLE AS photons, CAST(frame AS BIGINT) AS frame FROM t", "locs", round_=False)
def to_render_format(locs):
    out = locs.select("loc_id", *S.render_format())
    return out.select(*(F.col(c).cast("double" if t == "float" else "long").alias(c) for c, t in out.dtypes))


@query(f"""t AS (SELECT * FROM locs) SELECT loc_id, round(greatest(0.1, least(2.0, 1 / sqrt(photons / 1000))), 6) AS precision_sum, round(greatest(0.05, least(2.0, 1.2 / sqrt(photons / 100))), 6) AS precision_background,
 round(sqrt(x_error * x_error + y_error * y_error) * 10, 6) AS precision_nm, round(greatest(photons / 100 * 2 * pi() * sigma_x * sigma_x, 50), 6) AS emitter, round({_QUALITY}, 6) AS quality,
 round(greatest(0.1, least(2.0, photons / 1000)) * greatest(0.1, least(3.0, 20 / greatest(localization_precision, 1.0))), 6) AS weight, round((sigma_x + sigma_y) / 2 * 5, 6) AS sigma, round(x * 5, 6) AS super_x, round(y * 5, 6) AS super_y FROM t""", "locs")
def scalar_functions(locs):
    n = F.col("photons")
    return locs.select("loc_id", S.precision_from_photons(n).alias("precision_sum"), S.precision_from_photons(n, "background").alias("precision_background"), S.localization_precision(F.col("x_error"), F.col("y_error")).alias("precision_nm"), S.emitter_photons(n / 100, F.col("sigma_x")).alias("emitter"), S.quality_score().alias("quality"), S.render_weight().alias("weight"), S.render_sigma().alias("sigma"), (F.col("x") * 5).alias("super_x"), (F.col("y") * 5).alias("super_y"))


for _step, _where in {"photons": "photons BETWEEN 50 AND 50000", "precision": "localization_precision <= 20", "psf_shape": "(sigma_x + sigma_y) / 2 BETWEEN 0.5 AND 3 AND greatest(sigma_x, sigma_y) / least(sigma_x, sigma_y) <= 2", "cluster_quality": "cluster_n_molecules >= 2 AND cluster_chi_squared <= 10"}.items():

    def _filtered(locs, step=_step):
        return filters.apply_filter(locs, step).select("movie_id", "loc_id")

    _filtered.__name__ = f"filter_{_step}"
    query(f"t AS (SELECT * FROM locs) SELECT CAST(movie_id AS BIGINT) AS movie_id, loc_id FROM t WHERE {_where}", "locs")(_filtered)

# the k-th nearest others by brute force, over rows that pass the row-local filters
_KEPT = f"t AS (SELECT * FROM locs WHERE ({_REASON}) IS NULL)"
_NEAR = "p AS (SELECT a.movie_id, a.loc_id, b.loc_id AS other_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM t a JOIN t b ON a.movie_id = b.movie_id AND a.loc_id <> b.loc_id), k AS (SELECT *, row_number() OVER (PARTITION BY movie_id, loc_id ORDER BY distance, other_id) AS rank FROM p)"
_OUT = "g AS (SELECT movie_id, loc_id, avg(distance) AS d FROM k WHERE rank <= 9 GROUP BY ALL), s AS (SELECT *, CASE WHEN stddev_pop(d) OVER (PARTITION BY movie_id) > 0 THEN abs(d - avg(d) OVER (PARTITION BY movie_id)) / stddev_pop(d) OVER (PARTITION BY movie_id) > 3 ELSE false END AS outlier FROM g)"
# runs by a walk over rows in order of frame and id
_WALK = """o AS (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY frame, loc_id) AS r FROM {rows}),
w AS (SELECT movie_id, r, loc_id, frame, loc_id AS run_id, x AS ax, y AS ay, frame AS af FROM o WHERE r = 1
 UNION ALL SELECT o.movie_id, o.r, o.loc_id, o.frame, CASE WHEN {fits} THEN w.run_id ELSE o.loc_id END, CASE WHEN {fits} THEN w.ax ELSE o.x END, CASE WHEN {fits} THEN w.ay ELSE o.y END, CASE WHEN {fits} THEN w.af ELSE o.frame END
 FROM w JOIN o ON o.movie_id = w.movie_id AND o.r = w.r + 1)"""
_STRICT = "o.frame = w.frame + 1 AND sqrt((o.x - w.ax) * (o.x - w.ax) + (o.y - w.ay) * (o.y - w.ay)) < 2.0"
_LOOSE = "o.frame - w.af <= 10 AND sqrt((o.x - w.ax) * (o.x - w.ax) + (o.y - w.ay) * (o.y - w.ay)) <= 2.0"


def _kept(locs):
    return locs.filter(filters.first_reason().isNull())


@query(f"{_KEPT}, {_NEAR}, {_OUT} SELECT CAST(movie_id AS BIGINT) AS movie_id, loc_id, outlier FROM s", "locs")
def filter_spatial_outliers(locs):
    return filters.spatial_outliers(_kept(locs)).select("movie_id", "loc_id", "outlier")


@query(f"{_WALK.format(rows='locs', fits=_STRICT)} SELECT CAST(movie_id AS BIGINT) AS movie_id, loc_id, count(*) OVER (PARTITION BY movie_id, run_id) > 5 AS rejected FROM w", "locs")
def filter_temporal_consistency(locs):
    return filters.temporal_rejects(locs).select("movie_id", "loc_id", "rejected")


_CASCADE = f"{_KEPT}, {_NEAR}, {_OUT}, u AS (SELECT t.* FROM t JOIN s USING (movie_id, loc_id) WHERE NOT s.outlier), {_WALK.format(rows='u', fits=_STRICT)}, z AS (SELECT movie_id, loc_id, count(*) OVER (PARTITION BY movie_id, run_id) > 5 AS rejected FROM w)"


@query(f"{_CASCADE} SELECT CAST(u.movie_id AS BIGINT) AS movie_id, u.loc_id, round({_QUALITY}, 6) AS quality_score FROM u JOIN z USING (movie_id, loc_id) WHERE NOT z.rejected", "locs")
def filter_cascade(locs):
    return filters.filter_cascade(locs).select("movie_id", "loc_id", "quality_score")


@query(f"{_CASCADE}, f AS (SELECT movie_id, {_REASON} AS step FROM locs WHERE ({_REASON}) IS NOT NULL UNION ALL SELECT movie_id, 'spatial:outlier' FROM s WHERE outlier UNION ALL SELECT movie_id, CASE WHEN rejected THEN 'temporal:run' ELSE 'kept' END FROM z) SELECT CAST(movie_id AS BIGINT) AS movie_id, step, count(*) AS n FROM f GROUP BY ALL", "locs")
def filter_funnel(locs):
    return filters.filter_funnel(locs)


@query(f"{_WALK.format(rows='locs', fits=_LOOSE)}, g AS (SELECT *, count(*) OVER (PARTITION BY movie_id, run_id) AS n FROM w), h AS (SELECT movie_id, run_id, min(af) AS f FROM g WHERE n >= 2 GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY f, run_id) - 1 AS c FROM h) SELECT CAST(g.movie_id AS BIGINT) AS movie_id, i.c AS temporal_cluster_id, g.loc_id FROM g JOIN i USING (movie_id, run_id)", "locs")
def temporal_link(locs):
    return temporal.temporal_link(locs)


@query(f"{_KEPT}, {_NEAR} SELECT CAST(movie_id AS BIGINT) AS movie_id, loc_id, other_id, round(distance, 6) AS distance, rank FROM k WHERE rank <= 5", "locs")
def knn(locs):
    return spatial.knn(_kept(locs), 5)


@query(f"{_KEPT}, {_NEAR} SELECT CAST(movie_id AS BIGINT) AS movie_id, loc_id, round(1 / (avg(distance) + 1e-6), 6) AS density FROM k WHERE rank <= 9 GROUP BY ALL", "locs")
def local_density(locs):
    return spatial.local_density(_kept(locs))


@query(f"""{_KEPT}, {_NEAR}, d AS (SELECT movie_id, distance, row_number() OVER (PARTITION BY movie_id ORDER BY distance) AS i FROM k WHERE rank = 3),
b AS (SELECT *, lead(distance, 2) OVER w - 2 * lead(distance) OVER w + distance AS bend, lead(distance) OVER w AS knee FROM d WINDOW w AS (PARTITION BY movie_id ORDER BY i)), c AS (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY bend DESC, i) AS r FROM b WHERE bend IS NOT NULL)
SELECT CAST(movie_id AS BIGINT) AS movie_id, round(least(10.0, greatest(2.5, knee)), 6) AS eps FROM c WHERE r = 1""", "locs")
def knee_eps(locs):
    return spatial.knee_eps(_kept(locs))


_EPS = "e AS (SELECT a.movie_id, a.loc_id, b.loc_id AS other_id FROM t a JOIN t b ON a.movie_id = b.movie_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.0)"


@query(f"{_KEPT}, {_EPS} SELECT CAST(movie_id AS BIGINT) AS movie_id, loc_id, other_id FROM e", "locs")
def eps_neighbors(locs):
    return spatial.eps_neighbors(_kept(locs), 1.0).drop("distance")


@query(f"""{_KEPT}, {_EPS}, c AS (SELECT movie_id, loc_id FROM e GROUP BY ALL HAVING count(*) >= 3), l AS (SELECT e.* FROM e JOIN c USING (movie_id, loc_id) JOIN c d ON e.movie_id = d.movie_id AND e.other_id = d.loc_id),
r AS (SELECT movie_id, loc_id, loc_id AS root FROM c UNION SELECT r.movie_id, l.other_id, r.root FROM r JOIN l ON r.movie_id = l.movie_id AND r.loc_id = l.loc_id AND r.root < l.other_id),
m AS (SELECT movie_id, loc_id, min(root) AS root FROM r GROUP BY ALL), b AS (SELECT e.movie_id, e.loc_id, min(m.root) AS root FROM e JOIN m ON e.movie_id = m.movie_id AND e.other_id = m.loc_id GROUP BY ALL),
n AS (SELECT *, dense_rank() OVER (PARTITION BY movie_id ORDER BY root) - 1 AS cluster_id FROM (SELECT DISTINCT movie_id, root FROM m)),
a AS (SELECT movie_id, loc_id, root FROM m UNION ALL SELECT b.* FROM b ANTI JOIN m USING (movie_id, loc_id))
SELECT CAST(t.movie_id AS BIGINT) AS movie_id, t.loc_id, CAST(coalesce(n.cluster_id, -1) AS BIGINT) AS cluster_id FROM t LEFT JOIN a USING (movie_id, loc_id) LEFT JOIN n ON a.movie_id = n.movie_id AND a.root = n.root""", "locs")
def dbscan(locs):
    return spatial.dbscan(_kept(locs), 1.0).select("movie_id", "loc_id", "cluster_id")


_TRUNC = "a AS (SELECT l.*, coalesce(i.label, 0) AS speckle_id FROM locs l LEFT JOIN labels_image i ON i.movie_id = l.movie_id AND i.x = trunc(l.x) AND i.y = trunc(l.y) AND trunc(l.x) BETWEEN 0 AND 255 AND trunc(l.y) BETWEEN 0 AND 255)"


def _assigned(locs, labels):
    return assign.assign_to_speckles(locs, labels, SIZE, SIZE)


@query(f"{_TRUNC} SELECT CAST(movie_id AS BIGINT) AS movie_id, loc_id, CASE WHEN speckle_id > 0 THEN 'nuclear_speckle' ELSE 'background' END AS location, CAST(speckle_id AS BIGINT) AS speckle_id FROM a", "locs", "labels_image")
def assign_trunc(locs, labels):
    return _assigned(locs, labels).select("movie_id", "loc_id", "location", "speckle_id")


@query("""r AS (SELECT movie_id, loc_id, round_even(x - 100, 0) AS px, round_even(y - 100, 0) AS py FROM locs), a AS (SELECT r.*, i.label, px BETWEEN 0 AND 79 AND py BETWEEN 0 AND 79 AS inside FROM r LEFT JOIN labels_image i ON i.movie_id = r.movie_id AND i.x = px AND i.y = py)
SELECT CAST(movie_id AS BIGINT) AS movie_id, loc_id, CASE WHEN NOT inside THEN 'out_of_bounds' WHEN label > 0 THEN 'nuclear_speckle' ELSE 'background' END AS location, CAST(CASE WHEN NOT inside THEN -1 ELSE coalesce(label, 0) END AS BIGINT) AS speckle_id FROM a""", "locs", "labels_image")
def assign_round(locs, labels):
    moved = locs.withColumn("x", F.col("x") - 100).withColumn("y", F.col("y") - 100)
    return assign.assign_to_speckles(moved, labels, 80, 80, "round").select("movie_id", "loc_id", "location", "speckle_id")


@query(f"{_TRUNC}, s AS (SELECT movie_id, count(*) AS area FROM labels_image GROUP BY movie_id) SELECT CAST(movie_id AS BIGINT) AS movie_id, count(*) FILTER (speckle_id > 0) AS n_speckle, count(*) FILTER (speckle_id = 0) AS n_background, any_value(area) AS speckle_area, 65536 - any_value(area) AS background_area, round((count(*) FILTER (speckle_id > 0) / any_value(area)) / (count(*) FILTER (speckle_id = 0) / (65536 - any_value(area))), 6) AS enrichment FROM a JOIN s USING (movie_id) GROUP BY movie_id", "locs", "labels_image")
def enrichment_density(locs, labels):
    return assign.enrichment_density(_assigned(locs, labels), labels, SIZE, SIZE)


@query(f"{_TRUNC} SELECT CAST(movie_id AS BIGINT) AS movie_id, count(*) AS total, count(*) FILTER (speckle_id > 0) AS n_speckle, count(*) FILTER (speckle_id = 0) AS n_background, round(count(*) FILTER (speckle_id > 0) / greatest(count(*) FILTER (speckle_id = 0), 1), 6) AS enrichment, round(100 * count(*) FILTER (speckle_id > 0) / count(*), 6) AS speckle_percent FROM a GROUP BY movie_id", "locs", "labels_image")
def enrichment_counts(locs, labels):
    return assign.enrichment_counts(_assigned(locs, labels))


@query(f"{_TRUNC}, g AS (SELECT DISTINCT movie_id, label FROM labels_image SEMI JOIN locs USING (movie_id)) SELECT CAST(g.movie_id AS BIGINT) AS movie_id, CAST(g.label AS BIGINT) AS speckle_id, count(a.loc_id) AS molecule_count, round(coalesce(sum(a.photons), 0), 6) AS total_photons FROM g LEFT JOIN a ON a.movie_id = g.movie_id AND a.speckle_id = g.label GROUP BY ALL", "locs", "labels_image")
def speckle_stats(locs, labels):
    return assign.speckle_stats(_assigned(locs, labels), labels)


@query(f"{_TRUNC} SELECT CAST(movie_id AS BIGINT) AS movie_id, CASE WHEN speckle_id > 0 THEN 'nuclear_speckle' ELSE 'background' END AS location, count(*) AS n FROM a GROUP BY ALL", "locs", "labels_image")
def points_by_location(locs, labels):
    return assign.points_by_location(_assigned(locs, labels))


@query(f"{_TRUNC} SELECT CAST(movie_id AS BIGINT) AS movie_id, CASE WHEN speckle_id > 0 THEN 'nuclear_speckle' ELSE 'background' END AS location, loc_id, round(x, 6) AS x, round(y, 6) AS y, CAST(frame AS BIGINT) AS frame, round(photons, 6) AS photons FROM a", "locs", "labels_image")
def located_points(locs, labels):
    return assign.located_points(_assigned(locs, labels))


_M = "CAST(movie_id AS BIGINT) AS movie_id"
_MC = f"{_M}, CAST(cluster_id AS BIGINT) AS cluster_id"
_C = "t AS (SELECT * FROM locs WHERE cluster_id <> -1)"
query(f"t AS (SELECT * FROM locs) SELECT {_M}, count(*) AS n, round(avg(localization_precision), 6) AS mean_precision, round(stddev_pop(localization_precision), 6) AS std_precision, round(avg(photons), 6) AS mean_photons, round(stddev_pop(photons), 6) AS std_photons FROM t GROUP BY movie_id", "locs")(stats.localization_summary)
_PROPERTIES = f"""g AS (SELECT movie_id, cluster_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, max(x) - min(x) AS xe, max(y) - min(y) AS ye, sum(photons) AS tp, avg(photons) AS mp, stddev_pop(photons) AS sp, avg(quality_score) AS q, avg(localization_precision) AS lp, max(frame) - min(frame) + 1 AS span FROM t GROUP BY ALL),
c AS (SELECT movie_id, cluster_id, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) * 10 AS c FROM t JOIN g USING (movie_id, cluster_id) GROUP BY ALL)
SELECT {_MC}, n AS n_molecules, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, round(xe, 6) AS x_extent, round(ye, 6) AS y_extent, round(tp, 6) AS total_photons, round(mp, 6) AS mean_photons, round(sp, 6) AS std_photons, round(q, 6) AS mean_quality, round(lp, 6) AS mean_precision, CAST(span AS BIGINT) AS frame_span, round(xe * ye, 6) AS area, round(xe * ye * 100, 6) AS area_nm2,
 round(sqrt(xe * ye / pi()), 6) AS radius, round(sqrt(xe * ye / pi()) * 10, 6) AS radius_nm, round(n / greatest(xe * ye, 1.0), 6) AS density, round(n / greatest(xe * ye, 1.0) * 10000, 6) AS density_um2, round(n / greatest(span, 1), 6) AS temporal_density, round(c, 6) AS compactness_nm FROM g JOIN c USING (movie_id, cluster_id)"""
_STATS = f"t AS (SELECT movie_id, cluster_id, count(*) AS n FROM locs GROUP BY ALL) SELECT {_M}, count(*) FILTER (cluster_id <> -1) AS n_clusters, CAST(coalesce(sum(n) FILTER (cluster_id = -1), 0) AS BIGINT) AS n_noise, round(coalesce(sum(n) FILTER (cluster_id = -1), 0) / sum(n), 6) AS noise_fraction, min(n) FILTER (cluster_id <> -1) AS min_size, max(n) FILTER (cluster_id <> -1) AS max_size, round(avg(n) FILTER (cluster_id <> -1), 6) AS mean_size FROM t GROUP BY movie_id".replace("FROM locs", "FROM {rows}")
query(f"{_C}, {_PROPERTIES}", "locs")(stats.cluster_properties)
query(_STATS.format(rows="locs"), "locs")(stats.cluster_stats)
query(f"{_C} SELECT {_MC}, count(*) AS n, round(avg(photons), 6) AS mean_photons, round((max(x) - min(x)) * (max(y) - min(y)), 6) AS area, round(count(*) / greatest((max(x) - min(x)) * (max(y) - min(y)), 1.0), 6) AS density FROM t GROUP BY movie_id, cluster_id", "locs")(stats.cluster_table)
query(f"{_C} SELECT {_MC}, round(avg(x), 6) AS center_x, round(avg(y), 6) AS center_y, round(4 * stddev_pop(x), 6) AS width, round(4 * stddev_pop(y), 6) AS height FROM t GROUP BY movie_id, cluster_id HAVING count(*) >= 3", "locs")(stats.cluster_ellipses)
query(f"{_C} SELECT {_MC}, count(*) AS size, CAST(max(frame) - min(frame) + 1 AS BIGINT) AS lifetime FROM t GROUP BY movie_id, cluster_id", "locs")(stats.cluster_lifetimes)
query(f"t AS (SELECT * FROM locs) SELECT {_M}, CAST(frame AS BIGINT) AS frame, count(*) AS n FROM t GROUP BY movie_id, frame", "locs")(stats.locs_per_frame)
query(f"{_C}, r AS (SELECT *, dense_rank() OVER (PARTITION BY movie_id ORDER BY cluster_id) AS r FROM t) SELECT {_MC}, CAST(frame AS BIGINT) AS frame, count(*) AS n FROM r WHERE r <= 10 GROUP BY movie_id, cluster_id, frame", "locs")(stats.cluster_frames)
query(f"{_C}, r AS (SELECT *, dense_rank() OVER (PARTITION BY movie_id ORDER BY cluster_id) AS r FROM t), q AS (SELECT movie_id, cluster_id, quantile_cont(photons, 0.25) AS q1, quantile_cont(photons, 0.5) AS q2, quantile_cont(photons, 0.75) AS q3 FROM r WHERE r <= 10 GROUP BY ALL), v AS (SELECT r.movie_id, r.cluster_id, q1, q2, q3, photons, photons BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM r JOIN q USING (movie_id, cluster_id)) SELECT {_MC}, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, round(min(photons) FILTER (inside), 6) AS low, round(max(photons) FILTER (inside), 6) AS high, count(*) FILTER (NOT inside) AS n_fliers FROM v GROUP BY movie_id, cluster_id, q1, q2, q3", "locs")(stats.photon_boxplot)
query(f"t AS (SELECT * FROM locs) SELECT {_M}, round(min(x) - 5, 6) AS x_min, round(max(x) + 5, 6) AS x_max, round(min(y) - 5, 6) AS y_min, round(max(y) + 5, 6) AS y_max FROM t GROUP BY movie_id", "locs")(stats.image_bounds)
query(f"t AS (SELECT * FROM locs) SELECT {_M}, count(*) AS n, count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS n_clusters, count(*) FILTER (cluster_id = -1) AS n_noise, round(sum(photons), 6) AS total_photons, round(avg(photons), 6) AS mean_photons, round(avg(quality_score), 6) AS mean_quality, round(100 * count(*) FILTER (cluster_id = -1) / count(*), 6) AS noise_percent, round(count(*) FILTER (cluster_id <> -1) / count(DISTINCT cluster_id) FILTER (cluster_id <> -1), 6) AS mean_cluster_size FROM t GROUP BY movie_id", "locs")(stats.dataset_summary)
query(f"t AS (SELECT movie_id, loc_id, CAST(frame - lag(frame) OVER (PARTITION BY movie_id ORDER BY frame, loc_id) AS BIGINT) AS gap FROM locs) SELECT {_M}, loc_id, gap FROM t WHERE gap IS NOT NULL", "locs")(stats.frame_intervals)
query(f"{_C} SELECT {_M}, loc_id, CAST(cluster_id AS BIGINT) AS cluster_id, row_number() OVER (PARTITION BY movie_id, cluster_id ORDER BY loc_id) - 1 AS rank FROM t", "locs")(stats.rank_in_cluster)
query(f"t AS (SELECT * FROM locs) SELECT {_M}, count(*) AS n_localizations, CAST(max(frame) + 1 AS BIGINT) AS n_frames, round(min(photons), 6) AS min_photons, round(max(photons), 6) AS max_photons, min(quality_score) AS min_quality, max(quality_score) AS max_quality, count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS n_clusters FROM t GROUP BY movie_id", "locs")(lambda locs: tables.localization_metadata(locs).drop("parameters"))
QUERIES["localization_metadata"], SQL["localization_metadata"] = QUERIES.pop("<lambda>"), SQL.pop("<lambda>")


@query("""d AS (SELECT movie_id, cluster_id, frame, count(*) AS k FROM locs WHERE cluster_id <> -1 GROUP BY ALL), g AS (SELECT movie_id, cluster_id, sum(k) AS n, max(k) AS most, max(frame) - min(frame) + 1 AS span FROM d GROUP BY ALL)
SELECT CAST(l.movie_id AS BIGINT) AS movie_id, l.loc_id, CAST(CASE WHEN g.n < 2 OR (g.n / g.span > 0.02 AND g.most > least(1, g.n // 2)) THEN -1 ELSE l.cluster_id END AS BIGINT) AS cluster_id FROM locs l LEFT JOIN g USING (movie_id, cluster_id)""", "locs")
def validate_temporal(locs):
    return stats.validate_temporal(locs, max_density=0.02, max_simultaneous=1).select("movie_id", "loc_id", "cluster_id")


@query("""d AS (SELECT movie_id, cluster_id, frame, count(*) AS k FROM locs WHERE cluster_id <> -1 GROUP BY ALL), g AS (SELECT movie_id, cluster_id, sum(k) AS n, max(k) AS most, max(frame) - min(frame) + 1 AS span FROM d GROUP BY ALL)
SELECT CAST(l.movie_id AS BIGINT) AS movie_id, l.loc_id, CAST(CASE WHEN g.n < 2 OR (g.n / g.span > 0.5 AND g.most > least(5, g.n // 2)) THEN -1 ELSE l.cluster_id END AS BIGINT) AS cluster_id
FROM (SELECT * REPLACE (CASE WHEN loc_id % 1200 < 60 THEN frame // 12 ELSE frame END AS frame, CASE WHEN loc_id % 1200 < 60 THEN 90 ELSE cluster_id END AS cluster_id) FROM locs) l LEFT JOIN g USING (movie_id, cluster_id)""".replace("FROM locs WHERE", "FROM (SELECT * REPLACE (CASE WHEN loc_id % 1200 < 60 THEN frame // 12 ELSE frame END AS frame, CASE WHEN loc_id % 1200 < 60 THEN 90 ELSE cluster_id END AS cluster_id) FROM locs) WHERE"), "locs")
def validate_temporal_default(locs):
    """At the defaults, over rows of which a cluster in each movie is bright in twelve rows of a frame."""
    burst = F.col("loc_id") % 1200 < 60
    moved = locs.withColumn("frame", F.when(burst, F.floor(F.col("frame") / 12)).otherwise(F.col("frame")).cast("int")).withColumn("cluster_id", F.when(burst, 90).otherwise(F.col("cluster_id")))
    return stats.validate_temporal(moved).select("movie_id", "loc_id", "cluster_id")


def _graph_sql(rows: str, eps: str) -> str:
    """Density clusters of a table of rows: table q has its rows with a new cluster_id. Roots spread from neighbour to neighbour in rounds."""
    return f"""e AS MATERIALIZED (SELECT a.movie_id, a.loc_id, b.loc_id AS other_id FROM {rows} a JOIN {rows} b ON a.movie_id = b.movie_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {eps}),
gc AS MATERIALIZED (SELECT movie_id, loc_id FROM e GROUP BY ALL HAVING count(*) >= 3), gl AS MATERIALIZED (SELECT e.* FROM e JOIN gc USING (movie_id, loc_id) JOIN gc d ON e.movie_id = d.movie_id AND e.other_id = d.loc_id),
gr AS (SELECT movie_id, loc_id, loc_id AS root, 0 AS i FROM gc UNION ALL SELECT gr.movie_id, gl.other_id, min(gr.root), gr.i + 1 FROM gr JOIN gl ON gr.movie_id = gl.movie_id AND gr.loc_id = gl.loc_id WHERE gr.i < 100 GROUP BY gr.movie_id, gl.other_id, gr.i + 1),
gm AS (SELECT movie_id, loc_id, root FROM gr WHERE i = 100), gb AS (SELECT e.movie_id, e.loc_id, min(gm.root) AS root FROM e JOIN gm ON e.movie_id = gm.movie_id AND e.other_id = gm.loc_id GROUP BY ALL),
gn AS (SELECT *, dense_rank() OVER (PARTITION BY movie_id ORDER BY root) - 1 AS number FROM (SELECT DISTINCT movie_id, root FROM gm)), ga AS (SELECT movie_id, loc_id, root FROM gm UNION ALL SELECT gb.* FROM gb ANTI JOIN gm USING (movie_id, loc_id)),
q AS (SELECT o.* REPLACE (coalesce(gn.number, -1) AS cluster_id) FROM {rows} o LEFT JOIN ga ON ga.movie_id = o.movie_id AND ga.loc_id = o.loc_id LEFT JOIN gn ON ga.movie_id = gn.movie_id AND ga.root = gn.root)"""


@query(f"{_KEPT}, {_graph_sql('t', '5.0')} SELECT CAST(movie_id AS BIGINT) AS movie_id, loc_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM q", "locs")
def dbscan_default(locs):
    return spatial.dbscan(_kept(locs)).select("movie_id", "loc_id", "cluster_id")


# the knee of each movie, clusters at it, checked in time at the defaults: table v
_CLUSTERED = f"""{_KEPT}, {_NEAR}, kd AS (SELECT movie_id, distance, row_number() OVER (PARTITION BY movie_id ORDER BY distance) AS i FROM k WHERE rank = 3),
kb AS (SELECT *, lead(distance, 2) OVER w - 2 * lead(distance) OVER w + distance AS bend, lead(distance) OVER w AS knee FROM kd WINDOW w AS (PARTITION BY movie_id ORDER BY i)), kc AS (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY bend DESC, i) AS r FROM kb WHERE bend IS NOT NULL),
te AS (SELECT t.*, least(10.0, greatest(2.5, knee)) AS eps FROM t JOIN kc ON t.movie_id = kc.movie_id AND kc.r = 1), {_graph_sql("te", "a.eps")},
vd AS (SELECT movie_id, cluster_id, frame, count(*) AS k FROM q WHERE cluster_id <> -1 GROUP BY ALL), vg AS (SELECT movie_id, cluster_id, sum(k) AS n, max(k) AS most, max(frame) - min(frame) + 1 AS span FROM vd GROUP BY ALL),
v AS (SELECT q.* REPLACE (CASE WHEN vg.n < 2 OR (vg.n / vg.span > 0.5 AND vg.most > least(5, vg.n // 2)) THEN -1 ELSE q.cluster_id END AS cluster_id) FROM q LEFT JOIN vg USING (movie_id, cluster_id))"""


@query(f"{_CLUSTERED} SELECT * FROM (WITH t AS (SELECT * FROM v WHERE cluster_id <> -1), {_PROPERTIES})", "locs")
def cluster_speckles_properties(locs):
    """The clusters' table of the whole: knee, density clusters, check in time, sub-clusters."""
    return workloads.cluster_speckles(_kept(locs))["properties"]


@query(f"{_CLUSTERED} SELECT * FROM (WITH {_STATS.format(rows='v')})", "locs")
def cluster_speckles_stats(locs):
    return workloads.cluster_speckles(_kept(locs))["stats"]


_HIST = "b AS (SELECT l_linenumber AS k, min(l_extendedprice)::DOUBLE AS a, max(l_extendedprice)::DOUBLE AS z FROM lineitem GROUP BY ALL), g AS (SELECT k, CASE WHEN a = z THEN a - 0.5 ELSE a END AS a, CASE WHEN a = z THEN z + 0.5 ELSE z END AS z FROM b)"


@query(f"""{_HIST}, n AS (SELECT k, CAST(least(floor((l_extendedprice::DOUBLE - a) / (z - a) * 30), 29) AS BIGINT) AS bin, count(*) AS n FROM lineitem JOIN g ON k = l_linenumber GROUP BY ALL), r AS (SELECT k, a, z, unnest(range(30)) AS bin FROM g)
SELECT CAST(r.k AS BIGINT) AS l_linenumber, CAST(r.bin AS BIGINT) AS bin, round(a + (z - a) / 30 * r.bin, 6) AS lo, round(a + (z - a) / 30 * (r.bin + 1), 6) AS hi, coalesce(n.n, 0) AS n FROM r LEFT JOIN n ON r.k = n.k AND r.bin = n.bin""")
def histogram(spark, sf_dir):
    return stats.histogram(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", 30, "l_linenumber")


@query("t AS (SELECT movie_id, frame::DOUBLE AS v, photons AS w FROM locs), b AS (SELECT movie_id, min(v) AS a, max(v) AS z, min(w) AS c, max(w) AS d FROM t GROUP BY ALL) SELECT CAST(movie_id AS BIGINT) AS movie_id, CAST(least(floor((v - a) / (z - a) * 30), 29) AS BIGINT) AS bin_1, CAST(least(floor((w - c) / (d - c) * 30), 29) AS BIGINT) AS bin_2, count(*) AS n FROM t JOIN b USING (movie_id) GROUP BY ALL", "locs")
def histogram2d(locs):
    return stats.histogram2d(locs, "frame", "photons")


def _smooth_sql(sigma: float, source: str = "marker_pixels") -> str:
    r = int(4 * sigma + 0.5)
    return f"""d AS (SELECT unnest(range(-{r}, {r} + 1)) AS d), q AS (SELECT d, exp(-d * d / {2 * sigma * sigma}) / (SELECT sum(exp(-d * d / {2 * sigma * sigma})) FROM d) AS w FROM d), o AS (SELECT unnest(range(64)) AS o), w AS (SELECT o, least(greatest(o + d, 0), 63) AS i, sum(w) AS w FROM o, q GROUP BY ALL),
h AS (SELECT image_id, y, o AS x, sum(value * w) AS value FROM {source} JOIN w ON x = i GROUP BY ALL), s AS (SELECT image_id, o AS y, x, sum(value * w) AS value FROM h JOIN w ON y = i GROUP BY ALL)"""


_PIX = "CAST(image_id AS BIGINT) AS image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x"


@query(f"{_smooth_sql(1.5)} SELECT {_PIX}, round(value, 6) AS value FROM s", "marker_pixels")
def gaussian_smooth(pixels):
    return images.gaussian_smooth(pixels, 1.5)


@query(f"t AS (SELECT *, value / max(value) OVER (PARTITION BY image_id) AS v FROM marker_pixels) SELECT {_PIX}, CAST(trunc(v * 65535) AS BIGINT) AS value FROM t", "marker_pixels")
def normalize_image(pixels):
    return images.normalize_image(pixels, bits16=True)


@query("t AS (SELECT * FROM marker_pixels) SELECT CAST(image_id AS BIGINT) AS image_id, round(quantile_cont(value, 0.85), 6) AS threshold FROM t GROUP BY image_id", "marker_pixels")
def percentile_threshold(pixels):
    return images.percentile_threshold(pixels, 85)


_OTSU = """b AS (SELECT image_id, min(value) AS a, max(value) AS z FROM marker_pixels GROUP BY ALL), n AS (SELECT image_id, a, z, least(floor((value - a) / (z - a) * 256), 255) AS bin, count(*) AS n FROM marker_pixels JOIN b USING (image_id) GROUP BY ALL),
c AS (SELECT *, a + (z - a) * (bin + 0.5) / 256 AS c FROM n), e AS (SELECT image_id, bin, c, sum(n) OVER w AS w1, sum(n * c) OVER w AS s1, sum(n) OVER p AS w, sum(n * c) OVER p AS s FROM c WINDOW w AS (PARTITION BY image_id ORDER BY bin), p AS (PARTITION BY image_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / (w - w1), 2), 6) DESC, bin) AS r FROM e WHERE w > w1), th AS (SELECT image_id, c AS threshold FROM f WHERE r = 1)"""


@query(f"{_OTSU} SELECT CAST(image_id AS BIGINT) AS image_id, round(threshold, 6) AS threshold FROM th", "marker_pixels")
def otsu_threshold(pixels):
    return images.otsu_threshold(pixels)


_MASK = f"{_OTSU}, m AS (SELECT image_id, y, x, y * 1048576 + x AS i FROM marker_pixels JOIN th USING (image_id) WHERE value > threshold)"
_PARTS = """r AS (SELECT image_id, i, y, x, i AS root FROM m UNION SELECT m.image_id, m.i, m.y, m.x, r.root FROM r JOIN m ON m.image_id = r.image_id AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1 AND r.root < m.i),
p AS (SELECT image_id, y, x, min(root) AS root FROM r GROUP BY ALL), l AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM p)"""


def _mask(pixels):
    return images.threshold_mask(pixels, images.otsu_threshold(pixels))


@query(f"{_MASK} SELECT {_PIX} FROM m", "marker_pixels")
def threshold_mask(pixels):
    return _mask(pixels)


@query(f"{_MASK}, {_PARTS} SELECT {_PIX}, label FROM l", "marker_pixels")
def label_components(pixels):
    return images.label_components(_mask(pixels))


@query(f"{_MASK}, {_PARTS}, k AS (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS area FROM l) SELECT {_PIX}, dense_rank() OVER (PARTITION BY image_id ORDER BY label) AS label FROM k WHERE area BETWEEN 50 AND 200", "marker_pixels")
def filter_regions_by_area(pixels):
    return images.filter_regions_by_area(images.label_components(_mask(pixels)), 50, 200)


@query(f"{_MASK}, {_PARTS}, k AS (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS area FROM l) SELECT {_PIX} FROM k WHERE area >= 60", "marker_pixels")
def remove_small(pixels):
    return images.remove_small(_mask(pixels), 60, 8)


@query(f"""{_MASK}, {_PARTS} SELECT CAST(image_id AS BIGINT) AS image_id, label, count(*) AS area, round(avg(y), 6) AS centroid_y, round(avg(x), 6) AS centroid_x, CAST(min(y) AS BIGINT) AS min_row, CAST(min(x) AS BIGINT) AS min_col, CAST(max(y) + 1 AS BIGINT) AS max_row, CAST(max(x) + 1 AS BIGINT) AS max_col, round(avg(value), 6) AS mean_intensity FROM l JOIN marker_pixels USING (image_id, y, x) GROUP BY image_id, label""", "marker_pixels")
def region_props(pixels):
    return images.region_props(images.label_components(_mask(pixels)), pixels).drop("perimeter", "circularity")


_EDGE = "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0))"


@query(f"""{_MASK}, {_PARTS}, rim AS (SELECT a.image_id, a.label, a.y, a.x FROM l a LEFT JOIN l c ON a.image_id = c.image_id AND a.label = c.label AND abs(a.y - c.y) + abs(a.x - c.x) = 1 GROUP BY ALL HAVING count(c.y) < 4),
k AS (SELECT a.image_id, a.label, a.y, a.x, 1 + 2 * count(*) FILTER (abs(a.y - c.y) + abs(a.x - c.x) = 1) + 10 * count(*) FILTER (abs(a.y - c.y) = 1 AND abs(a.x - c.x) = 1) AS code FROM rim a JOIN rim c ON a.image_id = c.image_id AND a.label = c.label AND abs(a.y - c.y) <= 1 AND abs(a.x - c.x) <= 1 GROUP BY ALL)
SELECT CAST(image_id AS BIGINT) AS image_id, label, round(sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1.0 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0.0 END), 6) AS perimeter FROM k GROUP BY image_id, label""", "marker_pixels")
def perimeter(pixels):
    return images.perimeter(images.label_components(_mask(pixels)))


@query(f"{_MASK} SELECT DISTINCT CAST(a.image_id AS BIGINT) AS image_id, CAST(a.y + v.dy AS BIGINT) AS y, CAST(a.x + v.dx AS BIGINT) AS x FROM m a, {_EDGE} v(dy, dx) WHERE a.y + v.dy BETWEEN 0 AND 63 AND a.x + v.dx BETWEEN 0 AND 63 AND NOT EXISTS (SELECT 1 FROM m b WHERE b.image_id = a.image_id AND b.y = a.y + v.dy AND b.x = a.x + v.dx)", "marker_pixels")
def label_boundaries(pixels):
    return images.label_boundaries(_mask(pixels).withColumn("label", F.lit(1)), images.image_sizes(pixels))


@query(f"""{_MASK}, z AS (SELECT p.image_id, p.y, p.x FROM marker_pixels p ANTI JOIN m USING (image_id, y, x)) SELECT CAST(m.image_id AS BIGINT) AS image_id, CAST(m.y AS BIGINT) AS y, CAST(m.x AS BIGINT) AS x, round(min(sqrt((m.y - z.y) * (m.y - z.y) + (m.x - z.x) * (m.x - z.x))), 6) AS distance FROM m JOIN z USING (image_id) GROUP BY ALL""", "marker_pixels")
def distance_transform(pixels):
    return images.distance_transform(_mask(pixels), images.image_sizes(pixels))


@query(f"""t AS (SELECT * FROM marker_pixels) SELECT {_PIX}, value FROM t a WHERE value > 40 AND y BETWEEN 3 AND 60 AND x BETWEEN 3 AND 60
 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.image_id = a.image_id AND abs(b.y - a.y) <= 3 AND abs(b.x - a.x) <= 3 AND (b.value > a.value OR (b.value = a.value AND b.y * 64 + b.x < a.y * 64 + a.x)))""", "marker_pixels")
def local_maxima(pixels):
    return images.local_maxima(pixels, 3, images.image_sizes(pixels).select("image_id", F.lit(40.0).alias("threshold")))


_DISK = "(SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= 4)"


@query(f"""{_MASK}, k AS (SELECT * FROM {_DISK}), w AS (SELECT DISTINCT image_id, m.y + dy AS y, m.x + dx AS x FROM m, k WHERE m.y + dy BETWEEN 0 AND 63 AND m.x + dx BETWEEN 0 AND 63)
SELECT CAST(w.image_id AS BIGINT) AS image_id, CAST(w.y AS BIGINT) AS y, CAST(w.x AS BIGINT) AS x FROM w WHERE NOT EXISTS (SELECT 1 FROM k WHERE w.y + dy BETWEEN 0 AND 63 AND w.x + dx BETWEEN 0 AND 63 AND NOT EXISTS (SELECT 1 FROM w v WHERE v.image_id = w.image_id AND v.y = w.y + dy AND v.x = w.x + dx))""", "marker_pixels")
def binary_closing(pixels):
    return images.binary_closing(_mask(pixels), 2, images.image_sizes(pixels))


@query(f"""m AS (SELECT image_id, y, x FROM dapi_pixels WHERE value > 30), e AS (SELECT image_id, y, x FROM dapi_pixels WHERE value <= 30),
r AS (SELECT image_id, y, x FROM e WHERE y IN (0, 63) OR x IN (0, 63) UNION SELECT e.image_id, e.y, e.x FROM r JOIN e ON e.image_id = r.image_id AND abs(e.y - r.y) + abs(e.x - r.x) = 1) SELECT {_PIX} FROM (SELECT * FROM m UNION ALL SELECT e.* FROM e ANTI JOIN r USING (image_id, y, x))""", "dapi_pixels")
def fill_holes(pixels):
    return images.fill_holes(pixels.filter("value > 30").select("image_id", "y", "x"), images.image_sizes(pixels))


@query("t AS (SELECT movie_id, CAST(trunc(y * 5) AS BIGINT) AS y, CAST(trunc(x * 5) AS BIGINT) AS x FROM locs WHERE x > 0 AND x < 256 AND y > 0 AND y < 256) SELECT CAST(movie_id AS BIGINT) AS movie_id, y, x, count(*)::DOUBLE AS value FROM t GROUP BY ALL", "locs")
def render_histogram(locs):
    return render.render_histogram(locs, SIZE, SIZE)


@query("""t AS (SELECT * FROM locs), p AS (SELECT movie_id, x * 5 AS cx, y * 5 AS cy, greatest(x_error, 0.1) * 5 AS sx, greatest(y_error, 0.1) * 5 AS sy FROM t WHERE x > 0 AND x < 256 AND y > 0 AND y < 256),
u AS (SELECT *, unnest(range(greatest(0, trunc(cy - 3 * sy)::BIGINT), least(1280, trunc(cy + 3 * sy)::BIGINT + 1))) AS y FROM p), v AS (SELECT *, unnest(range(greatest(0, trunc(cx - 3 * sx)::BIGINT), least(1280, trunc(cx + 3 * sx)::BIGINT + 1))) AS x FROM u)
SELECT CAST(movie_id AS BIGINT) AS movie_id, y, x, round(sum(exp(-((x - cx + 0.5) * (x - cx + 0.5) / (2 * sx * sx) + (y - cy + 0.5) * (y - cy + 0.5) / (2 * sy * sy))) / (2 * pi() * sx * sy)), 6) AS value FROM v GROUP BY ALL""", "locs")
def render_gaussian_pdf(locs):
    return render.render_gaussian_pdf(locs, SIZE, SIZE)


_PEAK = """t AS (SELECT * FROM locs), p AS (SELECT movie_id, x * 5 AS cx, y * 5 AS cy, {s} AS s, {a} AS a FROM t WHERE x >= 0 AND x < 256 AND y >= 0 AND y < 256), q AS (SELECT *, trunc(3 * s)::BIGINT + 1 AS r FROM p),
u AS (SELECT *, unnest(range(greatest(0, trunc(cy)::BIGINT - r), least(1280, trunc(cy)::BIGINT + r + 1))) AS y FROM q), v AS (SELECT *, unnest(range(greatest(0, trunc(cx)::BIGINT - r), least(1280, trunc(cx)::BIGINT + r + 1))) AS x FROM u),
i AS (SELECT movie_id, y, x, sum(a * exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * s * s))) AS value FROM v GROUP BY ALL) SELECT CAST(movie_id AS BIGINT) AS movie_id, y, x, round(value / max(value) OVER (PARTITION BY movie_id), 6) AS value FROM i"""


@query(_PEAK.format(s="greatest(x_error * 5, 0.5)", a="1"), "locs")
def render_gaussian_peak(locs):
    return render.render_gaussian_peak(locs, SIZE, SIZE)


@query(_PEAK.format(s="greatest(0.5, least(3.0, 5 / sqrt(greatest(photons, 1e-9) / 1000)))", a="photons / 1000"), "locs")
def render_gaussian_photon(locs):
    return render.render_gaussian_peak(locs, SIZE, SIZE, "photon")


@query(_PEAK.format(s="2.5", a="1"), "locs")
def render_gaussian_fixed(locs):
    return render.render_gaussian_peak(locs, SIZE, SIZE, "fixed")


@query("t AS (SELECT movie_id, loc_id, x, y FROM locs) SELECT CAST(movie_id AS BIGINT) AS movie_id, loc_id, x > 0 AND x < 128 AND y > 0 AND y < 128 AS in_viewport FROM t WHERE x * 5 >= 0 AND x * 5 < 1000 AND y * 5 >= 0 AND y * 5 < 1000", "locs")
def render_bounds(locs):
    on = render.render_bounds_check(locs, 200, 200)
    return on.join(render.viewport(locs, 128, 128).select("movie_id", "loc_id", F.lit(True).alias("v")), ["movie_id", "loc_id"], "left").select("movie_id", "loc_id", F.coalesce("v", F.lit(False)).alias("in_viewport"))


_DOG = ", ".join(f"{a} AS (WITH {_smooth_sql(g)} SELECT * FROM s)" for a, g in (("fine", 0.5), ("mid", 1.5), ("coarse", 3.0)))


@query(f"{_DOG}, t AS (SELECT image_id, y, x, greatest(0.0, mid.value - coarse.value + 0.5 * (fine.value - mid.value)) AS value FROM fine JOIN mid USING (image_id, y, x) JOIN coarse USING (image_id, y, x)) SELECT {_PIX}, round(value, 6) AS value FROM t", "marker_pixels")
def dog_enhance(pixels):
    return images.dog_enhance(pixels)


@query(f"""o AS (SELECT unnest(range(24)) AS o), a AS (SELECT o, (o + 0.5) * 64 / 24 - 0.5 AS pos FROM o), t AS (SELECT o, floor(pos)::BIGINT + k AS tap, 1 - abs(pos - floor(pos) - k) AS near FROM a, range(2) r(k)),
d AS (SELECT unnest(range(-3, 4)) AS d), q AS (SELECT d, exp(-d * d / (2 * pow((64 / 24 - 1) / 2, 2))) AS g FROM d), w AS (SELECT o, least((tap + d + 126) % 126, 126 - (tap + d + 126) % 126) AS i, sum(near * g / (SELECT sum(g) FROM q)) AS w FROM t, q GROUP BY ALL),
h AS (SELECT image_id, y, o AS x, sum(value * w) AS value FROM marker_pixels JOIN w ON x = i GROUP BY ALL), s AS (SELECT image_id, o AS y, x, sum(value * w) AS value FROM h JOIN w ON y = i GROUP BY ALL) SELECT {_PIX}, round(value, 6) AS value FROM s""", "marker_pixels")
def resize_image(pixels):
    return images.resize_image(pixels, 24, 24)


_OPEN = """k AS (SELECT dy, dx FROM range(-5, 6) a(dy), range(-5, 6) b(dx) WHERE dy * dy + dx * dx <= 25),
lo AS (SELECT p.image_id, p.y - dy AS y, p.x - dx AS x, min(value) AS value FROM marker_pixels p, k WHERE p.y - dy BETWEEN 0 AND 63 AND p.x - dx BETWEEN 0 AND 63 GROUP BY ALL),
hi AS (SELECT p.image_id, p.y - dy AS y, p.x - dx AS x, max(value) AS value FROM lo p, k WHERE p.y - dy BETWEEN 0 AND 63 AND p.x - dx BETWEEN 0 AND 63 GROUP BY ALL)"""


@query(f"{_OPEN} SELECT {_PIX}, value FROM hi", "marker_pixels")
def opening(pixels):
    return floods.opening(pixels, 5)


# a disk as rows of the width that each line of it has
_WIDE = """kd AS (SELECT dy, CAST(floor(sqrt(900 - dy * dy)) AS BIGINT) AS w FROM range(-30, 31) r(dy)),
la AS (SELECT image_id, y - dy AS y, x, min(value) OVER (PARTITION BY image_id, y, dy ORDER BY x ROWS BETWEEN w PRECEDING AND w FOLLOWING) AS value FROM marker_pixels, kd), lo AS (SELECT image_id, y, x, min(value) AS value FROM la WHERE y BETWEEN 0 AND 63 GROUP BY ALL),
ha AS (SELECT image_id, y - dy AS y, x, max(value) OVER (PARTITION BY image_id, y, dy ORDER BY x ROWS BETWEEN w PRECEDING AND w FOLLOWING) AS value FROM lo, kd), hi AS (SELECT image_id, y, x, max(value) AS value FROM ha WHERE y BETWEEN 0 AND 63 GROUP BY ALL)"""


@query(f"{_WIDE} SELECT {_PIX}, value FROM hi", "marker_pixels")
def opening_default(pixels):
    return floods.opening(pixels)


@query(f"{_OPEN}, t AS (SELECT image_id, y, x, m.value - hi.value AS value FROM hi JOIN marker_pixels m USING (image_id, y, x)) SELECT {_PIX}, value FROM t", "marker_pixels")
def top_hat(pixels):
    return floods.top_hat(pixels, 5)


# the image less h, grown under the image till nothing rises any more
_PEAKS = """nb AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy <> 0 OR dx <> 0), hq AS (SELECT image_id, quantile_cont(value, 0.9) * 0.1 * (1 - 1e-9) AS h FROM marker_pixels GROUP BY image_id),
g AS (SELECT image_id, y, x, value, value - h AS low FROM marker_pixels JOIN hq USING (image_id) WHERE h > 0),
rc(image_id, y, x, v) USING KEY (image_id, y, x) AS (SELECT image_id, y, x, low FROM g
 UNION SELECT g.image_id, g.y, g.x, max(least(g.value, r.v)) FROM rc r, nb JOIN g ON g.image_id = r.image_id AND g.y = r.y + dy AND g.x = r.x + dx JOIN recurring.rc o ON o.image_id = g.image_id AND o.y = g.y AND o.x = g.x WHERE least(g.value, r.v) > o.v GROUP BY g.image_id, g.y, g.x),
m AS (SELECT image_id, y, x, y * 1048576 + x AS i FROM g JOIN rc USING (image_id, y, x) WHERE v = low)"""


@query(f"{_PEAKS} SELECT {_PIX} FROM m", "marker_pixels")
def h_maxima(pixels):
    return floods.h_maxima(pixels, images.percentile_threshold(pixels, 90).select("image_id", (F.col("threshold") * 0.1).alias("h")))


# one pixel of each image at a time: the one behind the first of all edges that lead out of what is labelled
_FLOOD = """mk AS (SELECT image_id, y, x, y * 1048576 + x AS i, value FROM marker_pixels JOIN th USING (image_id) WHERE value > threshold),
un AS (SELECT s.image_id, s.i AS p, o.i AS q, least(s.value, o.value) AS low, greatest(s.value, o.value) AS high FROM mk s JOIN mk o ON o.image_id = s.image_id AND (o.y = s.y AND o.x = s.x + 1 OR o.y = s.y + 1 AND o.x = s.x)),
rk AS (SELECT image_id, p, q, row_number() OVER (PARTITION BY image_id ORDER BY low DESC, high DESC, p, q) AS k FROM un), ed AS (SELECT image_id, p AS a, q AS b, k FROM rk UNION ALL SELECT image_id, q, p, k FROM rk),
fl(image_id, i, label) USING KEY (image_id, i) AS (SELECT mk.image_id, mk.i, l.label FROM mk JOIN l USING (image_id, y, x)
 UNION SELECT e.image_id, arg_min(e.b, e.k), arg_min(t.label, e.k) FROM recurring.fl t JOIN ed e ON e.image_id = t.image_id AND e.a = t.i LEFT JOIN recurring.fl z ON z.image_id = e.image_id AND z.i = e.b WHERE z.i IS NULL GROUP BY e.image_id)"""


@query(f"{_OTSU}, {_PEAKS}, {_PARTS}, {_FLOOD}, t AS (SELECT mk.image_id, mk.y, mk.x, fl.label FROM fl JOIN mk USING (image_id, i)) SELECT {_PIX}, CAST(label AS BIGINT) AS label FROM t", "marker_pixels")
def watershed(pixels):
    seeds = images.label_components(h_maxima(pixels))
    return floods.watershed(pixels.withColumn("value", -F.col("value")), seeds, _mask(pixels))


_REGIONS = "g AS (SELECT image_id, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, avg(value) AS v FROM l JOIN marker_pixels USING (image_id, y, x) GROUP BY ALL)"


@query(f"{_MASK}, {_PARTS}, {_REGIONS}, own AS (SELECT g.image_id, g.label FROM g JOIN dapi_pixels d ON d.image_id = g.image_id AND d.y = trunc(cy) AND d.x = trunc(cx) AND d.value > 30) SELECT CAST(image_id AS BIGINT) AS image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY label) AS new_label FROM own", "marker_pixels", "dapi_pixels")
def speckles_in_nuclei(pixels, dapi):
    return images.speckles_in_nuclei(images.region_props(images.label_components(_mask(pixels)), pixels), dapi.filter("value > 30")).select("image_id", "label", "new_label")


_NUCLEI = """dm AS (SELECT image_id, y * 1048576 + x AS i, y, x FROM dapi_pixels WHERE value > 30), dr AS (SELECT image_id, i, y, x, i AS root FROM dm UNION SELECT dm.image_id, dm.i, dm.y, dm.x, dr.root FROM dr JOIN dm ON dm.image_id = dr.image_id AND abs(dm.y - dr.y) <= 1 AND abs(dm.x - dr.x) <= 1 AND dr.root < dm.i),
nn AS (SELECT image_id, count(DISTINCT root) AS n FROM (SELECT image_id, i, min(root) AS root FROM dr GROUP BY ALL) GROUP BY ALL)"""


@query(f"{_MASK}, {_PARTS}, {_REGIONS}, {_NUCLEI} SELECT CAST(g.image_id AS BIGINT) AS image_id, any_value(k.n) AS n_nuclei, count(*) AS n_speckles, round(avg(area), 6) AS mean_area, round(stddev_pop(area), 6) AS std_area, round(avg(v), 6) AS mean_intensity, round(stddev_pop(v), 6) AS std_intensity, round(count(*) / any_value(k.n), 6) AS speckles_per_nucleus FROM g JOIN nn k USING (image_id) GROUP BY g.image_id", "marker_pixels", "dapi_pixels")
def region_report(pixels, dapi):
    regions = lambda mask, p: images.region_props(images.label_components(mask), p)
    return images.region_report(regions(dapi.filter("value > 30"), dapi), regions(_mask(pixels), pixels))


@query(f"{_MASK}, {_PARTS}, {_REGIONS} SELECT CAST(image_id AS BIGINT) AS image_id, label, area, round(v, 6) AS mean_intensity FROM g", "marker_pixels")
def size_vs_intensity(pixels):
    return images.region_props(images.label_components(_mask(pixels)), pixels).select("image_id", "label", "area", "mean_intensity")


_BACK = "b AS (SELECT movie_id, frame, quantile_cont(value, 0.25) AS background FROM frame_pixels GROUP BY ALL), e AS (SELECT movie_id, frame, any_value(background) AS background, stddev_pop(value) FILTER (value < background) AS noise FROM frame_pixels JOIN b USING (movie_id, frame) GROUP BY ALL)"
_MF = "CAST(movie_id AS BIGINT) AS movie_id, CAST(frame AS BIGINT) AS frame"


@query(f"{_BACK} SELECT {_MF}, round(background, 6) AS background, round(noise, 6) AS noise, round(background + 5 * noise, 6) AS threshold FROM e", "frame_pixels")
def frame_background(pixels):
    return localize.frame_background(pixels)


@query(f"r AS (SELECT *, row_number() OVER (PARTITION BY movie_id, frame ORDER BY value, y, x) AS r, count(*) OVER (PARTITION BY movie_id, frame) AS n FROM frame_pixels) SELECT {_MF}, greatest(1.0, median(value)) AS background FROM r WHERE r <= n // 4 GROUP BY movie_id, frame", "frame_pixels")
def robust_background(pixels):
    return localize.robust_background(pixels)


# peaks of v over t, off a border, and the pixels about them
_PEAKS = """c AS (SELECT z.* FROM z JOIN th USING (movie_id, frame) WHERE v > t AND y BETWEEN {border} AND 63 - {border} AND x BETWEEN {border} AND 63 - {border}),
pk AS (SELECT movie_id, frame, y AS py, x AS px, row_number() OVER (PARTITION BY movie_id, frame ORDER BY v DESC, y, x) - 1 AS peak FROM c
 WHERE NOT EXISTS (SELECT 1 FROM z o WHERE o.movie_id = c.movie_id AND o.frame = c.frame AND abs(o.y - c.y) <= 3 AND abs(o.x - c.x) <= 3 AND (o.v > c.v OR (o.v = c.v AND (o.y < c.y OR (o.y = c.y AND o.x < c.x)))))),
n AS (SELECT * FROM pk JOIN frame_pixels USING (movie_id, frame) WHERE abs(y - py) <= {half} AND abs(x - px) <= {half})"""


@query(f"""f AS (SELECT movie_id * 1000 + frame AS image_id, y, x, value FROM frame_pixels), {_smooth_sql(1.0, "f")}, z AS (SELECT image_id // 1000 AS movie_id, image_id % 1000 AS frame, y, x, round(value, 9) AS v FROM s), th AS (SELECT movie_id, frame, quantile_cont(v, 0.995) AS t FROM z GROUP BY ALL), {_PEAKS.format(border=3, half=3)},
g AS (SELECT movie_id, frame, peak, sum(value) AS s, max(value) AS m, sum(value * x) / sum(value) AS cx, sum(value * y) / sum(value) AS cy FROM n GROUP BY ALL)
SELECT {_MF}, peak, round(cx, 6) AS x, round(cy, 6) AS y, round(greatest(0.1, least(2.0, 1 / sqrt(s / 1000))), 6) AS x_error, s AS photons, m AS intensity FROM g WHERE s >= 100""", "frame_pixels")
def localize_centroid(pixels):
    return localize.localize_centroid(tables.pixels_to_frames(pixels)).drop("y_error", "background")


@query(f"""{_BACK}, z AS (SELECT movie_id, frame, y, x, value AS v FROM frame_pixels), th AS (SELECT movie_id, frame, background + 5 * noise AS t FROM e), {_PEAKS.format(border=5, half=4)},
w AS (SELECT movie_id, frame, peak, quantile_cont(value, 0.25) AS ground FROM n GROUP BY ALL), l AS (SELECT n.*, ground, greatest(value - ground, 0) AS light FROM n JOIN w USING (movie_id, frame, peak)),
g AS (SELECT movie_id, frame, peak, any_value(ground) AS ground, sum(light) AS s, sum(light * x) / sum(light) AS cx, sum(light * y) / sum(light) AS cy FROM l GROUP BY ALL)
SELECT {_MF}, peak, round(cx, 6) AS x, round(cy, 6) AS y, round(greatest(0.05, least(2.0, 1.2 / sqrt(s / 100))), 6) AS x_error, s AS photons, ground AS background FROM g WHERE s >= 100""", "frame_pixels")
def localize_bgsub(pixels):
    return localize.localize_bgsub(tables.pixels_to_frames(pixels)).drop("y_error", "intensity")


@query(None, "frame_pixels")
def localize_grouped(pixels):
    return localize.localize_grouped(tables.pixels_to_frames(pixels))


@query(None, "frame_pixels")
def group_peaks(pixels):
    by = ["movie_id", "frame"]
    return localize.group_peaks(images.local_maxima(pixels, 2, pixels.select(by).distinct().withColumn("threshold", F.lit(40.0)), 3, by), 12.0)


@query("""f AS (SELECT image_id, y, x, value, sum(amplitude * exp(-((m.x - e.ex) * (m.x - e.ex) + (m.y - e.ey) * (m.y - e.ey)) / 8)) AS light FROM marker_pixels m JOIN (SELECT image_id AS i, x AS ex, y AS ey, amplitude FROM spots) e ON e.i = m.image_id GROUP BY ALL)
SELECT CAST(image_id AS BIGINT) AS image_id, round(sum(pow(value - 12 - light, 2)) / (count(*) - 25), 6) AS chi_squared, round(1 - sum(pow(value - 12 - light, 2)) / (var_pop(value) * count(*)), 6) AS r_squared FROM f GROUP BY image_id""", "marker_pixels", "spots")
def fit_quality(pixels, spots):
    return localize.fit_quality(pixels, spots.select("image_id").distinct().withColumn("background", F.lit(12.0)), spots, "image_id")


@query(None, "locs")
def subcluster(locs):
    return floods.subcluster(locs, 3).select("movie_id", "loc_id", "cluster_id", "sub_cluster_id")


@query(None, "locs")
def cluster_speckles(locs):
    return workloads.cluster_speckles(locs, 1.0)["locs"].select("movie_id", "loc_id", "cluster_id", "sub_cluster_id")


def _spread_sql(sigma: float, source: str, height: str, width: str) -> str:
    """A blur of a sparse table (movie_id, y, x, value, and its sizes), mirrored at the edges: table s."""
    r = int(4 * sigma + 0.5)
    fold = "CASE WHEN (({c} + d) % (2 * {n}) + 2 * {n}) % (2 * {n}) < {n} THEN (({c} + d) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - (({c} + d) % (2 * {n}) + 2 * {n}) % (2 * {n}) END"
    return f"""d AS (SELECT unnest(range(-{r}, {r} + 1)) AS d), q AS (SELECT d, exp(-d * d / {2 * sigma * sigma}) / (SELECT sum(exp(-d * d / {2 * sigma * sigma})) FROM d) AS w FROM d),
sx AS (SELECT movie_id, h, w, y, {fold.format(c="x", n="w")} AS x, sum(value * k) AS value FROM (SELECT i.*, {height} AS h, {width} AS w FROM {source} i) i, (SELECT d, w AS k FROM q) q GROUP BY ALL), s AS (SELECT movie_id, {fold.format(c="y", n="h")} AS y, x, sum(value * k) AS value FROM sx, (SELECT d, w AS k FROM q) q GROUP BY ALL)"""


_MYX = "CAST(movie_id AS BIGINT) AS movie_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x"


@query(f"""i AS (SELECT movie_id, trunc(y * 5)::BIGINT AS y, trunc(x * 5)::BIGINT AS x, count(*)::DOUBLE AS value FROM locs WHERE x * 5 >= 0 AND x * 5 < 1280 AND y * 5 >= 0 AND y * 5 < 1280 GROUP BY ALL), {_spread_sql(0.5, "i", "1280", "1280")},
t AS (SELECT *, value / max(value) OVER (PARTITION BY movie_id) AS v FROM s) SELECT {_MYX}, round(v, 6) AS value FROM t""", "locs")
def render_histogram_smooth(locs):
    return render.render_histogram_smooth(locs, SIZE, SIZE)


@query(f"""b AS (SELECT movie_id, min(x) - 5 AS bx, min(y) - 5 AS yb, ceil((max(x) - min(x) + 10) * 5)::BIGINT AS w, ceil((max(y) - min(y) + 10) * 5)::BIGINT AS h FROM locs GROUP BY ALL),
p AS (SELECT l.movie_id, b.w, b.h, (x - bx) * 5 AS cx, (y - yb) * 5 AS cy, (sigma_x + sigma_y) / 2 * 5 AS s, greatest(0.1, least(2.0, photons / 1000)) * greatest(0.1, least(3.0, 20 / greatest(localization_precision, 1.0))) AS a FROM locs l JOIN b USING (movie_id)), k AS (SELECT *, trunc(5 * s)::BIGINT + 1 AS r FROM p),
u AS (SELECT *, unnest(range(greatest(0, trunc(cy)::BIGINT - r), least(h, trunc(cy)::BIGINT + r + 1))) AS y FROM k), v AS (SELECT *, unnest(range(greatest(0, trunc(cx)::BIGINT - r), least(w, trunc(cx)::BIGINT + r + 1))) AS x FROM u),
i AS (SELECT movie_id, w, h, y, x, sum(a * exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * s * s))) AS value FROM v GROUP BY ALL), j AS (SELECT movie_id, y, x, value, w AS wide, h AS high FROM i), {_spread_sql(2.5, "j", "high", "wide")} SELECT {_MYX}, round(value, 6) AS value FROM s""", "locs")
def render_weighted(locs):
    return render.render_weighted(locs)


@query(None, "locs")
def render_set(locs):
    return render.render_set(locs, SIZE, SIZE)


_SET = {"precision": "render_gaussian_peak", "photon": "render_gaussian_photon", "histogram": "render_histogram_smooth"}
_EACH = " UNION ALL ".join(f"SELECT '{mode}' AS mode, movie_id, value FROM ({SQL[name]})" for mode, name in _SET.items())


@query(f"u AS ({_EACH}) SELECT mode, movie_id, count(*) AS n, count(*) FILTER (floor(value * 65535 + 1e-6) >= 65534) AS n_top, CAST(floor(max(value) * 65535 + 1e-6) AS BIGINT) AS top, round(sum(value) / 1000, 1) AS light FROM u GROUP BY ALL")
def render_set_summary(spark, sf_dir):
    """By mode and movie of the set of 16-bit images: pixels, those of full value, the largest value, and the light as a share of full pixels."""
    out = render.render_set(view(spark, sf_dir, "locs"), SIZE, SIZE).groupBy("mode", "movie_id")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 65534).alias("n_top"), F.max("value").alias("top"), F.round(F.sum((F.col("value") + 0.5) / 65535) / 1000, 1).alias("light"))


@query("t AS (SELECT movie_id, trunc(y * 5)::BIGINT AS y, trunc(x * 5)::BIGINT AS x FROM locs WHERE x > 0 AND x < 256 AND y > 0 AND y < 256) SELECT CAST(movie_id AS BIGINT) AS movie_id, y, x, count(*)::DOUBLE AS value FROM t WHERE y BETWEEN 320 AND 959 AND x BETWEEN 320 AND 959 GROUP BY ALL", "locs")
def crop_center(locs):
    return render.crop_center(render.render_histogram(locs, SIZE, SIZE), SIZE * 5, SIZE * 5)


@query("t AS (SELECT movie_id AS image_id, y, x, avg(value) AS value FROM frame_pixels GROUP BY ALL) SELECT CAST(image_id AS BIGINT) AS image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(value, 6) AS value FROM t", "frame_pixels")
def select_channel(pixels):
    return tables.select_channel(pixels.select(F.col("movie_id").alias("image_id"), F.col("frame").alias("channel"), "y", "x", "value"), "mean")


@query(f"t AS (SELECT * FROM frame_pixels) SELECT {_MF}, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, value FROM t", "frame_pixels")
def read_frames(pixels):
    return tables.frames_to_pixels(tables.pixels_to_frames(pixels))


@query(None, "marker_pixels")
def segment_speckles(pixels):
    return images.segment_speckles(pixels, small=10, least=30)


@query(None, "dapi_pixels")
def segment_nuclei(pixels):
    return images.segment_nuclei(pixels, least=200)


@query(None, "marker_pixels")
def segment_by_distance(pixels):
    return floods.segment_by_distance(pixels)


@query(None, "marker_pixels")
def segment_by_h_maxima(pixels):
    return floods.segment_by_h_maxima(pixels, radius=4, least=20)


@query(None, "frame_pixels", "marker_pixels")
def analyze_movie(pixels, marker):
    return workloads.analyze_movie(tables.pixels_to_frames(pixels), _of_movies(marker, pixels), 64, 64, small=10, least=30)["enrichment"]


@query(None, "frame_pixels", "marker_pixels")
def analyze_movie_counts(pixels, marker):
    return workloads.analyze_movie_counts(tables.pixels_to_frames(pixels), _of_movies(marker, pixels), 64, 64, small=10)["enrichment"]


def _of_movies(marker, pixels):
    """The marker images whose number is that of a movie."""
    return marker.withColumnRenamed("image_id", "movie_id").join(pixels.select("movie_id").distinct(), "movie_id", "left_semi")


@query(None, "marker_pixels", "dapi_pixels")
def analyze_marker_dapi(marker, dapi):
    return workloads.analyze_marker_dapi(marker, dapi, least_nucleus=200, least_speckle=20, radius=4)["report"]


@query(None, "frame_pixels")
def localize_filter_cluster(pixels):
    """From frames over fits to the filter cascade: what each rule rejects, and what stays for the clusters."""
    return workloads.localize_filter_cluster(tables.pixels_to_frames(pixels), eps=6.0)["funnel"]
