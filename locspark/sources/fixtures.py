"""Localizations, labels and images derived from the table `events`, in SQL that Spark and DuckDB read alike."""

from pyspark.sql import DataFrame, SparkSession

from locspark.operators.graph import written

# One movie for every 2,400 events, one image for every 1,000, one frame for every 500 (ten to a movie): what is in them comes
# from the rows' users and values, so numbers and content follow the table. Small ids serve as a row of numbers besides.
LOCS = """WITH b AS (SELECT event_id, user_id AS u, value, CAST((event_id - event_id % 12) / 12 AS BIGINT) AS block, CAST((event_id - event_id % 2400) / 2400 AS BIGINT) AS m, event_id % 12 AS p FROM events),
s AS (SELECT *, CAST((block - block % 4) / 4 AS BIGINT) % 25 AS c, CASE WHEN p < 7 THEN 0 WHEN p < 10 THEN 1 ELSE 2 END AS sub, block % 3 = 0 AS good FROM b),
t AS (SELECT *, CAST(2 + 2 * (CASE WHEN good THEN (event_id * 17) % 60 ELSE (event_id * 17) % 100 END) AS DOUBLE) / 100 AS xe, CAST(2 + 2 * (CASE WHEN good THEN (event_id * 29) % 60 ELSE (event_id * 29) % 100 END) AS DOUBLE) / 100 AS ye FROM s)
SELECT event_id AS loc_id, CAST(m AS INT) AS movie_id, CAST(event_id % 2400 AS INT) AS frame,
  CAST((c * 37) % 190 + 30 + (block * 11 + sub * 29) % 13 - 6 AS DOUBLE) + CAST((event_id * 31) % 17 - 8 AS DOUBLE) / 10 AS x,
  CAST((c * 53) % 190 + 30 + (block * 17 + sub * 41) % 13 - 6 AS DOUBLE) + CAST((event_id * 47) % 17 - 8 AS DOUBLE) / 10 AS y,
  value * 150 AS photons, CASE WHEN p = 11 THEN -1 ELSE CAST(c AS INT) END AS cluster_id,
  CASE WHEN u % 97 = 5 THEN CAST(6 AS DOUBLE) ELSE CAST(8 + u % 10 AS DOUBLE) / 10 END AS sigma_x, CASE WHEN good THEN CAST(8 + u % 10 AS DOUBLE) / 10 ELSE CAST(16 + 5 * (u % 7) AS DOUBLE) / 20 END AS sigma_y,
  xe AS x_error, ye AS y_error, sqrt(xe * xe + ye * ye) * 10 AS localization_precision, CAST(event_id % 11 AS DOUBLE) / 10 AS quality_score,
  CAST(CASE WHEN good THEN 4 ELSE 1 + (event_id * 7) % 8 END AS INT) AS cluster_n_molecules, CAST((event_id * 13) % (CASE WHEN good THEN 95 ELSE 120 END) AS DOUBLE) / 10 AS cluster_chi_squared FROM t"""

LABELS = """WITH mv AS (SELECT CAST((event_id - event_id % 2400) / 2400 AS BIGINT) AS m, SUM(user_id) AS u FROM events GROUP BY 1), c AS (SELECT event_id AS c FROM events WHERE event_id < 25),
dx AS (SELECT event_id - 8 AS dx FROM events WHERE event_id < 17), dy AS (SELECT event_id - 8 AS dy FROM events WHERE event_id < 17)
SELECT CAST(m AS INT) AS movie_id, CAST((c * 37) % 190 + 30 + dx AS INT) AS x, CAST((c * 53) % 190 + 30 + dy AS INT) AS y, CAST(MIN(c) + 1 AS INT) AS label
FROM mv CROSS JOIN c CROSS JOIN dx CROSS JOIN dy WHERE dx * dx + dy * dy <= (5 + (c + u) % 4) * (5 + (c + u) % 4) GROUP BY 1, 2, 3"""

_ROWS = """WITH e AS (SELECT CAST((event_id - event_id % {size}) / {size} AS BIGINT) AS i, event_id % {size} AS r, user_id AS u, CAST(FLOOR(value) AS BIGINT) AS v FROM events)"""
_GRID = """img AS (SELECT i, COUNT(*) AS n FROM e GROUP BY i), xs AS (SELECT event_id AS x FROM events WHERE event_id < 64), ys AS (SELECT event_id AS y FROM events WHERE event_id < 64),
px AS (SELECT i, y, x, (y * 64 + x) % n AS q FROM img CROSS JOIN xs CROSS JOIN ys)"""

MARKER = f"""{_ROWS.format(size=1000)}, {_GRID}, sp AS (SELECT i AS j, r AS k, u % 52 + 6 AS sx, v % 52 + 6 AS sy FROM e WHERE r < 6)
SELECT CAST(px.i AS INT) AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(MIN(10 + v % 5) + SUM(GREATEST(0, 60 + 10 * k - 3 * ((x - sx) * (x - sx) + (y - sy) * (y - sy)))) AS DOUBLE) AS value
FROM px JOIN e ON e.i = px.i AND e.r = px.q JOIN sp ON sp.j = px.i GROUP BY px.i, y, x"""

DAPI = f"""{_ROWS.format(size=1000)}, {_GRID}, sp AS (SELECT i AS j, CASE WHEN r = 0 THEN 14 + u % 5 ELSE 44 + u % 5 END AS sx, CASE WHEN r = 0 THEN 14 + v % 5 ELSE 44 + v % 5 END AS sy FROM e WHERE r = 0 OR (r = 1 AND u % 3 > 0))
SELECT CAST(px.i AS INT) AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(MIN(5 + v % 4) + MAX(CASE WHEN (x - sx) * (x - sx) + (y - sy) * (y - sy) BETWEEN 5 AND 144 THEN 50 ELSE 0 END) AS DOUBLE) AS value
FROM px JOIN e ON e.i = px.i AND e.r = px.q JOIN sp ON sp.j = px.i GROUP BY px.i, y, x"""

FRAMES = f"""{_ROWS.format(size=500)}, {_GRID}, sp AS (SELECT i AS j, r AS k, u % 45 + 8 AS sx, v % 45 + 8 AS sy FROM e WHERE r < 5 UNION ALL SELECT i AS j, r + 3 AS k, u % 45 + 11 AS sx, v % 45 + 9 AS sy FROM e WHERE r < 4)
SELECT CAST((px.i - px.i % 10) / 10 AS INT) AS movie_id, CAST(px.i % 10 AS INT) AS frame, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(MIN(5 + v % 6) + SUM(FLOOR((90 + 15 * k) * EXP(-CAST((x - sx) * (x - sx) + (y - sy) * (y - sy) AS DOUBLE) / 2))) AS DOUBLE) AS value
FROM px JOIN e ON e.i = px.i AND e.r = px.q JOIN sp ON sp.j = px.i GROUP BY px.i, y, x"""

SPOTS = f"""{_ROWS.format(size=1000)} SELECT CAST(i AS INT) AS image_id, CAST(u % 52 + 6 AS DOUBLE) AS x, CAST(v % 52 + 6 AS DOUBLE) AS y, CAST(2 AS DOUBLE) AS sigma, CAST(60 + 10 * r AS DOUBLE) AS amplitude FROM e WHERE r < 6"""

VIEWS = {"locs": LOCS, "labels_image": LABELS, "marker_pixels": MARKER, "dapi_pixels": DAPI, "frame_pixels": FRAMES, "spots": SPOTS}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a table. Runs a job when called if it counts by small ids.

    The rows of small ids are written once, so that Spark knows that they are few and sends them to all tasks: of the whole
    table's size they'd be crossed as partitions, each with each. Images and movies, which are multiplied by them, are dealt
    out first.
    """
    sql, events = VIEWS[name], spark.read.parquet(f"{sf_dir}/events.parquet")
    spread = f"/*+ REPARTITION({spark.conf.get('spark.sql.shuffle.partitions')}) */"
    for one in ("img AS (SELECT", "mv AS (SELECT"):
        sql = sql.replace(one, f"{one} {spread}")
    tables = {"events": events}
    if "FROM events WHERE event_id <" in sql:
        sql, tables["few"] = sql.replace("FROM events WHERE event_id <", "FROM {few} WHERE event_id <"), written(events.select("event_id").filter("event_id < 64"))
    return spark.sql(sql.replace("FROM events", "FROM {events}"), **tables)


def with_views(sql: str) -> str:
    """The SQL with the views it names in front of it."""
    used = [f"{n} AS ({v})" for n, v in VIEWS.items() if n in sql]
    return f"WITH RECURSIVE {', '.join(used)}, {sql}" if used else f"WITH RECURSIVE {sql}"
