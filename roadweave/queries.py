"""Queries over the driver's tables for every operator SQL can check, each beside its DuckDB SQL.

The tables hold no coordinates, so fixes are derived from ``events``: devices drive to and fro on a 4 x 4 grid of streets,
with jitter, wrong latitudes, jumps and repeated rows. A street graph follows from moves between 50 m cells.
"""

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.functions import geo, polyline
from roadweave.operators import clean, density, graph, spatial
from roadweave.operators.components import checkpoint_dir
from roadweave.plans.inference import build_roads
from roadweave.plans.params import Params
from roadweave.sources import sinks, tables
from roadweave.sources.tables import synthesize_times
from roadweave.streaming import fixes as streaming

METRES_A_DEGREE, SHRINK = 111320.0, 0.7071067811865476
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query of (spark, sf_dir) under the function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---- fixtures in Spark


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def from_events(events: DataFrame) -> DataFrame:
    events = events.select("event_id", "ts", "user_id", "event_type", "value")
    rows = events.union(events.where("event_id % 50 = 0"))
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - F.lit(1704067200.0)) / F.lit(600.0)
    rows = rows.withColumn("t", t).withColumn("s0", F.col("user_id") * F.lit(137.0) + F.col("t") * F.lit(8.0))
    v = F.col("value")
    rows = rows.withColumn("jit", v * F.lit(100.0) - F.lit(10.0) * F.floor(v * F.lit(10.0)) - F.lit(4.5)).withColumn("m", F.col("s0") - F.lit(2000.0) * F.floor(F.col("s0") / F.lit(2000.0)))
    rows = rows.withColumn("s", F.when(F.col("m") < 1000, F.col("m")).otherwise(F.lit(2000.0) - F.col("m"))).withColumn("r", F.col("user_id") % 8)
    street = F.lit(250.0) * F.when(F.col("r") < 4, F.col("r")).otherwise(F.col("r") - 4) + F.lit(125.0) + F.col("jit")
    rows = rows.withColumn("px", F.when(F.col("r") < 4, F.col("s")).otherwise(street)).withColumn("py", F.when(F.col("r") < 4, street).otherwise(F.col("s")))
    lat = F.when((F.col("event_type") == "error") & (v < 2), F.lit(95.0)).when((F.col("event_type") == "signup") & (v > 200), F.lit(45.3) + F.col("py") / METRES_A_DEGREE).otherwise(F.lit(45.0) + F.col("py") / METRES_A_DEGREE)
    lon = F.lit(134.0) + F.col("px") / F.lit(METRES_A_DEGREE * SHRINK)
    time = F.timestamp_micros(F.lit(1704067200000000).cast("long") + F.floor(F.col("t") * F.lit(1e6)).cast("long"))
    return rows.select(F.col("user_id").cast("string").alias("device"), time.alias("time"), lat.alias("lat"), lon.alias("lon"))


def unique_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.deduplicate(clean.drop_invalid(fixes(spark, sf_dir)))


def plane(points: DataFrame) -> DataFrame:
    return points.withColumn("x", (F.col("lon") - F.lit(134.0)) * F.lit(METRES_A_DEGREE * SHRINK)).withColumn("y", (F.col("lat") - F.lit(45.0)) * F.lit(METRES_A_DEGREE))


def flat_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, x, y) around the streets, to the centimetre; a device is a track."""
    points = plane(unique_fixes(spark, sf_dir).where("lat < 45.2"))
    return points.select(F.col("device").alias("track_id"), F.col("time"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def flat_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, seq, x, y) by segments of 300 s and 500 m."""
    points = plane(clean.segments(unique_fixes(spark, sf_dir).where("lat < 45.2")))
    return points.select("track_id", "seq", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def streets(spark: SparkSession, sf_dir: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the moves between neighbouring 50 m cells that at least so many devices made."""
    by = Window.partitionBy("track_id").orderBy("time", "x", "y")
    moves = flat_points(spark, sf_dir).withColumn("r", F.floor(F.col("y") / 50.0).cast("long")).withColumn("c", F.floor(F.col("x") / 50.0).cast("long"))
    moves = moves.withColumn("r0", F.lag("r").over(by)).withColumn("c0", F.lag("c").over(by)).where(F.abs(F.col("r") - F.col("r0")) + F.abs(F.col("c") - F.col("c0")) <= 2)
    name = lambda r, c: (F.col(r) + 100) * 1000 + F.col(c) + 100
    pairs = moves.withColumn("a", name("r", "c")).withColumn("b", name("r0", "c0")).where("a <> b")
    found = pairs.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.countDistinct("track_id").cast("int").alias("frequency")).where(F.col("frequency") >= least)
    place = lambda n: polyline.point(F.pmod(F.col(n), F.lit(1000)) * 50.0 - 4986.0 + F.pmod(F.col(n) * 7, F.lit(23)), F.floor(F.col(n) / 1000) * 50.0 - 4984.0 + F.pmod(F.col(n) * 11, F.lit(19)))
    edges = found.withColumn("coords", F.array(place("u"), place("v"))).withColumn("length", polyline.length(F.col("coords"))).withColumn("edge", F.col("u") * 1_000_000 + F.col("v"))
    nodes = found.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", place("id").alias("p")).select("id", "p.x", "p.y")
    return nodes, edges.select(*graph.COLUMNS)


# ---- the same in SQL

FIXES = """
g0 AS (SELECT event_id, ts, user_id, event_type, value FROM events UNION ALL SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_id % 50 = 0),
g1 AS (SELECT *, (epoch_us(ts) / 1e6 - 1704067200e0) / 600e0 AS t FROM g0),
g2 AS (SELECT *, user_id * 137e0 + t * 8e0 AS s0, value * 100e0 - 10e0 * floor(value * 10e0) - 4.5e0 AS jit, user_id % 8 AS r FROM g1),
g3 AS (SELECT *, s0 - 2000e0 * floor(s0 / 2000e0) AS m FROM g2),
g4 AS (SELECT *, CASE WHEN m < 1000 THEN m ELSE 2000e0 - m END AS s, 250e0 * (CASE WHEN r < 4 THEN r ELSE r - 4 END) + 125e0 + jit AS st FROM g3),
g5 AS (SELECT *, CASE WHEN r < 4 THEN s ELSE st END AS px, CASE WHEN r < 4 THEN st ELSE s END AS py FROM g4),
fixes AS (SELECT CAST(user_id AS VARCHAR) AS device, CAST(1704067200000000 + floor(t * 1e6) AS BIGINT) AS us,
  CASE WHEN event_type = 'error' AND value < 2 THEN 95e0 WHEN event_type = 'signup' AND value > 200 THEN 45.3e0 + py / 111320e0 ELSE 45e0 + py / 111320e0 END AS lat,
  134e0 + px / (111320e0 * 0.7071067811865476e0) AS lon FROM g5),
valid AS (SELECT * FROM fixes WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
u AS (SELECT DISTINCT device, us, lat, lon FROM valid)"""


def hav(a: str, b: str, c: str, d: str) -> str:
    square = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"(CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 2 * 6371008.8e0 * asin(sqrt(least(1e0, greatest(0e0, {square})))) END)"


W = "OVER (PARTITION BY device ORDER BY us, lat, lon)"
STEPS = f""",
l AS (SELECT *, lag(lat) {W} AS lat0, lag(lon) {W} AS lon0, lag(us) {W} AS us0, lead(lat) {W} AS lat2, lead(lon) {W} AS lon2, count(*) OVER (PARTITION BY device) AS n FROM u),
steps AS (SELECT *, {hav("lat0", "lon0", "lat", "lon")} AS step_m, (us - us0) / 1e6 AS dt_s FROM l)"""
FIX = "device, us AS time_us, round(lat, 7) AS lat, round(lon, 7) AS lon"
FLAT = """,
flat AS (SELECT device AS track_id, us, round((lon - 134e0) * (111320e0 * 0.7071067811865476e0), 2) AS x, round((lat - 45e0) * 111320e0, 2) AS y FROM u WHERE lat < 45.2)"""
TRACKS = f""",
ul AS (SELECT * FROM u WHERE lat < 45.2),
tl AS (SELECT *, lag(lat) {W} AS lat0, lag(lon) {W} AS lon0, lag(us) {W} AS us0 FROM ul),
tg AS (SELECT *, CASE WHEN (us - us0) / 1e6 > 300 OR {hav("lat0", "lon0", "lat", "lon")} > 500 THEN 1 ELSE 0 END AS gap FROM tl),
ts AS (SELECT *, sum(gap) OVER (PARTITION BY device ORDER BY us, lat, lon ROWS UNBOUNDED PRECEDING) AS seg FROM tg),
tracks AS (SELECT device || '#' || CAST(seg AS INTEGER) AS track_id, row_number() OVER (PARTITION BY device, seg ORDER BY us, lat, lon) - 1 AS seq,
  round((lon - 134e0) * (111320e0 * 0.7071067811865476e0), 2) AS x, round((lat - 45e0) * 111320e0, 2) AS y FROM ts)"""
STREETS = """,
sm AS (SELECT *, CAST(floor(y / 50e0) AS BIGINT) AS r, CAST(floor(x / 50e0) AS BIGINT) AS c FROM flat),
sl AS (SELECT *, lag(r) OVER w AS r0, lag(c) OVER w AS c0 FROM sm WINDOW w AS (PARTITION BY track_id ORDER BY us, x, y)),
sp AS (SELECT track_id, (r + 100) * 1000 + c + 100 AS a, (r0 + 100) * 1000 + c0 + 100 AS b FROM sl WHERE abs(r - r0) + abs(c - c0) <= 2),
se AS (SELECT least(a, b) AS u, greatest(a, b) AS v, CAST(count(DISTINCT track_id) AS INTEGER) AS frequency FROM sp WHERE a <> b GROUP BY 1, 2),
edges AS (SELECT u * 1000000 + v AS edge, u, v, frequency, (u % 1000) * 50e0 - 4986e0 + (u * 7) % 23 AS x1, (u // 1000) * 50e0 - 4984e0 + (u * 11) % 19 AS y1, (v % 1000) * 50e0 - 4986e0 + (v * 7) % 23 AS x2, (v // 1000) * 50e0 - 4984e0 + (v * 11) % 19 AS y2 FROM se),
edge AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM edges),
node AS (SELECT DISTINCT id, (id % 1000) * 50e0 - 4986e0 + (id * 7) % 23 AS x, (id // 1000) * 50e0 - 4984e0 + (id * 11) % 19 AS y FROM (SELECT u AS id FROM se UNION ALL SELECT v FROM se)),
deg AS (SELECT id, count(*) AS degree FROM (SELECT u AS id FROM se UNION ALL SELECT v FROM se) GROUP BY 1)"""
MAIN = STREETS.replace("WHERE a <> b GROUP BY 1, 2)", "WHERE a <> b GROUP BY 1, 2 HAVING count(DISTINCT track_id) >= 5)")
REACH = """,
ways AS (SELECT u AS a, v AS b FROM se UNION SELECT v, u FROM se),
reach AS (SELECT id AS a, id AS b FROM node UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1)"""
GRID = """,
grid AS (SELECT min(x) - 3 * 5e0 AS ox, min(y) - 3 * 5e0 AS oy, CAST(ceil((max(x) - min(x)) / 5e0) + 7 AS BIGINT) AS width, CAST(ceil((max(y) - min(y)) / 5e0) + 7 AS BIGINT) AS height FROM flat),
cellp AS (SELECT track_id, CAST(floor((y - oy) / 5e0) AS BIGINT) AS row, CAST(floor((x - ox) / 5e0) AS BIGINT) AS col FROM flat, grid),
cells AS (SELECT row, col, CAST(count(DISTINCT track_id) AS DOUBLE) AS v FROM cellp GROUP BY 1, 2)"""


def fix_rows(points: DataFrame) -> DataFrame:
    return points.select("device", F.unix_micros("time").alias("time_us"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


# ---- preprocessing


@query(f"WITH {FIXES} SELECT {FIX} FROM valid")
def drop_invalid(spark, sf_dir):
    return fix_rows(clean.drop_invalid(fixes(spark, sf_dir)))


@query(f"WITH {FIXES} SELECT {FIX} FROM u")
def deduplicate(spark, sf_dir):
    return fix_rows(unique_fixes(spark, sf_dir))


@query(f"WITH {FIXES}{STEPS} SELECT device, us AS time_us, round(lat, 7) AS lat, round(step_m, 3) AS step_m, dt_s, round(CASE WHEN dt_s > 0 THEN step_m / dt_s END, 6) AS speed FROM steps WHERE dt_s > 0")
def haversine_steps(spark, sf_dir):
    found = clean.steps(unique_fixes(spark, sf_dir)).where("dt_s > 0")
    return found.select("device", F.unix_micros("time").alias("time_us"), F.round("lat", 7).alias("lat"), F.round("step_m", 3).alias("step_m"), "dt_s", F.round("speed_mps", 6).alias("speed"))


SPEED = f"""{STEPS},
sp0 AS (SELECT *, CASE WHEN dt_s > 0 THEN step_m / dt_s WHEN dt_s <= 0 AND step_m > 0 THEN 1.7976931348623157e308 END AS speed FROM steps),
sp1 AS (SELECT *, lag(speed) {W} AS speed0 FROM sp0)"""


@query(f"WITH {FIXES}{SPEED} SELECT {FIX} FROM sp1 WHERE NOT coalesce(speed > 70 / 3.6e0, false)")
def speed_filter(spark, sf_dir):
    return fix_rows(clean.speed_filter(unique_fixes(spark, sf_dir), a_max=None))


@query(f"""WITH {FIXES}{SPEED} SELECT {FIX} FROM sp1 WHERE NOT coalesce(speed > 70 / 3.6e0, false)
  AND NOT (n > 2 AND coalesce(dt_s > 0 AND abs((speed - speed0) / dt_s) > 4, false))""")
def speed_filter_accel(spark, sf_dir):
    return fix_rows(clean.speed_filter(unique_fixes(spark, sf_dir)))


@query(f"""WITH {FIXES}{STEPS},
q AS (SELECT *, lead(step_m) {W} AS next_m, {hav("lat0", "lon0", "lat2", "lon2")} AS across FROM steps)
SELECT {FIX} FROM q WHERE NOT coalesce(dt_s > 0 AND step_m / dt_s > 120 / 3.6e0, false) AND NOT coalesce(step_m > 200 AND dt_s > 0 AND dt_s < 60, false)
  AND NOT coalesce(step_m > 200 AND next_m > 200 AND across < 200, false)""")
def spoof_filter(spark, sf_dir):
    return fix_rows(clean.spoof_filter(unique_fixes(spark, sf_dir)))


@query(f"WITH {FIXES}{STEPS} SELECT {FIX} FROM steps WHERE step_m IS NULL OR step_m >= 10")
def thin_consecutive(spark, sf_dir):
    return fix_rows(clean.thin_consecutive(unique_fixes(spark, sf_dir), 10.0))


@query(f"""WITH RECURSIVE {FIXES},
o AS (SELECT *, row_number() {W} AS k FROM u),
kept AS (SELECT device, k, us, lat, lon, lat AS klat, lon AS klon, true AS keep FROM o WHERE k = 1
  UNION ALL SELECT o.device, o.k, o.us, o.lat, o.lon, CASE WHEN {hav("klat", "klon", "o.lat", "o.lon")} >= 10 THEN o.lat ELSE klat END, CASE WHEN {hav("klat", "klon", "o.lat", "o.lon")} >= 10 THEN o.lon ELSE klon END,
    {hav("klat", "klon", "o.lat", "o.lon")} >= 10 FROM kept JOIN o ON o.device = kept.device AND o.k = kept.k + 1)
SELECT {FIX} FROM kept WHERE keep""")
def thin_greedy(spark, sf_dir):
    return fix_rows(clean.thin_greedy(unique_fixes(spark, sf_dir), 10.0))


@query(f"""WITH {FIXES}{STEPS},
g AS (SELECT *, sum(CASE WHEN dt_s > 300 OR step_m > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY us, lat, lon ROWS UNBOUNDED PRECEDING) AS seg FROM steps)
SELECT device || '#' || CAST(seg AS INTEGER) AS track_id, count(*) AS points, max(us) - min(us) AS lasts_us FROM g GROUP BY 1""")
def segments(spark, sf_dir):
    found = clean.segments(unique_fixes(spark, sf_dir))
    return found.groupBy("track_id").agg(F.count("*").alias("points"), (F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))).alias("lasts_us"))


@query(f"""WITH {FIXES}{STEPS},
g AS (SELECT *, sum(CASE WHEN dt_s > 300 OR step_m > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY us, lat, lon ROWS UNBOUNDED PRECEDING) AS seg FROM steps),
t AS (SELECT device, seg, count(*) AS n FROM g GROUP BY 1, 2)
SELECT count(*) AS tracks, count(*) FILTER (n >= 2) AS long_enough, CAST(sum(n) AS BIGINT) AS points FROM t""")
def track_count(spark, sf_dir):
    found = clean.segments(unique_fixes(spark, sf_dir)).groupBy("track_id").agg(F.count("*").alias("n"))
    return found.agg(F.count("*").alias("tracks"), F.count(F.when(F.col("n") >= 2, 1)).alias("long_enough"), F.sum("n").alias("points"))


@query(f"""WITH {FIXES}{SPEED}, k AS (SELECT count(*) AS n FROM sp1 WHERE NOT coalesce(speed > 70 / 3.6e0, false) AND NOT (n > 2 AND coalesce(dt_s > 0 AND abs((speed - speed0) / dt_s) > 4, false)))
SELECT (SELECT count(*) FROM fixes) AS input, (SELECT count(*) FROM fixes) - (SELECT count(*) FROM valid) AS invalid_removed, (SELECT count(*) FROM valid) - (SELECT count(*) FROM u) AS duplicates_removed,
  (SELECT count(*) FROM u) - n AS speed_removed, CAST(0 AS BIGINT) AS reb_removed, n AS output FROM k""")
def clean_stats(spark, sf_dir):
    return clean.clean(fixes(spark, sf_dir))[1]


RING = [(134.0, 45.0), (134.008, 45.0), (134.008, 45.006), (134.004, 45.009), (134.0, 45.006)]
HOLE = [(134.002, 45.002), (134.006, 45.002), (134.006, 45.004), (134.002, 45.004)]


def _ray(ring):
    parts = [f"(CASE WHEN ({y1!r}e0 > lat) <> ({y2!r}e0 > lat) AND lon < ({x2!r}e0 - {x1!r}e0) * (lat - {y1!r}e0) / ({y2!r}e0 - {y1!r}e0) + {x1!r}e0 THEN 1 ELSE 0 END)" for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]) if y1 != y2]
    return " + ".join(parts)


@query(f"WITH {FIXES} SELECT {FIX} FROM u WHERE ({_ray(RING)} + {_ray(HOLE)}) % 2 = 1")
def aoi_clip(spark, sf_dir):
    return fix_rows(clean.clip(unique_fixes(spark, sf_dir), [RING, HOLE]))


@query(f"""WITH {FIXES}, a AS (SELECT DISTINCT round(lon, 4) % 360 AS a FROM u), g AS (SELECT a - lag(a) OVER (ORDER BY a) AS g FROM a)
SELECT round(degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 6) AS center_lon, round(avg(lat), 6) AS center_lat, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max,
  round(360 - greatest((SELECT max(g) FROM g), (SELECT 360 - max(a) + min(a) FROM a)), 4) AS arc FROM u""")
def data_extent(spark, sf_dir):
    e = clean.extent(unique_fixes(spark, sf_dir))
    return e.select(*(F.round(c, 6).alias(c) for c in ("center_lon", "center_lat", "lat_min", "lat_max")), F.round("arc", 4).alias("arc"))


def _tmerc_sql(lat: str, lon: str, center: float) -> str:
    e = geo.ECCENTRICITY
    xs = " + ".join(f"{a!r}e0 * cos({2 * j}e0 * xi0) * sinh({2 * j}e0 * eta0)".replace("e-0", "e-").replace("e0e0", "e0") for j, a in enumerate(geo.ALPHA, 1))
    ys = " + ".join(f"{a!r}e0 * sin({2 * j}e0 * xi0) * cosh({2 * j}e0 * eta0)" for j, a in enumerate(geo.ALPHA, 1))
    num = lambda s: __import__("re").sub(r"(e-\d+)e0", r"\1", s)
    return num(f"""t1 AS (SELECT *, tan(radians({lat})) AS tau, radians({lon} - {center!r}e0) AS lam FROM u),
t2 AS (SELECT *, sinh({e!r}e0 * atanh({e!r}e0 * tau / sqrt(1 + tau * tau))) AS sg FROM t1),
t3 AS (SELECT *, tau * sqrt(1 + sg * sg) - sg * sqrt(1 + tau * tau) AS tc FROM t2),
t4 AS (SELECT *, atan2(tc, cos(lam)) AS xi0, asinh(sin(lam) / sqrt(tc * tc + cos(lam) * cos(lam))) AS eta0 FROM t3),
t5 AS (SELECT *, {geo.RECTIFYING!r}e0 * (eta0 + {xs}) AS px, {geo.RECTIFYING!r}e0 * (xi0 + {ys}) AS py FROM t4)""")


@query(f"WITH {FIXES}, {_tmerc_sql('lat', 'lon', 134.0)} SELECT device, us AS time_us, round(px, 3) AS x, round(py, 3) AS y FROM t5")
def project_tmerc(spark, sf_dir):
    found = geo.project(unique_fixes(spark, sf_dir), 134.0)
    return found.select("device", F.unix_micros("time").alias("time_us"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"WITH {FIXES} SELECT {FIX} FROM u")
def project_roundtrip(spark, sf_dir):
    there = geo.project(unique_fixes(spark, sf_dir), 134.0).drop("lat", "lon")
    return fix_rows(geo.unproject(there, 134.0))


@query(f"""WITH {FIXES}{TRACKS}, s AS (SELECT track_id, seq, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS m FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
t AS (SELECT track_id, sum(m) AS total FROM s GROUP BY 1)
SELECT track_id, CAST(CASE WHEN total = 0 THEN 1 ELSE greatest(1, round_even(total / 20e0, 0)) + 1 END AS BIGINT) AS points FROM t""")
def resample_counts(spark, sf_dir):
    return clean.resample(flat_tracks(spark, sf_dir), 20.0).groupBy("track_id").agg(F.count("*").alias("points"))


@query(f"""WITH {FIXES}{TRACKS}, s AS (SELECT track_id, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS m FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq))
SELECT track_id, round(coalesce(sum(m), 0), 3) AS length FROM s GROUP BY 1""")
def polyline_length(spark, sf_dir):
    return clean.pack(flat_tracks(spark, sf_dir)).select("track_id", F.round(polyline.length(F.col("coords")), 3).alias("length"))


@query(f"""WITH {FIXES}{TRACKS}, s AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS m FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq))
SELECT track_id, CAST(seq AS BIGINT) AS seq, round(sum(coalesce(m, 0)) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 3) AS at_m FROM s""")
def arc_length(spark, sf_dir):
    return clean.arc_length(flat_tracks(spark, sf_dir)).select("track_id", F.col("seq").cast("long").alias("seq"), F.round("at_m", 3).alias("at_m"))


@query("""WITH o AS (SELECT event_id, CAST(user_id AS VARCHAR) AS device, event_id AS idx FROM events),
f AS (SELECT *, CASE WHEN device IS DISTINCT FROM lag(device) OVER (PARTITION BY idx // 1000 ORDER BY idx) THEN 1 ELSE 0 END AS new FROM o),
b AS (SELECT *, sum(new) OVER (PARTITION BY idx // 1000 ORDER BY idx ROWS UNBOUNDED PRECEDING) AS block FROM f)
SELECT event_id, 946684800000000 + 2000000 * (row_number() OVER (PARTITION BY idx // 1000, block ORDER BY idx) - 1) AS time_us FROM b""")
def synthetic_times(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("device"), F.floor(F.col("event_id") / 1000).alias("part"))
    return synthesize_times(rows, order="event_id", step_s=2.0, part="part").select("event_id", F.unix_micros("time").alias("time_us"))


# ---- rasters


def cells_of(spark, sf_dir, mode="tracks"):
    points = flat_points(spark, sf_dir)
    meta = density.grid(points, 5.0)
    return density.density(points, meta, mode), meta


@query(f"WITH {FIXES}{FLAT}{GRID} SELECT round(ox, 3) AS ox, round(oy, 3) AS oy, 5e0 AS cell, width, height FROM grid")
def grid_bounds(spark, sf_dir):
    return density.grid(flat_points(spark, sf_dir), 5.0).select(F.round("ox", 3).alias("ox"), F.round("oy", 3).alias("oy"), "cell", "width", "height")


@query(f"WITH {FIXES}{FLAT}{GRID} SELECT * FROM cells")
def density_tracks(spark, sf_dir):
    return cells_of(spark, sf_dir)[0]


@query(f"WITH {FIXES}{FLAT}{GRID} SELECT row, col, CAST(count(*) AS DOUBLE) AS v FROM cellp GROUP BY 1, 2")
def density_points(spark, sf_dir):
    return cells_of(spark, sf_dir, "points")[0]


def _conv_sql(weights, source="cells"):
    half = len(weights) // 2
    values = ", ".join(f"({k - half}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(weights))
    return f""",
kw(d, w) AS (VALUES {values}),
c1 AS (SELECT row + d AS row, col, sum(v * w) AS v FROM {source}, kw, grid WHERE row + d >= 0 AND row + d < height GROUP BY 1, 2),
c2 AS (SELECT row, col + d AS col, sum(v * w) AS v FROM c1, kw, grid WHERE col + d >= 0 AND col + d < width GROUP BY 1, 2)"""


@query(f"WITH {FIXES}{FLAT}{GRID}{_conv_sql(density.sharpened(3.0))} SELECT row, col, round(v, 8) AS v FROM c2")
def smooth_density(spark, sf_dir):
    cells, meta = cells_of(spark, sf_dir)
    return density.smooth(cells, meta, 3.0).select("row", "col", F.round("v", 8).alias("v"))


@query(f"""WITH {FIXES}{FLAT}{GRID}, cp AS (SELECT row, col, CAST(count(*) AS DOUBLE) AS v FROM cellp GROUP BY 1, 2){_conv_sql(density.gaussian(2.0), "cp")}
SELECT row, col, round(v, 8) AS v FROM c2""")
def kde(spark, sf_dir):
    points = flat_points(spark, sf_dir)
    return density.kde(points, density.grid(points, 5.0), 5.0, 10.0).select("row", "col", F.round("v", 8).alias("v"))


@query(f"""WITH {FIXES}{FLAT}{GRID},
here AS (SELECT DISTINCT r AS row, c AS col FROM (SELECT row + a AS r, col + b AS c FROM cells, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(a, b)), grid WHERE r >= 0 AND c >= 0 AND r < height AND c < width),
g AS (SELECT here.row, here.col, width, height, coalesce(m.v, 0) AS v, coalesce(w.v, 0) AS w, coalesce(e.v, 0) AS e, coalesce(s.v, 0) AS s, coalesce(n.v, 0) AS n FROM here CROSS JOIN grid
  LEFT JOIN cells m ON m.row = here.row AND m.col = here.col LEFT JOIN cells w ON w.row = here.row AND w.col = here.col - 1 LEFT JOIN cells e ON e.row = here.row AND e.col = here.col + 1
  LEFT JOIN cells s ON s.row = here.row - 1 AND s.col = here.col LEFT JOIN cells n ON n.row = here.row + 1 AND n.col = here.col),
r AS (SELECT row, col, CASE WHEN col = 0 THEN e - v WHEN col = width - 1 THEN v - w ELSE (e - w) / 2 END AS gx, CASE WHEN row = 0 THEN n - v WHEN row = height - 1 THEN v - s ELSE (n - s) / 2 END AS gy FROM g)
SELECT * FROM r WHERE gx <> 0 OR gy <> 0""")
def gradient(spark, sf_dir):
    return density.gradient(*cells_of(spark, sf_dir))


@query(f"""WITH {FIXES}{FLAT}{GRID}, m AS (SELECT max(v) AS vmax FROM cells), h AS (SELECT least(255, CAST(floor(v / vmax * 256) AS INTEGER)) AS b, count(*) AS n FROM cells, m GROUP BY 1),
d AS (SELECT b, CAST(coalesce(n, 0) AS DOUBLE) AS n, (b + 0.5e0) * vmax / 256 AS c FROM range(256) t(b) LEFT JOIN h USING (b) CROSS JOIN m),
s AS (SELECT *, sum(n) OVER (ORDER BY b) AS w0, sum(n * c) OVER (ORDER BY b) AS s0, sum(n) OVER () AS w, sum(n * c) OVER () AS s FROM d),
v AS (SELECT b, c, CASE WHEN w0 > 0 AND w > w0 THEN round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) ELSE 0 END AS bt FROM s)
SELECT round(c, 9) AS threshold FROM v ORDER BY bt DESC, b LIMIT 1""")
def otsu_threshold(spark, sf_dir):
    return density.otsu(cells_of(spark, sf_dir)[0]).select(F.round("threshold", 9).alias("threshold"))


@query(f"WITH {FIXES}{FLAT}{GRID} SELECT round(quantile_cont(v, 0.8), 9) AS threshold FROM cells WHERE v > 0")
def percentile_threshold(spark, sf_dir):
    return density.percentile(cells_of(spark, sf_dir)[0], 80.0).select(F.round("threshold", 9).alias("threshold"))


@query(f"WITH {FIXES}{FLAT}{GRID} SELECT row, col FROM cells WHERE v > (SELECT quantile_cont(v, 0.8) FROM cells)")
def binarize(spark, sf_dir):
    cells = cells_of(spark, sf_dir)[0]
    return density.mask(cells, density.percentile(cells, 80.0))


@query(f"""WITH {FIXES}{FLAT}{GRID}, o AS (SELECT a, b FROM range(-2, 3) x(a), range(-2, 3) y(b) WHERE abs(a) + abs(b) <= 2),
w AS (SELECT DISTINCT row + a AS row, col + b AS col FROM cells, o WHERE v > 1)
SELECT row, col FROM w, grid WHERE row >= 0 AND col >= 0 AND row < height AND col < width""")
def dilate(spark, sf_dir):
    cells, meta = cells_of(spark, sf_dir)
    return density.dilate(cells.where("v > 1").select("row", "col"), meta, 2.0)


@query()
def fill_holes(spark, sf_dir):
    cells, meta = cells_of(spark, sf_dir)
    return density.holes(density.dilate(cells.select("row", "col"), meta, 2.0), meta, 6)


HIST = "b AS (SELECT min(v) AS a, max(v) AS z FROM val)"


@query(f"""WITH {FIXES}{FLAT}{GRID}, val AS (SELECT v FROM cells), {HIST}, h AS (SELECT least(11, CAST(floor((v - a) / (z - a) * 12) AS INTEGER)) AS bin, count(*) AS n FROM val, b GROUP BY 1)
SELECT CAST(k AS INTEGER) AS bin, round(a + k * (z - a) / 12, 6) AS lo, round(a + (k + 1) * (z - a) / 12, 6) AS hi, coalesce(n, 0) AS n FROM range(12) t(k) CROSS JOIN b LEFT JOIN h ON h.bin = k""")
def histogram_linear(spark, sf_dir):
    return density.histogram(cells_of(spark, sf_dir)[0]).select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query(f"""WITH {FIXES}{FLAT}{GRID}, val AS (SELECT v FROM cells), {HIST}, h AS (SELECT least(11, CAST(floor(log10(v + 1) / log10(z + 1) * 12) AS INTEGER)) AS bin, count(*) AS n FROM val, b GROUP BY 1)
SELECT CAST(k AS INTEGER) AS bin, round(pow(10, k / 12e0 * log10(z + 1)) - 1, 6) AS lo, round(pow(10, (k + 1) / 12e0 * log10(z + 1)) - 1, 6) AS hi, coalesce(n, 0) AS n FROM range(12) t(k) CROSS JOIN b LEFT JOIN h ON h.bin = k""")
def histogram_log(spark, sf_dir):
    return density.histogram(cells_of(spark, sf_dir)[0], scale="log").select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query(f"WITH {FIXES}{FLAT}{GRID} SELECT count(*) AS count, min(v) AS min, median(v) AS median, round(avg(v), 9) AS mean, max(v) AS max FROM cells")
def summary(spark, sf_dir):
    s = density.summary(cells_of(spark, sf_dir)[0])
    return s.withColumn("mean", F.round("mean", 9))


@query(f"""WITH {FIXES}{FLAT}{GRID}, p AS (SELECT row_number() OVER (ORDER BY track_id, us, x, y) AS id, (x - ox) / 5e0 AS px, (y - oy) / 5e0 AS py FROM flat, grid),
c AS (SELECT id, px, py, CAST(floor(py) AS BIGINT) + b AS row, CAST(floor(px) AS BIGINT) + a AS col FROM p, range(2) x(a), range(2) y(b))
SELECT id, round(sum(coalesce(v, 0) * (1 - abs(px - c.col)) * (1 - abs(py - c.row))), 6) AS value FROM c LEFT JOIN cells ON cells.row = c.row AND cells.col = c.col GROUP BY 1""")
def bilinear(spark, sf_dir):
    points = flat_points(spark, sf_dir)
    cells, meta = cells_of(spark, sf_dir)
    named = points.withColumn("id", F.row_number().over(Window.orderBy("track_id", "time", "x", "y")).cast("long")).join(meta, F.lit(True))
    at = named.select("id", ((F.col("x") - F.col("ox")) / 5.0).alias("px"), ((F.col("y") - F.col("oy")) / 5.0).alias("py"))
    return density.bilinear(cells, at).select("id", F.round("value", 6).alias("value"))


# ---- tiles and joins


@query(f"""WITH {FIXES}{TRACKS}, i AS (SELECT track_id, CAST(seq AS BIGINT) AS seq, j * 4 + i AS tile FROM tracks, range(4) a(i), range(4) b(j) WHERE x BETWEEN i * 250 - 75 AND (i + 1) * 250 + 75 AND y BETWEEN j * 250 - 75 AND (j + 1) * 250 + 75),
r AS (SELECT *, seq - row_number() OVER (PARTITION BY tile, track_id ORDER BY seq) AS island FROM i), n AS (SELECT tile, track_id, island, min(seq) AS first, count(*) AS points FROM r GROUP BY 1, 2, 3)
SELECT CAST(tile AS INTEGER) AS tile, track_id, CAST(row_number() OVER (PARTITION BY tile, track_id ORDER BY first) - 1 AS INTEGER) AS run, first, points FROM n WHERE points >= 2""")
def assign_tiles(spark, sf_dir):
    runs = spatial.assign_tiles(flat_tracks(spark, sf_dir), 0.0, 0.0, 250.0, 4, 4, 75.0)
    return runs.groupBy("tile", "track_id", "run").agg(F.min("seq").cast("long").alias("first"), F.count("*").alias("points"))


@query(f"""WITH {FIXES}{FLAT}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM flat), s AS (SELECT *, greatest((x1 - x0) / 3, (y1 - y0) / 3, 5) AS size FROM b)
SELECT CAST(j * nx + i AS INTEGER) AS tile, round(x0 + i * size, 3) AS cx0, round(y0 + j * size, 3) AS cy0, round(x0 + (i + 1) * size + 75, 3) AS rx1, round(y0 + (j + 1) * size + 75, 3) AS ry1
FROM (SELECT *, greatest(1, ceil((x1 - x0) / size - 1e-9)) AS nx, greatest(1, ceil((y1 - y0) / size - 1e-9)) AS ny FROM s), range(3) a(i), range(3) c(j) WHERE i < nx AND j < ny""")
def choose_tiling(spark, sf_dir):
    x0, x1, y0, y1 = flat_points(spark, sf_dir).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    tiles = spatial.choose_tiling(0, x0, y0, x1, y1, 5.0, "forced", (3, 2))
    rows = spark.createDataFrame([(t["tile"], t["cx0"], t["cy0"], t["rx1"], t["ry1"]) for t in tiles], "tile int, cx0 double, cy0 double, rx1 double, ry1 double")
    return rows.select("tile", *(F.round(c, 3).alias(c) for c in ("cx0", "cy0", "rx1", "ry1")))


@query(f"WITH {FIXES}{FLAT}{STREETS} SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d FROM node a JOIN node b ON a.id < b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 10000")
def radius_pairs(spark, sf_dir):
    return spatial.close_pairs(streets(spark, sf_dir)[0], 100.0).select("a", "b", F.round("d", 6).alias("d"))


@query(f"""WITH {FIXES}{FLAT}{STREETS}, p AS (SELECT a.id AS a, b.id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM node a JOIN node b ON a.id <> b.id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 22500)
SELECT a, b, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY a ORDER BY d, b) AS INTEGER) AS rank FROM p QUALIFY rank <= 3""")
def k_nearest(spark, sf_dir):
    return spatial.k_nearest(streets(spark, sf_dir)[0], 3, 150.0).withColumn("d", F.round("d", 6))


@query(f"""WITH {FIXES}{FLAT}{STREETS}, p AS (SELECT row_number() OVER (ORDER BY track_id, us, x, y) AS p_id, x, y FROM flat),
d AS (SELECT p_id, id AS t_id, sqrt(pow(p.x - node.x, 2) + pow(p.y - node.y, 2)) AS d FROM p JOIN node ON abs(p.x - node.x) < 30 AND abs(p.y - node.y) < 30)
SELECT p_id, t_id, round(d, 6) AS d FROM d WHERE d < 30 QUALIFY row_number() OVER (PARTITION BY p_id ORDER BY d, t_id) = 1""")
def nearest_node(spark, sf_dir):
    points = flat_points(spark, sf_dir).withColumn("p_id", F.row_number().over(Window.orderBy("track_id", "time", "x", "y")).cast("long"))
    nodes = streets(spark, sf_dir)[0].select(F.col("id").alias("t_id"), "x", "y")
    return spatial.nearest(points.select("p_id", "x", "y"), nodes, 30.0).withColumn("d", F.round("d", 6))


@query(f"""WITH {FIXES}{FLAT}{STREETS}, p AS (SELECT row_number() OVER (ORDER BY track_id, us, x, y) AS id, track_id, x, y FROM flat), v AS (SELECT edge, 0 AS k, x1 AS x, y1 AS y FROM edge UNION ALL SELECT edge, 1, x2, y2 FROM edge),
d AS (SELECT id, track_id, edge, k, sqrt(pow(p.x - v.x, 2) + pow(p.y - v.y, 2)) AS d FROM p JOIN v ON abs(p.x - v.x) < 30 AND abs(p.y - v.y) < 30),
n AS (SELECT * FROM d WHERE d < 30 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, edge, k) = 1)
SELECT edge.edge, CAST(count(DISTINCT track_id) AS INTEGER) AS n_devices FROM edge LEFT JOIN n ON n.edge = edge.edge GROUP BY 1""")
def count_devices(spark, sf_dir):
    points = flat_points(spark, sf_dir).select(F.col("track_id").alias("device"), "x", "y")
    return graph.count_devices(streets(spark, sf_dir)[1], points, 30.0).select("edge", "n_devices")


@query(f"""WITH {FIXES}{FLAT}{STREETS}, p AS (SELECT row_number() OVER (ORDER BY track_id, us, x, y) AS id, track_id, x, y FROM flat), v AS (SELECT edge, 0 AS k, x1 AS x, y1 AS y FROM edge UNION ALL SELECT edge, 1, x2, y2 FROM edge),
d AS (SELECT id, track_id, edge, k, sqrt(pow(p.x - v.x, 2) + pow(p.y - v.y, 2)) AS d FROM p JOIN v ON abs(p.x - v.x) < 30 AND abs(p.y - v.y) < 30),
n AS (SELECT * FROM d WHERE d < 30 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, edge, k) = 1),
h AS (SELECT edge, track_id, count(DISTINCT k) AS hits FROM n GROUP BY 1, 2), f AS (SELECT edge, count(*) AS f FROM h WHERE hits >= 2 * 0.75 GROUP BY 1)
SELECT edge.edge, CAST(coalesce(f, 0) AS INTEGER) AS frequency FROM edge LEFT JOIN f ON f.edge = edge.edge""")
def edge_frequencies(spark, sf_dir):
    edges = streets(spark, sf_dir)[1]
    pixels = edges.select("edge", F.posexplode("coords").alias("k", "p")).select("edge", "k", "p.x", "p.y")
    return graph.frequencies(pixels, flat_points(spark, sf_dir).select("track_id", "x", "y"), 0.75, 30.0)


# ---- graphs


@query(f"WITH {FIXES}{FLAT}{STREETS} SELECT id AS node, degree FROM deg")
def degrees(spark, sf_dir):
    return graph.degrees(streets(spark, sf_dir)[1])


@query(f"WITH {FIXES}{FLAT}{STREETS}, b AS (SELECT u AS node, v AS m FROM se UNION SELECT v, u FROM se) SELECT node, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS neighbours FROM b GROUP BY 1")
def neighbours(spark, sf_dir):
    return graph.neighbours(streets(spark, sf_dir)[1]).select("node", F.concat_ws(",", F.transform("neighbours", lambda x: x.cast("string"))).alias("neighbours"))


@query(f"WITH RECURSIVE {FIXES}{FLAT}{MAIN}{REACH} SELECT id, component FROM comp")
def components(spark, sf_dir):
    return graph.components(*streets(spark, sf_dir, 5))


@query(f"WITH RECURSIVE {FIXES}{FLAT}{MAIN}{REACH} SELECT component, round(sum(length), 3) AS length FROM comp JOIN edge ON edge.u = comp.id GROUP BY 1")
def component_lengths(spark, sf_dir):
    return graph.component_lengths(*streets(spark, sf_dir, 5)).select("component", F.round("length", 3).alias("length"))


@query(f"""WITH RECURSIVE {FIXES}{FLAT}{MAIN}{REACH}, t AS (SELECT component, round(sum(length), 3) AS length FROM comp JOIN edge ON edge.u = comp.id GROUP BY 1)
SELECT edge, u, v FROM edge JOIN comp ON comp.id = edge.u WHERE component = (SELECT component FROM t ORDER BY length DESC, component LIMIT 1)""")
def largest_component(spark, sf_dir):
    return graph.largest_component(*streets(spark, sf_dir, 5))[1].select("edge", "u", "v")


@query(f"""WITH RECURSIVE {FIXES}{FLAT}{MAIN}{REACH}, t AS (SELECT component, sum(length) AS length FROM comp JOIN edge ON edge.u = comp.id GROUP BY 1)
SELECT id, x, y FROM node JOIN comp USING (id) JOIN t USING (component) WHERE length >= 499.999""")
def small_components(spark, sf_dir):
    return graph.remove_small_components(*streets(spark, sf_dir, 5), 499.999)[0]


@query(f"""WITH RECURSIVE {FIXES}{FLAT}{STREETS}, cl AS (SELECT a.id AS a, b.id AS b FROM node a JOIN node b ON a.id <> b.id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1600),
mr AS (SELECT id AS a, id AS b FROM node UNION SELECT mr.a, cl.b FROM mr JOIN cl ON cl.a = mr.b), mc AS (SELECT a AS id, min(b) AS to_ FROM mr GROUP BY 1)
SELECT to_ AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM node JOIN mc USING (id) GROUP BY 1""")
def merge_close_nodes(spark, sf_dir):
    return graph.merge_close_nodes(*streets(spark, sf_dir), 40.0)[0].select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {FIXES}{FLAT}{STREETS} SELECT edge, frequency FROM edge WHERE NOT (frequency < 3 AND length < 55)")
def filter_edges(spark, sf_dir):
    return graph.filter_edges(streets(spark, sf_dir)[1], 3, 55.0).select("edge", "frequency")


@query(f"WITH {FIXES}{FLAT}{STREETS}, k AS (SELECT * FROM edge WHERE NOT (frequency < 3 AND length < 55)) SELECT id, x, y FROM node WHERE id IN (SELECT u FROM k UNION SELECT v FROM k)")
def prune_orphans(spark, sf_dir):
    nodes, edges = streets(spark, sf_dir)
    return graph.prune_orphans(nodes, graph.filter_edges(edges, 3, 55.0))


@query(f"WITH {FIXES}{FLAT}{STREETS}, l AS (SELECT edge, u, CASE WHEN frequency = 1 THEN u ELSE v END AS v, length FROM edge) SELECT edge, v FROM l WHERE NOT (u = v AND length < 60)")
def small_loops(spark, sf_dir):
    edges = streets(spark, sf_dir)[1].withColumn("v", F.when(F.col("frequency") == 1, F.col("u")).otherwise(F.col("v")))
    return graph.remove_small_loops(edges, 60.0).select("edge", "v")


@query(f"""WITH RECURSIVE {FIXES}{FLAT}{MAIN}, e2 AS (SELECT u AS node, edge FROM se JOIN edge USING (u, v) UNION ALL SELECT v, edge FROM se JOIN edge USING (u, v)),
th AS (SELECT min(edge) AS a, max(edge) AS b FROM e2 GROUP BY node HAVING count(*) = 2 AND min(edge) <> max(edge)), tb AS (SELECT a, b FROM th UNION SELECT b, a FROM th),
cr AS (SELECT edge AS a, edge AS b FROM edge UNION SELECT cr.a, tb.b FROM cr JOIN tb ON tb.a = cr.b), cc AS (SELECT a AS edge, min(b) AS chain FROM cr GROUP BY 1)
SELECT chain, count(*) AS edges, round(sum(length), 3) AS length, max(frequency) AS frequency FROM cc JOIN edge USING (edge) GROUP BY 1""")
def chain_totals(spark, sf_dir):
    return graph.chain_totals(streets(spark, sf_dir, 5)[1]).withColumn("length", F.round("length", 3))


@query(f"""WITH RECURSIVE {FIXES}{FLAT}{MAIN}, e2 AS (SELECT u AS node, edge FROM se JOIN edge USING (u, v) UNION ALL SELECT v, edge FROM se JOIN edge USING (u, v)),
th AS (SELECT min(edge) AS a, max(edge) AS b FROM e2 GROUP BY node HAVING count(*) = 2 AND min(edge) <> max(edge)), tb AS (SELECT a, b FROM th UNION SELECT b, a FROM th),
cr AS (SELECT edge AS a, edge AS b FROM edge UNION SELECT cr.a, tb.b FROM cr JOIN tb ON tb.a = cr.b), cc AS (SELECT a AS edge, min(b) AS chain FROM cr GROUP BY 1),
tips AS (SELECT chain, node FROM cc JOIN e2 USING (edge) GROUP BY 1, 2 HAVING count(*) = 1), ends AS (SELECT chain, min(node) AS a, max(node) AS b FROM tips GROUP BY 1)
SELECT chain AS edge, coalesce(any_value(a), chain // 1000000) AS u, coalesce(any_value(b), chain // 1000000) AS v, CAST(count(*) + 1 AS INTEGER) AS points, round(sum(length), 3) AS length, max(frequency) AS frequency
FROM cc JOIN edge USING (edge) LEFT JOIN ends USING (chain) GROUP BY chain""")
def merge_chains(spark, sf_dir):
    return graph.merge_chains(streets(spark, sf_dir, 5)[1]).select("edge", "u", "v", F.size("coords").alias("points"), F.round("length", 3).alias("length"), "frequency")


@query()
def short_spurs(spark, sf_dir):
    return graph.remove_short_spurs(streets(spark, sf_dir, 5)[1], 60.0).select("edge", "u", "v")


@query(f"WITH {FIXES}{FLAT}{STREETS} SELECT quantile_cont(frequency, 0.25) AS low, quantile_cont(frequency, 0.5) AS middle, quantile_cont(frequency, 0.75) AS high FROM edge WHERE frequency > 0")
def class_thresholds(spark, sf_dir):
    return graph.class_thresholds(streets(spark, sf_dir)[1])


@query(f"""WITH {FIXES}{FLAT}{STREETS}, q AS (SELECT quantile_cont(frequency, 0.25) AS lo, quantile_cont(frequency, 0.5) AS mi, quantile_cont(frequency, 0.75) AS hi FROM edge)
SELECT edge, CASE WHEN frequency >= hi THEN 'main' WHEN frequency >= mi THEN 'improved' WHEN frequency >= lo THEN 'ordinary' ELSE 'winter' END AS road_class, CAST(0 AS INTEGER) AS reconstructed, round(0.3 + 0.35 * sqrt(frequency), 6) AS stroke FROM edge, q""")
def annotate(spark, sf_dir):
    return graph.annotate(streets(spark, sf_dir)[1]).select("edge", "road_class", "reconstructed", F.round(geo.stroke_width(F.col("frequency")), 6).alias("stroke"))


@query(f"""WITH {FIXES}{FLAT}{MAIN}, s AS (SELECT a.id AS a, b.id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM node a JOIN deg ON deg.id = a.id AND degree = 1 JOIN node b ON a.id <> b.id
  AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 10000 WHERE NOT EXISTS (SELECT 1 FROM se WHERE (u = a.id AND v = b.id) OR (u = b.id AND v = a.id))),
n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM n""")
def end_bridges(spark, sf_dir):
    return graph.end_bridges(*streets(spark, sf_dir, 5), 100.0)


TIPS = """tp AS (SELECT node.id, node.x, node.y, CASE WHEN u = node.id THEN x1 - x2 ELSE x2 - x1 END / length AS dx, CASE WHEN u = node.id THEN y1 - y2 ELSE y2 - y1 END / length AS dy
  FROM node JOIN deg ON deg.id = node.id AND degree = 1 JOIN edge ON edge.u = node.id OR edge.v = node.id)"""


@query(f"""WITH {FIXES}{FLAT}{MAIN}, {TIPS},
s AS (SELECT p.id AS a, q.id AS b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d, p.dx AS pdx, p.dy AS pdy, q.dx AS qdx, q.dy AS qdy, q.x - p.x AS hx, q.y - p.y AS hy FROM tp p JOIN tp q ON p.id <> q.id AND pow(p.x - q.x, 2) + pow(p.y - q.y, 2) <= 62500),
f AS (SELECT * FROM s WHERE (pdx * hx + pdy * hy) / d >= {math.cos(math.radians(35))!r} AND -(qdx * hx + qdy * hy) / d >= {math.cos(math.radians(35))!r} AND NOT EXISTS (SELECT 1 FROM se WHERE (u = a AND v = b) OR (u = b AND v = a))),
n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM n""")
def facing_pairs(spark, sf_dir):
    return graph.facing_pairs(*streets(spark, sf_dir, 5), 250.0)


@query(f"""WITH {FIXES}{FLAT}{STREETS}, p AS (SELECT a.edge AS edge_a, b.edge AS edge_b, a.x1, a.y1, a.x2 - a.x1 AS rx, a.y2 - a.y1 AS ry, b.x2 - b.x1 AS sx, b.y2 - b.y1 AS sy, b.x1 - a.x1 AS qx, b.y1 - a.y1 AS qy
  FROM edge a JOIN edge b ON a.edge < b.edge AND a.u <> b.u AND a.u <> b.v AND a.v <> b.u AND a.v <> b.v AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)),
c AS (SELECT *, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS w FROM p WHERE abs(rx * sy - ry * sx) >= 1e-12)
SELECT edge_a, edge_b, round(x1 + t * rx, 6) AS x, round(y1 + t * ry, 6) AS y FROM c WHERE t > 1e-6 AND t < 1 - 1e-6 AND w > 1e-6 AND w < 1 - 1e-6""")
def crossings(spark, sf_dir):
    return spatial.crossings(streets(spark, sf_dir)[1]).select("edge_a", "edge_b", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def pieces(edges: DataFrame) -> DataFrame:
    """Where edges begin and end; the numbers of new nodes and edges are free."""
    a, b = F.element_at("coords", 1), F.element_at("coords", -1)
    place = [F.round(p[c], 5).alias(n) for p, c, n in ((a, "x", "x1"), (a, "y", "y1"), (b, "x", "x2"), (b, "y", "y2"))]
    return edges.select(*place, F.round("length", 5).alias("length"), "frequency")


CUT = """cp AS (SELECT edge, 0e0 AS t FROM edge UNION ALL SELECT edge, 1e0 FROM edge UNION ALL SELECT edge, t FROM cut),
cs AS (SELECT edge, t AS t0, lead(t) OVER (PARTITION BY edge ORDER BY t) AS t1 FROM cp),
cut_pieces AS (SELECT round(x1 + t0 * (x2 - x1), 5) AS x1, round(y1 + t0 * (y2 - y1), 5) AS y1, round(x1 + t1 * (x2 - x1), 5) AS x2, round(y1 + t1 * (y2 - y1), 5) AS y2, round(length * (t1 - t0), 5) AS length, frequency FROM cs JOIN edge USING (edge) WHERE t1 IS NOT NULL)"""


@query(f"""WITH {FIXES}{FLAT}{STREETS}, p AS (SELECT a.edge AS edge_a, b.edge AS edge_b, a.x2 - a.x1 AS rx, a.y2 - a.y1 AS ry, b.x2 - b.x1 AS sx, b.y2 - b.y1 AS sy, b.x1 - a.x1 AS qx, b.y1 - a.y1 AS qy
  FROM edge a JOIN edge b ON a.edge < b.edge AND a.u <> b.u AND a.u <> b.v AND a.v <> b.u AND a.v <> b.v AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)),
c AS (SELECT *, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS w FROM p WHERE abs(rx * sy - ry * sx) >= 1e-12),
ok AS (SELECT * FROM c WHERE t > 1e-6 AND t < 1 - 1e-6 AND w > 1e-6 AND w < 1 - 1e-6),
cut AS (SELECT edge_a AS edge, t FROM ok UNION ALL SELECT edge_b, w FROM ok), {CUT} SELECT * FROM cut_pieces""")
def break_at_crossings(spark, sf_dir):
    return pieces(graph.break_at_crossings(*streets(spark, sf_dir))[1])


@query(f"""WITH {FIXES}{FLAT}{MAIN}, tp AS (SELECT node.* FROM node JOIN deg ON deg.id = node.id AND degree = 1),
p AS (SELECT tp.id, edge, tp.x, tp.y, x1, y1, x2, y2, greatest(0, least(1, ((tp.x - x1) * (x2 - x1) + (tp.y - y1) * (y2 - y1)) / (length * length))) AS t FROM tp JOIN edge ON u <> tp.id AND v <> tp.id),
q AS (SELECT id, edge, t, sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)) AS d FROM p)
SELECT id, edge, round(t, 6) AS t, round(d, 6) AS d FROM q WHERE d <= 60 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, edge) = 1""")
def edge_snaps(spark, sf_dir):
    return graph.edge_snaps(*streets(spark, sf_dir, 5), 60.0).select("id", "edge", F.round("t", 6).alias("t"), F.round("d", 6).alias("d"))


@query(f"""WITH {FIXES}{FLAT}{MAIN}, tp AS (SELECT node.* FROM node JOIN deg ON deg.id = node.id AND degree = 1),
p AS (SELECT tp.id, edge, tp.x, tp.y, x1, y1, x2, y2, greatest(0, least(1, ((tp.x - x1) * (x2 - x1) + (tp.y - y1) * (y2 - y1)) / (length * length))) AS t FROM tp JOIN edge ON u <> tp.id AND v <> tp.id),
q AS (SELECT *, sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)) AS d FROM p),
best AS (SELECT * FROM q WHERE d <= 60 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, edge) = 1), cut AS (SELECT edge, t FROM best), {CUT}
SELECT * FROM cut_pieces UNION ALL SELECT round(x, 5), round(y, 5), round(x1 + t * (x2 - x1), 5), round(y1 + t * (y2 - y1), 5), round(d, 5), 0 FROM best""")
def snap_to_edges(spark, sf_dir):
    return pieces(graph.snap_to_edges(*streets(spark, sf_dir, 5), 60.0)[1])


@query()
def stitches(spark, sf_dir):
    return graph.stitches(*streets(spark, sf_dir, 5), 150.0)


def _chaikin_sql(source: str, name: str) -> str:
    """One round of corner cutting: both ends stay, each segment gives points at a quarter and three quarters; lines of two points stay."""
    return f"""{name}_n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER (PARTITION BY track_id) AS n FROM {source} WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
{name} AS (SELECT track_id, seq, x, y FROM {name}_n WHERE n < 3 UNION ALL SELECT track_id, 0, x, y FROM {name}_n WHERE n >= 3 AND seq = 0
  UNION ALL SELECT track_id, 2 * seq + 1, 0.75e0 * x + 0.25e0 * nx, 0.75e0 * y + 0.25e0 * ny FROM {name}_n WHERE n >= 3 AND nx IS NOT NULL
  UNION ALL SELECT track_id, 2 * seq + 2, 0.25e0 * x + 0.75e0 * nx, 0.25e0 * y + 0.75e0 * ny FROM {name}_n WHERE n >= 3 AND nx IS NOT NULL
  UNION ALL SELECT track_id, 2 * seq + 1, x, y FROM {name}_n WHERE n >= 3 AND nx IS NULL)"""


@query(f"WITH {FIXES}{TRACKS}, {_chaikin_sql('tracks', 'k1')}, {_chaikin_sql('k1', 'k2')} SELECT track_id, CAST(seq AS BIGINT) AS seq, round(x, 6) AS x, round(y, 6) AS y FROM k2")
def chaikin(spark, sf_dir):
    smooth = clean.pack(flat_tracks(spark, sf_dir)).select("track_id", polyline.chaikin(F.col("coords"), 2).alias("coords"))
    return clean.unpack(smooth).select("track_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {FIXES}{TRACKS}, m AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS m FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
a AS (SELECT *, sum(m) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS at1, sum(m) OVER (PARTITION BY track_id) AS total FROM m),
t AS (SELECT track_id, any_value(total) AS total, CAST(greatest(1, round_even(any_value(total) / 20e0, 0)) AS BIGINT) AS n FROM a GROUP BY 1),
k AS (SELECT track_id, total, n, unnest(range(1, n)) AS k FROM t WHERE total > 0)
SELECT track_id, CAST(0 AS BIGINT) AS seq, round(x, 4) AS x, round(y, 4) AS y FROM tracks WHERE seq = 0
UNION ALL SELECT track_id, n, round(x, 4), round(y, 4) FROM tracks JOIN t USING (track_id) WHERE total > 0 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY seq DESC) = 1
UNION ALL SELECT * FROM (SELECT k.track_id, k, round(x0 + (k * k.total / n - at1 + m) / m * (x - x0), 4), round(y0 + (k * k.total / n - at1 + m) / m * (y - y0), 4) FROM k JOIN a ON a.track_id = k.track_id AND m > 0 AND at1 >= k * k.total / n AND at1 - m <= k * k.total / n
  QUALIFY row_number() OVER (PARTITION BY k.track_id, k ORDER BY seq) = 1)""")
def resample_points(spark, sf_dir):
    found = clean.resample(flat_tracks(spark, sf_dir), 20.0)
    return found.select("track_id", "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def simplify(spark, sf_dir):
    packed = clean.pack(flat_tracks(spark, sf_dir))
    return packed.select("track_id", F.size("coords").alias("points"), F.size(polyline.simplify(5.0)("coords")).alias("kept"))


@query(f"WITH {FIXES}{FLAT}{STREETS} SELECT round(sum(length) / 1000, 6) AS km FROM edge")
def total_km(spark, sf_dir):
    return graph.total_km(streets(spark, sf_dir)[1]).select(F.round("km", 6).alias("km"))


@query(f"""WITH {FIXES}{FLAT}{STREETS} SELECT edge AS id, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[[' || printf('%.1f', x1) || ',' || printf('%.1f', y1) || '],[' || printf('%.1f', x2) || ',' || printf('%.1f', y2) ||
  ']]}},"properties":{{"id":' || edge || ',"frequency":' || frequency || ',"length":' || printf('%.3f', length) || ',"road_class":"","reconstructed":0,"n_devices":0}}}}' AS feature FROM edge""")
def geojson_features(spark, sf_dir):
    found = sinks.geojson_lines(graph.features(streets(spark, sf_dir)[1]))
    return found.select("id", F.regexp_replace("feature", r'"length":([0-9.]+)', F.concat(F.lit('"length":'), F.format_string("%.3f", F.regexp_extract("feature", r'"length":([0-9.]+)', 1).cast("double")))).alias("feature"))


@query(f"""WITH {FIXES}{FLAT}{STREETS} SELECT count(*) AS lines, CAST(sum(length(l)) AS BIGINT) AS letters FROM (
  SELECT '<node id="n' || id || '"><data key="x">' || printf('%.6f', x) || '</data><data key="y">' || printf('%.6f', y) || '</data></node>' AS l FROM node
  UNION ALL SELECT '<edge source="n' || u || '" target="n' || v || '"><data key="freq">' || frequency || '</data><data key="len">' || printf('%.3f', length) || '</data><data key="rclass"></data><data key="recon">0</data><data key="ndev">0</data></edge>' FROM edge)""")
def graphml_lines(spark, sf_dir):
    nodes, edges = streets(spark, sf_dir)
    lines = sinks.graphml_lines(nodes, edges).where("part in (1, 2)")
    return lines.agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("letters"))


# ---- whole runs and streams


def road_rows(edges: DataFrame) -> DataFrame:
    return edges.select("edge", "u", "v", F.size("coords").alias("points"), F.round("length", 3).alias("length"), "frequency", "road_class", "reconstructed", "n_devices")


@query()
def infer_roads_slide(spark, sf_dir):
    p = Params(eps_mode="percentile", eps_percentile=50.0, spur_min_m=30.0, smooth_iters=1)
    return road_rows(build_roads(fixes(spark, sf_dir), p).edges)


@query()
def infer_roads_kde(spark, sf_dir):
    p = Params(method="kde", cell_tau=10.0, kde_radius=15.0, gap_buffer_m=10.0, eps_mode="percentile", eps_percentile=60.0, fill_holes_m=30.0, loop_min_m=40.0, edge_f_min=1, edge_l_min=50.0, smooth_iters=2)
    return road_rows(build_roads(fixes(spark, sf_dir), p).edges)


def streamed(spark, sf_dir, make, mode="append") -> DataFrame:
    """All that a stream of the events has given when they are through."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(table).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = make(from_events(source))
    out.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query(f"WITH {FIXES} SELECT {FIX} FROM u")
def stream_deduplicate(spark, sf_dir):
    return fix_rows(streamed(spark, sf_dir, streaming.deduplicated))


@query(SQL["thin_greedy"])
def stream_thin(spark, sf_dir):
    return fix_rows(streamed(spark, sf_dir, lambda s: streaming.thinned(streaming.deduplicated(s))))


# ---- sources and checkpoints


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {FIXES} SELECT device, us // 1000000 * 1000000 AS time_us, round(lat, 7) AS lat, round(lon, 7) AS lon FROM fixes")
def read_delimited(spark, sf_dir):
    at = scratch(spark, "csv")
    raw = fixes(spark, sf_dir).select(F.col("device").alias("device_id"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("navigation_dttm"), "lat", "lon")
    raw.write.option("header", True).option("sep", ";").csv(f"{at}/2024-01")
    paths = [r["path"] for r in tables.list_files(spark, at).collect()]
    return fix_rows(tables.load(spark, paths))


@query(f"WITH {FIXES}{FLAT}{STREETS} SELECT CAST(edge AS VARCHAR) AS line, CAST(2 AS BIGINT) AS points, round(x1 / 100 + x2 / 100, 6) AS x, round(y1 / 100 + y2 / 100, 6) AS y FROM edge")
def geojson_roundtrip(spark, sf_dir):
    edges = streets(spark, sf_dir)[1].withColumn("coords", F.transform("coords", lambda p: polyline.point(p["x"] / 100, p["y"] / 100)))
    at = scratch(spark, "geojson")
    sinks.write_geojson(graph.features(edges), at)
    return tables.read_geojson(spark, [at]).groupBy(F.col("device").alias("line")).agg(F.count("*").alias("points"), F.round(F.sum("lon"), 6).alias("x"), F.round(F.sum("lat"), 6).alias("y"))


@query(f"WITH {FIXES}{TRACKS} SELECT track_id, count(*) AS points, round(sum(x), 2) AS x FROM tracks GROUP BY 1")
def checkpoint_roundtrip(spark, sf_dir):
    at = scratch(spark, "tracks")
    sinks.save_tracks(flat_tracks(spark, sf_dir), at, "plane")
    return tables.load_tracks(spark, at).groupBy("track_id").agg(F.count("*").alias("points"), F.round(F.sum("x"), 2).alias("x"))


@query(f"WITH {FIXES} SELECT count(*) FILTER (lat BETWEEN -90 AND 90) AS lat_ok, count(*) FILTER (lon BETWEEN -180 AND 180) AS lon_ok FROM fixes")
def valid_ranges(spark, sf_dir):
    return fixes(spark, sf_dir).agg(F.count(F.when(geo.valid_lat("lat"), 1)).alias("lat_ok"), F.count(F.when(geo.valid_lon("lon"), 1)).alias("lon_ok"))
