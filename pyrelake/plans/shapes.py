"""Queries over extents, polygons and hulls, and trends as served, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fires as O
from ..operators import geometry, increments
from ..sources.adapters import load
from .queries import distance, query
from .stateful import BRIDGE

# Events near episodes: three distances.

EPISODES_SQL = f""",
bridge AS ({BRIDGE.format(fires="fires")}),
episodes AS (
    SELECT episode_id, min(start_date) AS from_date, max(end_date) AS to_date, round(avg(lat) + 1e-9, 6) AS centre_lat, round(avg(lon) + 1e-9, 6) AS centre_lon,
        round(min(lat) + 1e-9, 6) AS south, round(max(lat) + 1e-9, 6) AS north, round(min(lon) + 1e-9, 6) AS west, round(max(lon) + 1e-9, 6) AS east
    FROM bridge JOIN fires ON id = event_id WHERE status IS DISTINCT FROM 'false_positive' GROUP BY episode_id
), pairs AS (
    SELECT f.*, e.*, 500 / 111320.0::DOUBLE AS dy, 500 / 111320.0::DOUBLE / greatest(cos(radians(f.lat)), 0.1) AS dx
    FROM fires f JOIN episodes e ON f.lat BETWEEN e.south - 0.1 AND e.north + 0.1 AND f.lon BETWEEN e.west - 0.2 AND e.east + 0.2
    WHERE f.start_date <= e.to_date + INTERVAL 72 HOUR AND f.end_date >= e.from_date - INTERVAL 72 HOUR
)
SELECT id, episode_id, round(d, 3) AS distance FROM (SELECT id, episode_id, #D# AS d FROM pairs) WHERE d <= 2000
"""
CENTRE = distance("lat", "lon", "centre_lat", "centre_lon")
DISTANCES = {"centroid": CENTRE, "buffer": f"greatest({CENTRE} - 500, 0.0)", "box": distance("lat", "lon", "greatest(south - dy, least(north + dy, lat))", "greatest(west - dx, least(east + dx, lon))")}


def near_query(mode: str):
    def near(spark, sf_dir):
        fires = load(spark, sf_dir, "fires")
        episodes = increments.episode_metrics(fires, spark.sql(BRIDGE, fires=fires))
        rows = geometry.near_extents(fires, episodes, 2000.0, 72, mode, 0.0 if mode == "centroid" else 500.0)
        return rows.select("id", "episode_id", F.round("distance", 3).alias("distance"))

    query(f"near_episodes_{mode}", EPISODES_SQL.replace("#D#", DISTANCES[mode]), "fires")(near)


for mode in DISTANCES:
    near_query(mode)


# Areas with a hole and a second part.

RINGS = (
    (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north")),
    (("west + 0.2", "south + 0.2"), ("west + 0.4", "south + 0.2"), ("west + 0.4", "north - 0.2"), ("west + 0.2", "north - 0.2")),
    (("east + 0.1", "south"), ("east + 0.3", "south"), ("east + 0.2", "north")),
)
SIGNS = (1, -1, 1)


def polygons(spark, sf_dir):
    corner = lambda c: f"named_struct('lon', CAST({c[0]} AS DOUBLE), 'lat', CAST({c[1]} AS DOUBLE))"
    rings = ", ".join(f"array({', '.join(map(corner, r))})" for r in RINGS)
    return load(spark, sf_dir, "areas").selectExpr("area_id", f"array({rings}) AS rings", f"array{SIGNS} AS signs")


SIDES_SQL = ", ".join(f"{{'ring': {k}, 'px': {p[0]}, 'py': {p[1]}, 'qx': {q[0]}, 'qy': {q[1]}}}" for k, r in enumerate(RINGS) for p, q in zip(r, (*r[1:], r[0]), strict=True))
METRES = "(6371000.0 * pi() / 180)"
NEAR_SQL = f""",
sides AS (SELECT area_id, unnest([{SIDES_SQL}], recursive := true) FROM areas),
local AS (
    SELECT f.id, s.area_id, f.lat, f.lon, px, py, qx, qy,
        (px - f.lon) * cos(radians(f.lat)) * {METRES} AS x, (py - f.lat) * {METRES} AS y, (qx - px) * cos(radians(f.lat)) * {METRES} AS dx, (qy - py) * {METRES} AS dy
    FROM fires f JOIN areas a ON f.lat BETWEEN a.south - 0.1 AND a.north + 0.1 AND f.lon BETWEEN a.west - 0.2 AND a.east + 0.5 JOIN sides s ON s.area_id = a.area_id
), measured AS (
    SELECT *, greatest(0.0, least(1.0, -(x * dx + y * dy) / (dx * dx + dy * dy))) AS t FROM local
), summed AS (
    SELECT id, area_id, count(*) FILTER ((py > lat) <> (qy > lat) AND lon < (qx - px) * (lat - py) / (qy - py) + px) % 2 = 1 AS is_inside, min(sqrt(pow(x + t * dx, 2) + pow(y + t * dy, 2))) AS far
    FROM measured GROUP BY id, area_id
)
SELECT id, area_id, is_inside, CASE WHEN is_inside THEN 0.0 ELSE round(far, 3) END AS distance FROM summed WHERE is_inside OR far <= 5000
"""


@query("near_polygons", NEAR_SQL, "fires", "areas")
def near_polygons(spark, sf_dir):
    rows = geometry.near_polygons(load(spark, sf_dir, "fires"), polygons(spark, sf_dir))
    return rows.withColumn("distance", F.round("distance", 3))


# Transverse Mercator by its series, corner by corner.

PROJECT_SQL = """,
corners AS (SELECT area_id, ring, px AS lon, py AS lat, qx, qy, floor((west + 180) / 6) * 6 - 177 AS meridian FROM sides JOIN areas USING (area_id)),
doubled AS (SELECT area_id, ring, meridian, unnest([{'end': 'p', 'lon': lon, 'lat': lat}, {'end': 'q', 'lon': qx, 'lat': qy}], recursive := true), row_number() OVER () AS side FROM corners),
terms AS (
    SELECT *, radians(lat) AS phi, 0.006694379990141317::DOUBLE AS e2, 0.006739496742276435::DOUBLE AS second, radians(lon - meridian) * cos(radians(lat)) AS x,
        6378137.0 / sqrt(1 - 0.006694379990141317::DOUBLE * pow(sin(radians(lat)), 2)) AS n, pow(tan(radians(lat)), 2) AS t, 0.006739496742276435::DOUBLE * pow(cos(radians(lat)), 2) AS c
    FROM doubled
), flat AS (
    SELECT area_id, ring, side, "end", 0.9996 * n * (x + (1 - t + c) * pow(x, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * pow(x, 5) / 120) AS east,
        0.9996 * (6378137.0 * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * pow(e2, 3) / 256) * phi - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * phi)
            + (15 * e2 * e2 / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * phi) - 35 * pow(e2, 3) / 3072 * sin(6 * phi))
            + n * tan(phi) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * pow(x, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * pow(x, 6) / 720)) AS north
    FROM terms
), whole AS (
    SELECT p.area_id, p.ring, abs(sum(p.east * q.north - q.east * p.north)) / 2 / 1e4 AS hectares
    FROM flat p JOIN flat q ON p.side = q.side AND p."end" = 'p' AND q."end" = 'q' GROUP BY p.area_id, p.ring
)
SELECT area_id, round(sum(CASE WHEN ring = 1 THEN -hectares ELSE hectares END), 2) AS hectares FROM whole GROUP BY area_id
"""


@query("area_hectares", f", sides AS (SELECT area_id, unnest([{SIDES_SQL}], recursive := true) FROM areas)" + PROJECT_SQL, "areas")
def area_hectares(spark, sf_dir):
    return geometry.area_hectares(polygons(spark, sf_dir))


# Perimeters of detections by user and kind; an edge of a hull has no point to its right. Coordinates are whole 1e-4 degrees.

PERIMETER_SQL = """,
points AS (SELECT user_id * 7 + id % 7 AS event, round(lon * 10000)::BIGINT AS x, round(lat * 10000)::BIGINT AS y FROM detections),
counts AS (SELECT event, count(*) AS n FROM points GROUP BY event),
places AS (SELECT DISTINCT event, x, y FROM points),
sides AS (
    SELECT p.event, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy
    FROM places p JOIN places q ON p.event = q.event AND (p.x, p.y) <> (q.x, q.y) JOIN places r ON r.event = p.event
    GROUP BY ALL
    HAVING bool_and((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0
        OR ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND r.x BETWEEN least(p.x, q.x) AND greatest(p.x, q.x) AND r.y BETWEEN least(p.y, q.y) AND greatest(p.y, q.y)))
), shapes AS (
    SELECT event, count(*) AS corners, abs(sum(radians((qx - px) / 10000.0::DOUBLE) * (sin(radians(py / 10000.0::DOUBLE)) + sin(radians(qy / 10000.0::DOUBLE))))) * 6371007.2::DOUBLE * 6371007.2::DOUBLE / 2 / 1e4 AS hectares,
        max(#L#) AS length
    FROM sides GROUP BY event
)
SELECT event, n, CASE WHEN corners IS NULL AND n <> 2 THEN 'circle' WHEN coalesce(corners, 2) = 2 THEN 'strip' ELSE 'hull' END AS kind,
    round(CASE WHEN corners IS NULL AND n <> 2 THEN 16 * sin(pi() / 16) * 375 * 375 / 1e4 WHEN coalesce(corners, 2) = 2 THEN coalesce(length, 0) * 400 / 1e4 + 16 * sin(pi() / 16) * 200 * 200 / 1e4 ELSE hectares END, 2) AS hectares
FROM counts LEFT JOIN shapes USING (event)
""".replace("#L#", distance("py / 10000.0::DOUBLE", "px / 10000.0::DOUBLE", "qy / 10000.0::DOUBLE", "qx / 10000.0::DOUBLE"))


@query("perimeters", PERIMETER_SQL, "detections")
def perimeters(spark, sf_dir):
    points = load(spark, sf_dir, "detections").selectExpr("user_id * 7 + id % 7 AS event", "lon", "lat")
    return geometry.perimeters(points, "event")


# Trends as served.

TRENDS = {"trends_months": ("1996-03-15", "2000-07-04", (-70.0, -50.0, -56.0, -30.0)), "trends_days": ("1999-02-01", "1999-04-10", None)}


def trend_queries(name: str, since: str, until: str, box: tuple | None):
    unit = O.trend_granularity(since, until)
    inside = f" AND lon BETWEEN {box[0]} AND {box[2]} AND lat BETWEEN {box[1]} AND {box[3]}" if box else ""
    points = f""",
points AS (
    SELECT *, row_number() OVER (ORDER BY period) - 1 AS x FROM (
        SELECT date_trunc('{unit}', start_date)::DATE AS period, count(*) AS n, coalesce(sum(estimated_area_hectares), 0)::DOUBLE AS area
        FROM fires WHERE start_date >= TIMESTAMP '{since}' AND start_date <= TIMESTAMP '{until}'{inside} GROUP BY 1)
), rated AS (
    SELECT round(coalesce(regr_slope(n, x) / avg(n) * 100, 0), 2) AS rate, coalesce(regr_slope(n, x) / avg(n) * 100, 0) AS exact, coalesce(sum(n), 0)::BIGINT AS fires, coalesce(sum(area), 0) AS hectares, max(period) AS last_period, arg_max(n, x) AS last FROM points
)
"""
    summary = points + f"""SELECT CASE WHEN exact > 5 THEN 'increasing' WHEN exact < -5 THEN 'decreasing' ELSE 'stable' END AS direction, rate, round(rate * {12 if unit == "month" else 365}, 2) AS annual_rate, fires AS total_fires, round(hectares, 2) AS total_hectares FROM rated"""
    ahead = points + f"""SELECT (last_period + INTERVAL 1 {unit} * k)::DATE AS period, round(v, 2) AS n, round(v * (hectares / fires), 2) AS area, round(v * 0.8::DOUBLE, 2) AS low, round(v * 1.2::DOUBLE, 2) AS high
FROM (SELECT *, greatest(last + k * (rate / 100 * last), 0.0) AS v FROM rated, range(1, 4) t(k))"""
    rows = lambda spark, sf_dir: O.trend_series(load(spark, sf_dir, "fires"), since, until, box)
    query(f"{name}_summary", summary, "fires")(lambda spark, sf_dir: O.trend_summary(rows(spark, sf_dir), unit))
    query(f"{name}_next", ahead, "fires")(lambda spark, sf_dir: O.trend_next(rows(spark, sf_dir), unit))


for name, (since, until, box) in TRENDS.items():
    trend_queries(name, since, until, box)
