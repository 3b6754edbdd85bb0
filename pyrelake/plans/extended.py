"""More registered queries: listings, details, recovery, polygons, small reports. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..operators import episodes as E
from ..operators import fires as O
from ..operators import listing as L
from ..operators import monitoring as M
from ..operators import regions as R
from ..operators import spatial
from ..sources.adapters import load, table
from .queries import AS_OF, CROSS, INSIDE, both, distance, fires_query, query

crossings = lambda s, d: spatial.crossing(*both(s, d))

# Events.
fires_query("fires_search_slim", "SELECT id, province, department, start_date, coalesce(status, 'unknown') AS status, avg_confidence AS quality_score FROM fires")(L.search_items)
fires_query("fires_filter_department", "SELECT id FROM fires WHERE department ILIKE '%ñ2%' AND is_significant")(lambda f: O.Filters(AS_OF, department="ñ2", significant=True).apply(f).select("id"))
fires_query("fires_filter_provinces", "SELECT id FROM fires WHERE province IN ('NATION_2', 'NATION_7') AND total_detections >= 2")(lambda f: O.Filters(AS_OF, provinces=("NATION_2", "NATION_7"), min_detections=2).apply(f).select("id"))
fires_query("fires_home", "SELECT id FROM fires WHERE json_array_length(slides_data) > 0 AND (status IN ('active', 'monitoring') OR (status IS NULL AND coalesce(last_seen_at, end_date, start_date) >= TIMESTAMP '2001-08-11') OR ((status = 'extinct' OR (status IS NULL AND coalesce(last_seen_at, end_date, start_date) < TIMESTAMP '2001-08-11')) AND coalesce(extinct_at, last_seen_at, end_date) >= TIMESTAMP '2001-07-12'))")(lambda f: L.home_events(f, AS_OF).select("id"))
fires_query("page_meta", "SELECT n AS total, ceil(n / 20.0)::BIGINT AS total_pages, 3 < ceil(n / 20.0) AS has_next, true AS has_prev FROM (SELECT count(*) AS n FROM fires)")(lambda f: L.page_meta(f, 3, 20))
fires_query("province_list", "SELECT province, count(*) AS n FROM fires GROUP BY 1")(L.provinces)
fires_query("chart_top_provinces", "SELECT province, count(*) AS n FROM fires WHERE province IS NOT NULL GROUP BY 1 ORDER BY n DESC, province LIMIT 8")(lambda f: O.by_province(f.filter("province IS NOT NULL")).orderBy(F.desc("n"), "province").limit(8).select("province", "n"))
fires_query("area_stats", "SELECT count(estimated_area_hectares) AS n, round(avg(estimated_area_hectares) + 1e-7, 2) AS mean, round(min(estimated_area_hectares), 2) AS low, round(max(estimated_area_hectares), 2) AS high FROM fires")(
    lambda f: f.agg(F.count("estimated_area_hectares").alias("n"), F.round(F.avg("estimated_area_hectares") + 1e-7, 2).alias("mean"), F.round(F.min("estimated_area_hectares"), 2).alias("low"), F.round(F.max("estimated_area_hectares"), 2).alias("high"))
)
fires_query("recurrence_cell_count", "SELECT count(DISTINCT (floor((lat + 90) / 0.5)::BIGINT * 1000000 + floor((lon + 180) / 0.5)::BIGINT)) AS n FROM fires WHERE lon BETWEEN -70 AND -56 AND lat BETWEEN -50 AND -30")(lambda f: O.cell_count(f, (-70, -50, -56, -30)))
fires_query("event_timeline", """SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS dates FROM (SELECT id, list_transform([d - INTERVAL 12 MONTH, d - INTERVAL 6 MONTH, d, e, e + INTERVAL 3 MONTH, e + INTERVAL 6 MONTH, e + INTERVAL 12 MONTH, e + INTERVAL 24 MONTH], lambda x: x::DATE::VARCHAR) AS l
 FROM (SELECT id, start_date::DATE AS d, coalesce(end_date::DATE, start_date::DATE) AS e FROM fires))""")(L.timeline)
fires_query("event_preview", """SELECT id, floor((lon - 0.01) * 10000 + 0.5) / 10000 AS west, floor((lat - 0.01) * 10000 + 0.5) / 10000 AS south, floor((lon + 0.01) * 10000 + 0.5) / 10000 AS east, floor((lat + 0.01) * 10000 + 0.5) / 10000 AS north,
 coalesce(greatest(1, ceil(epoch(end_date - start_date) / 86400)), 1)::INT AS duration_days, concat('{"type":"Point","coordinates":[', round(lon, 4)::DOUBLE, ',', round(lat, 4)::DOUBLE, ']}') AS geojson FROM fires""")(L.preview)
fires_query("date_rules", """SELECT id, (d + INTERVAL 1 MONTH)::DATE::VARCHAR AS clamped, CASE WHEN day(d) > day(last_day((date_trunc('month', d) + INTERVAL 1 MONTH)::DATE)) THEN concat(strftime(date_trunc('month', d) + INTERVAL 1 MONTH, '%Y-%m'), '-28') ELSE (d + INTERVAL 1 MONTH)::DATE::VARCHAR END AS overflow28,
 (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE::VARCHAR AS next_month, (d + 1)::DATE::VARCHAR AS next_day FROM (SELECT id, start_date::DATE AS d FROM fires)""")(L.anniversaries)
fires_query("heat_colours", "SELECT id, CASE WHEN x > 0.8 THEN 'very_high' WHEN x > 0.6 THEN 'high' WHEN x > 0.4 THEN 'medium' WHEN x > 0.2 THEN 'low' ELSE 'very_low' END AS colour FROM (SELECT id, least(1.0, coalesce(max_frp, 0) / 100) AS x FROM fires)")(
    lambda f: f.select("id", scoring.heat(F.least(F.lit(1.0), F.coalesce("max_frp", F.lit(0.0)) / 100)).alias("colour"))
)
fires_query("match_score", """SELECT id, floor((0.4::DOUBLE * (1 - least(d / 5000, 1.0)) + 0.3::DOUBLE * least(total_detections / (7 * 24.0), 1.0) + 0.2::DOUBLE * least(coalesce(max_frp, 0.0) / 100, 1.0) + 0.1::DOUBLE * least(total_detections / 50.0, 1.0)) * 1e6 + 0.5) AS score_e6
 FROM (SELECT *, (id % 100) * 100.0::DOUBLE AS d FROM fires)""")(lambda f: f.select("id", F.floor(scoring.match((F.col("id") % 100) * 100.0, F.col("total_detections"), F.col("max_frp"), F.col("total_detections"), 5000.0, 7.0) * 1e6 + 0.5).cast("double").alias("score_e6")))
fires_query("radius_boxes", "SELECT id, floor(lat * 1e4 - m + 0.5)::BIGINT AS south, floor(lat * 1e4 + m + 0.5)::BIGINT AS north, floor(lon * 1e4 - m / greatest(cos(radians(lat)), 1e-6) + 0.5)::BIGINT AS west, floor(lon * 1e4 + m / greatest(cos(radians(lat)), 1e-6) + 0.5)::BIGINT AS east FROM (SELECT id, lat, lon, 2500 / 111000.0::DOUBLE * 1e4 AS m FROM fires)")(
    lambda f: f.select("id", *[F.floor(c * 1 + 0.5).cast("long").alias(n) for n, c in geo.radius_box(F.col("lat"), F.col("lon"), 2500.0)])
)

# Events, areas, scenes.
query("fires_flags", f"SELECT id, EXISTS (SELECT 1 FROM scenes WHERE event_id = f.id) AS has_imagery, EXISTS (SELECT 1 FROM areas WHERE {INSIDE}) AS in_protected_area FROM fires f", "fires", "areas", "scenes")(lambda s, d: L.flags(load(s, d, "fires"), crossings(s, d), load(s, d, "scenes")))
query("fires_detail", f"SELECT f.id, f.province, f.total_detections, f.max_frp, coalesce(string_agg(official_name, ',' ORDER BY official_name), '') AS areas, count(c.area_id)::INT AS n_areas, max(overlap) AS max_overlap FROM fires f LEFT JOIN ({CROSS}) c ON f.id = c.id LEFT JOIN areas a ON a.area_id = c.area_id GROUP BY 1, 2, 3, 4", "fires", "areas")(
    lambda s, d: L.details(load(s, d, "fires"), crossings(s, d), load(s, d, "areas"))
)
query("detail_detections_500", "SELECT user_id, id, k::INT AS place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY detected_at DESC, id) AS k FROM detections) WHERE k <= 500", "detections")(lambda s, d: L.top_detections(load(s, d, "detections"), "user_id", 500))
query("stats_in_protected", f"SELECT count(DISTINCT f.id) AS n FROM fires f JOIN areas ON {INSIDE}", "fires", "areas")(lambda s, d: crossings(s, d).filter("overlap = 100").agg(F.countDistinct("id").alias("n")))
query("area_fire_windows", f"SELECT area_id, count(*) AS n, min(start_date) AS first, max(start_date) AS last FROM ({CROSS}) c JOIN fires f ON f.id = c.id GROUP BY 1", "fires", "areas")(lambda s, d: M.area_windows(crossings(s, d), load(s, d, "fires")))
query("fires_search_areas", f"SELECT id FROM fires f WHERE lower(province) LIKE '%a_1%' OR EXISTS (SELECT 1 FROM areas WHERE {INSIDE} AND lower(official_name) LIKE '%a_1%')".replace("a_1", "a\\_1").replace("LIKE '%a\\_1%'", "LIKE '%a\\_1%' ESCAPE '\\'"), "fires", "areas")(
    lambda s, d: O.search_with_areas(load(s, d, "fires"), crossings(s, d), load(s, d, "areas"), " A_1 ").select("id")
)
query("scene_stats", "SELECT event_id, count(*) AS n, min(cloud_cover) AS low, max(cloud_cover) AS high, round(avg(cloud_cover) + 1e-7, 4) AS mean, round(stddev_pop(cloud_cover) + 1e-7, 4) AS deviation FROM scenes GROUP BY 1", "scenes")(lambda s, d: M.scene_stats(load(s, d, "scenes")))
query("clear_scenes", "SELECT event_id, scene_id, acquired_on, cloud_cover, CASE WHEN cloud_cover <= 10 THEN 'excellent' WHEN cloud_cover <= 20 THEN 'good' WHEN cloud_cover <= 30 THEN 'fair' WHEN cloud_cover <= 50 THEN 'poor' ELSE 'unusable' END AS quality FROM scenes WHERE acquired_on BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND cloud_cover < 20", "scenes")(
    lambda s, d: M.clear_scenes(load(s, d, "scenes"), "1996-01-01", "1996-12-31")
)
SLOTS = "(VALUES ('post', 1, 0, 14, 7), ('pre', 1, -15, -7, -10), ('pre', 2, -30, -15, -22)) v(side, tier, low, high, target)"
query("closure_images", f"""SELECT event_id, side, tier::INT AS tier, gap::INT AS gap, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY tier, gap, scene_id) AS p FROM (SELECT event_id, side, tier, abs(k - target) AS gap, scene_id FROM
 (SELECT s.event_id, s.scene_id, v.*, date_diff('day', CASE WHEN side = 'post' THEN f.extinct_at::DATE ELSE f.start_date::DATE END, s.acquired_on) AS k FROM scenes s JOIN fires f ON s.event_id = f.id AND f.extinct_at IS NOT NULL AND s.cloud_cover < 20, {SLOTS}) WHERE k BETWEEN low AND high)) WHERE p = 1""", "fires", "scenes")(lambda s, d: M.closure_images(load(s, d, "fires"), load(s, d, "scenes")))
OBSERVED = """(SELECT *, ((year(acquired_on) - year(b)) * 12 + month(acquired_on) - month(b))::DOUBLE AS m, round(CASE WHEN base <= 0 THEN CASE WHEN ndvi > 0.4 THEN 100.0 ELSE 0.0 END ELSE greatest(0.0, least(100.0, ndvi / base * 100)) END, 4)::DOUBLE AS p FROM
 (SELECT *, first(ndvi) OVER w AS base, first(acquired_on) OVER w AS b, row_number() OVER w - 1 AS x FROM (SELECT *, (nir - red) / (nir + red) AS ndvi FROM scenes) WINDOW w AS (PARTITION BY event_id ORDER BY acquired_on, scene_id, nir, red)))"""
EXPECTED = "(CASE WHEN m <= 0 THEN 0 WHEN m <= 3 THEN m / 3 * 0.15 WHEN m <= 6 THEN 0.15 + (m - 3) / 3 * 0.15 WHEN m <= 12 THEN 0.3 + (m - 6) / 6 * 0.2 WHEN m <= 24 THEN 0.5 + (m - 12) / 12 * 0.2 WHEN m <= 36 THEN 0.7 + (m - 24) / 12 * 0.15 ELSE 0.85 END)"
KIND = f"CASE WHEN m > 12 AND p < 20 THEN 'no_recovery' WHEN ndvi < base * 0.3 THEN 'sudden_drop' WHEN m < 6 AND p > 80 THEN 'rapid_greening' WHEN p < {EXPECTED} * 50 THEN 'no_recovery' ELSE 'none' END"
query("recovery_anomalies", f"SELECT event_id, scene_id, {KIND} AS kind, (CASE WHEN m > 12 AND p < 20 THEN 0.8 WHEN ndvi < base * 0.3 THEN 0.9 WHEN m < 6 AND p > 80 THEN 0.7 WHEN p < {EXPECTED} * 50 THEN 0.6 ELSE 0.0 END)::DOUBLE AS confidence FROM {OBSERVED}", "scenes")(lambda s, d: M.anomalies(load(s, d, "scenes")))
query("recovery_summary", f"SELECT CASE WHEN k = 'no_recovery' THEN 'suspicious' WHEN p >= 90 THEN 'excellent' WHEN p >= 70 THEN 'good' WHEN p >= 50 THEN 'moderate' WHEN p >= 25 THEN 'poor' ELSE 'critical' END AS status, count(*) AS n FROM (SELECT *, {KIND} AS k, row_number() OVER (PARTITION BY event_id ORDER BY acquired_on DESC, scene_id DESC, nir DESC, red DESC) AS z FROM {OBSERVED}) WHERE z = 1 GROUP BY 1", "scenes")(
    lambda s, d: M.recovery_summary(load(s, d, "scenes"))
)
query("recovery_trend", f"SELECT event_id, CASE WHEN n < 2 THEN 'unknown' WHEN r > 5 THEN 'improving' WHEN r < -5 THEN 'declining' ELSE 'stagnant' END AS trend, round(CASE WHEN n < 2 THEN 0.0 WHEN abs(r) > 5 THEN least(0.9, 0.5 + abs(r) / 20) ELSE 0.6 END, 3)::DOUBLE AS confidence FROM (SELECT event_id, count(*) AS n, floor(regr_slope(p, x) * 1e6 + 0.5) / 1e6 AS r FROM {OBSERVED} GROUP BY 1)", "scenes")(
    lambda s, d: M.recovery_trend(load(s, d, "scenes"))
)
query("land_use_changes", f"SELECT event_id, scene_id, CASE WHEN ndvi < 0.1 AND m > 12 THEN 'construction' WHEN ndvi < 0.2 AND m > 18 THEN 'bare_soil' WHEN m < 6 AND q > 1.2 THEN 'agriculture' WHEN q > {EXPECTED} * 0.7 THEN 'natural_recovery' ELSE 'uncertain' END AS change FROM (SELECT *, ndvi / greatest(base, 0.1) AS q FROM {OBSERVED})", "scenes")(
    lambda s, d: M.land_uses(load(s, d, "scenes"))
)

# Episodes.
EPISODES = """(SELECT concat(site_id, '-', strftime(start_date, '%Y-%m')) AS episode_id, count(*) AS n_events, max(end_date) AS end_date, sum(total_detections)::BIGINT AS detections, min(lat) AS south, max(lat) AS north, list(DISTINCT province) FILTER (province IS NOT NULL) AS provinces,
 coalesce(bool_or(status = 'active'), false) AS a FROM fires GROUP BY 1)"""
ITEMS = f"""(SELECT episode_id, CASE WHEN a THEN 'active' WHEN date_diff('day', end_date::DATE, DATE '2001-08-11') < 15 THEN 'monitoring' ELSE 'extinct' END AS status, n_events, detections, end_date, date_diff('day', end_date::DATE, DATE '2001-08-11')::INT AS recent_days,
 coalesce(date_diff('day', end_date::DATE, DATE '2001-08-11') <= 60, false) AS is_recent, concat_ws(',', floor(round(south, 6) * 100)::BIGINT, floor(round(north, 6) * 100)::BIGINT) AS box FROM {EPISODES})"""
items = lambda f: L.episode_items(E.metrics(f), E.status(f, AS_OF), AS_OF)
fires_query("episode_items", f"SELECT * FROM {ITEMS}")(items)
fires_query("episodes_recent_page", f"SELECT * FROM {ITEMS} ORDER BY end_date DESC NULLS LAST, episode_id LIMIT 20")(lambda f: O.page(items(f), [F.desc_nulls_last("end_date"), F.col("episode_id")], 1, 20))
fires_query("episodes_home", f"SELECT * FROM {ITEMS} WHERE status IN ('active', 'monitoring') OR is_recent ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'monitoring' THEN 1 ELSE 2 END, detections DESC NULLS LAST, end_date DESC NULLS LAST, episode_id LIMIT 20")(lambda f: L.home_episodes(items(f)))
fires_query("episode_histogram", f"SELECT status, count(*) AS n, count(*) FILTER (detections >= 10) AS candidates FROM {ITEMS} GROUP BY 1")(lambda f: items(f).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("detections") >= 10).alias("candidates")))
fires_query("province_names", "SELECT DISTINCT province FROM fires WHERE province IS NOT NULL")(lambda f: L.province_names(f, E.metrics(f)))
fires_query("province_distribution", f"SELECT province, count(*) AS n FROM (SELECT unnest(CASE WHEN provinces IS NULL THEN [''] ELSE provinces END) AS province FROM {EPISODES}) GROUP BY 1")(lambda f: L.province_distribution(E.metrics(f)))
LINKS = "SELECT l_orderkey AS event_id, l_partkey AS episode_id, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS added_at FROM lineitem"
query("bridge_unique", f"SELECT event_id, episode_id FROM (SELECT event_id, episode_id, row_number() OVER (PARTITION BY event_id ORDER BY added_at DESC NULLS LAST, episode_id) AS k FROM ({LINKS})) WHERE k = 1")(
    lambda s, d: L.bridge(table(s, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("episode_id"), F.when(F.col("l_linenumber") != 3, F.col("l_shipdate").cast("date")).alias("added_at")))
)

# Polygons: one five-sided, dented region for each of nine nations.
CORNERS = ((0.0, 0.0), (6.0, 1.0), (5.0, 7.0), (3.0, 3.0), (-1.0, 6.0))
SIDES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True))
RINGS = f"sides AS (SELECT n_name AS name, n_nationkey, -72 + n_nationkey % 3 * 6 + x1 AS x1, -52 + n_nationkey // 3 * 9 + y1 AS y1, -72 + n_nationkey % 3 * 6 + x2 AS x2, -52 + n_nationkey // 3 * 9 + y2 AS y2 FROM nation, (VALUES {SIDES}) v(x1, y1, x2, y2) WHERE n_nationkey < 9)"
CAST = "SELECT f.id, f.province, s.name FROM fires f JOIN sides s ON (s.y1 > f.lat) <> (s.y2 > f.lat) AND f.lon < (s.x2 - s.x1) * (f.lat - s.y1) / (s.y2 - s.y1) + s.x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1"


def regions(s, d):
    nation = table(s, d, "nation").filter("n_nationkey < 9")
    x, y = F.col("n_nationkey") % 3 * 6 - 72, F.floor(F.col("n_nationkey") / 3) * 9 - 52
    return nation.select(F.col("n_name").alias("name"), F.array(*[F.struct((x + a).cast("double").alias("lon"), (y + b).cast("double").alias("lat")) for a, b in CORNERS]).alias("ring"))


query("fires_in_regions", f", {RINGS} SELECT id, name FROM ({CAST})", "fires")(lambda s, d: R.inside(load(s, d, "fires"), regions(s, d)))
query("province_enrichment", f", {RINGS} SELECT f.id, coalesce(f.province, c.name) AS province FROM fires f LEFT JOIN (SELECT id, min(name) AS name FROM ({CAST}) GROUP BY 1) c ON f.id = c.id", "fires")(lambda s, d: R.with_province(load(s, d, "fires"), regions(s, d)).select("id", "province"))
CLIP = """greatest(coalesce(least((west - x1) / nullif(x2 - x1, 0), (east - x1) / nullif(x2 - x1, 0)), CASE WHEN x1 BETWEEN west AND east THEN 0 ELSE 2 END), coalesce(least((south - y1) / nullif(y2 - y1, 0), (north - y1) / nullif(y2 - y1, 0)), CASE WHEN y1 BETWEEN south AND north THEN 0 ELSE 2 END), 0)
 <= least(coalesce(greatest((west - x1) / nullif(x2 - x1, 0), (east - x1) / nullif(x2 - x1, 0)), 1), coalesce(greatest((south - y1) / nullif(y2 - y1, 0), (north - y1) / nullif(y2 - y1, 0)), 1), 1)"""
query("areas_meet_regions", f", {RINGS} SELECT DISTINCT area_id AS id, name FROM areas JOIN sides ON {CLIP} UNION SELECT area_id, name FROM areas JOIN sides ON (y1 > south) <> (y2 > south) AND west < (x2 - x1) * (south - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1", "areas")(
    lambda s, d: R.meeting(load(s, d, "areas").withColumnRenamed("area_id", "id"), regions(s, d))
)

# Detections, requests, jobs.
query("propagation", f"""SELECT id, place::INT AS place, CASE WHEN a IS NULL THEN NULL ELSE floor({distance('a', 'b', 'lat', 'lon')} / 10 + 0.5) END AS step_10m FROM (SELECT *, row_number() OVER w AS place, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM detections WINDOW w AS (PARTITION BY user_id ORDER BY detected_at, id))""", "detections")(
    lambda s, d: load(s, d, "detections").selectExpr("id", "lat", "lon", *[f"{e} OVER (PARTITION BY user_id ORDER BY detected_at, id) AS {n}" for e, n in (("row_number()", "place"), ("lag(lat)", "a"), ("lag(lon)", "b"))]).select("id", "place", F.floor(geo.haversine(F.col("a"), F.col("b"), F.col("lat"), F.col("lon")) / 10 + 0.5).cast("double").alias("step_10m"))
)
query("detections_history_filter", "SELECT id FROM detections WHERE lat BETWEEN -55 AND -21 AND lon BETWEEN -73 AND -53 AND confidence >= 80", "detections")(lambda s, d: load(s, d, "detections").filter(geo.in_box(F.col("lat"), F.col("lon"), -73, -55, -53, -21) & (F.col("confidence") >= 80)).select("id"))
query("job_progress", "SELECT l_orderkey AS job_id, count(*) AS n, count(*) FILTER (l_linestatus = 'F') * 100 // count(*) AS progress, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1")(
    lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(l_linestatus = 'F') * 100 div count(1)").alias("progress"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
)
query("storage_usage", "SELECT regexp_extract(url, '^[a-z]+://[^/]+') AS prefix, count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")(
    lambda s, d: table(s, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("html")).alias("chars"))
)
query("daily_quota", "SELECT user_id, ts::DATE AS day, count(*) AS n, CASE WHEN user_id % 10 = 0 THEN 'admin' WHEN user_id % 2 = 0 THEN 'user' ELSE 'anonymous' END AS tier, count(*) > CASE WHEN user_id % 10 = 0 THEN 1000000000 WHEN user_id % 2 = 0 THEN 5 ELSE 2 END AS blocked FROM events GROUP BY 1, 2")(
    lambda s, d: table(s, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("tier", F.when(F.col("user_id") % 10 == 0, "admin").when(F.col("user_id") % 2 == 0, "user").otherwise("anonymous")).withColumn("blocked", F.col("n") > F.when(F.col("tier") == "admin", 10**9).when(F.col("tier") == "user", 5).otherwise(2))
)
BODY = """concat('{"id":', event_id, ',"kind":"', event_type, '"}')"""
query("request_hashes", f"SELECT event_id, sha256({BODY} || 'pepper') AS h, event_type AS kind FROM events")(
    lambda s, d: table(s, d, "events").withColumn("body", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))).select("event_id", F.sha2(F.concat("body", F.lit("pepper")), 256).alias("h"), F.get_json_object("body", "$.kind").alias("kind"))
)
CATEGORY = "CASE area_id % 6 WHEN 0 THEN ' Parque Nacional' WHEN 1 THEN 'reserva provincial ' WHEN 2 THEN 'SITIO RAMSAR' WHEN 3 THEN 'otra' WHEN 4 THEN NULL ELSE 'Patrimonio Mundial' END"
query("area_categories", f"SELECT area_id, category, CASE WHEN category IN ('national_park', 'world_heritage') THEN 60 ELSE 30 END AS years FROM (SELECT area_id, CASE area_id % 6 WHEN 0 THEN 'national_park' WHEN 1 THEN 'provincial_reserve' WHEN 2 THEN 'ramsar_site' WHEN 5 THEN 'world_heritage' ELSE 'other' END AS category FROM areas)", "areas")(
    lambda s, d: load(s, d, "areas").select("area_id", scoring.area_category(F.expr(CATEGORY)).alias("category")).withColumn("years", scoring.prohibition_years(F.col("category")))
)
query("quotes", "SELECT n, (least(n, 12) * 2.50)::DOUBLE AS price FROM (SELECT DISTINCT p_size AS n FROM part)")(lambda s, d: table(s, d, "part").select(F.col("p_size").alias("n")).distinct().select("n", (F.least("n", F.lit(12)) * 2.5).alias("price")))
