"""The registered queries over the domain tables and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import episodes as E
from ..operators import fires as O
from ..operators import ingest, spatial
from ..sources.adapters import load, oracle, table
from ..streaming import streams

AS_OF = "2001-08-11"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
HAVERSINE = "12742000.0 * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - ({a}))))"


def distance(lat1, lon1, lat2, lon2) -> str:
    return HAVERSINE.format(a=f"pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)")


def query(name: str, sql: str | None = None, *domain: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (oracle(*domain) + "\n" if domain else "") + sql
        return f

    return add


def fires_query(name: str, sql: str):
    """A query over the event table alone."""

    def add(f):
        QUERIES[name] = lambda spark, d: f(load(spark, d, "fires"))
        ORACLE_SQL[name] = oracle("fires") + "\n" + sql
        return f

    return add


ITEM = "SELECT id, province, coalesce(status, 'unknown') AS status, coalesce(date_diff('hour', start_date, end_date), 0)::DOUBLE AS duration_hours, coalesce(max_frp, 0.0) AS max_frp, coalesce(estimated_area_hectares, 0.0) AS area, total_detections FROM fires"
LIVE = "(coalesce(status IN ('active', 'monitoring'), coalesce(end_date, start_date) >= TIMESTAMP '2001-08-04'))"

fires_query("fires_list_page", ITEM + " ORDER BY start_date DESC, id LIMIT 20 OFFSET 20")(lambda f: O.page(f, [F.desc("start_date"), F.col("id")], 2, None).transform(O.items))
fires_query("fires_list_null_order", "SELECT id, estimated_area_hectares FROM fires ORDER BY estimated_area_hectares DESC NULLS FIRST, id LIMIT 100")(lambda f: O.page(f, [F.desc_nulls_first("estimated_area_hectares"), F.col("id")], 1, 500).select("id", "estimated_area_hectares"))
fires_query("fires_keyset_page", "SELECT id FROM fires WHERE start_date < TIMESTAMP '1999-01-01' OR (start_date = TIMESTAMP '1999-01-01' AND id > 30) ORDER BY start_date DESC, id LIMIT 50")(lambda f: O.keyset(f, "1999-01-01", 30, 50).select("id"))
fires_query("fires_items", ITEM)(O.items)
fires_query("fires_search_bbox", "SELECT id FROM fires WHERE lon > -70 AND lon < -60 AND lat > -40 AND lat < -30 AND avg_confidence >= 50 AND total_detections >= 3")(lambda f: O.Filters(AS_OF, box=(-70, -40, -60, -30), min_confidence=50, min_detections=3).apply(f).select("id"))
fires_query("fires_search_text", "SELECT id, province FROM fires WHERE (coalesce(lower(province) LIKE '%ñ1%', false) OR coalesce(lower(department) LIKE '%ñ1%', false)) AND start_date >= TIMESTAMP '1998-01-01' AND start_date < TIMESTAMP '1999-01-01'")(lambda f: O.Filters(AS_OF, search=" N1 ", date_from="1998-01-01", date_to="1998-12-31").apply(f).select("id", "province"))
fires_query("fires_status_active", f"SELECT id FROM fires WHERE {LIVE}")(lambda f: O.Filters(AS_OF, status="active").apply(f).select("id"))
fires_query("fires_status_historical", f"SELECT id FROM fires WHERE NOT {LIVE}")(lambda f: O.Filters(AS_OF, status="historical").apply(f).select("id"))
fires_query("stats_kpi", """SELECT count(*) AS total, count(*) FILTER (a) AS active, greatest(count(*) - count(*) FILTER (a), 0) AS historical,
 count(*) FILTER (is_significant) AS significant, coalesce(sum(total_detections), 0)::BIGINT AS detections, round(coalesce(sum(estimated_area_hectares), 0.0), 2) AS area,
 round(coalesce(avg(avg_confidence), 0.0), 4) AS confidence, round(coalesce(avg(estimated_area_hectares), 0.0), 4) AS mean_area, round(count(*) FILTER (a) * 100.0::DOUBLE / count(*), 4) AS active_share FROM
 (SELECT *, coalesce(status IN ('active', 'monitoring') OR (status IS NULL AND coalesce(last_seen_at, end_date, start_date) >= TIMESTAMP '2001-08-11'), false) AS a FROM fires)""")(lambda f: O.kpis(f, AS_OF))
fires_query("stats_median_area", "SELECT round(coalesce(quantile_cont(estimated_area_hectares, 0.5), 0.0), 4) AS median_area FROM fires")(O.median_area)
fires_query("stats_by_province", "SELECT coalesce(province, 'Unknown') AS province, count(*) AS n, max(start_date) AS latest FROM fires GROUP BY 1")(O.by_province)
fires_query("stats_by_month", "SELECT strftime(start_date, '%Y-%m') AS month, count(*) AS n FROM fires GROUP BY 1")(O.by_month)
fires_query("stats_top_frp", "SELECT id, max_frp, province FROM fires ORDER BY max_frp DESC NULLS LAST, id LIMIT 10")(O.strongest)
fires_query("stats_ytd", """SELECT current, previous, current - previous AS delta, round(CASE WHEN previous > 0 THEN (current - previous) * 100.0::DOUBLE / previous END, 2) AS delta_pct FROM
 (SELECT count(*) FILTER (start_date::DATE BETWEEN DATE '2001-01-01' AND DATE '2001-08-11') AS current, count(*) FILTER (start_date::DATE BETWEEN DATE '2000-01-01' AND DATE '2000-08-11') AS previous FROM fires)""")(lambda f: O.year_to_date(f, AS_OF))
STATS = "SELECT CAST({p} AS VARCHAR) AS stat_date, coalesce(province, 'Unknown') AS province, count(*) AS n, sum(total_detections)::BIGINT AS detections FROM fires WHERE start_date::DATE BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY 1, 2"
fires_query("public_stats_daily", STATS.format(p="start_date::DATE", a="1998-03-01", b="1998-04-30"))(lambda f: O.public_stats(f, "1998-03-01", "1998-04-30").withColumn("stat_date", F.col("stat_date").cast("string")))
fires_query("public_stats_monthly", STATS.format(p="date_trunc('month', start_date)::DATE", a="1998-01-01", b="1999-06-30"))(lambda f: O.public_stats(f, "1998-01-01", "1999-06-30").withColumn("stat_date", F.col("stat_date").cast("string")))
SERIES = "SELECT strftime(start_date, '%Y-%m') AS period, count(*) AS n, round(coalesce(sum(estimated_area_hectares), 0.0), 2) AS area, (row_number() OVER (ORDER BY strftime(start_date, '%Y-%m')) - 1)::INT AS x FROM fires GROUP BY 1"
RATE = f"(SELECT coalesce(regr_slope(n, x) / avg(n) * 100, 0.0) AS r, max_by(n, x) AS last FROM ({SERIES}))"
fires_query("trend_series", SERIES)(O.series)
fires_query("trend_direction", f"SELECT round(r, 2) AS rate, CASE WHEN r > 5 THEN 'increasing' WHEN r < -5 THEN 'decreasing' ELSE 'stable' END AS direction, last FROM {RATE}")(lambda f: O.direction(O.series(f)))
fires_query("trend_projection", f"SELECT k::INT AS ahead, round(v, 2) AS n, round(v * 0.8::DOUBLE, 2) AS low, round(v * 1.2::DOUBLE, 2) AS high FROM (SELECT k, greatest(last + k * (round(r, 2) / 100 * last), 0.0) AS v FROM {RATE}, range(1, 4) t(k))")(lambda f: O.projection(O.series(f)))
CELL = "(floor((lat + 90) / 0.5)::BIGINT * 1000000 + floor((lon + 180) / 0.5)::BIGINT)"
fires_query("recurrence_live", f"SELECT cell, n, max_frp, CASE WHEN n >= 5 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS class, round(least(n / 10, 1.0), 4)::DOUBLE AS score FROM (SELECT {CELL} AS cell, count(*) AS n, max(max_frp) AS max_frp FROM fires WHERE lon BETWEEN -70 AND -56 AND lat BETWEEN -50 AND -30 GROUP BY 1) ORDER BY least(n, 10) DESC, cell LIMIT 500")(lambda f: O.recurrence(f, (-70, -50, -56, -30)))
fires_query("recurrence_view", f"SELECT cell, n, n5, n1, CASE WHEN n5 > 3 THEN 'high' WHEN n5 >= 1 THEN 'medium' ELSE 'low' END AS class, round(least(n5 / 5, 1.0), 4)::DOUBLE AS score FROM (SELECT {CELL} AS cell, count(*) AS n, count(*) FILTER (start_date::DATE >= DATE '1996-08-11') AS n5, count(*) FILTER (start_date::DATE >= DATE '2000-08-11') AS n1 FROM fires GROUP BY 1)")(lambda f: O.recurrence_view(f, AS_OF))
fires_query("episode_metrics", """SELECT concat(site_id, '-', strftime(start_date, '%Y-%m')) AS episode_id, count(*) AS n_events, min(start_date) AS start_date, max(end_date) AS end_date, sum(total_detections)::BIGINT AS detections,
 coalesce(array_to_string(list_sort(list_distinct(list(province) FILTER (province IS NOT NULL))), ','), '') AS provinces, round(min(lat), 6) AS south, round(max(lat), 6) AS north, max(max_frp) AS max_frp, coalesce(bool_or(status IN ('active', 'monitoring')), false) AS live FROM fires GROUP BY 1""")(E.metrics)
fires_query("episode_representative", """SELECT episode_id, id FROM (SELECT concat(site_id, '-', strftime(start_date, '%Y-%m')) AS episode_id, id, row_number() OVER (PARTITION BY concat(site_id, '-', strftime(start_date, '%Y-%m'))
 ORDER BY CASE WHEN status IN ('active', 'monitoring') THEN 0 ELSE 1 END, end_date DESC NULLS LAST, start_date DESC NULLS LAST, id) AS k FROM fires) WHERE k = 1""")(E.representative)
fires_query("episode_status", """SELECT episode_id, CASE WHEN a THEN 'active' WHEN date_diff('day', l, DATE '2001-08-11') < 15 THEN 'monitoring' ELSE 'extinct' END AS status FROM
 (SELECT concat(site_id, '-', strftime(start_date, '%Y-%m')) AS episode_id, max(end_date)::DATE AS l, coalesce(bool_or(status = 'active'), false) AS a FROM fires GROUP BY 1)""")(lambda f: E.status(f, AS_OF))
fires_query("episode_priority", """SELECT episode_id, detections, row_number() OVER (ORDER BY detections DESC, episode_id)::INT AS priority_rank FROM (SELECT concat(site_id, '-', strftime(start_date, '%Y-%m')) AS episode_id, sum(total_detections)::BIGINT AS detections
 FROM fires GROUP BY 1 HAVING coalesce(bool_or(status IN ('active', 'monitoring')), false) AND sum(total_detections) >= 10) ORDER BY detections DESC, episode_id LIMIT 100""")(E.priority)
fires_query("candidate_profile", "SELECT min(n) AS low, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.95), 4) AS p95, max(n) AS high, round(count(*) FILTER (n > 3) * 1.0::DOUBLE / count(*), 4) AS share FROM (SELECT site_id, count(*) AS n FROM fires GROUP BY 1)")(
    lambda f: f.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("low"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.percentile("n", 0.95), 4).alias("p95"), F.max("n").alias("high"), F.round(F.count_if(F.col("n") > 3) * 1.0 / F.count(F.lit(1)), 4).alias("share"))
)
fires_query("certificate_numbers", "SELECT id, printf('CERT-%d-%06d', year(start_date), row_number() OVER (PARTITION BY year(start_date) ORDER BY start_date, id)) AS number FROM fires WHERE status = 'extinct'")(
    lambda f: f.filter("status = 'extinct'").selectExpr("id", "format_string('CERT-%d-%06d', year(start_date), row_number() OVER (PARTITION BY year(start_date) ORDER BY start_date, id)) AS number")
)

# Areas.
INSIDE = "lat BETWEEN south AND north AND lon BETWEEN west AND east"
BOX_D = distance("f.lat", "f.lon", "greatest(south, least(north, f.lat))", "greatest(west, least(east, f.lon))")
CROSS = f"SELECT id, area_id, CASE WHEN d = 0 THEN 100 ELSE 50 END AS overlap, (start_date::DATE + prohibition_years * 365)::DATE AS prohibition_until FROM (SELECT f.id, a.area_id, f.start_date, a.prohibition_years, {BOX_D} AS d FROM fires f JOIN areas a ON f.lat BETWEEN south - 0.01 AND north + 0.01 AND f.lon BETWEEN west - 0.02 AND east + 0.02) WHERE d <= 100"
both = lambda spark, d: (load(spark, d, "fires"), load(spark, d, "areas"))
query("legal_crossing", f"SELECT id, area_id, overlap, CAST(prohibition_until AS VARCHAR) AS prohibition_until FROM ({CROSS})", "fires", "areas")(lambda s, d: spatial.crossing(*both(s, d)).withColumn("prohibition_until", F.col("prohibition_until").cast("string")))
query("fires_in_protected", f"SELECT id FROM fires f WHERE EXISTS (SELECT 1 FROM areas WHERE {INSIDE})", "fires", "areas")(lambda s, d: load(s, d, "fires").select("id").join(spatial.crossing(*both(s, d)).filter("overlap = 100"), "id", "left_semi"))
query("fires_not_in_protected", f"SELECT id FROM fires f WHERE NOT EXISTS (SELECT 1 FROM areas WHERE {INSIDE})", "fires", "areas")(lambda s, d: load(s, d, "fires").select("id").join(spatial.crossing(*both(s, d)).filter("overlap = 100"), "id", "left_anti"))
query("fires_pa_summary", f"SELECT f.id, min(a.official_name) AS area_name, count(a.area_id) AS n_areas FROM fires f LEFT JOIN areas a ON {INSIDE} GROUP BY f.id", "fires", "areas")(
    lambda s, d: load(s, d, "fires").select("id").join(spatial.crossing(*both(s, d)).filter("overlap = 100").join(load(s, d, "areas").select("area_id", "official_name"), "area_id").groupBy("id").agg(F.min("official_name").alias("area_name"), F.count(F.lit(1)).alias("n_areas")), "id", "left").select("id", "area_name", F.coalesce("n_areas", F.lit(0)).alias("n_areas"))
)
query("crossing_top_areas", f"SELECT area_id, count(*) AS n FROM ({CROSS}) GROUP BY 1 ORDER BY n DESC, area_id LIMIT 5", "fires", "areas")(lambda s, d: spatial.crossing(*both(s, d)).groupBy("area_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "area_id").limit(5))
POINT = (-38.0, -63.0)
query("audit_radius", f"SELECT id, round(d, 1) AS distance FROM (SELECT id, {distance(*POINT, 'lat', 'lon')} AS d FROM fires) WHERE d <= 150000", "fires")(lambda s, d: spatial.within(load(s, d, "fires"), *POINT, 150_000).select("id", F.round("distance", 1).alias("distance")))
AUDIT = f"""SELECT id, distance, CAST(p AS VARCHAR) AS prohibition_until, y AS years_remaining, CASE WHEN y > 50 THEN 'critical' WHEN y > 30 THEN 'high' WHEN y > 10 THEN 'medium' WHEN y > 0 THEN 'low' ELSE 'none' END AS severity, p > DATE '2001-08-11' AS is_prohibited FROM
 (SELECT *, greatest(0, floor(date_diff('day', DATE '2001-08-11', p) / 365))::INT AS y FROM (SELECT f.id, round({distance(*POINT, 'lat', 'lon')}, 1) AS distance, coalesce(u, f.start_date::DATE + 30 * 365)::DATE AS p
 FROM fires f LEFT JOIN (SELECT id, max(prohibition_until) AS u FROM ({CROSS}) GROUP BY 1) c ON f.id = c.id WHERE {distance(*POINT, 'lat', 'lon')} <= 150000))"""
query("audit_prohibition", AUDIT, "fires", "areas")(lambda s, d: spatial.audit(*both(s, d), *POINT, 150_000, AS_OF).withColumn("prohibition_until", F.col("prohibition_until").cast("string")))
query("nearest_areas", f"SELECT area_id, round({distance(*POINT, f'greatest(south, least(north, {POINT[0]}))', f'greatest(west, least(east, {POINT[1]}))')}, 1) AS distance FROM areas ORDER BY 2, 1 LIMIT 5", "areas")(lambda s, d: spatial.nearest_areas(load(s, d, "areas"), *POINT))
query("park_alerts", """SELECT area_id, round(o, 4) AS occupancy, CASE WHEN o >= 1.2 THEN 'alert' WHEN o >= 0.8 THEN 'watch' ELSE 'normal' END AS level FROM (SELECT area_id, least(2.0, count(id) * 10.0::DOUBLE / carrying_capacity) AS o FROM areas LEFT JOIN fires ON """ + INSIDE + " GROUP BY area_id, carrying_capacity)", "fires", "areas")(
    lambda s, d: load(s, d, "areas").join(spatial.crossing(*both(s, d)).filter("overlap = 100").groupBy("area_id").agg(F.count(F.lit(1)).alias("n")), "area_id", "left").withColumn("o", F.least(F.lit(2.0), F.coalesce("n", F.lit(0)) * 10.0 / F.col("carrying_capacity"))).select("area_id", F.round("o", 4).alias("occupancy"), scoring.steps(F.col("o"), [(1.2, "alert"), (0.8, "watch")], "normal").alias("level"))
)

# Scenes.
query("image_nearest", """SELECT event_id, scene_id, gap::INT AS gap FROM (SELECT event_id, scene_id, gap, row_number() OVER (PARTITION BY event_id ORDER BY gap, acquired_on, scene_id) AS k FROM
 (SELECT s.*, abs(date_diff('day', f.start_date::DATE + 30, s.acquired_on)) AS gap FROM scenes s JOIN fires f ON s.event_id = f.id WHERE cloud_cover < 25)) WHERE k = 1""", "fires", "scenes")(lambda s, d: E.nearest_scene(load(s, d, "fires"), load(s, d, "scenes")))
query("image_threshold_scan", """SELECT event_id, scene_id, level FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY level, acquired_on DESC, scene_id) AS k FROM
 (SELECT *, CASE WHEN cloud_cover < 10 THEN 10 WHEN cloud_cover < 20 THEN 20 WHEN cloud_cover < 30 THEN 30 WHEN cloud_cover < 50 THEN 50 END AS level FROM scenes) WHERE level IS NOT NULL) WHERE k = 1""", "scenes")(lambda s, d: E.threshold_scan(load(s, d, "scenes")))
query("dnbr_severity", """SELECT event_id, d AS dnbr, CASE WHEN d >= 0.66 THEN 'high' WHEN d >= 0.44 THEN 'moderate_high' WHEN d >= 0.27 THEN 'moderate_low' WHEN d >= 0.1 THEN 'low' ELSE 'unburned' END AS severity FROM
 (SELECT event_id, floor((arg_max(nbr, (acquired_on, scene_id, nbr)) - arg_min(nbr, (acquired_on, scene_id, nbr))) * 1e6 + 0.5) / 1e6 + 0.0 AS d FROM (SELECT *, (nir - swir) / (nir + swir) AS nbr FROM scenes) GROUP BY 1 HAVING count(*) > 1)""", "scenes")(lambda s, d: E.burn_severity(load(s, d, "scenes")))
query("recovery_series", """SELECT event_id, scene_id, m::INT AS months, p AS pct, CASE WHEN p >= 90 THEN 'full_recovery' WHEN p >= 60 THEN 'advanced_recovery' WHEN p >= 30 THEN 'moderate_recovery' WHEN p >= 10 THEN 'early_recovery' ELSE 'no_recovery' END AS class,
 round(CASE WHEN m <= 0 THEN 0 WHEN m <= 3 THEN m / 3 * 0.15 WHEN m <= 6 THEN 0.15 + (m - 3) / 3 * 0.15 WHEN m <= 12 THEN 0.3 + (m - 6) / 6 * 0.2 WHEN m <= 24 THEN 0.5 + (m - 12) / 12 * 0.2 WHEN m <= 36 THEN 0.7 + (m - 24) / 12 * 0.15 ELSE 0.85 END, 6)::DOUBLE AS expected FROM
 (SELECT event_id, scene_id, ((year(acquired_on) - year(b)) * 12 + month(acquired_on) - month(b))::DOUBLE AS m, round(CASE WHEN base <= 0 THEN CASE WHEN ndvi > 0.4 THEN 100.0 ELSE 0.0 END ELSE greatest(0.0, least(100.0, ndvi / base * 100)) END, 4)::DOUBLE AS p FROM
 (SELECT *, first(ndvi) OVER w AS base, first(acquired_on) OVER w AS b FROM (SELECT *, (nir - red) / (nir + red) AS ndvi FROM scenes) WINDOW w AS (PARTITION BY event_id ORDER BY acquired_on, scene_id, nir, red)))""", "scenes")(lambda s, d: E.recovery(load(s, d, "scenes")))
QUALITY = """SELECT id, round(x, 2)::DOUBLE AS score, CASE WHEN x >= 80 THEN 'high' WHEN x >= 50 THEN 'medium' ELSE 'low' END AS class,
 concat_ws(',', CASE WHEN avg_confidence < 50 THEN 'low_confidence' END, CASE WHEN n = 0 THEN 'no_imagery' END, CASE WHEN area IS NULL THEN 'no_climate' END, CASE WHEN k < 2 THEN 'single_source' END) AS limitations FROM
 (SELECT *, greatest(0.0, least(100.0, avg_confidence * 0.4::DOUBLE + CASE WHEN n > 0 THEN 100 ELSE 0 END * 0.2::DOUBLE + CASE WHEN area IS NOT NULL THEN 100 ELSE 0 END * 0.2::DOUBLE + CASE WHEN k >= 3 THEN 100 WHEN k = 2 THEN 50 ELSE 0 END * 0.2::DOUBLE)) AS x FROM
 (SELECT f.id, f.avg_confidence, f.estimated_area_hectares AS area, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM fires f LEFT JOIN (SELECT event_id, count(*) AS n, count(DISTINCT scene_id % 3) AS k FROM scenes GROUP BY 1) s ON f.id = s.event_id))"""
query("quality_scores", QUALITY, "fires", "scenes")(lambda s, d: E.quality(load(s, d, "fires"), load(s, d, "scenes")))

# Detections.
hashed = lambda s, d: ingest.hashed(load(s, d, "detections").withColumn("instrument", ingest.instrument(F.col("satellite"))))
HASH = "sha256(concat_ws('|', satellite, CASE WHEN upper(satellite) LIKE '%VIIRS%' THEN 'VIIRS' ELSE 'MODIS' END, strftime(detected_at, '%Y-%m-%dT%H:%M:%S') || '+00:00', printf('%.5f', lat), printf('%.5f', lon), printf('%.2f', frp), confidence::VARCHAR))"
query("ingest_hash", f"SELECT id, {HASH} AS detection_hash FROM detections", "detections")(lambda s, d: hashed(s, d).select("id", "detection_hash"))


def dedup(rows):
    """A batch against the history before it, of which only the batch's days are read."""
    batch = rows.filter("detected_at >= timestamp_ntz'2024-01-15'")
    return ingest.new_only(batch, ingest.on_days_of(rows.filter("detected_at < timestamp_ntz'2024-01-15'"), batch))


query("ingest_dedup", f"SELECT min(id) AS id, h AS detection_hash FROM (SELECT id, detected_at, {HASH} AS h FROM detections) WHERE detected_at >= TIMESTAMP '2024-01-15' AND h NOT IN (SELECT {HASH} FROM detections WHERE detected_at < TIMESTAMP '2024-01-15') GROUP BY h", "detections")(
    lambda s, d: dedup(hashed(s, d)).select("id", "detection_hash")
)
RAW = "CASE WHEN event_id % 5 = 0 THEN ' Low ' WHEN event_id % 5 = 1 THEN 'n' WHEN event_id % 5 = 2 THEN 'HIGH' WHEN event_id % 5 = 3 THEN CAST(event_id % 150 - 20 AS VARCHAR(9)) ELSE 'x?' END"
query("ingest_confidence", f"SELECT event_id, CASE WHEN t IN ('l', 'low') THEN 33 WHEN t IN ('n', 'nominal') THEN 66 WHEN t IN ('h', 'high') THEN 100 ELSE greatest(0, least(100, coalesce(TRY_CAST(t AS INT), 0))) END AS confidence FROM (SELECT event_id, lower(trim({RAW})) AS t FROM events)")(
    lambda s, d: table(s, d, "events").select("event_id", scoring.confidence(F.expr(RAW)).alias("confidence"))
)
query("ingest_time", "SELECT event_id, ts::DATE + CASE WHEN event_id % 7 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR * (event_id % 24) + INTERVAL 1 MINUTE * (event_id % 60) END AS at FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", ingest.detected_at(F.col("ts").cast("date").cast("string"), F.expr("CASE WHEN event_id % 7 = 1 THEN concat('99', lpad(CAST(event_id % 24 * 100 + event_id % 60 AS STRING), 4, '0')) WHEN event_id % 7 > 0 THEN CAST(event_id % 24 * 100 + event_id % 60 AS STRING) END")).alias("at"))
)
query("detail_top_detections", "SELECT user_id, id, k::INT AS place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY detected_at DESC, id) AS k FROM detections) WHERE k <= 5", "detections")(
    lambda s, d: load(s, d, "detections").selectExpr("user_id", "id", "row_number() OVER (PARTITION BY user_id ORDER BY detected_at DESC, id) AS place").filter("place <= 5")
)
query("last_seen", "SELECT user_id, max(detected_at) AS last_seen_at FROM detections GROUP BY 1", "detections")(lambda s, d: streams.last_seen(load(s, d, "detections"), "detected_at", "user_id"))
query("session_windows", """SELECT user_id, count(*) AS n, min(detected_at) AS first_seen, max(detected_at) AS last_seen FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY detected_at, id) AS g FROM
 (SELECT *, CASE WHEN detected_at - lag(detected_at) OVER (PARTITION BY user_id ORDER BY detected_at, id) < INTERVAL 48 HOUR THEN 0 ELSE 1 END AS brk FROM detections)) GROUP BY user_id, g""", "detections")(lambda s, d: streams.sessions(load(s, d, "detections"), "detected_at", "user_id"))
query("rate_limit_windows", "SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, count(*) > 3 AS blocked FROM events GROUP BY 1, 2")(lambda s, d: streams.counters(table(s, d, "events"), "ts", "user_id", "1 day", 3))
query("request_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(count(*) FILTER (event_type = 'error') * 1.0::DOUBLE / count(*), 4) AS error_rate FROM events GROUP BY 1")(
    lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.count_if(F.col("event_type") == "error") * 1.0 / F.count(F.lit(1)), 4).alias("error_rate"))
)
EPS, WINDOW = 2000.0, 48 * 3600
timed = lambda s, d: load(s, d, "detections").withColumn("t", spatial.exact_seconds("detected_at")).withColumn("day", F.to_date("detected_at"))
NEAR = f"d AS (SELECT *, epoch(detected_at) AS t FROM detections), pairs AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.id < b.id AND abs(a.lat - b.lat) < 0.02 WHERE {distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2000 AND abs(a.t - b.t) <= 172800)"
query("stdbscan_neighbours", NEAR.join([", ", " SELECT a, b FROM pairs"]), "detections")(lambda s, d: spatial.neighbours(timed(s, d), EPS, WINDOW))
query("stdbscan_labels", NEAR.join([", ", """, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT x.id, min(y.id) AS label FROM d x JOIN (SELECT DISTINCT * FROM walk) w ON w.a = x.id JOIN d y ON y.id = w.b GROUP BY 1)
 SELECT d.id, r.label FROM d LEFT JOIN reach r ON d.id = r.id""".replace("walk", "(WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT * FROM r)")]), "detections")(lambda s, d: spatial.dbscan(timed(s, d), EPS, 2, WINDOW))
# Two points make a cluster here, so that every linked point is core and clusters are the components.
WALK = ", e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), labels AS (SELECT a AS id, least(a, min(b)) AS label FROM (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT * FROM r) GROUP BY a)"
CLUSTERS = """ SELECT label AS event_id, count(*) AS n, round(avg(lat) + 1e-9, 6) AS lat, round(avg(lon) + 1e-9, 6) AS lon, min(detected_at) AS start_date, max(detected_at) AS end_date, round(max(frp), 2) AS max_frp, round(sum(frp), 2) AS sum_frp, round(avg(frp) + 1e-7, 4) AS avg_frp,
 (max(frp) > 50 OR avg(confidence) > 80) AS is_significant FROM detections JOIN labels ON detections.id = labels.id GROUP BY 1"""
query("stdbscan_events", NEAR.join([", ", WALK + CLUSTERS]), "detections")(lambda s, d: spatial.cluster_events(load(s, d, "detections"), spatial.dbscan(timed(s, d), EPS, 2, WINDOW)))
DAILY = f"pairs AS (SELECT a.id AS a, b.id AS b FROM detections a JOIN detections b ON a.id < b.id AND a.detected_at::DATE = b.detected_at::DATE AND a.confidence >= 50 AND b.confidence >= 50 WHERE {distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1000)"
query("daily_dbscan_events", DAILY.join([", ", WALK + CLUSTERS]), "detections")(lambda s, d: spatial.cluster_events(load(s, d, "detections"), spatial.dbscan(timed(s, d).filter("confidence >= 50"), 1000.0, 2, partition="day")))
SAME = f"""pairs AS (SELECT a.id AS a, b.id AS b FROM fires a JOIN fires b ON a.id < b.id AND abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.05 WHERE a.status = 'active' AND b.status = 'active' AND coalesce(a.province = b.province, true)
 AND a.start_date::DATE <= b.end_date::DATE + 5 AND b.start_date::DATE <= a.end_date::DATE + 5 AND {distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1000)"""
query("consolidate_events", SAME.join([", ", WALK + " SELECT id, label AS survivor FROM labels"]), "fires")(lambda s, d: spatial.consolidate(load(s, d, "fires")))
query("merged_events", SAME.join([", ", WALK + """ SELECT label AS id, count(*) AS n_merged, min(start_date) AS start_date, max(end_date) AS end_date, sum(total_detections)::BIGINT AS total_detections, max(max_frp) AS max_frp,
 floor(sum(avg_confidence * total_detections) / nullif(sum(total_detections), 0) * 10000 + 0.5)::BIGINT AS confidence_e4, floor(avg(lat) * 10000 + 0.5)::BIGINT AS lat_e4, floor(avg(lon) * 10000 + 0.5)::BIGINT AS lon_e4 FROM fires JOIN labels ON fires.id = labels.id GROUP BY 1"""]), "fires")(
    lambda s, d: spatial.merged(load(s, d, "fires"), spatial.consolidate(load(s, d, "fires")))
)
query("legacy_hash", "SELECT id, substring(md5(concat_ws('|', printf('%.5f', lat), printf('%.5f', lon), strftime(detected_at, '%Y-%m-%d'), strftime(detected_at, '%H:%M:%S'), satellite)), 1, 16) AS legacy_hash FROM detections", "detections")(
    lambda s, d: load(s, d, "detections").select("id", ingest.legacy_hash(F.col("satellite"), F.col("detected_at"), F.col("lat"), F.col("lon")).alias("legacy_hash"))
)

# Text and prices.
PLAIN = "translate(lower(trim(text)), 'áàâãäéèêëíìîïóòôõöúùûüñç', 'aaaaaeeeeiiiiooooouuuunc')"
query("normalize_text", f"SELECT doc_id, md5({PLAIN}) AS h FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(text.plain(F.col("text"))).alias("h")))
REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '([\p{L}\p{N}_.-])[\p{L}\p{N}_.-]*@([\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+)', '\1***@\2', 'g'), '\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.)\d{1,3}\b', '\1***', 'g'), 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '[JWT_REDACTED]', 'g'),
 '\b[[:xdigit:]]{32,}\b', '[API_KEY_REDACTED]', 'g'), '(password|passwd|pwd|secret)["'']?\s*[:=]\s*["'']?[^"''&\s]+', '\1=[REDACTED]', 'gi'), '\+?54[\s-]?\d{1,4}[\s-]?\d{4,8}', '[PHONE_REDACTED]', 'g'), '\b\d{2}-\d{7,8}-\d\b', '[CUIT_REDACTED]', 'g')"""
query("redact_pii", f"SELECT doc_id, md5({REDACTED}) AS h FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("h")))
query("scrape_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", F.md5(text.visible(F.col("html"))).alias("h")))
query("credit_prices", "SELECT p_size, CASE WHEN p_size = 5 THEN 2.50::DECIMAL(10,2) WHEN p_size = 12 THEN 5.00::DECIMAL(10,2) WHEN p_size = 25 THEN 10.00::DECIMAL(10,2) ELSE (p_size * 0.50::DECIMAL(10,2))::DECIMAL(10,2) END::DOUBLE AS usd, count(*) AS n FROM part GROUP BY 1")(
    lambda s, d: table(s, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).select("p_size", scoring.credit_price(F.col("p_size")).cast("double").alias("usd"), "n")
)
