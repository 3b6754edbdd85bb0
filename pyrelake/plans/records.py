"""Queries over whole rows, audits, candidates, ledgers, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import increments, records, spatial
from ..sources.adapters import load, table
from .extended import KIND, OBSERVED
from .queries import AS_OF, AUDIT, POINT, distance, query
from .stateful import BRIDGE

CROSSED = "crossings AS (SELECT f.id, a.area_id, a.official_name, 100 AS overlap FROM fires f JOIN areas a ON f.lat BETWEEN a.south AND a.north AND f.lon BETWEEN a.west AND a.east)"


def crossed(spark, sf_dir):
    """Events in areas, a hundred percent each."""
    return spatial.crossing(load(spark, sf_dir, "fires"), load(spark, sf_dir, "areas"), near_m=0.0).select("id", "area_id", "overlap")


LIST_SQL = f""",
{CROSSED},
own AS (SELECT id, arg_min(official_name, area_id) AS protected_area_name, min(area_id) AS protected_area_id, max(overlap) AS overlap_percentage, count(*) AS n FROM crossings GROUP BY id)
SELECT f.*, EXISTS (SELECT 1 FROM scenes s WHERE s.event_id = f.id) AS has_imagery, o.protected_area_name, o.protected_area_id, o.overlap_percentage, coalesce(o.n, 0) AS protected_area_count
FROM fires f LEFT JOIN own o ON o.id = f.id
"""


@query("list_rows", LIST_SQL, "fires", "areas", "scenes")
def list_rows(spark, sf_dir):
    return records.list_rows(load(spark, sf_dir, "fires"), load(spark, sf_dir, "scenes"), crossed(spark, sf_dir), load(spark, sf_dir, "areas"))


SEARCH_SQL = f"""
SELECT id, start_date, end_date, province, department, nullif(estimated_area_hectares, 0) AS estimated_area_hectares, nullif(avg_confidence, 0) AS avg_confidence, nullif(avg_confidence, 0) AS quality_score,
    coalesce(total_detections, 0) AS total_detections, EXISTS (SELECT 1 FROM scenes s WHERE s.event_id = fires.id) AS has_satellite_imagery, lat AS latitude, lon AS longitude,
    CASE WHEN status IS NOT NULL THEN status WHEN coalesce(last_seen_at, end_date, start_date) > TIMESTAMP '{AS_OF}' THEN 'active'
        WHEN coalesce(last_seen_at, end_date, start_date) >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR THEN 'monitoring' ELSE 'extinct' END AS status
FROM fires
"""


@query("search_rows", SEARCH_SQL, "fires", "scenes")
def search_rows(spark, sf_dir):
    return records.search_rows(load(spark, sf_dir, "fires"), load(spark, sf_dir, "scenes"), AS_OF)


# A detection belongs to the event of its third, and a user's readings are the climate of the events of a site. Arrays are listed by id.

DETAIL_SQL = f""",
{CROSSED},
placed AS (SELECT id // 40 AS fire_id, id, row_number() OVER (PARTITION BY id // 40 ORDER BY detected_at DESC, id) AS place FROM detections),
latest AS (SELECT fire_id, string_agg(id::VARCHAR, ',' ORDER BY place) AS detections FROM placed WHERE place <= 25 GROUP BY fire_id),
own AS (SELECT id, string_agg(area_id || ' ' || official_name, ',' ORDER BY overlap DESC, area_id) AS protected_areas, max(overlap) AS overlap_percentage FROM crossings GROUP BY id)
SELECT f.id, coalesce(o.protected_areas, '') AS protected_areas, o.overlap_percentage, coalesce(l.detections, '') AS detections, f.site_id < 150 AS has_climate_data
FROM fires f LEFT JOIN own o ON o.id = f.id LEFT JOIN latest l ON l.fire_id = f.id
"""


@query("detail_rows", DETAIL_SQL, "fires", "areas", "detections")
def detail_rows(spark, sf_dir):
    fires = load(spark, sf_dir, "fires")
    detections = load(spark, sf_dir, "detections").selectExpr("id div 40 AS fire_id", "id", "detected_at")
    rows = records.detail_rows(fires, detections, crossed(spark, sf_dir), load(spark, sf_dir, "areas"), fires.filter("site_id < 150"), most=25)
    listed = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    return rows.select("id", listed("protected_areas", lambda a: F.concat_ws(" ", a["area_id"], a["official_name"])).alias("protected_areas"), "overlap_percentage", listed("detections", lambda d: d["id"].cast("string")).alias("detections"), "has_climate_data")


# Audit search: a province, an area, a point.

PLACES_SQL = f""",
{CROSSED},
places AS (
    SELECT b.episode_id, f.province, c.area_id, f.lat, f.lon, f.start_date, f.end_date
    FROM fires f JOIN ({BRIDGE.format(fires="fires")}) b ON b.event_id = f.id LEFT JOIN crossings c ON c.id = f.id
), chosen AS (SELECT episode_id, min(start_date) AS start_date, max(end_date) AS end_date FROM places WHERE #W# GROUP BY episode_id)
SELECT '#K#' AS resolved_type, '#N#' AS label, c.episode_id, c.start_date, s.total, s.earliest, s.latest
FROM chosen c, (SELECT count(*) AS total, min(start_date) AS earliest, max(end_date) AS latest FROM chosen) s ORDER BY c.start_date DESC, c.episode_id LIMIT 20
"""
SEARCHES = {
    "province": ("  nation_2 ", None, "province = 'NATION_2'", "province", "NATION_2"),
    "area": ("pa_7", None, "area_id = 7", "protected_area", "PA_7"),
    "point": ("Ruta 40", (-52.41, -69.29), f"{distance('-52.41', '-69.29', 'lat', 'lon')} <= 25000", "address", "Ruta 40"),
}


def search_query(name: str, q: str, point: tuple | None, where: str, kind: str, label: str):
    def search(spark, sf_dir):
        fires = load(spark, sf_dir, "fires")
        episodes = fires.join(spark.sql(BRIDGE, fires=fires).withColumnRenamed("event_id", "id"), "id").join(crossed(spark, sf_dir).select("id", "area_id"), "id", "left")
        return records.audit_search(episodes, load(spark, sf_dir, "areas"), q, point=point)

    query(f"audit_search_{name}", PLACES_SQL.replace("#W#", where).replace("#K#", kind).replace("#N#", label), "fires", "areas")(search)


for name, search in SEARCHES.items():
    search_query(name, *search)


@query("closure_candidates", f""",
{CROSSED}
SELECT id, start_date, extinct_at, estimated_area_hectares FROM fires
WHERE status = 'extinct' AND extinct_at >= DATE '{AS_OF}' - 2000 AND estimated_area_hectares >= 100 AND id IN (SELECT id FROM crossings) AND id % 3 <> 0
ORDER BY extinct_at DESC, id LIMIT 50
""", "fires", "areas")  # fmt: skip
def closure_candidates(spark, sf_dir):
    fires = load(spark, sf_dir, "fires")
    return records.closure_candidates(fires, crossed(spark, sf_dir), fires.filter("id % 3 = 0"), AS_OF, 2000, 100.0, 50)


# Every ninth episode has lost its events.

CLOSED_SQL = f""",
bridge AS (SELECT * FROM ({BRIDGE.format(fires="fires")})),
kept AS (SELECT b.episode_id, f.status, coalesce(f.extinct_at, f.end_date) AS gone FROM bridge b JOIN fires f ON f.id = b.event_id WHERE length(b.episode_id) % 2 = 0 OR f.id % 9 <> 0),
grouped AS (SELECT e.episode_id, count(k.episode_id) AS n, coalesce(bool_or(k.status = 'active'), false) AS active, max(k.gone) AS gone FROM (SELECT DISTINCT episode_id FROM bridge) e LEFT JOIN kept k ON k.episode_id = e.episode_id GROUP BY 1)
SELECT episode_id, CASE WHEN n = 0 THEN 'closed' WHEN active THEN 'active' WHEN gone > TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY THEN 'monitoring' ELSE 'extinct' END AS status FROM grouped
"""


@query("episode_status_all", CLOSED_SQL, "fires")
def episode_status_all(spark, sf_dir):
    fires = load(spark, sf_dir, "fires")
    bridge = spark.sql(BRIDGE, fires=fires)
    kept = bridge.filter("length(episode_id) % 2 = 0 OR event_id % 9 <> 0")
    return records.episode_status(bridge.select("episode_id").distinct(), fires, kept, AS_OF)


CANDIDATE_SQL = f""",
e AS (
    SELECT b.episode_id, min(f.start_date) AS start_date, max(f.end_date) AS end_date, sum(f.total_detections) AS detections, max(f.max_frp) AS max_frp,
        round(sum(f.max_frp), 4) AS frp_sum, round(sum(f.estimated_area_hectares), 4) AS hectares, coalesce(bool_or(f.status = 'active'), false) AS live
    FROM fires f JOIN ({BRIDGE.format(fires="fires")}) b ON b.event_id = f.id GROUP BY 1
)
SELECT episode_id, row_number() OVER (ORDER BY #O# DESC NULLS LAST, episode_id)::INT AS priority FROM e
WHERE live AND end_date - start_date >= INTERVAL 24 HOUR AND detections >= 10 AND max_frp >= 20 QUALIFY priority <= 40
"""


def candidate_query(sort: str, column: str):
    def candidates(spark, sf_dir):
        fires = load(spark, sf_dir, "fires")
        rows = fires.join(spark.sql(BRIDGE, fires=fires).withColumnRenamed("event_id", "id"), "id").groupBy("episode_id")
        rows = rows.agg(
            F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.sum("total_detections").alias("detections"), F.max("max_frp").alias("max_frp"), F.round(F.sum("max_frp"), 4).alias("frp_sum"),
            F.round(F.sum("estimated_area_hectares"), 4).alias("hectares"), F.when(F.bool_or(F.col("status") == "active"), "active").otherwise("extinct").alias("status"),
        )
        return records.image_candidates(rows, sort, frp_max=20.0, most=40)

    query(f"image_candidates_{sort}", CANDIDATE_SQL.replace("#O#", column), "fires")(candidates)


for sort, column in {"frp_sum": "frp_sum", "frp_max": "max_frp", "detections": "detections", "area_estimated": "hectares", "recent": "end_date"}.items():
    candidate_query(sort, column)


LEDGER = """SELECT user_id, event_id AS entry_id, ts AS at, CASE WHEN event_id % 4 = 0 THEN 'grant' ELSE 'generate' END AS kind,
    CASE WHEN event_id % 4 = 0 THEN 5 ELSE event_id % 14 END AS amount, CAST(event_id % 9 AS INT) AS investigation FROM {events}"""
LEDGER_SQL = f"""
WITH RECURSIVE r AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_, entry_id) AS k FROM ({LEDGER.format(events="events").replace(" AS at,", " AS at_,")})
), judged AS (
    SELECT user_id, entry_id, k, kind, amount, investigation, 0::BIGINT AS balance, []::INT[] AS paid, '' AS outcome FROM r WHERE false
    UNION ALL SELECT user_id, NULL, 0, '', 0, 0, 0, [], '' FROM (SELECT DISTINCT user_id FROM r)
), w AS (
    SELECT * FROM judged
    UNION ALL
    SELECT user_id, entry_id, k, kind, amount, investigation,
        CASE outcome WHEN 'granted' THEN balance + amount WHEN 'spent' THEN balance - amount ELSE balance END,
        CASE outcome WHEN 'spent' THEN list_append(paid, investigation) ELSE paid END, outcome
    FROM (
        SELECT r.user_id, r.entry_id, r.k, r.kind, r.amount, r.investigation, w.balance, w.paid,
            CASE WHEN r.kind = 'grant' THEN 'granted' WHEN list_contains(w.paid, r.investigation) THEN 'repeated' WHEN r.amount NOT BETWEEN 1 AND 12 THEN 'invalid' WHEN w.balance < r.amount THEN 'insufficient' ELSE 'spent' END AS outcome
        FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1
    )
)
SELECT user_id, entry_id, outcome, balance FROM w WHERE k > 0
"""


@query("credit_ledger", LEDGER_SQL)
def credit_ledger(spark, sf_dir):
    return records.ledger(spark.sql(LEDGER, events=table(spark, sf_dir, "events")))


@query("image_integrity", f""",
bridge AS (SELECT event_id % 500 AS episode_id FROM ({BRIDGE.format(fires="fires")}) WHERE event_id % 3 = 0),
shown AS (SELECT id + 3 AS episode_id FROM fires WHERE json_array_length(slides_data) > 0)
SELECT s.episode_id, count(b.episode_id) AS linked, (SELECT count(*) FROM fires f WHERE f.id = s.episode_id) AS same_id,
    CASE WHEN count(b.episode_id) > 0 THEN 'OK' WHEN (SELECT count(*) FROM fires f WHERE f.id = s.episode_id) > 0 THEN 'Fallback OK' ELSE 'MISSING_EVENT' END AS result
FROM shown s LEFT JOIN bridge b ON b.episode_id = s.episode_id GROUP BY s.episode_id
""", "fires")  # fmt: skip
def image_integrity(spark, sf_dir):
    fires = load(spark, sf_dir, "fires")
    bridge = spark.sql(BRIDGE, fires=fires).filter("event_id % 3 = 0").selectExpr("event_id % 500 AS episode_id")
    return records.image_integrity(fires.selectExpr("id + 3 AS episode_id", "slides_data"), bridge, fires)


@query("request_boxes", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 90 - 0.5 WHEN event_id % 3 = 1 THEN -60.0 - 0.01 END::DOUBLE AS west, CASE WHEN event_id % 3 = 0 THEN event_id % 45 + 2.0 WHEN event_id % 3 = 1 THEN -30.0 + 0.01 END::DOUBLE AS north,
    CASE WHEN event_id % 200 BETWEEN 1 AND 90 THEN event_id % 200 END::DOUBLE AS parsed_north
FROM events
""")  # fmt: skip
def request_boxes(spark, sf_dir):
    """Boxes as JSON, missing a side, or none with a point; and as text, a north of 0 or beyond 90 being refused."""
    rows = table(spark, sf_dir, "events")
    aoi = F.expr("CASE WHEN event_id % 3 = 0 THEN concat('{\"west\": ', event_id % 90 - 0.5, ', \"south\": 1, \"east\": 2, \"north\": ', event_id % 45 + 2, '}') ELSE '{\"west\": 1}' END")
    point = lambda v: F.when(F.col("event_id") % 3 == 1, F.lit(v))
    box = records.box_or_point(aoi, point(-30.0), point(-60.0), 0.01)
    parsed = records.parsed_box(F.concat(F.lit("-10, 0,10,"), (F.col("event_id") % 200).cast("string")))
    return rows.select("event_id", box["west"].alias("west"), box["north"].alias("north"), parsed["north"].alias("parsed_north"))


NEWEST = f"(SELECT event_id, p, {KIND} AS k FROM {OBSERVED} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY acquired_on DESC, scene_id DESC, nir DESC, red DESC) = 1)"
REPORT_SQL = f"""
SELECT CASE WHEN n.k = 'no_recovery' THEN 'suspicious' WHEN n.p IS NULL THEN 'unknown' WHEN n.p >= 90 THEN 'excellent' WHEN n.p >= 70 THEN 'good' WHEN n.p >= 50 THEN 'moderate' WHEN n.p >= 25 THEN 'poor' ELSE 'critical' END AS status, count(*) AS n
FROM fires f LEFT JOIN {NEWEST} n ON n.event_id = f.id AND f.id % 7 <> 0 WHERE f.start_date < TIMESTAMP '2001-05-11' AND f.province = 'NATION_2' GROUP BY 1
"""


@query("recovery_report", REPORT_SQL, "fires", "scenes")
def recovery_report(spark, sf_dir):
    """Every seventh event has no scene."""
    return records.recovery_report(load(spark, sf_dir, "fires"), load(spark, sf_dir, "scenes").filter("event_id % 7 <> 0"), AS_OF, province="NATION_2")


VERDICT_SQL = f""", rows AS ({AUDIT}),
summed AS (
    SELECT count(*) AS n_events, count(*) FILTER (prohibition_until::DATE > DATE '{AS_OF}') AS n_prohibiting, max(prohibition_until::DATE) AS prohibition_until,
        coalesce(greatest(0, (max(prohibition_until::DATE) - DATE '{AS_OF}') // 365), 0)::INT AS years_remaining,
        sha256(coalesce(string_agg(id || ':' || prohibition_until, ',' ORDER BY id || ':' || prohibition_until), '')) AS evidence_hash
    FROM rows
)
SELECT n_events, n_prohibiting, prohibition_until, coalesce(prohibition_until > DATE '{AS_OF}', false) AS is_prohibited, years_remaining,
    CASE WHEN years_remaining > 50 THEN 'critical' WHEN years_remaining > 30 THEN 'high' WHEN years_remaining > 10 THEN 'medium' WHEN years_remaining > 0 THEN 'low' ELSE 'none' END AS severity, evidence_hash
FROM summed
"""


@query("audit_verdict", VERDICT_SQL, "fires", "areas")
def audit_verdict(spark, sf_dir):
    return records.audit_verdict(spatial.audit(load(spark, sf_dir, "fires"), load(spark, sf_dir, "areas"), *POINT, 150_000, AS_OF), AS_OF)
