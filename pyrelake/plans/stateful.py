"""Queries with state, increments and series, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import increments, series, spatial
from ..sources.adapters import load, table
from ..streaming import state
from .queries import EPS, WINDOW, distance, query

# Sliding limit: three requests of a user in twelve hours, so that some are refused.

LIMIT_SQL = """
WITH RECURSIVE r AS (
    SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), w(user_id, k, event_id, held, allowed) AS (
    SELECT user_id, k, event_id, [t], true FROM r WHERE k = 1
    UNION ALL
    SELECT user_id, k, event_id, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END, len(h) < 3
    FROM (SELECT r.user_id, r.k, r.event_id, r.t, list_filter(w.held, lambda x: x >= r.t - 43200000000) AS h FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
)
SELECT user_id, event_id, CASE WHEN allowed THEN 'allowed' ELSE 'limited' END AS outcome FROM w
"""


@query("sliding_limit", LIMIT_SQL)
def sliding_limit(spark, sf_dir):
    return state.sliding_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=3, window_s=12 * 3600)


IDEMPOTENT_SQL = """
WITH RECURSIVE r AS (
    SELECT event_id, user_id, event_type, epoch_us(ts) AS t, props AS h, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events
), w(user_id, event_type, k, event_id, kept, expires, outcome) AS (
    SELECT user_id, event_type, k, event_id, h, t + 86400000000, 'new' FROM r WHERE k = 1
    UNION ALL
    SELECT r.user_id, r.event_type, r.k, r.event_id,
        CASE WHEN w.expires > r.t THEN w.kept ELSE r.h END,
        CASE WHEN w.expires > r.t THEN w.expires ELSE r.t + 86400000000 END,
        CASE WHEN w.expires <= r.t THEN 'new' WHEN w.kept = r.h THEN 'replayed' ELSE 'conflict' END
    FROM w JOIN r ON r.user_id = w.user_id AND r.event_type = w.event_type AND r.k = w.k + 1
)
SELECT user_id, event_type, event_id, outcome FROM w
"""


@query("idempotent_requests", IDEMPOTENT_SQL)
def idempotent_requests(spark, sf_dir):
    return state.idempotent(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", "props")


REPLAY_SQL = """
WITH r AS (
    SELECT event_id, event_id // 3 AS call, ts, abs(epoch_us(ts) - epoch_us(ts + INTERVAL 1 SECOND * (event_id * 37 % 700 - 350))) / 1e6 > 300 AS stale FROM events
)
SELECT event_id, CASE WHEN stale THEN 'stale' WHEN row_number() OVER (PARTITION BY call, stale ORDER BY ts, event_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome FROM r
"""


@query("replay_guard", REPLAY_SQL)
def replay_guard(spark, sf_dir):
    """Calls come three times, signed some minutes before or after."""
    calls = table(spark, sf_dir, "events").selectExpr("event_id", "event_id div 3 AS call", "ts", "ts + (event_id * 37 % 700 - 350) * interval '1' second AS signed_at")
    return state.replay_guard(calls, "call", "ts", "signed_at", "event_id")


# Two batches of detections: what the first one settled, noise too, the second one leaves as it is.

SPLIT = "2024-01-16"
INCREMENT_SQL = f""",
d AS (SELECT *, epoch(detected_at) AS t, detected_at >= TIMESTAMP '{SPLIT}' AS late FROM detections WHERE confidence >= 50),
pairs AS (
    SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.id < b.id AND a.late = b.late AND abs(a.lat - b.lat) < 0.02
    WHERE {distance("a.lat", "a.lon", "b.lat", "b.lon")} <= 2000 AND abs(a.t - b.t) <= 172800
), e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
labels AS (
    SELECT a AS id, least(a, min(b)) AS label
    FROM (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT * FROM r) GROUP BY a
)
SELECT d.id, l.label AS event_id, d.detected_at FROM d LEFT JOIN labels l ON d.id = l.id
"""


@query("incremental_clusters", INCREMENT_SQL, "detections")
def incremental_clusters(spark, sf_dir):
    rows = load(spark, sf_dir, "detections")
    none = rows.selectExpr("id", "id AS event_id", "detected_at").limit(0)
    first = spatial.written(increments.cluster_pending(rows.filter(F.col("detected_at") < F.lit(SPLIT).cast("timestamp_ntz")), none, EPS, 2, WINDOW))
    return first.union(increments.cluster_pending(rows, first, EPS, 2, WINDOW, since=SPLIT))


# Events change: one in nineteen moves, one in twenty-three turns out wrong. Episodes are those of the bridge.

BRIDGE = "SELECT concat(site_id, '-', year(start_date)) AS episode_id, id AS event_id FROM {fires}"
CHANGED = "SELECT id, start_date, end_date, total_detections, max_frp, lat + CASE WHEN id % 19 = 0 THEN 0.01 ELSE 0 END AS lat, lon, CASE WHEN id % 23 = 0 THEN 'false_positive' ELSE status END AS status FROM {fires}"
REFRESH_SQL = f""",
bridge AS ({BRIDGE.format(fires="fires")}), changed AS ({CHANGED.format(fires="fires")}),
e AS (SELECT * FROM changed WHERE status IS DISTINCT FROM 'false_positive')
SELECT episode_id, count(lat) AS n_events, min(start_date) AS start_date, max(end_date) AS end_date, coalesce(sum(total_detections), 0)::BIGINT AS detections, max(max_frp) AS max_frp,
    round(avg(lat) + 1e-9, 6) AS centre_lat, round(avg(lon) + 1e-9, 6) AS centre_lon,
    round(min(lat) + 1e-9, 6) AS south, round(max(lat) + 1e-9, 6) AS north, round(min(lon) + 1e-9, 6) AS west, round(max(lon) + 1e-9, 6) AS east
FROM bridge LEFT JOIN e ON e.id = bridge.event_id GROUP BY episode_id
"""


@query("refreshed_episodes", REFRESH_SQL, "fires")
def refreshed_episodes(spark, sf_dir):
    old = load(spark, sf_dir, "fires")
    bridge, new = spark.sql(BRIDGE, fires=old), spark.sql(CHANGED, fires=old)
    stored = spatial.written(increments.episode_metrics(old, bridge))
    affected = increments.affected_episodes(increments.changed_events(old, new), bridge)
    return increments.refreshed(stored, new, bridge, affected)


# Visitor logs are the customers; every event is an update to one of them, minutes after it was submitted.

LOGS = "SELECT c_custkey AS log_id, TIMESTAMP_NTZ '2024-01-01 08:00:00' + (c_custkey % 28) * INTERVAL '1' DAY AS first_submitted, c_name AS leader, c_mktsegment AS kind FROM {customer}"
UPDATES = """SELECT event_id AS update_id, user_id + 1 AS log_id, TIMESTAMP_NTZ '2024-01-01 08:00:00' + ((user_id + 1) % 28) * INTERVAL '1' DAY + (event_id % 60) * INTERVAL '1' MINUTE AS made_at,
    CASE WHEN event_id % 3 = 0 THEN concat('Lead ', event_id) END AS leader, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind FROM {events}"""
FIELDS = ["leader", "kind"]
HISTORY_SQL = f"""
WITH logs AS ({LOGS.format(customer="customer").replace("_NTZ", "")}), updates AS ({UPDATES.format(events="events").replace("_NTZ", "")}),
rows AS (
    SELECT u.log_id, u.update_id, u.made_at, u.leader, u.kind, l.leader AS leader_0, l.kind AS kind_0
    FROM updates u JOIN logs l USING (log_id) WHERE u.made_at <= l.first_submitted + INTERVAL 30 MINUTE
), history AS (
    SELECT log_id, row_number() OVER w AS revision, made_at AS valid_from, lead(made_at) OVER w AS valid_to,
        to_json({{'leader': coalesce(last_value(leader IGNORE NULLS) OVER b, leader_0), 'kind': coalesce(last_value(kind IGNORE NULLS) OVER b, kind_0)}})::VARCHAR AS before,
        to_json({{'leader': coalesce(last_value(leader IGNORE NULLS) OVER w, leader_0), 'kind': coalesce(last_value(kind IGNORE NULLS) OVER w, kind_0)}})::VARCHAR AS after
    FROM rows WINDOW w AS (PARTITION BY log_id ORDER BY made_at, update_id ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY log_id ORDER BY made_at, update_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
"""


def visitor_logs(spark, sf_dir):
    logs = spark.sql(LOGS, customer=table(spark, sf_dir, "customer"))
    updates = spark.sql(UPDATES, events=table(spark, sf_dir, "events"))
    return logs, increments.revisions(logs, updates, FIELDS, "log_id")


@query("log_revisions", HISTORY_SQL + "SELECT * FROM history")
def log_revisions(spark, sf_dir):
    return visitor_logs(spark, sf_dir)[1]


@query(
    "logs_at",
    HISTORY_SQL
    + """SELECT l.log_id, coalesce(h.after, to_json({'leader': l.leader, 'kind': l.kind})::VARCHAR) AS state
FROM logs l LEFT JOIN history h ON h.log_id = l.log_id AND h.valid_from <= TIMESTAMP '2024-01-15 08:10:00' AND (h.valid_to IS NULL OR h.valid_to > TIMESTAMP '2024-01-15 08:10:00')
WHERE l.first_submitted <= TIMESTAMP '2024-01-15 08:10:00'""",
)
def logs_at(spark, sf_dir):
    logs, history = visitor_logs(spark, sf_dir)
    return increments.state_at(logs, history, FIELDS, "log_id", "2024-01-15 08:10:00")


# Orders ask for their report's hash; a third have it in the report table, their items are the audit events.

REQUESTS = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS report_id, CASE WHEN o_orderkey % 2 = 0 THEN upper(sha2(CAST(o_orderkey AS VARCHAR(20)), 256)) ELSE sha2(concat(o_orderkey, '-3'), 256) END AS given FROM {orders}"
REPORTS = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS report_id, CASE WHEN o_orderkey % 6 < 3 THEN sha2(CAST(o_orderkey AS VARCHAR(20)), 256) ELSE '' END AS verification_hash FROM {orders} WHERE o_orderkey % 3 <> 1"
AUDIT = """SELECT CASE WHEN l_linenumber = 2 THEN 'report_viewed' ELSE 'report_generated' END AS action, l_shipdate AS created_at, l_linenumber AS audit_id,
    concat('{{"report_id": "', l_orderkey, '", "verification_hash": "', sha2(concat(l_orderkey, '-', l_linenumber), 256), '"}}') AS details FROM {lineitem}"""
VERIFY_SQL = f"""
WITH requests AS ({REQUESTS.format(orders="orders")}), reports AS ({REPORTS.format(orders="orders")}), audit AS ({AUDIT.format(lineitem="lineitem")}),
newest AS (
    SELECT details->>'report_id' AS report_id, details->>'verification_hash' AS audited FROM audit WHERE action = 'report_generated'
    QUALIFY row_number() OVER (PARTITION BY details->>'report_id' ORDER BY created_at DESC, audit_id DESC) = 1
), found AS (
    SELECT report_id, given, coalesce(nullif(verification_hash, ''), nullif(audited, '')) AS stored
    FROM requests LEFT JOIN reports USING (report_id) LEFT JOIN newest USING (report_id)
)
SELECT report_id, stored IS NOT NULL AS found, lower(stored) = lower(given) AS is_valid, stored[1:16] || '...' || right(stored, 16) AS shown FROM found
""".replace(", 256)", ")").replace("sha2(", "sha256(").replace('{"', '{"')


@query("report_verification", VERIFY_SQL)
def report_verification(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    audit = spark.sql(AUDIT, lineitem=table(spark, sf_dir, "lineitem"))
    return increments.verified(spark.sql(REQUESTS, orders=orders), spark.sql(REPORTS, orders=orders), audit)


# Series of images.

SERIES_SQL = """,
steps AS (SELECT id AS event_id, start_date::DATE AS start, unnest(range(0, 7)) AS k FROM fires),
firsts AS (SELECT *, (date_trunc('month', start) + INTERVAL 1 MONTH * k)::DATE AS first FROM steps),
dated AS (
    SELECT event_id, k, first + CASE WHEN bool_or(day(last_day(first)) < day(start)) OVER (PARTITION BY event_id ORDER BY k) THEN 27 ELSE day(start)::INT - 1 END AS target FROM firsts
), near AS (
    SELECT d.event_id, d.k, s.scene_id, abs(date_diff('day', d.target, s.acquired_on)) AS gap,
        row_number() OVER (PARTITION BY d.event_id, d.k ORDER BY abs(date_diff('day', d.target, s.acquired_on)), s.scene_id) AS place
    FROM dated d JOIN scenes s ON s.event_id = d.event_id AND s.cloud_cover < 20 AND abs(date_diff('day', d.target, s.acquired_on)) <= 15
)
SELECT d.event_id, d.target, n.scene_id, n.gap::INT AS gap FROM dated d LEFT JOIN near n ON n.event_id = d.event_id AND n.k = d.k AND n.place = 1
"""


@query("image_series", SERIES_SQL, "fires", "scenes")
def image_series(spark, sf_dir):
    return series.image_series(load(spark, sf_dir, "fires"), load(spark, sf_dir, "scenes"), months=6)


AREA_IMAGES_SQL = """,
crossings AS (SELECT f.id, f.start_date::DATE AS low, a.area_id FROM fires f JOIN areas a ON f.lat BETWEEN a.south AND a.north AND f.lon BETWEEN a.west AND a.east),
images AS (SELECT c.area_id, s.acquired_on FROM scenes s JOIN crossings c ON c.id = s.event_id)
SELECT c.area_id, c.id, count(*) AS n_images, min(i.acquired_on) AS first_image, max(i.acquired_on) AS last_image
FROM crossings c JOIN images i ON i.area_id = c.area_id AND i.acquired_on BETWEEN c.low AND c.low + 60 GROUP BY c.area_id, c.id
"""


@query("area_images", AREA_IMAGES_SQL, "fires", "areas", "scenes")
def area_images(spark, sf_dir):
    return series.area_images(*(load(spark, sf_dir, name) for name in ("scenes", "fires", "areas")))


CLIMATE_SQL = """,
climate AS (SELECT event_id AS climate_id, user_id, ts::DATE AS reference_date, value AS temp_max FROM events),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reference_date DESC, climate_id) AS place FROM climate)
SELECT f.id, b.climate_id, b.reference_date, b.temp_max FROM fires f JOIN best b ON b.user_id = f.site_id % 150 AND b.place = 1
"""


@query("latest_climate", CLIMATE_SQL, "fires")
def latest_climate(spark, sf_dir):
    """The climate of an event is what was read at its station, the latest day."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS climate_id", "user_id", "CAST(ts AS DATE) AS reference_date", "value AS temp_max")
    stations = series.latest_associated(rows.select("user_id", "climate_id"), rows.drop("user_id"), "user_id", "climate_id", "reference_date")
    fires = load(spark, sf_dir, "fires").selectExpr("id", "site_id % 150 AS user_id")
    return fires.join(stations, "user_id").select("id", "climate_id", "reference_date", "temp_max")
