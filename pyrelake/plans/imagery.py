"""Queries over images, citizens' reports, recurrence and jobs, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fires as O
from ..operators import imagery, monitoring, reports, spatial
from ..sources.adapters import load, table
from .queries import AS_OF, distance, query
from .stateful import BRIDGE

# Carousel: the run of a day after the one of the day before, whose images it compares with. Every 50th episode has no centre.

RUN, BEFORE = "1997-03-01", "1997-02-27"
EPISODES = """
SELECT episode_id, CASE WHEN bool_or(coalesce(status = 'active', false)) THEN 'active' WHEN bool_or(coalesce(status = 'monitoring', false)) THEN 'monitoring' ELSE 'extinct' END AS status,
    sum(total_detections) >= 3 AS candidate, CASE WHEN max(site_id) % 7 <> 0 THEN count(*) END AS priority, min(start_date) AS start_date,
    CASE WHEN max(site_id) % 50 <> 0 THEN avg(lat) END AS lat, avg(lon) AS lon
FROM {fires} f JOIN {bridge} b ON b.event_id = f.id GROUP BY episode_id"""
CHOSEN = """SELECT DISTINCT ON (episode_id) episode_id, image, threshold, is_archive FROM (
    SELECT b.episode_id, s.event_id, s.scene_id, s.event_id || '-' || s.scene_id AS image, 1 AS tier, s.cloud_cover::DOUBLE AS rank, false AS is_archive,
        CASE WHEN s.cloud_cover < 10 THEN 10 WHEN s.cloud_cover < 20 THEN 20 WHEN s.cloud_cover < 30 THEN 30 ELSE 50 END AS threshold
    FROM scenes s JOIN bridge b ON b.event_id = s.event_id WHERE s.cloud_cover < 50 AND s.acquired_on >= DATE '{day}' - 7 AND s.acquired_on < DATE '{day}'
    UNION ALL
    SELECT b.episode_id, s.event_id, s.scene_id, s.event_id || '-' || s.scene_id, 2, s.acquired_on - DATE '1970-01-01', true, 30
    FROM scenes s JOIN bridge b ON b.event_id = s.event_id WHERE s.cloud_cover < 30 AND s.acquired_on >= DATE '{day}' - 30 AND s.acquired_on < DATE '{day}'
) ORDER BY episode_id, tier, rank, event_id, scene_id"""
CAROUSEL_SQL = f""",
bridge AS ({BRIDGE.format(fires="fires")}),
ordered AS (
    SELECT episode_id, lat FROM ({EPISODES.format(fires="fires", bridge="bridge")}) WHERE status IN ('active', 'monitoring') AND candidate
    ORDER BY priority DESC NULLS LAST, start_date DESC NULLS LAST, episode_id LIMIT 1000
), now AS ({CHOSEN.format(day=RUN)}), earlier AS ({CHOSEN.format(day=BEFORE)}),
shown AS (
    SELECT DISTINCT ON (b.episode_id) b.episode_id, f.id FROM fires f JOIN bridge b ON b.event_id = f.id
    ORDER BY b.episode_id, coalesce(f.status IN ('active', 'monitoring'), false) DESC, f.end_date DESC NULLS LAST, f.start_date DESC NULLS LAST, f.id
)
SELECT o.episode_id, s.id AS event_id, n.image, n.threshold, n.is_archive,
    CASE WHEN o.lat IS NULL THEN 'missing_centroid' WHEN s.id IS NULL THEN 'missing_event' WHEN n.image IS NULL THEN 'no_image' WHEN n.image = e.image THEN 'no_change' ELSE 'updated' END AS outcome
FROM ordered o LEFT JOIN shown s USING (episode_id) LEFT JOIN now n USING (episode_id) LEFT JOIN earlier e USING (episode_id)
"""


@query("carousel_run", CAROUSEL_SQL, "fires", "scenes")
def carousel_run(spark, sf_dir):
    fires, scenes = load(spark, sf_dir, "fires"), load(spark, sf_dir, "scenes")
    bridge = spark.sql(BRIDGE, fires=fires)
    stored = imagery.selected_images(bridge.join(scenes, "event_id"), "episode_id", BEFORE).select("episode_id", F.col("image").alias("last_image"))
    episodes = spark.sql(EPISODES, fires=fires, bridge=bridge).join(stored, "episode_id", "left")
    return imagery.carousel(episodes, bridge, fires, scenes, RUN, most=1000)


# Report images. The oracle lists every target and ranks its scenes.

REPORT_SQL = """,
asked AS (
    SELECT id AS event_id, 0 AS k, start_date::DATE - 15 AS target FROM fires
    UNION ALL SELECT id, k, #T# FROM fires, range(1, 7) t(k)
), near AS (
    SELECT a.event_id, a.k, a.target, s.scene_id, (s.nir - s.red) / (s.nir + s.red) AS v, row_number() OVER (PARTITION BY a.event_id, a.k ORDER BY abs(s.acquired_on - a.target), s.scene_id, (s.nir - s.red) / (s.nir + s.red)) AS p
    FROM asked a JOIN scenes s ON s.event_id = a.event_id AND s.cloud_cover < 30 AND s.acquired_on >= a.target - 30 AND s.acquired_on < a.target + 30
    WHERE a.k = 0 OR a.target <= DATE '1998-01-01'
), best AS (SELECT * FROM near WHERE p = 1),
shown AS (SELECT b.* FROM best b WHERE b.k <= 6 - (SELECT count(*) FROM best o WHERE o.event_id = b.event_id AND o.k = 0))
SELECT event_id, k * 2 AS place, 'RGB' AS vis_type, target, event_id || '-' || scene_id AS image, round(v::DOUBLE, 6) AS ndvi, k = 0 AS is_before FROM shown
"""
SECOND_SQL = "UNION ALL SELECT event_id, k * 2 + 1, 'NDVI', target, event_id || '-' || scene_id, NULL, false FROM shown WHERE k > 0"


def report_query(frequency: str, target: str, more: str):
    def images(spark, sf_dir):
        return imagery.report_images(load(spark, sf_dir, "fires"), load(spark, sf_dir, "scenes"), "1998-01-01", 6, frequency)

    query(f"report_images_{frequency}", REPORT_SQL.replace("#T#", target) + more, "fires", "scenes")(images)


report_query("annual", "make_date(year(start_date) + k, month(start_date), least(day(start_date), 28))", SECOND_SQL)
MONTH = "(date_trunc('month', start_date)::DATE + to_months(k::INT))"
report_query("monthly", f"({MONTH} + to_days((CASE WHEN day(last_day({MONTH})) < day(start_date) THEN 27 ELSE day(start_date) - 1 END)::INT))::DATE", "")


# Closure: every extinct event of a size, images as chosen for it.

CLOSURE_SQL = f""",
images AS ({{images}}),
candidates AS (SELECT id, start_date, extinct_at FROM fires WHERE status = 'extinct' AND extinct_at IS NOT NULL AND estimated_area_hectares >= 50),
sides AS (
    SELECT DISTINCT ON (i.event_id, i.side) i.event_id AS id, i.side, i.event_id || '-' || i.scene_id AS image, s.cloud_cover, s.acquired_on, coalesce((s.nir - s.swir) / nullif(s.nir + s.swir, 0), 0)::DOUBLE AS nbr
    FROM images i JOIN scenes s ON s.event_id = i.event_id AND s.scene_id = i.scene_id
    ORDER BY i.event_id, i.side, s.cloud_cover, s.acquired_on, nbr
), pairs AS (SELECT a.id, round(a.nbr - b.nbr, 6) AS d, 'DNBR:' || a.image || ':' || b.image AS product, b.cloud_cover, b.acquired_on FROM sides a JOIN sides b ON b.id = a.id AND a.side = 'pre' AND b.side = 'post')
SELECT c.id, CASE WHEN b.id IS NOT NULL THEN 'updated' WHEN DATE '2001-03-01' - c.extinct_at::DATE >= 90 THEN 'incomplete' ELSE 'waiting' END AS outcome, b.d AS dnbr, b.product,
    CASE WHEN d < 0.1 THEN 'unburned' WHEN d < 0.27 THEN 'low' WHEN d < 0.44 THEN 'moderate_low' WHEN d < 0.66 THEN 'moderate_high' WHEN d IS NOT NULL THEN 'high' END AS severity,
    CASE WHEN cloud_cover <= 10 THEN 'excellent' WHEN cloud_cover <= 20 THEN 'good' WHEN cloud_cover <= 30 THEN 'fair' WHEN cloud_cover <= 50 THEN 'poor' WHEN cloud_cover IS NOT NULL THEN 'unusable' END AS quality,
    b.acquired_on - c.start_date::DATE AS days_after
FROM candidates c LEFT JOIN pairs b ON b.id = c.id
"""
IMAGES_SQL = """
SELECT DISTINCT ON (event_id, side) event_id, side, scene_id FROM (
    SELECT s.event_id, s.scene_id, 'post' AS side, 1 AS tier, abs(s.acquired_on - f.extinct_at::DATE - 7) AS gap FROM scenes s JOIN fires f ON f.id = s.event_id
    WHERE s.cloud_cover < 45 AND s.acquired_on - f.extinct_at::DATE BETWEEN 0 AND 14
    UNION ALL SELECT s.event_id, s.scene_id, 'pre', t.tier, abs(s.acquired_on - f.start_date::DATE - t.target)
    FROM scenes s JOIN fires f ON f.id = s.event_id AND f.extinct_at IS NOT NULL JOIN (VALUES (1, -15, -7, -10), (2, -30, -15, -22)) t(tier, low, high, target) ON s.acquired_on - f.start_date::DATE BETWEEN t.low AND t.high
    WHERE s.cloud_cover < 45
) ORDER BY event_id, side, tier, gap, scene_id
"""

# The dates of the supplied scenes are far from their events, so here they are taken within some weeks of them.

AROUND = """SELECT s.event_id, s.scene_id, s.cloud_cover, s.nir, s.red, s.swir, CAST(f.start_date AS DATE) + CAST((s.event_id * 7 + s.scene_id * 11) % 60 - 30 AS INT) AS acquired_on
FROM {scenes} s JOIN {fires} f ON f.id = s.event_id"""


@query("closure_reports", ",\nnear AS (" + AROUND.format(scenes="scenes", fires="fires") + ")" + CLOSURE_SQL.format(images=IMAGES_SQL).replace("scenes s", "near s"), "fires", "scenes")
def closure_reports(spark, sf_dir):
    fires = load(spark, sf_dir, "fires")
    scenes = spark.sql(AROUND, scenes=load(spark, sf_dir, "scenes"), fires=fires)
    candidates = fires.filter("status = 'extinct' AND extinct_at IS NOT NULL AND estimated_area_hectares >= 50").select("id", "start_date", "extinct_at")
    return imagery.closure_report(candidates, monitoring.closure_images(fires, scenes, 45.0), scenes, "2001-03-01", 90)


# Metadata: every fifth image has no datatake, others lack a satellite or a tile.

KINDS = """SELECT event_id, scene_id, CASE scene_id % 4 WHEN 0 THEN 'closure_dNBR' WHEN 1 THEN 'NBR_after' WHEN 2 THEN 'carousel' END AS image_type,
    CASE event_id % 6 WHEN 0 THEN '{{"vis_type": "ndvi"}}' WHEN 1 THEN '{{"bands": ["b12", "B8A", "B4"]}}' WHEN 2 THEN '{{"bands": ["B4", "B3", "B2"]}}' WHEN 3 THEN '[1]' WHEN 4 THEN '{{"bands": "B12"}}' END AS params FROM {scenes}"""


@query("image_vis_types", f"""
SELECT event_id, scene_id, CASE WHEN scene_id % 4 = 0 THEN 'DNBR' WHEN scene_id % 4 = 1 THEN 'NBR' WHEN event_id % 6 = 0 THEN 'NDVI' WHEN event_id % 6 = 1 THEN 'NBR' ELSE 'RGB' END AS vis_type
FROM ({KINDS.format(scenes="scenes")})
""", "scenes")  # fmt: skip
def image_vis_types(spark, sf_dir):
    return spark.sql(KINDS, scenes=load(spark, sf_dir, "scenes")).select("event_id", "scene_id", imagery.vis_type(F.col("image_type"), F.col("params")).alias("vis_type"))


@query("image_metadata", """
SELECT event_id || '-' || scene_id AS image, CASE WHEN event_id % 5 <> 0 THEN acquired_on END AS acquired_on, CASE WHEN event_id % 3 = 0 THEN 'S2A' ELSE 'Sentinel-2' END AS satellite, cloud_cover::DOUBLE AS cloud_cover,
    CASE WHEN event_id % 4 = 0 THEN '20HMK' ELSE '' END AS tile
FROM scenes WHERE acquired_on >= DATE '1996-01-01' AND acquired_on < DATE '1997-01-01' AND cloud_cover < 30 ORDER BY scenes.cloud_cover, 1 LIMIT 100
""", "scenes")  # fmt: skip
def image_metadata(spark, sf_dir):
    rows = load(spark, sf_dir, "scenes").filter("acquired_on >= '1996-01-01' AND acquired_on < '1997-01-01' AND cloud_cover < 30")
    datatake = F.expr("CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 5 <> 0 THEN concat(date_format(acquired_on, 'yyyyMMdd'), 'T101559') END")
    return imagery.image_metadata(
        rows.select(imagery.image_id().alias("image"), datatake.alias("datatake"), F.col("cloud_cover").cast("double").alias("cloud_cover"), F.expr("CASE WHEN event_id % 3 = 0 THEN 'S2A' END").alias("satellite"), F.expr("CASE WHEN event_id % 4 = 0 THEN '20HMK' END").alias("tile"))
    )


# Citizens' reports: a seventh of the detections, told near where they were seen.

TOLD = "SELECT id AS report_id, lat, lon FROM {detections} WHERE id % 7 = 0"


@query("reports_fires", f""",
told AS ({TOLD.format(detections="detections")}),
until AS (SELECT f.id, max(f.start_date::DATE + (a.prohibition_years * 365)::INT) AS u FROM fires f JOIN areas a ON f.lat BETWEEN a.south AND a.north AND f.lon BETWEEN a.west AND a.east GROUP BY f.id),
near AS (
    SELECT r.report_id, f.id, {distance("r.lat", "r.lon", "f.lat", "f.lon")} AS d, row_number() OVER (PARTITION BY r.report_id ORDER BY f.start_date DESC, f.id) AS place
    FROM told r JOIN fires f ON f.lat BETWEEN r.lat - 0.02 AND r.lat + 0.02 AND f.lon BETWEEN r.lon - 0.03 AND r.lon + 0.03 WHERE d <= 1000
)
SELECT report_id, place, id, round(d, 1) AS distance, u IS NOT NULL AS in_area, u AS prohibition_until FROM near LEFT JOIN until USING (id) WHERE place <= 10
""", "detections", "fires", "areas")  # fmt: skip
def reports_fires(spark, sf_dir):
    fires = load(spark, sf_dir, "fires")
    told = spark.sql(TOLD, detections=load(spark, sf_dir, "detections"))
    return reports.related_fires(told, fires, spatial.crossing(fires, load(spark, sf_dir, "areas"), near_m=0.0))


@query("reports_areas", f""",
told AS ({TOLD.format(detections="detections")}),
near AS (
    SELECT r.report_id, a.area_id, round({distance("r.lat", "r.lon", "greatest(a.south, least(a.north, r.lat))", "greatest(a.west, least(a.east, r.lon))")}, 1) AS d
    FROM told r JOIN areas a ON r.lat BETWEEN a.south - 0.1 AND a.north + 0.1 AND r.lon BETWEEN a.west - 0.2 AND a.east + 0.2 WHERE d <= 5000
)
SELECT report_id, area_id, d AS distance, row_number() OVER (PARTITION BY report_id ORDER BY d, area_id) AS place FROM near QUALIFY place <= 5
""", "detections", "areas")  # fmt: skip
def reports_areas(spark, sf_dir):
    return reports.related_areas(spark.sql(TOLD, detections=load(spark, sf_dir, "detections")), load(spark, sf_dir, "areas"))


VIEW_BOX = (-72.0, -50.0, -62.0, -35.0)
CELL = "(floor((lat + 90) / 0.5)::BIGINT * 1000000 + floor((lon + 180) / 0.5)::BIGINT)"


@query("recurrence_in_box", f""",
v AS (
    SELECT {CELL} AS cell, count(*) AS n, count(*) FILTER (start_date::DATE >= DATE '{AS_OF}' - INTERVAL 60 MONTH) AS n5, count(*) FILTER (start_date::DATE >= DATE '{AS_OF}' - INTERVAL 12 MONTH) AS n1 FROM fires GROUP BY 1
)
SELECT cell, n, n5, n1, CASE WHEN n5 > 3 THEN 'high' WHEN n5 >= 1 THEN 'medium' ELSE 'low' END AS class, round(least(n5 / 5, 1.0), 4) AS score FROM v
WHERE cell IN (SELECT {CELL} FROM fires WHERE lon BETWEEN -72 AND -62 AND lat BETWEEN -50 AND -35)
""", "fires")  # fmt: skip
def recurrence_in_box(spark, sf_dir):
    fires = load(spark, sf_dir, "fires")
    return reports.recurrence_from_view(fires, O.recurrence_view(fires, AS_OF), VIEW_BOX)


@query("recurrence_summary", f"""
SELECT count(*) AS n_cells, coalesce(max(least(n / 10, 1.0)), 0) AS max_intensity
FROM (SELECT {CELL} AS cell, count(*) AS n FROM fires WHERE lon BETWEEN -72 AND -62 AND lat BETWEEN -50 AND -35 GROUP BY 1 ORDER BY least(count(*), 10) DESC, 1 LIMIT 500)
""", "fires")  # fmt: skip
def recurrence_summary(spark, sf_dir):
    return reports.recurrence_summary(O.recurrence(load(spark, sf_dir, "fires"), VIEW_BOX))


@query("job_states", """
SELECT l_orderkey AS job_id, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS done, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'R') AS failed,
    CASE WHEN bool_or(l_linestatus <> 'F') THEN 'running' WHEN bool_or(l_returnflag = 'R') THEN 'failed' ELSE 'ready' END AS state
FROM lineitem GROUP BY 1
""")  # fmt: skip
def job_states(spark, sf_dir):
    status = F.expr("CASE WHEN l_linestatus <> 'F' THEN 'pending' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'ready' END")
    return reports.job_states(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), status.alias("status")), "job_id")


# A user's address is its route; every thirteenth request is refused and some fail.

ANSWERED = "SELECT concat(CASE WHEN event_id % 2 = 0 THEN 'GET ' ELSE 'POST ' END, '/', event_type) AS route, value AS ms, CASE WHEN event_id % 13 = 0 THEN 404 WHEN event_id % 37 = 0 THEN 500 ELSE 200 END AS status FROM {events}"


@query("route_metrics", f"SELECT route, count(*) AS n, round(avg(ms), 2) AS avg_ms, round((count(*) FILTER (status >= 400)) / count(*), 4) AS error_rate FROM ({ANSWERED.format(events='events')}) GROUP BY route")
def route_metrics(spark, sf_dir):
    return reports.request_metrics(spark.sql(ANSWERED, events=table(spark, sf_dir, "events")))


# The map of an event's detections, ten points at most twice over; users stand for events.

PLOTTED_SQL = """,
ranked AS (SELECT user_id, lat, lon, row_number() OVER (PARTITION BY user_id ORDER BY detected_at NULLS FIRST, id) - 1 AS place FROM detections),
ends AS (SELECT user_id, count(*) AS n, min(lat) AS s, max(lat) AS t, min(lon) AS w, max(lon) AS e FROM detections GROUP BY 1),
wide AS (SELECT user_id, n, CASE WHEN s = t THEN s - 0.01::DOUBLE ELSE s END AS s, CASE WHEN s = t THEN t + 0.01::DOUBLE ELSE t END AS t, CASE WHEN w = e THEN w - 0.01::DOUBLE ELSE w END AS w, CASE WHEN w = e THEN e + 0.01::DOUBLE ELSE e END AS e FROM ends)
SELECT user_id, place, (lon - w) / (e - w) AS x, (lat - s) / (t - s) AS y FROM ranked JOIN wide USING (user_id) WHERE place % greatest(1, n // 10) = 0
UNION ALL SELECT id, 0, (lon - (lon - 0.01::DOUBLE)) / ((lon + 0.01::DOUBLE) - (lon - 0.01::DOUBLE)), (lat - (lat - 0.01::DOUBLE)) / ((lat + 0.01::DOUBLE) - (lat - 0.01::DOUBLE)) FROM fires WHERE id NOT IN (SELECT user_id FROM ends)
"""


@query("plotted_points", PLOTTED_SQL, "detections", "fires")
def plotted_points(spark, sf_dir):
    centres = load(spark, sf_dir, "fires").select(F.col("id").alias("user_id"), "lat", "lon")
    return reports.plotted_points(load(spark, sf_dir, "detections"), centres, "user_id", "detected_at", "id", most=10)


#: The queries of this module.
QUERY_NAMES = (
    "carousel_run", "report_images_annual", "report_images_monthly", "closure_reports", "image_vis_types", "image_metadata", "reports_fires", "reports_areas", "recurrence_in_box", "recurrence_summary",
    "job_states", "route_metrics", "plotted_points",
)
