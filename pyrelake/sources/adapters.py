"""Domain tables over the supplied test tables.

Each table is one SELECT that Spark and DuckDB read alike; ``{name}`` stands for a source table. The same text builds
the DataFrame here and the oracle's common table expression, so both sides start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DETECTIONS = """
SELECT event_id AS id, ts AS detected_at, user_id,
       -55 + CAST((user_id * 7 + event_id % 7) * 37 % 3400 AS DOUBLE) / 100 + CAST(event_id * 13 % 100 - 50 AS DOUBLE) / 10000 AS lat,
       -73 + CAST((user_id * 7 + event_id % 7) * 53 % 2000 AS DOUBLE) / 100 + CAST(event_id * 29 % 100 - 50 AS DOUBLE) / 10000 AS lon,
       value AS frp, CAST(event_id * 31 % 101 AS INT) AS confidence, event_type AS satellite
FROM {events}"""

EVENTS = """
SELECT o_orderkey AS id, o_custkey AS site_id, o_orderdate + (o_orderkey % 24) * interval '1' hour AS start_date,
       o_orderdate + (o_orderkey % 24) * interval '1' hour + (o_orderkey % 10) * interval '1' day AS end_date,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'extinct' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'monitoring' END AS status,
       CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE n_name END AS province, CASE WHEN o_custkey % 29 = 0 THEN NULL ELSE concat('Zona Ñ', CAST(o_custkey % 40 AS VARCHAR(9))) END AS department,
       coalesce(mx / 1000 > 50, false) OR o_orderkey * 31 % 101 > 80 AS is_significant,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + (o_orderkey % 10 + 1) * interval '1' day END AS last_seen_at,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + (o_orderkey % 10 + 2) * interval '1' day END AS extinct_at,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '[]' ELSE concat('[{{"n": ', CAST(o_orderkey % 3 AS VARCHAR(3)), '}}]') END AS slides_data,
       -55 + CAST(o_custkey * 37 % 3400 AS DOUBLE) / 100 + CAST(o_orderkey * 13 % 100 - 50 AS DOUBLE) / 10000 AS lat,
       -73 + CAST(o_custkey * 53 % 2000 AS DOUBLE) / 100 + CAST(o_orderkey * 29 % 100 - 50 AS DOUBLE) / 10000 AS lon,
       CAST(coalesce(n, 0) AS BIGINT) AS total_detections, mx / 1000 AS max_frp, CAST(o_orderkey * 31 % 101 AS DOUBLE) AS avg_confidence,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) / 1000 END AS estimated_area_hectares
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS mx FROM {lineitem} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey"""

AREAS = """
SELECT s_suppkey AS area_id, concat('PA_', CAST(s_suppkey AS VARCHAR(20))) AS official_name,
       -55 + CAST(s_suppkey * 37 % 3400 AS DOUBLE) / 100 - 0.3 AS south, -55 + CAST(s_suppkey * 37 % 3400 AS DOUBLE) / 100 + 0.3 AS north,
       -73 + CAST(s_suppkey * 53 % 2000 AS DOUBLE) / 100 - 0.3 AS west, -73 + CAST(s_suppkey * 53 % 2000 AS DOUBLE) / 100 + 0.3 AS east,
       CASE WHEN s_suppkey % 5 < 2 THEN 60 ELSE 30 END AS prohibition_years, CAST(100 + s_suppkey % 400 AS INT) AS carrying_capacity
FROM {supplier}"""

SCENES = """
SELECT l_orderkey AS event_id, CAST(l_linenumber AS INT) AS scene_id, CAST(l_shipdate AS DATE) AS acquired_on, l_discount * 500 AS cloud_cover,
       l_extendedprice AS nir, l_extendedprice * (1 - l_discount) * (1 - l_tax) AS swir, l_extendedprice * (0.2 + l_tax * 5) AS red
FROM {lineitem}"""

TABLES = {"detections": (DETECTIONS, ("events",)), "fires": (EVENTS, ("orders", "customer", "nation", "lineitem")), "areas": (AREAS, ("supplier",)), "scenes": (SCENES, ("lineitem",))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table."""
    sql, sources = TABLES[name]
    return spark.sql(sql, **{s: table(spark, sf_dir, s) for s in sources})


def oracle(*names: str) -> str:
    """WITH clause that defines the domain tables for the oracle."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n][0].format(**{s: s for s in TABLES[n][1]})})" for n in names)
