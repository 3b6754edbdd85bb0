"""Every query with an oracle against DuckDB, the others against brute force; hand fixtures for the rest."""

import math
import random
from datetime import datetime
from itertools import combinations
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from pyrelake.functions import geo, scoring, text
from pyrelake.operators import fires, ingest, spatial
from pyrelake.plans import extended, imagery, records, shapes, stateful  # noqa: F401  register their queries
from pyrelake.plans.queries import ORACLE_SQL, QUERIES
from pyrelake.sources import readers, sinks
from pyrelake.sources.adapters import load
from pyrelake.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def cell(v):
    if v is None or v != v:
        return "none"
    return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def metres(a, b):
    (y1, x1), (y2, x2) = a[:2], b[:2]
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * geo.RADIUS * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def dbscan_brute(points, eps, least, window):
    near = {i: {i} for i in points}
    for i, j in combinations(points, 2):
        if metres(points[i], points[j]) <= eps and abs(points[i][2] - points[j][2]) <= window:
            near[i].add(j)
            near[j].add(i)
    core = {i for i in points if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k in core and k not in label:
                label[k] = i
                todo += near[k]
    return {i: label.get(i, min((label[k] for k in near[i] if k in core), default=None)) for i in points}


@pytest.mark.parametrize("least", [2, 3])
def test_dbscan(spark, least):
    points = {r["id"]: (r["lat"], r["lon"], r["t"]) for r in load(spark, SF, "detections").withColumn("t", spatial.seconds("detected_at")).collect()}
    chain = {10_000 + k: (-30 + k * 0.01, -60.0, 0) for k in range(6)}  # longer than eps from end to end
    points = dict(list(points.items())[:400]) | chain | {20_000: (-30.0, -60.0, 10**6), 20_001: (-30.0, -60.0, 172_800)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, lat double, lon double, t long")
    assert {r["id"]: r["label"] for r in spatial.dbscan(df, 2000, least, 172_800).collect()} == dbscan_brute(points, 2000, least, 172_800)


@pytest.mark.parametrize("least", [1, 2, 4])
def test_dbscan_crowded(spark, least, monkeypatch):
    """Crowded and empty cells, clusters that only inner points link, points in one place, parts, times with fractions, NULL positions; no pairs are written."""
    rng = random.Random(least)
    spots = [(-40 + rng.uniform(0, 0.06), -60 + rng.uniform(0, 0.08), rng.uniform(0, 400)) for _ in range(14)]
    points = [(y + rng.gauss(0, 0.004), x + rng.gauss(0, 0.005), t + rng.gauss(0, 25), rng.randrange(3) // 2) for y, x, t in spots for _ in range(45)] + [(-40.0, -60.0, 5.5, 0)] * 40
    # two crowds whose outermost points are all too far apart, but a pair of inner ones is not
    for y, up in ((60.0, 1), (60.0 + 0.0157, -1)):
        points += [(y + up * dy, 10 + dx, 7.25, 0) for dy, dx in [(0.0035, -0.01), (0.0035, 0.01), (0, -0.004), (0, 0.004), (0.007, 0.0), (0.0001, 0.0)] for _ in range(5)]
    points += [(y, 20.0, t, 0) for y, t in [(50.0, 0.0)] * 4 + [(50.001, 100.5)] * 4]  # half a second too late
    points = dict(enumerate(points))
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(5000, None, 1.0, 1.0, 0), (5001, 1.0, 1.0, None, 0)], "id long, lat double, lon double, t double, part int").repartition(4)
    sizes, write = [], spatial.written

    def seen(rows):
        sizes.append((out := write(rows)).count())
        return out

    monkeypatch.setattr(spatial, "written", seen)
    got = {r["id"]: r["label"] for r in spatial.dbscan(df, 1500, least, 100, "part").collect()}
    want = {5000: 5000, 5001: 5001} if least == 1 else {5000: None, 5001: None}
    for part in (0, 1):
        want |= dbscan_brute({i: p for i, p in points.items() if p[3] == part}, 1500, least, 100)
    assert got == want
    n_pairs = sum(a[3] == b[3] and abs(a[2] - b[2]) <= 100 and metres(a, b) <= 1500 for a, b in combinations(points.values(), 2))
    assert max(sizes) < n_pairs / 4
    labels = {i: got[i] for i, p in points.items() if p[1] == 20.0}
    assert len(set(labels.values())) == 2 and len({i for i, x in got.items() if x == i}) > 3


def test_consolidate(spark):
    f = load(spark, "/root/testdata/sf0.001", "fires")
    live = {r["id"]: r for r in f.filter("status = 'active'").collect()}
    near = {i: {i} for i in live}
    for i, j in combinations(live, 2):
        a, b = live[i], live[j]
        if abs(a["lat"] - b["lat"]) < 0.02 and metres((a["lat"], a["lon"]), (b["lat"], b["lon"])) <= 1000 and (a["province"] is None or b["province"] is None or a["province"] == b["province"]):
            if (a["start_date"].date() - b["end_date"].date()).days <= 5 and (b["start_date"].date() - a["end_date"].date()).days <= 5:
                near[i].add(j)
                near[j].add(i)
    want, done = {}, set()
    for i in sorted(live):
        group, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in group:
                group.add(k)
                todo += near[k]
        if i not in done and len(group) > 1:
            want |= {k: min(group) for k in group}
        done |= group
    assert {r["id"]: r["survivor"] for r in spatial.consolidate(f).collect()} == want


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_scalars(spark):
    ring = F.expr("from_json('[{\"lon\":0,\"lat\":0},{\"lon\":4,\"lat\":0},{\"lon\":4,\"lat\":4},{\"lon\":0,\"lat\":4}]', 'array<struct<lon:double,lat:double>>')")
    inside = [geo.in_ring(F.lit(float(y)), F.lit(float(x)), ring) for y, x in ((1, 1), (5, 1), (1, -1))]
    assert one(spark, *inside) == [True, False, False]
    assert one(spark, *[scoring.confidence(F.lit(x)) for x in ("l", "Nominal", "high", "250", "-3", "7.9", "?", None)]) == [33, 66, 100, 100, 0, 7, 0, 0]
    assert one(spark, scoring.severity(F.lit(0.4)), scoring.reliability(F.lit(80.0), F.lit(100), F.lit(100), F.lit(100))) == ["moderate_low", 92.0]
    assert str(one(spark, scoring.add_months_28(F.lit("2024-01-31").cast("date"), 1))[0]) == "2024-02-28"
    assert one(spark, text.plain(F.lit(" Córdoba ")), text.redact(F.lit("ana@x.org 10.1.2.3"))) == ["cordoba", "a***@x.org 10.1.2.***"]
    assert str(one(spark, text.decimal(F.lit("1.234,50")))[0]) == "1234.5000"
    with pytest.raises(ValueError):
        fires.public_stats(None, "2000-01-01", "2003-01-01")


def test_ingest_csv(spark, tmp_path):
    head = "latitude,longitude,brightness,bright_ti4,bright_t31,bright_ti5,confidence,acq_date,acq_time,frp,daynight,satellite,instrument,_corrupt"
    (tmp_path / "d.csv").write_text(f"{head}\n-30.0,-60.0,,330.5,,290.1,n,2024-01-05,45,1.5,D,SUOMI_VIIRS_NRT,VIIRS,\n10,10,,1,,1,h,2024-01-05,45,1,D,A,B,\n-30.0,-60.0,,1,,1,l,2024-01-05,45,1,D,A,B,\n")
    got = ingest.normalize(readers.detections_csv(spark, f"file://{tmp_path}/d.csv")).collect()
    assert [(r["satellite"], r["bt_mir"], r["confidence"], r["detected_at"]) for r in got] == [("SUOMI-VIIRS", 330.5, 66, datetime(2024, 1, 5, 0, 45))]


def test_geojson(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"fna":"Chaco"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}]}')
    r = readers.provinces(spark, f"file://{tmp_path}/g.json").withColumn("ring", readers.ring(F.col("coordinates"))).first()
    assert r["name"] == "Chaco" and [tuple(p) for p in r["ring"]] == [(0, 0), (1, 0), (1, 1)]


def test_sinks(spark, tmp_path):
    f = load(spark, SF, "fires")
    sinks.export_csv(f, f"file://{tmp_path}/csv", 50)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 50
    sinks.export_json(f, f"file://{tmp_path}/json", {"province": "x"}, "2024-01-01", 10)
    assert spark.read.json(f"file://{tmp_path}/json").selectExpr("total_records", "size(fires) AS n").first()["n"] == 10
    old, new = (spark.createDataFrame(r, "k int, v int") for r in ([(1, 1), (2, 2)], [(2, 9), (3, 3), (3, 3)]))
    assert sorted(map(tuple, sinks.upsert(old, new.distinct(), ["k"]).collect())) == [(1, 1), (2, 9), (3, 3)]
    assert [r["k"] for r in sinks.unseen(new, old, "k").collect()] == [3]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 2)), ("b", datetime(2024, 1, 2))], "detection_hash string, detected_at timestamp").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("detection_hash string, detected_at timestamp").parquet(f"file://{tmp_path}/in")
    got = []
    streams.in_batches(streams.fresh(stream), lambda b: got.extend(r["detection_hash"] for r in b.collect()), f"file://{tmp_path}/cp").awaitTermination(120)
    assert sorted(got) == ["a", "b"]
