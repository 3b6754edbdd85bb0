"""Streams with state, restarts, merges into stored tables: what the oracles do not reach."""

import os
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pyrelake.operators import increments, series
from pyrelake.streaming import state

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def times(*seconds):
    return [datetime(2024, 1, 1) + timedelta(seconds=s) for s in seconds]


def requests(spark, rows):
    """rows: (ip, seconds, id, hash)"""
    data = [(ip, times(s)[0], i, h) for ip, s, i, h in rows]
    return spark.createDataFrame(data, "ip string, ts timestamp, id long, hash string")


def test_tenth_eleventh_and_boundary(spark):
    """Ten go through, the eleventh does not and is not recorded; a time exactly one window old still counts."""
    rows = [("a", s, s, "") for s in range(11)] + [("a", 60, 60, ""), ("a", 61, 61, ""), ("b", 5, 100, ""), (None, 5, 101, ""), (None, 5, 102, "")]
    got = {r["id"]: r["outcome"] for r in state.sliding_limit(requests(spark, rows), "ip", "ts", "id").collect()}
    assert [got[i] for i in range(11)] == ["allowed"] * 10 + ["limited"]
    assert (got[60], got[61], got[100], got[101], got[102]) == ("limited", "allowed", "allowed", "allowed", "allowed")
    assert state.sliding_limit(requests(spark, []), "ip", "ts", "id").collect() == []


def test_idempotent(spark):
    rows = [("k", 0, 1, "x"), ("k", 10, 2, "x"), ("k", 20, 3, "y"), ("k", 86399, 4, "x"), ("k", 86400, 5, "y"), ("k", 86401, 6, "x"), ("j", 0, 7, None)]
    got = {r["id"]: r["outcome"] for r in state.idempotent(requests(spark, rows), ["ip"], "ts", "id", "hash").collect()}
    assert got == {1: "new", 2: "replayed", 3: "conflict", 4: "replayed", 5: "new", 6: "conflict", 7: "new"}


@pytest.mark.parametrize("form", ["limit", "idempotent"])
def test_stream_restarts(spark, tmp_path, form):
    """Rows in two runs of a stream, restarted from its checkpoint, come out as in one batch."""
    rows = [("a", s, s, "x") for s in (0, 1, 2, 3, 30, 61, 62, 63, 64)] + [("b", 2, 100, "x"), ("b", 50, 101, "y"), ("b", 103, 102, "y")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    try:
        for part in (rows[:4] + rows[9:10], rows[4:9] + rows[10:]):
            requests(spark, part).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema("ip string, ts timestamp, id long, hash string").parquet(source)
            if form == "limit":
                got = state.sliding_limit_stream(stream, "ip", "ts", "id", limit=3, window_s=60, late="1 hour")
            else:
                got = state.idempotent_stream(stream, "ip", "ts", "id", "hash", ttl_s=60, late="1 hour")
            q = got.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = requests(spark, rows)
    want = state.sliding_limit(batch, "ip", "ts", "id", 3, 60) if form == "limit" else state.idempotent(batch, ["ip"], "ts", "id", "hash", 60)
    ids = lambda df: sorted((r["id"], r["outcome"]) for r in df.collect())
    assert ids(spark.read.parquet(out)) == ids(want)
    assert len({o for _, o in ids(want)}) > 1


def test_replay_guard(spark):
    rows = [("c", times(0)[0], times(300)[0], 1), ("c", times(1)[0], times(302)[0], 2), ("c", times(2)[0], times(2)[0], 3), ("d", times(2)[0], None, 4)]
    calls = spark.createDataFrame(rows, "call string, at timestamp, signed timestamp, id long")
    got = {r["id"]: r["outcome"] for r in state.replay_guard(calls, "call", "at", "signed", "id").collect()}
    assert got == {1: "accepted", 2: "stale", 3: "duplicate", 4: "stale"}


def test_pending_reads_what_is_new(spark):
    rows = [(i, datetime(2024, 1, 1 + i // 4), -30.0 - i % 2, -60.0, None if i % 3 else 80) for i in range(8)]
    detections = spark.createDataFrame(rows, "id long, detected_at timestamp_ntz, lat double, lon double, confidence int")
    done = spark.createDataFrame([(4, None, datetime(2024, 1, 2))], "id long, event_id long, detected_at timestamp_ntz")
    got = increments.cluster_pending(detections, done, 1000.0, 2, 3600, since="2024-01-02")
    assert sorted((r["id"], r["event_id"]) for r in got.collect()) == [(5, 5), (6, None), (7, 5)]  # 4 was noise and stays so
    again = done.union(got)
    assert increments.cluster_pending(detections, again, 1000.0, 2, 3600, since="2024-01-02").count() == 0
    flagged = increments.clear_processed(again, spark.createDataFrame([(5,)], "id long"))
    assert sorted(r["id"] for r in flagged.collect()) == [4, 6]


def test_merge_touches_only_its_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(i, f"v{i}", i % 4) for i in range(40)]
    increments.rebuild(path, spark.createDataFrame(rows, "id long, v string, p int"), "p", truncate=True)
    files = lambda p: {f: os.stat(f"{path}/p={p}/{f}").st_mtime_ns for f in os.listdir(f"{path}/p={p}") if f.endswith(".parquet")}
    before = {p: files(p) for p in range(4)}
    new = spark.createDataFrame([(1, "new", 1), (41, "added", 1)], "id long, v string, p int")
    for _ in range(2):  # a rerun changes nothing
        increments.merge_into(spark, path, new, ["id"], "p")
        want = {i: v for i, v, _ in rows} | {1: "new", 41: "added"}
        assert {r["id"]: r["v"] for r in spark.read.parquet(path).collect()} == want
        assert spark.read.parquet(path).count() == len(want)
    assert {p: files(p) for p in (0, 2, 3)} == {p: before[p] for p in (0, 2, 3)}
    assert files(1) != before[1]
    increments.merge_into(spark, path, new.limit(0), ["id"], "p")
    increments.rebuild(path, new, "p", truncate=False)
    assert spark.read.parquet(path).count() == 43
    increments.rebuild(path, new, "p", truncate=True)
    assert spark.read.parquet(path).count() == 2


def test_refresh_reads_affected_events_only(spark):
    schema = "id long, lat double, lon double, status string, start_date timestamp_ntz, end_date timestamp_ntz, total_detections long, max_frp double"
    at = datetime(2024, 1, 1)
    old = spark.createDataFrame([(i, 1.0 * i, 2.0, None, at, at, 1, 3.0) for i in range(6)], schema)
    new = old.withColumn("lat", F.when(F.col("id") == 0, 9.0).otherwise(F.col("lat"))).withColumn("status", F.when(F.col("id") == 5, "false_positive"))
    bridge = spark.createDataFrame([("x", 0), ("x", 1), ("y", 2), ("y", 3), ("z", 5)], "episode_id string, event_id long")
    changed = increments.changed_events(old, new)
    assert sorted(r["id"] for r in changed.collect()) == [0, 5]
    affected = increments.affected_episodes(changed, bridge)
    assert sorted(r[0] for r in affected.collect()) == ["x", "z"]
    poisoned = new.withColumn("lat", F.when(F.col("id").isin(2, 3), F.lit(77.0)).otherwise(F.col("lat")))
    got = {r["episode_id"]: r for r in increments.refreshed(increments.episode_metrics(old, bridge), poisoned, bridge, affected).collect()}
    assert (got["x"]["centre_lat"], got["y"]["centre_lat"], got["z"]["n_events"], got["z"]["centre_lat"]) == (5.0, 2.5, 0, None)


def test_targets_keep_the_28th(spark):
    rows = [(date(2023, 1, 31), 1, 1), (date(2023, 1, 31), 2, 1), (date(2023, 3, 31), 1, 1), (date(2024, 1, 29), 1, 1), (date(2023, 1, 29), 3, 1), (date(2023, 12, 15), 1, 1), (date(2024, 2, 29), 1, 12), (date(2024, 2, 29), 4, 12), (date(2023, 5, 31), 0, 1)]
    df = spark.createDataFrame(rows, "start date, k int, step int")
    got = [r[0] for r in df.select(series.targets(F.col("start"), F.col("k"), F.col("step"))).collect()]
    want = ["2023-02-28", "2023-03-28", "2023-04-28", "2024-02-29", "2023-04-28", "2024-01-15", "2025-02-28", "2028-02-28", "2023-05-31"]
    assert [str(d) for d in got] == want


def test_annual_series(spark):
    fires = spark.createDataFrame([(1, datetime(2020, 3, 10))], "id long, start_date timestamp_ntz")
    rows = [(1, 1, date(2020, 3, 1), 24.0), (1, 2, date(2020, 2, 20), 5.0), (1, 3, date(2020, 3, 10), 0.0), (1, 4, date(2021, 3, 1), 29.0), (1, 5, date(2021, 3, 12), 31.0), (1, 6, date(2022, 4, 9), 1.0), (1, 7, date(2022, 4, 10), 1.0)]
    scenes = spark.createDataFrame(rows, "event_id long, scene_id int, acquired_on date, cloud_cover double")
    got = {r["year"]: r["scene_id"] for r in series.annual_series(fires, scenes, 5, "2023-03-10").collect()}
    assert got == {0: 2, 1: 4, 2: 6, 3: None}


def test_area_images_brute(spark):
    """Spans across stretches, days without dates, repeated images, events on an edge and in two areas; images never meet events one by one."""
    rng, start = random.Random(3), date(2020, 1, 1)
    days = lambda n: start + timedelta(days=n)
    areas = [("a", 0.0, 1.0, 0.0, 1.0), ("b", 0.5, 1.5, 0.5, 1.5), ("far", 5.0, 6.0, 5.0, 6.0), ("day", -0.6, -0.4, -0.6, -0.4)]
    fires = [(k, rng.choice((0.0, 0.7, 1.0, 1.4)), rng.choice((0.0, 0.7, 1.5)), None if k % 9 == 0 else datetime.combine(days(rng.randrange(-20, 60)), datetime.min.time())) for k in range(60)]
    fires += [(100 + k, -0.5, -0.5, datetime(2020, 1, 1, 12)) for k in range(3000)] + [(7777, None, 0.5, datetime(2020, 1, 1))]
    scenes = [(rng.randrange(70), k % 5, None if k % 17 == 0 else days(rng.randrange(-30, 80)), 1.0) for k in range(300)] + [(100 + k, 1, days(3), 1.0) for k in range(3000)]
    want = {}
    where = {k: {a for a, south, north, west, east in areas if lat is not None and south <= lat <= north and west <= lon <= east} for k, lat, lon, _ in fires}
    taken = {a: Counter(d for k, _, d, _ in scenes if d and a in where.get(k, ())) for a, *_ in areas}
    for k, _, _, at in fires:
        for a in where[k] if at else ():
            hits = {d: n for d, n in taken[a].items() if at.date() <= d <= at.date() + timedelta(days=5)}
            if hits:
                want[a, k] = (sum(hits.values()), min(hits), max(hits))
    frames = spark.createDataFrame(scenes, "event_id long, scene_id int, acquired_on date, cloud_cover double"), spark.createDataFrame(fires, "id long, lat double, lon double, start_date timestamp_ntz"), spark.createDataFrame(areas, "area_id string, south double, north double, west double, east double")
    for stretch in (7, 512):
        rows = series.area_images(*frames, days=5, stretch=stretch)
        got = [((r["area_id"], r["id"]), tuple(r)[2:]) for r in rows.collect()]
        assert len(got) == len(want) and dict(got) == want
    assert want["day", 100] == (3000, days(3), days(3))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join [area_id" not in plan and "BroadcastHashJoin [gy" not in plan


def test_no_nested_loops(spark):
    from pyrelake.plans.queries import QUERIES

    for name in ("area_images", "image_series", "refreshed_episodes"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
