"""Image selection, report images and citizens' reports by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pyrelake.operators import imagery, reports
from pyrelake.plans.imagery import QUERY_NAMES
from pyrelake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCENES = "event_id long, scene_id int, acquired_on date, cloud_cover double, nir double, red double, swir double"
EPISODES = "episode_id string, status string, candidate boolean, priority int, start_date timestamp_ntz, lat double, lon double, last_image string"
FIRES = "id long, status string, start_date timestamp_ntz, end_date timestamp_ntz"


def scene(event, number, day, cloud):
    return (event, number, date.fromisoformat(day), cloud, 3.0, 1.0, 1.0)


def test_selected_images(spark):
    rows = [
        scene(1, 1, "2024-05-08", 25.0), scene(1, 2, "2024-05-07", 12.0), scene(1, 3, "2024-05-10", 1.0), scene(1, 4, "2024-05-02", 0.0),
        scene(2, 1, "2024-05-01", 29.0), scene(2, 2, "2024-04-12", 29.9), scene(2, 3, "2024-04-11", 30.0), scene(2, 4, "2024-04-09", 1.0),
        scene(3, 1, "2024-05-09", 50.0), scene(4, 1, "2024-05-03", 10.0), scene(4, 2, "2024-05-03", 10.0), scene(5, 1, "2024-05-09", None),
    ]
    got = {r["event_id"]: tuple(r)[1:] for r in imagery.selected_images(spark.createDataFrame(rows, SCENES), "event_id", "2024-05-10").collect()}
    assert got == {1: ("1-2", 20, False), 2: ("2-2", 30, True), 4: ("4-1", 20, False)}


def test_carousel_outcomes(spark):
    at = datetime(2024, 5, 1)
    episodes = [
        ("a", "active", True, 9, at, 1.0, 1.0, None), ("b", "monitoring", True, 8, at, 1.0, 1.0, "2-1"), ("c", "active", True, 7, at, None, 1.0, None), ("d", "active", True, 6, at, 1.0, 1.0, None),
        ("5", "active", True, None, at, 1.0, 1.0, None), ("e", "extinct", True, 99, at, 1.0, 1.0, None), ("f", "active", False, 99, at, 1.0, 1.0, None), ("g", "active", True, None, None, 1.0, 1.0, None),
    ]
    fires = [(1, "extinct", at, datetime(2024, 5, 9)), (2, "active", at, None), (3, "active", at, at), (5, None, at, None)]
    bridge = [("a", 1), ("a", 3), ("b", 2)]
    tables = spark.createDataFrame(episodes, EPISODES), spark.createDataFrame(bridge, "episode_id string, event_id long"), spark.createDataFrame(fires, FIRES), spark.createDataFrame([scene(1, 1, "2024-05-09", 5.0), scene(2, 1, "2024-05-09", 5.0)], SCENES)
    run = lambda **o: {r["episode_id"]: (r["outcome"], r["event_id"]) for r in imagery.carousel(*tables, "2024-05-10", **({"most": 5} | o)).collect()}
    want = {"a": ("updated", 3), "b": ("no_change", 2), "c": ("missing_centroid", None), "d": ("missing_event", None), "5": ("no_image", 5)}
    assert run() == want
    assert run(force=True)["b"] == ("updated", 2)
    assert run(most=2).keys() == {"a", "b"}
    assert run(most=9).keys() == want.keys() | {"g"}


def test_report_images_make_room(spark):
    """The image before takes one of two places; without it, both are for years, and each has its second image."""
    fires = spark.createDataFrame([(1, datetime(2020, 2, 29)), (2, datetime(2020, 2, 29)), (3, datetime(2020, 1, 1))], "id long, start_date timestamp_ntz")
    years = [scene(e, 10 + k, f"{2020 + k}-02-28", 0.0) for e in (1, 2) for k in (1, 2, 3)]
    scenes = spark.createDataFrame([scene(1, 1, "2020-02-14", 0.0), scene(2, 1, "2020-03-15", 0.0), *years], SCENES)
    got = [(r["event_id"], r["place"], r["vis_type"], r["image"], r["ndvi"]) for r in imagery.report_images(fires, scenes, "2021-12-31", most=2).orderBy("event_id", "place").collect()]
    assert got == [(1, 0, "RGB", "1-1", 0.5), (1, 2, "RGB", "1-11", 0.5), (1, 3, "NDVI", "1-11", None), (2, 2, "RGB", "2-11", 0.5), (2, 3, "NDVI", "2-11", None)]
    later = imagery.report_images(fires, scenes, "2024-01-01", most=2, ndvi=False).filter("NOT is_before").collect()
    assert sorted(r["image"] for r in later) == ["1-11", "2-11", "2-12"]


@pytest.mark.parametrize("start, months, want", [("2023-01-31", 1, "2023-02-28"), ("2024-01-30", 1, "2024-02-28"), ("2024-01-29", 1, "2024-02-29"), ("2023-10-31", 13, "2024-11-28"), ("2023-12-31", 1, "2024-01-31")])
def test_month_after(spark, start, months, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(imagery.month_after(F.lit(start).cast("date"), months)).first()[0] == date.fromisoformat(want)


def test_closure_report(spark):
    at, out = datetime(2024, 1, 10), datetime(2024, 1, 20)
    candidates = spark.createDataFrame([(1, at, out), (2, at, out), (3, at, datetime(2024, 3, 1))], "id long, start_date timestamp_ntz, extinct_at timestamp_ntz")
    scenes = spark.createDataFrame([(1, 1, date(2024, 1, 1), 5.0, 3.0, 1.0, 1.0), (1, 2, date(2024, 1, 27), 25.0, 1.0, 1.0, 1.0), (2, 1, date(2024, 1, 1), 5.0, 0.0, 0.0, 0.0)], SCENES)
    images = spark.createDataFrame([(1, "pre", 1), (1, "post", 2), (2, "pre", 1)], "event_id long, side string, scene_id int")
    got = {r["id"]: tuple(r)[1:] for r in imagery.closure_report(candidates, images, scenes, "2024-04-19", 90).collect()}
    assert got == {1: ("updated", 0.5, "moderate_high", "DNBR:1-1:1-2", "fair", 17), 2: ("incomplete", *[None] * 5), 3: ("waiting", *[None] * 5)}
    assert imagery.closure_report(candidates.limit(0), images, scenes, "2024-04-19", 90).count() == 0


def test_related_across_cells_and_top(spark):
    """Twelve events beside a grid line: the ten latest; one is in two areas and is listed once."""
    told = spark.createDataFrame([(1, -40.0001, -70.0001), (2, None, None), (3, 10.0, 10.0)], "report_id long, lat double, lon double")
    fires = spark.createDataFrame([(i, -40.0 + 0.0001 * i, -70.0 + 0.0001 * i, datetime(2024, 1, 1 + i // 2)) for i in range(12)] + [(99, -40.02, -70.0, datetime(2025, 1, 1))], "id long, lat double, lon double, start_date timestamp_ntz")
    crossings = spark.createDataFrame([(11, date(2050, 1, 1)), (11, date(2080, 1, 1))], "id long, prohibition_until date")
    got = reports.related_fires(told, fires, crossings).orderBy("report_id", "place").collect()
    assert [(r["report_id"], r["id"]) for r in got] == [(1, i) for i in (10, 11, 8, 9, 6, 7, 4, 5, 2, 3)]
    assert [(r["in_area"], r["prohibition_until"]) for r in got[:2]] == [(False, None), (True, date(2080, 1, 1))]


def test_no_nested_loops(spark):
    for name in QUERY_NAMES:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_results_hold_all_cases(spark):
    """The registered queries meet every outcome that their rules name."""
    seen = lambda name, c: {r[0] for r in QUERIES[name](spark, SF).select(c).distinct().collect()}
    assert seen("carousel_run", "outcome") >= {"missing_centroid", "no_image", "no_change", "updated"}
    assert seen("closure_reports", "outcome") == {"updated", "incomplete", "waiting"}
    assert seen("job_states", "state") == {"running", "failed", "ready"}
    assert seen("image_vis_types", "vis_type") == {"DNBR", "NBR", "NDVI", "RGB"}
    assert all(QUERIES[name](spark, SF).limit(1).count() for name in QUERY_NAMES)


def test_plotted_points(spark):
    """Every second of four points in time order (one without a time first), a flat axis in the middle, a centre for keys without located points."""
    rows = [(1, 10, "2020-01-02", 0.0, 5.0), (1, 11, "2020-01-01", 2.0, 5.0), (1, 12, None, 1.0, 5.0), (1, 13, "2020-01-02", 4.0, 5.0), (1, 14, "2020-01-03", None, 9.0), (2, 15, "2020-01-01", None, None)]
    points = spark.createDataFrame(rows, "event long, id long, at string, lat double, lon double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    centres = spark.createDataFrame([(1, 7.0, 7.0), (2, 3.0, 4.0), (3, None, 4.0)], "event long, lat double, lon double")
    got = sorted(map(tuple, reports.plotted_points(points, centres, "event", "at", "id", most=2).collect()))
    assert [r[:2] for r in got] == [(1, 0), (1, 2), (2, 0)]
    assert [r[2:] for r in got] == [pytest.approx(p) for p in ((0.5, 0.25), (0.5, 0.0), (0.5, 0.5))]
    assert reports.plotted_points(points.limit(0), centres.limit(0), "event", "at", "id").count() == 0
