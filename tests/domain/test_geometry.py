"""Shapes by hand and by brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pyrelake.operators import geometry
from pyrelake.plans import shapes

POINT = "struct<lon: double, lat: double>"


def ring(points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def test_hull_brute():
    rng = random.Random(1)
    for n in (3, 4, 8, 30):
        points = [(rng.randrange(12), rng.randrange(12)) for _ in range(n)]
        got = geometry.hull(points)
        inside = lambda p: all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for a, b in zip(got, got[1:] + got[:1], strict=True))
        assert len(got) < 3 or all(map(inside, points))
        assert set(got) <= set(points)
        assert len(got) < 3 or all((b[0] - a[0]) * (c[1] - a[1]) != (b[1] - a[1]) * (c[0] - a[0]) for a, b, c in zip(got, got[1:] + got[:1], got[2:] + got[:2], strict=True))


def test_perimeters_by_hand(spark):
    """One point, two, two in one place, three in one place, three in a line, a square in many rows, NULL positions and keys."""
    rows = [("one", 0.0, 0.0), ("two", 0.0, 0.0), ("two", 0.01, 0.0), ("twice", 1.0, 1.0), ("twice", 1.0, 1.0)] + [("same", 2.0, 2.0)] * 3 + [("line", 0.0, 0.0), ("line", 0.01, 0.0), ("line", 0.02, 0.0)]
    rows += [("square", x / 1000, y / 1000) for x in range(21) for y in range(21)] * 5 + [("one", None, 1.0), (None, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, lon double, lat double").repartition(7)
    got = {r["k"]: (r["n"], r["kind"], r["hectares"]) for r in geometry.perimeters(df, "k").collect()}
    circle = lambda r: 16 * math.sin(math.pi / 16) * r * r / 1e4
    degree = geometry.RADIUS * math.pi / 180
    assert got["one"] == (1, "circle", round(circle(375), 2)) == got[None]
    assert got["two"] == (2, "strip", pytest.approx(0.01 * degree * 400 / 1e4 + circle(200), abs=0.01))
    assert got["twice"] == (2, "strip", round(circle(200), 2))
    assert got["same"] == (3, "circle", round(circle(375), 2))
    assert got["line"] == (3, "strip", pytest.approx(0.02 * degree * 400 / 1e4 + circle(200), abs=0.01))
    assert got["square"] == (2205, "hull", pytest.approx((0.02 * degree) ** 2 / 1e4, rel=1e-3))
    assert geometry.perimeters(df.limit(0), "k").collect() == []


def test_hulls_of_many_keys(spark):
    """A circle of more points than a task gathers, beside many small keys; no call of Python for each key."""
    circle = [(math.cos(k / 3000 * math.tau), math.sin(k / 3000 * math.tau)) for k in range(3000)]
    rows = [(-1, x * r, y * r) for r in (1.0, 0.5) for x, y in circle] + [(k, float(x), float(x * x)) for k in range(5000) for x in range(4)] + [(None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k long, lon double, lat double").repartition(5)
    out = geometry.hulls(df, "k")
    got = {r["k"]: (r["n"], {tuple(c) for c in r["corners"]}) for r in out.collect()}
    assert len(got) == 5002 and got[None] == (1, {(1.0, 2.0)})
    assert got[-1] == (6000, set(geometry.hull(circle))) and len(got[-1][1]) == 3000
    assert all(got[k] == (4, {(float(x), float(x * x)) for x in range(4)}) for k in range(5000))
    plan = out._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "FlatMapGroups" not in plan


def test_projected_area(spark):
    """Within half a percent of the area on the sphere, holes and parts counted by sign."""
    for row in shapes.area_hectares(spark, "/root/testdata/sf0.001").join(shapes.polygons(spark, "/root/testdata/sf0.001"), "area_id").collect():
        want = 0
        for sign, r in zip(row["signs"], row["rings"], strict=True):
            p = [(math.radians(c["lon"]), math.radians(c["lat"])) for c in r]
            want += sign * abs(sum((b[0] - a[0]) * (math.sin(a[1]) + math.sin(b[1])) for a, b in zip(p, p[1:] + p[:1], strict=True))) * geometry.AUTHALIC**2 / 2e4
        assert row["hectares"] == pytest.approx(want, rel=0.005)


def test_projected_point(spark):
    """On the central meridian there is no easting, and a degree of latitude at the equator is 110,574 m."""
    df = spark.range(1).select(*[c.alias(n) for n, c in zip("xy", geometry.projected(F.lit(1.0), F.lit(-57.0), F.lit(-57.0)), strict=True)])
    x, y = df.first()
    assert x == 0 and y == pytest.approx(0.9996 * 110574.4, abs=1)


def test_simplified(spark):
    noisy = [(x / 100, 0.00001 * (x % 2)) for x in range(100)] + [(1.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([(1, [ring(noisy), ring([(0, 0), (0.00001, 0), (0, 0.00001)])]), (2, []), (3, None)], f"id long, rings array<array<{POINT}>>")
    got = {r["id"]: r["rings"] for r in geometry.simplified(df, 0.001).collect()}
    assert [(p["lon"], p["lat"]) for p in got[1][0]] == [(0.0, 0.0), (0.99, 0.00001), (1.0, 1.0), (0.0, 1.0)] or len(got[1][0]) <= 5
    assert len(got[1][1]) == 3 and got[2] == [] and got[3] is None


def test_polygon_distance(spark):
    """Inside, in the hole, in the second part, near and far."""
    rings = [ring([(0, 0), (1, 0), (1, 1), (0, 1)]), ring([(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]), ring([(2, 0), (3, 0), (3, 1)])]
    areas = spark.createDataFrame([(7, rings)], f"area_id long, rings array<array<{POINT}>>")
    points = spark.createDataFrame([(1, 0.2, 0.2), (2, 0.5, 0.5), (3, 0.2, 2.8), (4, 1.03, 0.5), (5, 1.2, 0.5), (6, 0.5, 0.41)], "id long, lat double, lon double")
    got = {r["id"]: (r["is_inside"], r["distance"]) for r in geometry.near_polygons(points, areas, 5000.0).collect()}
    degree = geometry.RADIUS * math.pi / 180
    assert got[1] == (True, 0.0) and got[3] == (True, 0.0)
    assert got[4] == (False, pytest.approx(0.03 * degree, rel=1e-6))
    assert got[6] == (False, pytest.approx(0.01 * degree, rel=1e-3))
    assert 2 not in got and 5 not in got  # 11 km from the hole's edge
    wider = {r["id"]: r["distance"] for r in geometry.near_polygons(points, areas, 12_000.0).collect()}
    assert wider[2] == pytest.approx(0.1 * degree, rel=1e-3)


def test_polygon_far_north(spark):
    """4.9 km are more than a degree of longitude there."""
    areas = spark.createDataFrame([(7, [ring([(0, 88), (1, 88), (1, 88.1), (0, 88.1)])])], f"area_id long, rings array<array<{POINT}>>")
    points = spark.createDataFrame([(1, 88.05, 1 + lon) for lon in (1.27, 1.4)], "id long, lat double, lon double").selectExpr("monotonically_increasing_id() AS id", "lat", "lon").coalesce(1)
    rows = geometry.near_polygons(points, areas, 5000.0)
    assert [r["distance"] for r in rows.collect()] == [pytest.approx(1.27 * math.cos(math.radians(88.05)) * geometry.RADIUS * math.pi / 180, rel=1e-6)]


def test_polygons_meet_by_box(spark):
    """Only pairs within reach of a box are measured, in a join that broadcasts no table of areas by cell."""
    plan = shapes.near_polygons(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [gy" in plan and "lon#" in plan[(at := plan.index("SortMergeJoin [gy")) : plan.index("\n", at)]


def test_extent_modes(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.03), (3, None, None)], "id long, lat double, lon double").selectExpr("*", "timestamp_ntz'2024-01-01' AS start_date", "timestamp_ntz'2024-01-02' AS end_date")
    box = spark.sql("SELECT 'e' AS episode_id, 0.0D AS centre_lat, 0.02D AS centre_lon, -0.01D AS south, 0.01D AS north, 0.01D AS west, 0.03D AS east, timestamp_ntz'2024-01-05' AS start_date, timestamp_ntz'2024-01-06' AS end_date")
    near = lambda mode, reach, hours, buffer: {r["id"]: round(r["distance"]) for r in geometry.near_extents(points, box, reach, hours, mode, buffer).collect()}
    assert near("centroid", 2500, 72, 0) == {1: 2224, 2: 1112}
    assert near("centroid", 2500, 71, 0) == {}
    assert near("buffer", 1000, 72, 1500) == {1: 724, 2: 0}
    assert near("box", 700, 72, 500) == {1: 613, 2: 0}
    with pytest.raises(ValueError):
        geometry.extent_distance("hexagon", 0)
