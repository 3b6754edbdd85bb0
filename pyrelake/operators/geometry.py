"""Geometry: points near extents, polygons of several rings, hulls and perimeters, projected areas, simplification.

Points have one grid cell, extents all that they cover with a margin, so each pair meets once, in the cell of its point.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import DEGREE, RADIUS, haversine
from ..sources.shipping import ship
from .spatial import covered

#: Fixed value: metres a degree where extents are grown by a buffer.
GROWN_DEGREE = 111_320.0
#: Radius of the sphere with the earth's surface.
AUTHALIC = 6_371_007.2
#: Corners that span less than this many square degrees (a hundredth of a square metre) lie in one line.
FLAT = 1e-12
#: A circle is drawn with this many corners.
CORNERS = 32
#: Points of one key that a task gathers before their hull replaces them.
GATHERED = 4096


# Points and extents


def extent_distance(mode: str, buffer_m: float) -> Column:
    """Metres from a point (lat, lon) to an extent: to its centre, to that less a buffer, or to its box grown by the buffer."""
    lat, lon = F.col("lat"), F.col("lon")
    if mode == "box":
        dy, dx = buffer_m / GROWN_DEGREE, F.lit(buffer_m / GROWN_DEGREE) / F.greatest(F.cos(F.radians(lat)), F.lit(0.1))
        return haversine(lat, lon, F.greatest(F.col("south") - dy, F.least(F.col("north") + dy, lat)), F.greatest(F.col("west") - dx, F.least(F.col("east") + dx, lon)))
    centre = haversine(lat, lon, F.col("centre_lat"), F.col("centre_lon"))
    if mode == "buffer":
        return F.greatest(centre - buffer_m, F.lit(0.0))
    if mode == "centroid":
        return centre
    raise ValueError(f"no distance {mode}")


def near_extents(points: DataFrame, extents: DataFrame, reach_m: float, hours: int, mode: str = "centroid", buffer_m: float = 0.0, size: float = 0.1) -> DataFrame:
    """(id, episode_id, distance): points and extents within ``reach_m`` whose spans meet within ``hours``.

    points: id, lat, lon, start_date, end_date. extents: episode_id, centre, box, start_date, end_date. NULL positions are near nothing.
    """
    box = mode == "box"
    sides = {s: F.col(s if box else f"centre_{'lat' if s in ('south', 'north') else 'lon'}") for s in ("south", "north", "west", "east")}
    margin = (reach_m + (0.0 if mode == "centroid" else buffer_m)) / DEGREE
    wide = F.lit(margin) / F.greatest(F.cos(F.radians(F.greatest(F.abs(sides["south"]), F.abs(sides["north"])) + margin)), F.lit(0.01))
    e = extents.filter(F.col("centre_lat").isNotNull()).select(
        "episode_id", "centre_lat", "centre_lon", "south", "north", "west", "east", F.col("start_date").alias("from_date"), F.col("end_date").alias("to_date"),
        F.struct((sides["south"] - margin).alias("south"), (sides["north"] + margin).alias("north"), (sides["west"] - wide).alias("west"), (sides["east"] + wide).alias("east")).alias("reach"),
    )
    span = lambda lo, hi, base: F.explode(F.sequence(F.floor((F.col(f"reach.{lo}") + base) / size).cast("long"), F.floor((F.col(f"reach.{hi}") + base) / size).cast("long")))
    e = e.withColumn("gy", span("south", "north", 90)).withColumn("gx", span("west", "east", 180)).drop("reach")
    p = points.select("id", "lat", "lon", "start_date", "end_date", F.floor((F.col("lat") + 90) / size).cast("long").alias("gy"), F.floor((F.col("lon") + 180) / size).cast("long").alias("gx"))
    apart = F.make_dt_interval(hours=F.lit(hours))
    meets = (F.col("start_date") <= F.col("to_date") + apart) & (F.col("end_date") >= F.col("from_date") - apart)
    rows = p.join(e, ["gy", "gx"]).filter(meets).withColumn("distance", extent_distance(mode, buffer_m))
    return rows.filter(F.col("distance") <= reach_m).select("id", "episode_id", "distance")


# Polygons of several rings


def edges(rings: Column) -> Column:
    """All edges (p, q) of rings, arrays of (lon, lat); the last corner joins the first."""
    around = lambda r: F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    return F.flatten(F.transform(rings, lambda r: F.zip_with(r, around(r), lambda p, q: F.struct(p.alias("p"), q.alias("q")))))


def ring_distances(lat: np.ndarray, lon: np.ndarray, n_sides: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is_inside, metres) of points to polygons; ``sides`` (px, py, qx, qy) has the ``n_sides`` of each point's polygon one after another.

    Even-odd over all rings: holes are out, islands in holes and further parts are in, at distance 0. Others: to the nearest
    edge, on the plane that touches the earth at the point, for short distances.
    """
    starts = np.cumsum(n_sides) - n_sides
    px, py, qx, qy = sides.T
    y, x = np.repeat(lat, n_sides), np.repeat(lon, n_sides)
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = ((py > y) != (qy > y)) & (x < (qx - px) * (y - py) / (qy - py) + px)
        inside = np.add.reduceat(crosses, starts, dtype=np.int64) % 2 == 1
        far = np.zeros(len(lat))
        if not inside.all():
            out = np.repeat(~inside, n_sides)
            px, py, qx, qy, y, x = (c[out] for c in (px, py, qx, qy, y, x))
            metres = RADIUS * math.pi / 180
            wide = np.cos(np.radians(y)) * metres
            ax, ay, dx, dy = (px - x) * wide, (py - y) * metres, (qx - px) * wide, (qy - py) * metres
            square = dx * dx + dy * dy
            t = np.where(square == 0, 0.0, np.clip(-(ax * dx + ay * dy) / square, 0.0, 1.0))
            n = n_sides[~inside]
            far[~inside] = np.fmin.reduceat(np.sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2), np.cumsum(n) - n)
    return inside, far


def near_polygons(points: DataFrame, areas: DataFrame, near_m: float = 5000.0, size: float = 0.25) -> DataFrame:
    """(id, area_id, is_inside, distance): points in or within ``near_m`` of areas (area_id, rings); 0 inside.

    A point meets the areas whose box, grown by ``near_m``, holds it; batches of such pairs are measured in columns. The join
    is a merge join: an area is in many cells with all its edges, which Spark would take for small.
    """
    ship(points.sparkSession)
    flat = lambda c: F.transform(F.flatten("rings"), lambda p: p[c])
    sides = F.flatten(F.transform(edges(F.col("rings")), lambda e: F.array(e["p"]["lon"], e["p"]["lat"], e["q"]["lon"], e["q"]["lat"])))
    boxed = areas.select("area_id", sides.alias("sides"), *[f(flat(c)).alias(n) for f, c, n in ((F.array_min, "lat", "south"), (F.array_max, "lat", "north"), (F.array_min, "lon", "west"), (F.array_max, "lon", "east"))])
    high = near_m / DEGREE
    wide = F.lit(high) / F.greatest(F.cos(F.radians(F.greatest(F.abs("south"), F.abs("north")) + high)), F.lit(0.01))
    grown = boxed.select("area_id", "sides", (F.col("south") - high).alias("south"), (F.col("north") + high).alias("north"), (F.col("west") - wide).alias("west"), (F.col("east") + wide).alias("east"))
    p = points.select("id", "lat", "lon", F.floor((F.col("lat") + 90) / size).cast("long").alias("gy"), F.floor((F.col("lon") + 180) / size).cast("long").alias("gx"))
    both = p.hint("merge").join(covered(grown, size), ["gy", "gx"]).filter(F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east")))

    def measured(batches):
        for b in batches:
            n_sides = b.column(4).value_lengths().to_numpy() // 4
            inside, far = ring_distances(b.column(2).to_numpy(), b.column(3).to_numpy(), n_sides, b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4))
            rows = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(inside), pa.array(far)], ["id", "area_id", "is_inside", "distance"])
            yield rows.filter(pa.array(far <= near_m))

    kinds = [f"{n} {df.schema[n].dataType.simpleString()}" for df, n in ((points, "id"), (areas, "area_id"))]
    return both.select("id", "area_id", "lat", "lon", "sides").mapInArrow(measured, f"{', '.join(kinds)}, is_inside boolean, distance double")


# Hulls


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise; one or two points where there is no area."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    halves = []
    for order in (points, points[::-1]):
        half: list[tuple[float, float]] = []
        for x, y in order:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (y - half[-2][1]) - (half[-1][1] - half[-2][1]) * (x - half[-2][0]) <= FLAT:
                half.pop()
            half.append((x, y))
        halves += half[:-1]
    return halves


def hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, n, corners): hulls of points (key, lon, lat), merged like any aggregate.

    Of the points of a meridian only the outermost two can be corners. What is left of a key in one partition is replaced by
    a partial hull, and those are merged; no task holds the points of a key, only corners and ``GATHERED`` points.
    """
    ship(points.sparkSession)
    kind = points.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n long, lons array<double>, lats array<double>"

    def shaped(batches):
        """Rows of one key are together, also where a batch ends."""
        open_key, n, held, room, kept = None, 0, [], GATHERED, None

        def close(out):
            corners = hull(held)
            for column, v in zip(out, (open_key, n, [x for x, _ in corners], [y for _, y in corners]), strict=True):
                column.append(v)

        for b in batches:
            kept, out = b.schema, ([], [], [], [])
            ends = np.cumsum(b.column(2).value_lengths().to_numpy()).tolist()
            lons, lats = (b.column(k).flatten().to_numpy().tolist() for k in (2, 3))
            start = 0
            for k, m, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends, strict=True):
                if k != open_key and not (k != k and open_key != open_key):
                    if n:
                        close(out)
                    open_key, n, held, room = k, 0, [], GATHERED
                n += m
                held += zip(lons[start:end], lats[start:end], strict=True)
                start = end
                if len(held) > room:
                    held = hull(held)
                    room = max(GATHERED, 2 * len(held))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kept, strict=True)], schema=kept)
        if n:
            close(out := ([], [], [], []))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kept, strict=True)], schema=kept)

    ends = points.filter("lon IS NOT NULL AND lat IS NOT NULL").groupBy(key, "lon").agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    once = F.col("south") == F.col("north")
    some = ends.select(key, "n", F.when(once, F.array("lon")).otherwise(F.array("lon", "lon")).alias("lons"), F.when(once, F.array("south")).otherwise(F.array("south", "north")).alias("lats"))
    some = some.sortWithinPartitions(key).mapInArrow(shaped, schema)
    whole = some.repartition(key).sortWithinPartitions(key).mapInArrow(shaped, schema)
    return whole.select(key, "n", F.zip_with("lons", "lats", lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))).alias("corners"))


def ring_hectares(ring: Column) -> Column:
    """Area of a ring on the sphere, in hectares."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, after, lambda p, q: F.radians(q["lon"] - p["lon"]) * (F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"]))))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)) * (AUTHALIC**2 / 2 / 1e4)


def perimeters(points: DataFrame, key: str) -> DataFrame:
    """(key, n, kind, hectares): one point is a circle of 375 m, two a strip of 200 m around their line, more a hull; points in one place or one line are circle and strip, too."""
    circle = lambda r: CORNERS / 2 * math.sin(2 * math.pi / CORNERS) * r * r / 1e4
    first, last = F.get("corners", F.lit(0)), F.get("corners", F.lit(1))
    length = F.when(F.size("corners") == 2, haversine(first["lat"], first["lon"], last["lat"], last["lon"])).otherwise(0.0)
    kind = F.when((F.col("n") != 2) & (F.size("corners") == 1), "circle").when(F.size("corners") < 3, "strip").otherwise("hull")
    area = F.when(kind == "circle", circle(375.0)).when(kind == "strip", length * 400 / 1e4 + circle(200.0)).otherwise(ring_hectares(F.col("corners")))
    return hulls(points, key).select(key, "n", kind.alias("kind"), F.round(area, 2).alias("hectares"))


# Projection


def projected(lat: Column, lon: Column, meridian: Column) -> tuple[Column, Column]:
    """Transverse Mercator (scale 0.9996, WGS 84) of a point: metres east of the meridian and north of the equator."""
    a, f = 6_378_137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    second = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, x = F.pow(F.tan(phi), 2), second * F.pow(F.cos(phi), 2), lam * F.cos(phi)
    arc = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = n * (x + (1 - t + c) * F.pow(x, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * F.pow(x, 5) / 120)
    north = arc + n * F.tan(phi) * (F.pow(x, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(x, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * F.pow(x, 6) / 720)
    return 0.9996 * east, 0.9996 * north


def area_hectares(areas: DataFrame) -> DataFrame:
    """(area_id, hectares): the first ring less holes plus further parts; ``rings`` by sign: (sign, ring), projected to the zone of the first corner."""
    rings = areas.select("area_id", F.posexplode("rings").alias("k", "ring"), F.col("rings")[0][0]["lon"].alias("lon0"), "signs")
    meridian = F.floor((F.col("lon0") + 180) / 6) * 6 - 177
    flat = F.transform("ring", lambda p: F.struct(*[c.alias(n) for c, n in zip(projected(p["lat"], p["lon"], meridian), "xy", strict=True)]))
    rings = rings.select("area_id", F.get("signs", F.col("k")).alias("sign"), flat.alias("flat"))
    after = F.concat(F.slice("flat", 2, F.size("flat")), F.slice("flat", 1, 1))
    twice = F.aggregate(F.zip_with("flat", after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, x: s + x)
    return rings.groupBy("area_id").agg(F.round(F.sum(F.col("sign") * F.abs(twice) / 2 / 1e4), 2).alias("hectares"))


def thinned(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker without recursion: corners farther than ``tolerance`` from the line between kept ones stay."""
    keep, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        s, e = todo.pop()
        (x0, y0), (x1, y1) = ring[s], ring[e]
        length = math.hypot(x1 - x0, y1 - y0)
        best, at = 0.0, None
        for k in range(s + 1, e):
            x, y = ring[k]
            far = abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / length if length else math.hypot(x - x0, y - y0)
            if far > best:
                best, at = far, k
        if at is not None and best > tolerance:
            keep.add(at)
            todo += [(s, at), (at, e)]
    return [ring[k] for k in sorted(keep)]


def simplified(areas: DataFrame, tolerance: float = 0.0001) -> DataFrame:
    """``areas`` with thinner rings; a ring that would fall below three corners stays as it is."""

    ship(areas.sparkSession)
    at = areas.columns.index("rings")

    def run(batches):
        for b in batches:
            out = []
            for rings in b.column(at).to_pylist():
                done = []
                for ring in rings or []:
                    closed = [(p["lon"], p["lat"]) for p in ring] + [(p["lon"], p["lat"]) for p in ring[:1]]
                    thin = thinned(closed, tolerance)[:-1] if len(closed) > 3 else closed[:-1]
                    done.append([{"lon": x, "lat": y} for x, y in (thin if len(thin) >= 3 else closed[:-1])])
                out.append(None if rings is None else done)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return areas.mapInArrow(run, areas.schema)
