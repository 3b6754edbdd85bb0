"""Polygons: points in regions, provinces for events without one, boxes that meet a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_ring
from .spatial import covered


def boxed(regions: DataFrame) -> DataFrame:
    """Regions (name, ring of lon and lat) with the box around the ring."""
    at = lambda c: F.transform("ring", lambda p: p[c])
    return regions.withColumns({"west": F.array_min(at("lon")), "east": F.array_max(at("lon")), "south": F.array_min(at("lat")), "north": F.array_max(at("lat"))})


def inside(points: DataFrame, regions: DataFrame, size: float = 0.5) -> DataFrame:
    """(id, name): points and the regions that hold them; they meet by grid cell, then by ray casting."""
    cells = points.select("id", "lat", "lon", F.floor((F.col("lat") + 90) / size).cast("long").alias("gy"), F.floor((F.col("lon") + 180) / size).cast("long").alias("gx"))
    return cells.join(covered(boxed(regions), size), ["gy", "gx"]).filter(in_ring(F.col("lat"), F.col("lon"), F.col("ring"))).select("id", "name")


def with_province(fires: DataFrame, regions: DataFrame) -> DataFrame:
    """Events without a province get that of their region, the first by name; others keep theirs."""
    found = inside(fires.filter("province IS NULL"), regions).groupBy("id").agg(F.min("name").alias("found"))
    return fires.join(found, "id", "left").withColumn("province", F.coalesce("province", "found")).drop("found")


def crosses_box(p: Column, q: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether the segment from p to q meets a box: the spans of its parameter inside each pair of sides overlap."""

    def span(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = b - a
        flat = F.when(a.between(low, high), F.lit(0.0)).otherwise(F.lit(2.0))
        t, u = (low - a) / F.nullif(d, F.lit(0.0)), (high - a) / F.nullif(d, F.lit(0.0))
        return F.coalesce(F.least(t, u), flat), F.coalesce(F.greatest(t, u), F.lit(1.0))

    (x0, x1), (y0, y1) = span(p["lon"], q["lon"], west, east), span(p["lat"], q["lat"], south, north)
    return F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))


def meeting(boxes: DataFrame, regions: DataFrame, size: float = 0.5) -> DataFrame:
    """(id, name): boxes (west, south, east, north) and the regions that they meet: an edge crosses the box, or it lies inside."""
    a = covered(boxes.select("id", "west", "south", "east", "north"), size)
    r = covered(boxed(regions), size).select("name", "ring", "gy", "gx")
    ring = F.col("ring")
    edges = F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("q"))
    meets = F.exists(edges, lambda e: crosses_box(e["p"], e["q"], *[F.col(c) for c in ("west", "south", "east", "north")])) | in_ring(F.col("south"), F.col("west"), ring)
    return a.join(r, ["gy", "gx"]).filter(meets).select("id", "name").distinct()
