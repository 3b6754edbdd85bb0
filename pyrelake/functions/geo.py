"""Geodesy as Column expressions. Distances are in metres on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_000.0
#: Metres a degree, on the safe side: prefilters by it never lose a pair.
DEGREE = 111_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def lon_degrees(metres: float, lat: Column) -> Column:
    return F.lit(metres / DEGREE) / F.greatest(F.cos(F.radians(lat)), F.lit(0.1))


def radius_box(lat: Column, lon: Column, metres: float) -> list[tuple[str, Column]]:
    """Sides of the box around a point, in 1e-4 degrees."""
    m = F.lit(metres / DEGREE * 1e4)
    wide = m / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    return [("south", lat * 1e4 - m), ("north", lat * 1e4 + m), ("west", lon * 1e4 - wide), ("east", lon * 1e4 + wide)]


def in_box(lat: Column, lon: Column, west, south, east, north, strict: bool = False) -> Column:
    """strict: points on the boundary are outside."""
    return (lon > west) & (lon < east) & (lat > south) & (lat < north) if strict else lon.between(west, east) & lat.between(south, north)


def box_distance(lat: Column, lon: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """From a point to the nearest point of a box; 0 inside."""
    return haversine(lat, lon, F.greatest(south, F.least(north, lat)), F.greatest(west, F.least(east, lon)))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting over an array of (lon, lat); points on the southern and western edges count as inside."""
    pairs = F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("q"))
    crosses = lambda e: ((e["p"]["lat"] > lat) != (e["q"]["lat"] > lat)) & (lon < (e["q"]["lon"] - e["p"]["lon"]) * (lat - e["p"]["lat"]) / (e["q"]["lat"] - e["p"]["lat"]) + e["p"]["lon"])
    return F.size(F.filter(pairs, crosses)) % 2 == 1


def cell(lat: Column, lon: Column, size: float = 0.01) -> Column:
    """A grid cell as one integer; ``size`` in degrees."""
    return (F.floor((lat + 90) / size).cast("long") * 1_000_000 + F.floor((lon + 180) / size).cast("long"))
