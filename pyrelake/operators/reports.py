"""Reports of citizens met with events and areas, recurrence from the stored view, jobs, request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE, box_distance, cell, haversine, in_box
from .spatial import covered


def gridded(rows: DataFrame, size: float) -> DataFrame:
    return rows.withColumn("gy", F.floor((F.col("lat") + 90) / size).cast("long")).withColumn("gx", F.floor((F.col("lon") + 180) / size).cast("long"))


def first_of(rows: DataFrame, key: str, most: int, *order) -> DataFrame:
    """At most ``most`` rows of each key; Spark cuts each task's rows to that number before it shuffles them."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= most)


def related_fires(reports: DataFrame, fires: DataFrame, crossings: DataFrame, metres: float = 1000.0, most: int = 10, size: float = 0.05) -> DataFrame:
    """For each report the latest events within ``metres``: report_id, place, id, distance, in_area, prohibition_until.

    A report meets the events of its grid cell and of the neighbours that its circle reaches (latitudes up to 84 degrees),
    and the distance decides. An event in several areas is listed once, with the longest prohibition. Ties go to the smaller id.
    """
    reach = metres / DEGREE
    asked = reports.withColumnsRenamed({"lat": "y", "lon": "x"}).withColumn("wide", F.lit(reach) / F.greatest(F.cos(F.radians("y")), F.lit(0.1)))
    span = lambda c, base, r: F.explode(F.sequence(F.floor((F.col(c) + base - r) / size).cast("long"), F.floor((F.col(c) + base + r) / size).cast("long")))
    asked = asked.withColumn("gy", span("y", 90, F.lit(reach))).withColumn("gx", span("x", 180, F.col("wide")))
    near = asked.join(gridded(fires.select("id", "lat", "lon", "start_date"), size), ["gy", "gx"])
    near = near.withColumn("distance", haversine(F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))).filter(F.col("distance") <= metres)
    top = first_of(near, "report_id", most, F.desc_nulls_last("start_date"), F.col("id"))
    until = crossings.groupBy("id").agg(F.max("prohibition_until").alias("prohibition_until"))
    rows = top.select("report_id", "place", "id", F.round("distance", 1).alias("distance")).join(until.withColumn("in_area", F.lit(True)), "id", "left")
    return rows.select("report_id", "place", "id", "distance", F.coalesce("in_area", F.lit(False)).alias("in_area"), "prohibition_until")


def related_areas(reports: DataFrame, areas: DataFrame, metres: float = 5000.0, most: int = 5, size: float = 0.5) -> DataFrame:
    """For each report the nearest areas within ``metres``: report_id, place, area_id, distance (0 inside). Ties go to the smaller area_id."""
    d = box_distance(F.col("lat"), F.col("lon"), F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    near = gridded(reports, size).join(covered(areas, size, metres / DEGREE / 0.1), ["gy", "gx"]).withColumn("distance", d).filter(F.col("distance") <= metres)
    return first_of(near, "report_id", most, F.round("distance", 1), F.col("area_id")).select("report_id", "place", "area_id", F.round("distance", 1).alias("distance"))


def recurrence_from_view(fires: DataFrame, view: DataFrame, box: tuple[float, float, float, float], size: float = 0.5) -> DataFrame:
    """The view's rows for the cells that have an event within a box (west, south, east, north)."""
    cells = fires.filter(in_box(F.col("lat"), F.col("lon"), *box)).select(cell(F.col("lat"), F.col("lon"), size).alias("cell")).distinct()
    return view.join(cells, "cell", "left_semi")


def recurrence_summary(cells: DataFrame) -> DataFrame:
    """Number of cells in a recurrence report and the highest score; no cells: 0."""
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_intensity"))


def job_states(items: DataFrame, key: str) -> DataFrame:
    """Progress of each job over its items (status: pending, ready, failed): running while one is pending, then failed if one failed, else ready."""
    n, done, failed = F.count(F.lit(1)), F.count_if(F.col("status").isin("ready", "failed")), F.count_if(F.col("status") == "failed")
    rows = items.groupBy(key).agg(n.alias("total"), done.alias("done"), failed.alias("failed"))
    return rows.withColumn("state", F.when(F.col("done") < F.col("total"), "running").when(F.col("failed") > 0, "failed").otherwise("ready"))


def request_metrics(requests: DataFrame) -> DataFrame:
    """Requests of each route: number, mean milliseconds, share answered with 400 or more."""
    g = requests.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 2).alias("avg_ms"), F.count_if(F.col("status") >= 400).alias("errors"))
    return g.select("route", "n", "avg_ms", F.round(F.col("errors") / F.col("n"), 4).alias("error_rate"))


def plotted_points(points: DataFrame, centres: DataFrame, key: str, at: str, order: str, most: int = 150) -> DataFrame:
    """key, place, x, y: about ``most`` points of each key for a map, in time order, scaled to the extent of all its points.

    Of n located points every max(1, n // most)-th is kept, the first included. An axis without extent is widened by 0.01
    both ways. A key of ``centres`` (key, lat, lon) without located points shows its centre, if that is located.
    ``order`` breaks ties in time, so with distinct values the result is fixed; a null time comes first.
    Places are counted by (key, day) first and numbered within a day, so that a key with very many points is no single task.
    """
    located = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select(key, at, order, "lat", "lon", F.to_date(at).alias("day"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)]
    days = located.groupBy(key, "day").agg(F.count(F.lit(1)).alias("n"), *ends)
    whole, before = Window.partitionBy(key), Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    spans = [(F.min if c.startswith("min") else F.max)(c).over(whole).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    days = days.select(key, F.col("day").alias("d"), F.sum("n").over(whole).alias("n"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), *spans)
    placed = located.withColumn("nth", F.row_number().over(Window.partitionBy(key, "day").orderBy(at, order)))
    placed = placed.join(days.withColumnRenamed(key, "k"), F.col(key).eqNullSafe(F.col("k")) & F.col("day").eqNullSafe(F.col("d")))
    place = (F.col("earlier") + F.col("nth") - 1).alias("place")
    kept = placed.withColumn("place", place).filter(F.col("place") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0)
    alone = centres.filter("lat IS NOT NULL AND lon IS NOT NULL").join(located.select(key).distinct(), key, "left_anti")
    alone = alone.select(key, F.lit(0).cast("long").alias("place"), "lat", "lon", *[F.col(c[4:]).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])
    shown = kept.select(*alone.columns).union(alone)
    for name, c in (("x", "lon"), ("y", "lat")):
        wider = F.when(F.col(f"min_{c}") == F.col(f"max_{c}"), 0.01).otherwise(0.0)
        low, high = F.col(f"min_{c}") - wider, F.col(f"max_{c}") + wider
        shown = shown.withColumn(name, (F.col(c) - low) / (high - low))
    return shown.select(key, "place", "x", "y")
