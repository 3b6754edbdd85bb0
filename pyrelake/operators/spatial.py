"""Spatial operators: neighbour joins on a grid, density clustering, areas, audits.

Neighbours meet by grid cell and time bucket: one side is put in the 27 cells around it, the join is an equi join and
the exact distance decides. Areas are joined by the cells that their box covers, so neither side is broadcast.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE, RADIUS, box_distance, haversine
from ..functions.scoring import violation


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the cluster's shared folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b). Labels shorten by pointer jumping."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        far = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        new = written(step.join(far, "next").select("id", F.col("far").alias("component"), (F.col("far") != F.col("component")).alias("moved")))
        labels = new.select("id", "component")
        if new.filter("moved").isEmpty():
            return labels


def neighbours(points: DataFrame, eps: float, window_s: int | None = None, partition: str | None = None) -> DataFrame:
    """(a, b), a < b: points within ``eps`` metres, within ``window_s`` seconds if set, and equal in ``partition`` if set.

    points: id, lat, lon, and t (seconds) if a window is set.
    """
    dlat, dlon = eps / DEGREE, eps / DEGREE / 0.1  # the widest a degree of longitude gets in the inhabited world
    y, x = F.floor((F.col("lat") + 90) / dlat), F.floor((F.col("lon") + 180) / dlon)
    z = F.floor(F.col("t") / max(1, window_s)) if window_s is not None else F.lit(0)
    p = points.select("id", "lat", "lon", F.col("t") if window_s is not None else F.lit(0).alias("t"), F.col(partition).alias("part") if partition else F.lit(0).alias("part"), y.cast("long").alias("cy"), x.cast("long").alias("cx"), z.cast("long").alias("cz"))
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    a = p.withColumn("cy", around("cy")).withColumn("cx", around("cx"))
    a = a.withColumn("cz", around("cz")) if window_s is not None else a
    a = a.select(*[F.col(c).alias(f"{c}_a") if c in ("id", "lat", "lon", "t") else F.col(c) for c in a.columns])
    close = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat"), F.col("lon")) <= eps
    if window_s is not None:
        close = close & (F.abs(F.col("t_a") - F.col("t")) <= window_s)
    return a.join(p, ["part", "cy", "cx", "cz"]).filter((F.col("id_a") < F.col("id")) & close).select(F.col("id_a").alias("a"), F.col("id").alias("b"))


#: Grid of density clustering: cells in a block along latitude, longitude and time.
BLOCK = {"cy": 4, "cx": 8, "cz": 2}


def dbscan(points: DataFrame, eps: float, min_points: int, window_s: int | None = None, partition: str | None = None) -> DataFrame:
    """(id, label) of every point; label is the smallest core id of the cluster, NULL for noise.

    A point counts itself. A border point goes to the smallest label among its core neighbours. All points of a grid cell
    are within reach of each other, so a cell of ``min_points`` has core points only and is one node of the graph of
    clusters. Points of other cells meet the points around them; two full cells are linked by any of their outermost
    points, and only cells that are left in different clusters have all their points compared. Pairs of points are counted
    or tested as they are made, none are written.
    """
    timed, reach = window_s is not None, {"cy": F.lit(2), "cz": F.lit(1 if window_s is not None else 0)}
    size = eps / (RADIUS * math.pi / 180) / math.sqrt(2) * (1 - 1e-6)
    close = lambda a, b: (haversine(a["lat"], a["lon"], b["lat"], b["lon"]) <= eps) & (F.abs(a["t"] - b["t"]) <= window_s if timed else F.lit(True))
    p = points.select("id", "lat", "lon", F.col("t") if timed else F.lit(0).alias("t"), F.col(partition).alias("part") if partition else F.lit(0).alias("part"))
    placed = p.filter("lat IS NOT NULL AND lon IS NOT NULL AND t IS NOT NULL AND part IS NOT NULL")
    grid = {"cy": (F.col("lat") + 90) / size, "cx": (F.col("lon") + 180) / size, "cz": F.col("t") / max(1, window_s) if timed else F.lit(0)}
    placed = placed.select("*", *[F.floor(c).cast("long").alias(n) for n, c in grid.items()])
    mates = Window.partitionBy("part", *grid)
    cells = written(placed.select("*", F.count(F.lit(1)).over(mates).alias("n"), F.min("id").over(mates).alias("cell")))
    # cells of longitude within reach: fewer metres a degree nearer to the poles
    reach["cx"] = F.floor(F.lit(math.sqrt(2) * 1.0001) / F.greatest(F.cos(F.radians((F.abs(F.col("cy") * size - 90) + 3 * size))), F.lit(0.01))).cast("long") + 1

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows a, b of equal part whose cells are within reach."""
        block = lambda c, n: F.floor(c / BLOCK[n]).cast("long")
        x = a.select("part", F.struct(*a.columns, *[r.alias(f"{n}_reach") for n, r in reach.items()]).alias("a"))
        for n in grid:
            x = x.withColumn(n, F.explode(F.sequence(block(F.col(f"a.{n}") - F.col(f"a.{n}_reach"), n), block(F.col(f"a.{n}") + F.col(f"a.{n}_reach"), n))))
        y = b.select("part", F.struct(*b.columns).alias("b"), *[block(F.col(n), n).alias(n) for n in grid])
        near = [F.abs(F.col(f"a.{n}") - F.col(f"b.{n}")) <= F.col(f"a.{n}_reach") for n in grid]
        return x.hint("merge").join(y, ["part", *grid]).filter(near[0] & near[1] & near[2]).select("a", "b")

    full, few = cells.filter(F.col("n") >= min_points), cells.filter(F.col("n") < min_points)
    # points of other cells: neighbours by cell, one by one where those are in such cells, too
    pairs = meet(few, cells).filter((F.col("a.id") != F.col("b.id")) & close(F.col("a"), F.col("b")))
    other = F.when(F.col("b.n") < min_points, F.col("b.id"))
    near = written(pairs.groupBy(F.col("a.id").alias("id"), F.col("a.cell").alias("own"), F.col("b.cell").alias("cell"), other.alias("other")).agg(F.count(F.lit(1)).alias("n")))
    core = near.groupBy("id", F.col("own").alias("cell")).agg((F.sum("n") + 1).alias("n")).filter(F.col("n") >= min_points)
    core = written(core.select("id", F.min("id").over(Window.partitionBy("cell")).alias("node")))
    known = core.select(F.col("id").alias("other"), F.col("node").alias("other_node"))
    beside = near.hint("merge").join(known, "other", "left").filter("other IS NULL OR other_node IS NOT NULL").select("id", F.coalesce("other_node", "cell").alias("touched"))
    links = beside.hint("merge").join(core, "id").select(F.col("node").alias("a"), F.col("touched").alias("b")).filter("a <> b")
    # full cells: by their outermost points
    outermost = F.array(*[f(F.struct("lat", "lon", "t"), by) for by in ("t", "lat", "lon") for f in (F.max_by, F.min_by)])
    shapes = full.groupBy("part", *grid, "cell").agg(outermost.alias("ends"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon", "t") for f, n in ((F.min, "low"), (F.max, "high"))])
    gap = lambda c: F.greatest(F.col(f"a.low_{c}") - F.col(f"b.high_{c}"), F.col(f"b.low_{c}") - F.col(f"a.high_{c}"))
    shapes = written(shapes)
    met = meet(shapes, shapes).filter((F.col("a.cell") < F.col("b.cell")) & (gap("lat") * DEGREE <= eps) & ((gap("t") <= window_s) if timed else F.lit(True)))
    met = met.withColumn("linked", F.exists("a.ends", lambda x: F.exists("b.ends", lambda y: close(x, y))))
    met = written(met.select("linked", F.col("a.cell").alias("a"), F.col("b.cell").alias("b")))
    labels = components(links.union(met.filter("linked").select("a", "b")))
    # full cells that may be linked and are in different clusters so far: all points near the other's box
    open_ = met.filter("NOT linked")
    for s in "ab":
        open_ = open_.hint("merge").join(labels.select(F.col("id").alias(s), F.col("component").alias(f"{s}_c")), s, "left").withColumn(f"{s}_c", F.coalesce(f"{s}_c", s))
    open_ = written(open_.filter("a_c <> b_c"))
    if not open_.isEmpty():
        for s in "ab":
            open_ = open_.hint("merge").join(shapes.select(F.col("cell").alias(s), F.struct(*[f"{n}_{c}" for c in ("lat", "lon", "t") for n in ("low", "high")]).alias(f"box_{s}")), s)
        inside = full.select("cell", F.struct("lat", "lon", "t").alias("p"))
        deg = eps / DEGREE

        def by_box(box: str) -> Column:
            p, b = F.col("p"), F.col(box)
            wide = F.lit(deg) / F.greatest(F.cos(F.radians(F.abs(p["lat"]) + deg)), F.lit(0.01))
            time = p["t"].between(b["low_t"] - window_s, b["high_t"] + window_s) if timed else F.lit(True)
            return p["lat"].between(b["low_lat"] - deg, b["high_lat"] + deg) & p["lon"].between(b["low_lon"] - wide, b["high_lon"] + wide) & time

        x = open_.hint("merge").join(inside.withColumnRenamed("cell", "a"), "a").filter(by_box("box_b")).select("b", "a_c", "b_c", "box_a", F.col("p").alias("q"))
        x = x.hint("merge").join(inside.withColumnRenamed("cell", "b"), "b").filter(by_box("box_a") & close(F.col("p"), F.col("q")))
        joined = components(written(x.select(F.col("a_c").alias("a"), F.col("b_c").alias("b")).distinct()))
        further = joined.select(F.col("id").alias("component"), F.col("component").alias("whole"))
        nodes = labels.unionByName(joined.join(labels, "id", "left_anti"))
        labels = written(nodes.hint("merge").join(further, "component", "left").select("id", F.coalesce("whole", "component").alias("component")))
    name = labels.select(F.col("id").alias("node"), F.col("component"))
    of = lambda df, node: df.hint("merge").join(name.withColumnRenamed("node", node), node, "left").withColumn("label", F.coalesce("component", node))
    border = of(beside.join(core, "id", "left_anti"), "touched").groupBy("id").agg(F.min("label").alias("label"))
    rest = few.select("id").join(core, "id", "left_anti").hint("merge").join(border, "id", "left")
    lost = p.filter("lat IS NULL OR lon IS NULL OR t IS NULL OR part IS NULL").select("id", (F.col("id") if min_points <= 1 else F.lit(None)).cast(p.schema["id"].dataType).alias("label"))
    return of(full.select("id", "cell"), "cell").select("id", "label").union(of(core, "node").select("id", "label")).union(rest.select("id", "label")).union(lost)


def seconds(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def exact_seconds(c: str) -> Column:
    """With their fraction: by whole seconds, points up to a second too far apart would be within a window."""
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def cluster_events(detections: DataFrame, labels: DataFrame) -> DataFrame:
    """One event a cluster: counts, centre, span, power."""
    g = detections.join(labels.filter("label IS NOT NULL"), "id").groupBy(F.col("label").alias("event_id"))
    return g.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("lat") + 1e-9, 6).alias("lat"), F.round(F.avg("lon") + 1e-9, 6).alias("lon"), F.min("detected_at").alias("start_date"), F.max("detected_at").alias("end_date"), F.round(F.max("frp"), 2).alias("max_frp"),
        F.round(F.sum("frp"), 2).alias("sum_frp"), F.round(F.avg("frp") + 1e-7, 4).alias("avg_frp"), ((F.max("frp") > 50) | (F.avg("confidence") > 80)).alias("is_significant"),
    )


def consolidate(fires: DataFrame, eps: float = 1000.0, buffer_days: int = 5) -> DataFrame:
    """(id, survivor): active events near each other, equal in province, whose spans overlap within a buffer.

    Chains are closed: the smallest id of all events that links reach survives.
    """
    live = fires.filter(F.col("status") == "active").select("id", "lat", "lon", "province", F.col("start_date").cast("date").alias("s"), F.col("end_date").cast("date").alias("e"))
    near = neighbours(live, eps)
    a, b = (live.select(*[F.col(c).alias(f"{c}_{k}") for c in ("id", "province", "s", "e")]) for k in "ab")
    both = near.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b"))
    apart = (F.col("s_a") > F.date_add("e_b", buffer_days)) | (F.col("s_b") > F.date_add("e_a", buffer_days))
    same = F.coalesce(F.col("province_a") == F.col("province_b"), F.lit(True))
    edges = both.filter(same & ~apart).select("a", "b")
    return components(edges).select("id", F.col("component").alias("survivor"))


def merged(fires: DataFrame, survivors: DataFrame) -> DataFrame:
    """The surviving events recomputed over what was merged into them."""
    g = fires.join(survivors, "id").groupBy(F.col("survivor").alias("id"))
    weight = F.sum(F.col("avg_confidence") * F.col("total_detections")) / F.nullif(F.sum("total_detections"), F.lit(0))
    return g.agg(
        F.count(F.lit(1)).alias("n_merged"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.sum("total_detections").alias("total_detections"), F.max("max_frp").alias("max_frp"),
        F.floor(weight * 10000 + 0.5).alias("confidence_e4"), F.floor(F.avg("lat") * 10000 + 0.5).alias("lat_e4"), F.floor(F.avg("lon") * 10000 + 0.5).alias("lon_e4"),
    )


def covered(areas: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Areas by each grid cell that their box covers."""
    span = lambda lo, hi, base: F.explode(F.sequence(F.floor((F.col(lo) + base - margin) / size).cast("long"), F.floor((F.col(hi) + base + margin) / size).cast("long")))
    return areas.withColumn("gy", span("south", "north", 90)).withColumn("gx", span("west", "east", 180))


def crossing(fires: DataFrame, areas: DataFrame, near_m: float = 100.0, size: float = 0.5) -> DataFrame:
    """Events in an area (overlap 100) or within ``near_m`` of it (50), with the end of the prohibition (years of 365 days)."""
    cells = fires.withColumn("gy", F.floor((F.col("lat") + 90) / size).cast("long")).withColumn("gx", F.floor((F.col("lon") + 180) / size).cast("long"))
    d = box_distance(F.col("lat"), F.col("lon"), F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    hit = cells.join(covered(areas, size, near_m / DEGREE / 0.1), ["gy", "gx"]).withColumn("distance", d).filter(F.col("distance") <= near_m)
    until = F.date_add(F.col("start_date").cast("date"), F.col("prohibition_years") * 365)
    return hit.select("id", "area_id", F.when(F.col("distance") == 0, 100).otherwise(50).alias("overlap"), until.alias("prohibition_until"))


def within(rows: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Rows around a point with their distance; a box filter reaches the scan first."""
    dlat, dlon = metres / DEGREE, metres / DEGREE / 0.1
    box = F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon)
    return rows.filter(box).withColumn("distance", haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).filter(F.col("distance") <= metres)


def audit(fires: DataFrame, areas: DataFrame, lat: float, lon: float, metres: float, as_of: str) -> DataFrame:
    """The events around a point with the prohibition that follows from each: that of its areas, or else 30 years."""
    near = within(fires, lat, lon, metres)
    most = crossing(near, areas).groupBy("id").agg(F.max("prohibition_until").alias("until"))
    until = F.coalesce("until", F.date_add(F.col("start_date").cast("date"), 30 * 365))
    left = F.greatest(F.lit(0), F.floor(F.datediff(F.col("prohibition_until"), F.lit(as_of).cast("date")) / 365)).cast("int")
    rows = near.join(most, "id", "left").select("id", F.round("distance", 1).alias("distance"), until.alias("prohibition_until"))
    return rows.select("id", "distance", "prohibition_until", left.alias("years_remaining"), violation(left).alias("severity"), (F.col("prohibition_until") > F.lit(as_of).cast("date")).alias("is_prohibited"))


def nearest_areas(areas: DataFrame, lat: float, lon: float, n: int = 5) -> DataFrame:
    d = box_distance(F.lit(lat), F.lit(lon), F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    return areas.select("area_id", F.round(d, 1).alias("distance")).orderBy("distance", "area_id").limit(n)


def latest_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_place = 1").drop("_place")
