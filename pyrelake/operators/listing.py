"""Listings and details of events and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import add_months_28


def days_since(as_of: str, c: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), F.col(c).cast("date"))


def search_items(fires: DataFrame) -> DataFrame:
    """The slim rows of a search; their quality is the mean confidence."""
    return fires.select("id", "province", "department", "start_date", F.coalesce("status", F.lit("unknown")).alias("status"), F.col("avg_confidence").alias("quality_score"))


def flags(fires: DataFrame, crossings: DataFrame, scenes: DataFrame) -> DataFrame:
    """Whether an event has scenes and lies in an area."""
    seen = scenes.select(F.col("event_id").alias("id"), F.lit(True).alias("seen")).distinct()
    inside = crossings.filter("overlap = 100").select("id", F.lit(True).alias("inside")).distinct()
    return fires.select("id").join(seen, "id", "left").join(inside, "id", "left").select("id", F.col("seen").isNotNull().alias("has_imagery"), F.col("inside").isNotNull().alias("in_protected_area"))


def details(fires: DataFrame, crossings: DataFrame, areas: DataFrame) -> DataFrame:
    """Each event with its areas by name, their number and the largest overlap; an event meets few areas."""
    named = crossings.join(areas.select("area_id", "official_name"), "area_id")
    g = named.groupBy("id").agg(F.array_sort(F.collect_list("official_name")).alias("names"), F.max("overlap").alias("max_overlap"))
    return fires.join(g, "id", "left").select("id", "province", "total_detections", "max_frp", F.coalesce(F.array_join("names", ","), F.lit("")).alias("areas"), F.coalesce(F.size("names"), F.lit(0)).alias("n_areas"), "max_overlap")


def top_detections(detections: DataFrame, key: str, most: int) -> DataFrame:
    """The newest detections of each key: a top-k report."""
    return detections.selectExpr(key, "id", f"row_number() OVER (PARTITION BY {key} ORDER BY detected_at DESC, id) AS place").filter(F.col("place") <= most)


def timeline(fires: DataFrame) -> DataFrame:
    """Dates for which a preview shows images: 12 and 6 months before, start and end, 3, 6, 12 and 24 months after; each once, in this order."""
    start = F.col("start_date").cast("date")
    end = F.coalesce(F.col("end_date").cast("date"), start)
    dates = [F.add_months(start, -12), F.add_months(start, -6), start, end, *[F.add_months(end, m) for m in (3, 6, 12, 24)]]
    return fires.select("id", F.array_join(F.array_distinct(F.transform(F.array(*dates), lambda d: d.cast("string"))), ",").alias("dates"))


def preview(fires: DataFrame, margin: float = 0.01) -> DataFrame:
    """Box around an event, whole days (open ones last one), and its point as GeoJSON."""
    box = [(F.floor((F.col(c) + d) * 10000 + 0.5) / 10000).alias(n) for c, d, n in (("lon", -margin, "west"), ("lat", -margin, "south"), ("lon", margin, "east"), ("lat", margin, "north"))]
    days = F.greatest(F.lit(1), F.ceil((F.unix_timestamp(F.col("end_date").cast("timestamp")) - F.unix_timestamp(F.col("start_date").cast("timestamp"))) / 86400)).cast("int")
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 4), F.round("lat", 4)).alias("coordinates")))
    return fires.select("id", *box, F.coalesce(days, F.lit(1)).alias("duration_days"), point.alias("geojson"))


def home_events(fires: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Events with images that are active or monitoring, or extinct for at most ``days``; without a status, the time last seen tells."""
    now = F.lit(as_of).cast("date")
    seen = F.coalesce("last_seen_at", "end_date", "start_date") >= now.cast("timestamp_ntz")
    live = F.col("status").isin("active", "monitoring") | (F.col("status").isNull() & seen)
    out = (F.col("status") == "extinct") | (F.col("status").isNull() & ~seen)
    recent = F.coalesce("extinct_at", "last_seen_at", "end_date") >= F.date_sub(now, days).cast("timestamp_ntz")
    return fires.filter(live | (out & recent)).filter(F.json_array_length("slides_data") > 0)


def episode_items(episodes: DataFrame, status: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """Episodes with status, age, whether that is recent, and a box that is NULL if a side is."""
    age = days_since(as_of, "end_date")
    box = F.when(F.col("south").isNotNull() & F.col("north").isNotNull(), F.concat_ws(",", F.floor(F.col("south") * 100).cast("string"), F.floor(F.col("north") * 100).cast("string")))
    return episodes.join(status, "episode_id").select("episode_id", "status", "n_events", "detections", "end_date", age.alias("recent_days"), F.coalesce(age <= days, F.lit(False)).alias("is_recent"), box.alias("box"))


def home_episodes(items: DataFrame, most: int = 20) -> DataFrame:
    """Live episodes and recent extinct ones: by status, detections, end."""
    rank = F.when(F.col("status") == "active", 0).when(F.col("status") == "monitoring", 1).otherwise(2)
    return items.filter(F.col("status").isin("active", "monitoring") | (F.col("status").isin("extinct", "closed") & F.col("is_recent"))).orderBy(rank, F.desc_nulls_last("detections"), F.desc_nulls_last("end_date"), "episode_id").limit(most)


def page_meta(rows: DataFrame, number: int, size: int) -> DataFrame:
    pages = F.ceil(F.col("total") / size).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("total")).select("total", pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def provinces(fires: DataFrame) -> DataFrame:
    """Each province once with its events, the unknown one last."""
    return fires.groupBy("province").agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_last("province"))


def province_names(fires: DataFrame, episodes: DataFrame) -> DataFrame:
    """Names in events or in the lists of episodes, each once."""
    listed = episodes.select(F.explode(F.split("provinces", ",")).alias("province")).filter("province <> ''")
    return fires.filter("province IS NOT NULL").select("province").union(listed).distinct()


def province_distribution(episodes: DataFrame) -> DataFrame:
    return episodes.select(F.explode(F.split("provinces", ",")).alias("province")).groupBy("province").agg(F.count(F.lit(1)).alias("n"))


def bridge(links: DataFrame) -> DataFrame:
    """One episode an event: the link added last, unknown times last, then the smallest episode."""
    return links.selectExpr("event_id", "episode_id", "row_number() OVER (PARTITION BY event_id ORDER BY added_at DESC NULLS LAST, episode_id) AS place").filter("place = 1").drop("place")


def anniversaries(fires: DataFrame) -> DataFrame:
    """One month on by both conventions: clamped to the month's end, or the 28th."""
    d = F.col("start_date").cast("date")
    return fires.select("id", F.add_months(d, 1).cast("string").alias("clamped"), add_months_28(d, 1).cast("string").alias("overflow28"), F.add_months(F.trunc(d, "month"), 1).cast("string").alias("next_month"), F.date_add(d, 1).cast("string").alias("next_day"))
