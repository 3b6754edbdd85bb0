"""Images for episodes and reports: selection a day, what a report shows, closure reports, image metadata.

A scene is named by its event and its number. Spans of dates exclude their last day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .spatial import latest_by


def image_id(event: str = "event_id", scene: str = "scene_id") -> Column:
    return F.concat_ws("-", F.col(event).cast("string"), F.col(scene).cast("string"))


def selected_images(scenes: DataFrame, key: str, as_of: str, thresholds: tuple[int, ...] = (10, 20, 30, 50), days: int = 7, archive_days: int = 30, archive_cloud: int = 30) -> DataFrame:
    """key, image, threshold, is_archive: the clearest scene of the last days, under the first threshold that lets one through; else the oldest one under ``archive_cloud`` of the last ``archive_days``.

    The clearest scene passes the first threshold that any scene passes, so one aggregate a key decides, with a partial one
    before the shuffle. Equally clear or old scenes: the smallest event and number. Keys without either have no row.
    """
    day = F.lit(as_of).cast("date")
    cloud, taken = F.col("cloud_cover"), F.col("acquired_on")
    rows = scenes.filter((taken >= F.date_sub(day, max(days, archive_days))) & (taken < day) & (cloud < max(*thresholds, archive_cloud)))
    recent = F.when((taken >= F.date_sub(day, days)) & (cloud < max(thresholds)), F.struct(cloud.alias("cloud"), "event_id", "scene_id"))
    old = F.when((taken >= F.date_sub(day, archive_days)) & (cloud < archive_cloud), F.struct("acquired_on", "event_id", "scene_id"))
    best = rows.groupBy(key).agg(F.min(recent).alias("r"), F.min(old).alias("o")).filter("r IS NOT NULL OR o IS NOT NULL")
    level = F.array_min(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col("r.cloud") < t))
    archive = F.col("r").isNull()
    return best.select(key, F.when(archive, image_id("o.event_id", "o.scene_id")).otherwise(image_id("r.event_id", "r.scene_id")).alias("image"), F.when(archive, F.lit(archive_cloud)).otherwise(level).alias("threshold"), archive.alias("is_archive"))


def carousel(episodes: DataFrame, bridge: DataFrame, fires: DataFrame, scenes: DataFrame, as_of: str, most: int, force: bool = False, **selection) -> DataFrame:
    """What a day's run does with each of the ``most`` candidates that come first: episode_id, event_id, outcome, image, threshold, is_archive.

    ``episodes``: episode_id, status, candidate, priority, start_date, lat, lon, last_image. Outcomes, the first that holds:
    missing_centroid; missing_event (neither an event of the episode nor one with its id); no_image; no_change (the stored
    image again, unless ``force``); updated. The run is a top-k report: only the candidates meet events and scenes.
    """
    top = episodes.filter(F.col("status").isin("active", "monitoring") & F.col("candidate"))
    top = top.orderBy(F.desc_nulls_last("priority"), F.desc_nulls_last("start_date"), "episode_id").limit(most).select("episode_id", "lat", "lon", "last_image")
    own = top.select("episode_id").join(bridge, "episode_id").withColumnRenamed("event_id", "id").join(fires.select("id", "status", "start_date", "end_date"), "id")
    live = F.when(F.col("status").isin("active", "monitoring"), 0).otherwise(1)
    shown = latest_by(own, "episode_id", live, F.desc_nulls_last("end_date"), F.desc_nulls_last("start_date"), F.col("id")).select("episode_id", F.col("id").alias("linked"))
    same = fires.select(F.col("id").cast("string").alias("episode_id"), F.col("id").alias("same"))
    seen = own.select("episode_id", F.col("id").alias("event_id")).join(scenes, "event_id")
    rows = top.join(shown, "episode_id", "left").join(same, "episode_id", "left").join(selected_images(seen, "episode_id", as_of, **selection), "episode_id", "left")
    event = F.coalesce("linked", "same")
    unchanged = F.coalesce(F.col("last_image") == F.col("image"), F.lit(False)) & F.lit(not force)
    outcome = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "missing_centroid").when(event.isNull(), "missing_event").when(F.col("image").isNull(), "no_image").when(unchanged, "no_change").otherwise("updated")
    return rows.select("episode_id", event.alias("event_id"), outcome.alias("outcome"), "image", "threshold", "is_archive")


def month_after(day: Column, months: int) -> Column:
    """The same day some months on; a day that the month lacks becomes the 28th."""
    first = F.add_months(F.trunc(day, "month"), months)
    return F.date_add(first, F.when(F.day(F.last_day(first)) < F.day(day), F.lit(27)).otherwise(F.day(day) - 1))


def report_images(fires: DataFrame, scenes: DataFrame, as_of: str, most: int = 6, frequency: str = "annual", ndvi: bool = True, before: bool = True, reach: int = 30, most_cloud: float = 30.0) -> DataFrame:
    """The images that a report on each event shows, in order: event_id, place, vis_type, target, image, ndvi, is_before.

    Before: 15 days ahead of the event. After: each year (at most on the 28th; with a second image, of NDVI, where asked) or
    each of twelve months, up to ``as_of`` and while the report has room: ``most`` less the one before, if it was found.
    Second images don't count. Each is the clear scene nearest to its target among those from ``reach`` days before it to
    the day ahead of ``reach`` days after; ties go to the smaller scene_id, a target without one is left out.

    Each event has at most ``most`` + 1 targets, so all are decided in one aggregate of the event's scenes.
    """
    start = F.col("start_date").cast("date")
    after = min(most, 12) if frequency == "monthly" else most
    yearly = lambda k: F.make_date(F.year(start) + k, F.month(start), F.least(F.day(start), F.lit(28)))
    targets = [F.date_sub(start, 15)] + [month_after(start, k) if frequency == "monthly" else yearly(k) for k in range(1, after + 1)]
    events = fires.select(F.col("id").alias("event_id"), F.array(*targets).alias("targets"))
    value = (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red"))
    clear = scenes.filter(F.col("cloud_cover") < most_cloud).select("event_id", "scene_id", "acquired_on", value.alias("ndvi"))

    def nearest(k: int) -> Column:
        gap = F.datediff("acquired_on", F.col("targets")[k])
        asked = F.lit(before) if k == 0 else F.col("targets")[k] <= F.lit(as_of).cast("date")
        return F.min(F.when(asked & (gap >= -reach) & (gap < reach), F.struct(F.abs(gap).alias("gap"), "scene_id", "ndvi")))

    best = clear.join(events, "event_id").groupBy("event_id").agg(F.first("targets").alias("targets"), F.array(*[nearest(k) for k in range(after + 1)]).alias("best"))
    room = F.lit(most) - F.when(F.col("best")[0].isNotNull(), 1).otherwise(0)
    rows = best.select("event_id", room.alias("room"), F.posexplode(F.arrays_zip("targets", "best")).alias("k", "e")).filter("e.best IS NOT NULL AND k <= room")
    kinds = F.when((F.col("k") > 0) & F.lit(ndvi and frequency == "annual"), F.array(F.lit("RGB"), F.lit("NDVI"))).otherwise(F.array(F.lit("RGB")))
    rows = rows.select("event_id", "k", "e.targets", "e.best", F.posexplode(kinds).alias("second", "vis_type"))
    colour = F.when(F.col("vis_type") == "RGB", F.round("best.ndvi", 6))
    return rows.select("event_id", (F.col("k") * 2 + F.col("second")).cast("int").alias("place"), "vis_type", F.col("targets").alias("target"), image_id("event_id", "best.scene_id").alias("image"), colour.alias("ndvi"), (F.col("k") == 0).alias("is_before"))


def closure_report(candidates: DataFrame, images: DataFrame, scenes: DataFrame, as_of: str, retry_days: int) -> DataFrame:
    """One row for each candidate: id, outcome, dnbr, severity, product, quality, days_after.

    ``images``: event_id, side (pre, post), scene_id, as chosen for closure. With both, the event is ``updated``; otherwise
    it is ``waiting`` until it has been extinct for ``retry_days``, then ``incomplete``. An index that can't be computed
    counts as 0; of a scene's repeated rows, the clearest counts.
    """
    nbr = F.coalesce(F.try_divide(F.col("nir") - F.col("swir"), F.col("nir") + F.col("swir")), F.lit(0.0))
    rows = candidates.select("id").join(images.withColumnRenamed("event_id", "id"), "id").join(scenes.select(F.col("event_id").alias("id"), "scene_id", nbr.alias("nbr"), "cloud_cover", "acquired_on"), ["id", "scene_id"])
    side = lambda s: F.min(F.when(F.col("side") == s, F.struct("cloud_cover", "acquired_on", "nbr", image_id("id").alias("image")))).alias(s)
    found = candidates.join(rows.groupBy("id").agg(side("pre"), side("post")), "id", "left")
    both = F.col("pre").isNotNull() & F.col("post").isNotNull()
    age = F.datediff(F.lit(as_of).cast("date"), F.col("extinct_at").cast("date"))
    dnbr = S.rounded(F.col("pre.nbr") - F.col("post.nbr"), 6)
    return found.select(
        "id", F.when(both, "updated").when(age >= retry_days, "incomplete").otherwise("waiting").alias("outcome"), F.when(both, dnbr).alias("dnbr"), F.when(both, S.severity(dnbr)).alias("severity"),
        F.when(both, product_id(F.col("pre.image"), F.col("post.image"))).alias("product"), F.when(both, S.cloud_quality(F.col("post.cloud_cover"))).alias("quality"),
        F.when(both, F.datediff(F.col("post.acquired_on"), F.col("start_date").cast("date"))).alias("days_after"),
    )


def product_id(pre: Column, post: Column) -> Column:
    """Name of a difference of two images; beyond 92 characters, its digest."""
    raw = F.concat_ws(":", pre, post)
    return F.concat(F.lit("DNBR:"), F.when(F.length(raw) <= 92, raw).otherwise(F.sha1(raw)))


#: The bands that show a burn.
BURN_BANDS = ["B12", "B8A", "B4"]


def vis_type(image_type: Column, params: Column) -> Column:
    """DNBR or NBR where the type says so, else what the parameters (JSON) name, else NBR for the bands that show a burn, else RGB."""
    kind = F.coalesce(F.lower(image_type), F.lit(""))
    named = F.coalesce(F.array_contains(F.json_object_keys(params), "vis_type"), F.lit(False))
    bands = F.transform(F.from_json(F.get_json_object(params, "$.bands"), "array<string>"), F.upper)
    return (
        F.when(kind.contains("dnbr"), "DNBR")
        .when(kind.contains("nbr"), "NBR")
        .when(named, F.upper(F.coalesce(F.get_json_object(params, "$.vis_type"), F.lit("None"))))
        .when(bands == F.array(*[F.lit(b) for b in BURN_BANDS]), "NBR")
        .otherwise("RGB")
    )


def image_metadata(images: DataFrame, most: int = 100) -> DataFrame:
    """Metadata of a collection's clearest images, a report of ``most`` rows: the day is the start of the datatake's name, what is missing has its default."""
    day = F.to_date(F.left(F.when(F.col("datatake") != "", F.col("datatake")), F.lit(8)), "yyyyMMdd")
    rows = images.orderBy("cloud_cover", "image").limit(most)
    return rows.select("image", day.alias("acquired_on"), F.coalesce("cloud_cover", F.lit(0.0)).alias("cloud_cover"), F.coalesce("satellite", F.lit("Sentinel-2")).alias("satellite"), F.coalesce("tile", F.lit("")).alias("tile"))
