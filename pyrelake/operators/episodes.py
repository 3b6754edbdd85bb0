"""Episodes over events (a site and month is an episode here), quality, scenes and vegetation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from .fires import month
from .spatial import latest_by


def linked(fires: DataFrame) -> DataFrame:
    return fires.withColumn("episode_id", F.concat_ws("-", F.col("site_id").cast("string"), month("start_date")))


def metrics(fires: DataFrame) -> DataFrame:
    return linked(fires).groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.sum("total_detections").alias("detections"), F.array_join(F.array_sort(F.collect_set("province")), ",").alias("provinces"),
        F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lat"), 6).alias("north"), F.max("max_frp").alias("max_frp"), F.coalesce(F.bool_or(F.col("status").isin("active", "monitoring")), F.lit(False)).alias("live"),
    )


def representative(fires: DataFrame) -> DataFrame:
    """Of each episode the event that is live, ends last, starts last."""
    live = F.when(F.col("status").isin("active", "monitoring"), 0).otherwise(1)
    return latest_by(linked(fires), "episode_id", live, F.desc_nulls_last("end_date"), F.desc_nulls_last("start_date"), F.col("id")).select("episode_id", "id")


def status(fires: DataFrame, as_of: str, monitor_days: int = 15) -> DataFrame:
    """active if an event is, monitoring if the last one ended within the days, else extinct."""
    g = linked(fires).groupBy("episode_id").agg(F.max("end_date").cast("date").alias("last"), F.coalesce(F.bool_or(F.col("status") == "active"), F.lit(False)).alias("active"))
    return g.select("episode_id", F.when(F.col("active"), "active").when(F.datediff(F.lit(as_of).cast("date"), F.col("last")) < monitor_days, "monitoring").otherwise("extinct").alias("status"))


def priority(fires: DataFrame, most: int = 100) -> DataFrame:
    """The candidate episodes that come first: a top-k report."""
    m = metrics(fires).filter("live AND detections >= 10").orderBy(F.desc("detections"), "episode_id").limit(most)
    return m.select("episode_id", "detections", F.row_number().over(Window.orderBy(F.desc("detections"), "episode_id")).alias("priority_rank"))


def quality(fires: DataFrame, scenes: DataFrame) -> DataFrame:
    """Reliability of each event from its confidence and what else saw it."""
    seen = scenes.groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("n_scenes"), F.countDistinct(F.col("scene_id") % 3).alias("n_sources"))
    j = fires.join(seen, "id", "left").select("id", "avg_confidence", F.coalesce("n_scenes", F.lit(0)).alias("n_scenes"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.col("estimated_area_hectares").isNotNull().alias("has_area"))
    independent = F.when(F.col("n_sources") >= 3, 100).when(F.col("n_sources") == 2, 50).otherwise(0)
    score = S.reliability(F.col("avg_confidence"), F.when(F.col("n_scenes") > 0, 100).otherwise(0), F.when(F.col("has_area"), 100).otherwise(0), independent)
    limits = F.array_compact(F.array(F.when(F.col("avg_confidence") < 50, "low_confidence"), F.when(F.col("n_scenes") == 0, "no_imagery"), F.when(~F.col("has_area"), "no_climate"), F.when(F.col("n_sources") < 2, "single_source")))
    return j.select("id", F.round(score, 2).alias("score"), S.reliability_class(score).alias("class"), F.array_join(limits, ",").alias("limitations"))


def nearest_scene(fires: DataFrame, scenes: DataFrame, offset_days: int = 30, max_cloud: float = 25.0) -> DataFrame:
    """The clear scene of each event whose date is nearest to a target, before or after."""
    target = F.date_add(F.col("start_date").cast("date"), offset_days)
    j = fires.select(F.col("id").alias("event_id"), target.alias("target")).join(scenes.filter(F.col("cloud_cover") < max_cloud), "event_id")
    j = j.withColumn("gap", F.abs(F.datediff("acquired_on", "target")))
    return latest_by(j, "event_id", F.col("gap"), F.col("acquired_on"), F.col("scene_id")).select("event_id", "scene_id", "gap")


def threshold_scan(scenes: DataFrame, thresholds: tuple[int, ...] = (10, 20, 30, 50)) -> DataFrame:
    """The newest scene under the first threshold that lets one through."""
    level = None
    for t in thresholds:
        test = F.col("cloud_cover") < t
        level = F.when(test, t) if level is None else level.when(test, t)
    j = scenes.withColumn("level", level).filter("level IS NOT NULL")
    return latest_by(j, "event_id", F.col("level"), F.desc("acquired_on"), F.col("scene_id")).select("event_id", "scene_id", "level")


def burn_severity(scenes: DataFrame) -> DataFrame:
    """Change of the burn ratio from the first scene to the last."""
    nbr = (F.col("nir") - F.col("swir")) / (F.col("nir") + F.col("swir"))
    order = F.struct("acquired_on", "scene_id", "nbr")
    g = scenes.withColumn("nbr", nbr).groupBy("event_id").agg(F.min_by("nbr", order).alias("post"), F.max_by("nbr", order).alias("pre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    d = S.rounded(F.col("pre") - F.col("post"), 6)
    return g.select("event_id", d.alias("dnbr"), S.severity(d).alias("severity"))


def recovery(scenes: DataFrame) -> DataFrame:
    """Vegetation of each later scene against the first one, with class and what was to be expected."""
    ndvi = (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red"))
    w = Window.partitionBy("event_id").orderBy("acquired_on", "scene_id", "nir", "red")
    j = scenes.withColumn("ndvi", ndvi).withColumn("base", F.first("ndvi").over(w)).withColumn("from", F.first("acquired_on").over(w))
    pct = F.round(S.recovery(F.col("ndvi"), F.col("base")), 4)
    months = S.months_between(F.col("from"), F.col("acquired_on"))
    return j.select("event_id", "scene_id", months.cast("int").alias("months"), pct.alias("pct"), S.recovery_class(pct).alias("class"), F.round(S.expected_recovery(months), 6).alias("expected"))
