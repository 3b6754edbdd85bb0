"""Recovery after fires: summaries, anomalies, land use, images for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from .spatial import latest_by


def anomaly(baseline: Column, current: Column, months: Column, pct: Column) -> Column:
    """(kind, confidence): the first rule that holds."""
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    return (
        F.when((months > 12) & (pct < 20), kind("no_recovery", 0.8))
        .when(current < baseline * 0.3, kind("sudden_drop", 0.9))
        .when((months < 6) & (pct > 80), kind("rapid_greening", 0.7))
        .when(pct < S.expected_recovery(months) * 50, kind("no_recovery", 0.6))
        .otherwise(kind("none", 0.0))
    )


def summary_status(pct: Column, suspicious: Column) -> Column:
    """Status in the recovery summary; a suspicious event is that whatever its share."""
    return F.when(suspicious, "suspicious").when(pct.isNull(), "unknown").otherwise(S.steps(pct, [(90, "excellent"), (70, "good"), (50, "moderate"), (25, "poor")], "critical"))


def observed(scenes: DataFrame) -> DataFrame:
    """Scenes with NDVI, that of the first scene, months since it and the share recovered."""
    w = Window.partitionBy("event_id").orderBy("acquired_on", "scene_id", "nir", "red")
    j = scenes.withColumn("ndvi", (F.col("nir") - F.col("red")) / (F.col("nir") + F.col("red"))).withColumn("base", F.first("ndvi").over(w)).withColumn("from", F.first("acquired_on").over(w)).withColumn("x", F.row_number().over(w) - 1)
    return j.withColumn("months", S.months_between(F.col("from"), F.col("acquired_on"))).withColumn("pct", F.round(S.recovery(F.col("ndvi"), F.col("base")), 4))


def anomalies(scenes: DataFrame) -> DataFrame:
    j = observed(scenes).withColumn("a", anomaly(F.col("base"), F.col("ndvi"), F.col("months"), F.col("pct")))
    return j.select("event_id", "scene_id", F.col("a.kind").alias("kind"), F.col("a.confidence").alias("confidence"))


def recovery_summary(scenes: DataFrame) -> DataFrame:
    """Events by status of their newest scene."""
    last = latest_by(observed(scenes), "event_id", F.desc("acquired_on"), F.desc("scene_id"), F.desc("nir"), F.desc("red"))
    kind = anomaly(F.col("base"), F.col("ndvi"), F.col("months"), F.col("pct"))["kind"]
    return last.groupBy(summary_status(F.col("pct"), kind == "no_recovery").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def recovery_trend(scenes: DataFrame) -> DataFrame:
    """Slope of the recovered share over the scenes in order; confidence grows with it."""
    g = observed(scenes).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.regr_slope("pct", "x"), 6).alias("slope"))
    sure = F.least(F.lit(0.9), 0.5 + F.abs("slope") / 20)
    trend = F.when(F.col("n") < 2, "unknown").when(F.col("slope") > 5, "improving").when(F.col("slope") < -5, "declining").otherwise("stagnant")
    return g.select("event_id", trend.alias("trend"), F.round(F.when(F.col("n") < 2, 0.0).when(F.abs("slope") > 5, sure).otherwise(0.6), 3).alias("confidence"))


#: NDVI below which ground is bare, and below which its plants are sparse.
BARE, SPARSE = 0.1, 0.2


def land_use(baseline: Column, current: Column, months: Column) -> Column:
    share = current / F.greatest(baseline, F.lit(0.1))
    return (
        F.when((current < BARE) & (months > 12), "construction")
        .when((current < SPARSE) & (months > 18), "bare_soil")
        .when((months < 6) & (share > 1.2), "agriculture")
        .when(share > S.expected_recovery(months) * 0.7, "natural_recovery")
        .otherwise("uncertain")
    )


def land_uses(scenes: DataFrame) -> DataFrame:
    return observed(scenes).select("event_id", "scene_id", land_use(F.col("base"), F.col("ndvi"), F.col("months")).alias("change"))


def scene_stats(scenes: DataFrame) -> DataFrame:
    """Cloud cover of the scenes of each event."""
    c = F.col("cloud_cover")
    return scenes.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.avg(c) + 1e-7, 4).alias("mean"), F.round(F.stddev_pop(c) + 1e-7, 4).alias("deviation"))


def clear_scenes(scenes: DataFrame, since: str, until: str, most_cloud: float = 20.0) -> DataFrame:
    """Scenes of a span under a cloud cover: a collection in order of cover."""
    return scenes.filter(F.col("acquired_on").between(since, until) & (F.col("cloud_cover") < most_cloud)).select("event_id", "scene_id", "acquired_on", "cloud_cover", S.cloud_quality(F.col("cloud_cover")).alias("quality"))


def closure_images(fires: DataFrame, scenes: DataFrame, most_cloud: float = 20.0) -> DataFrame:
    """For each extinct event, of the scenes under a cloud cover, the one after its extinction within two weeks, nearest to a week, and before its start: within 15 to 7 days (nearest to 10), or else 30 to 15 (nearest to 22)."""
    events = fires.filter("extinct_at IS NOT NULL").select(F.col("id").alias("event_id"), F.col("start_date").cast("date").alias("pre"), F.col("extinct_at").cast("date").alias("post"))
    j = events.join(scenes.filter(F.col("cloud_cover") < most_cloud).select("event_id", "scene_id", "acquired_on"), "event_id")
    since = lambda side: F.datediff("acquired_on", side)
    slots = [("post", 1, 0, 14, 7), ("pre", 1, -15, -7, -10), ("pre", 2, -30, -15, -22)]
    fits = F.array_compact(F.array(*[F.when(since(side).between(low, high), F.struct(F.lit(side).alias("side"), F.lit(tier).alias("tier"), F.abs(since(side) - target).alias("gap"))) for side, tier, low, high, target in slots]))
    rows = j.select("event_id", "scene_id", F.inline(fits))
    return rows.groupBy("event_id", "side").agg(F.min(F.struct("tier", "gap", "scene_id")).alias("best")).select("event_id", "side", "best.tier", "best.gap", "best.scene_id")


def area_windows(crossings: DataFrame, fires: DataFrame) -> DataFrame:
    """Events of each area: number, first and last."""
    return crossings.join(fires.select("id", "start_date"), "id").groupBy("area_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_date").alias("first"), F.max("start_date").alias("last"))
