"""Work on what is new: pending detections, invalidated episodes, merges into stored tables, revisions, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spatial

# Clustering of what is pending


def pending(detections: DataFrame, processed: DataFrame, since: str | None = None, least: int = 50) -> DataFrame:
    """Detections without a row in ``processed`` (id, event_id; event_id NULL is noise), seen since a day and sure enough; a NULL confidence is."""
    rows = detections.filter(F.col("confidence").isNull() | (F.col("confidence") >= least))
    if since:
        rows = rows.filter(F.col("detected_at") >= F.lit(since).cast("timestamp_ntz"))
        processed = processed.filter(F.col("detected_at") >= F.lit(since).cast("timestamp_ntz")) if "detected_at" in processed.columns else processed
    return rows.join(processed.select("id"), "id", "left_anti")


def cluster_pending(detections: DataFrame, processed: DataFrame, eps: float, min_points: int, window_s: int, since: str | None = None) -> DataFrame:
    """(id, event_id, detected_at) of the pending detections, noise with a NULL event_id: rows to append to ``processed``.

    What was processed, as noise too, is left as it is; new clusters get events of their own.
    """
    rows = pending(detections, processed, since).withColumn("t", spatial.seconds("detected_at"))
    rows = spatial.written(rows.select("id", "lat", "lon", "t", "detected_at"))
    labels = spatial.dbscan(rows, eps, min_points, window_s)
    return labels.join(rows.select("id", "detected_at"), "id").select("id", F.col("label").alias("event_id"), "detected_at")


def clear_processed(processed: DataFrame, events: DataFrame) -> DataFrame:
    """``processed`` without the rows of flagged events: the next run clusters their detections anew."""
    return processed.join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti").select(processed.columns)


# Invalidation of episodes


def changed_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id) of events that moved, or became false positives."""
    o, n = (t.select("id", *[F.col(c).alias(f"{c}_{k}") for c in ("lat", "lon", "status")]) for t, k in ((old, "old"), (new, "new")))
    moved = ~F.col("lat_old").eqNullSafe(F.col("lat_new")) | ~F.col("lon_old").eqNullSafe(F.col("lon_new"))
    wrong = ~F.col("status_old").eqNullSafe(F.lit("false_positive")) & F.col("status_new").eqNullSafe(F.lit("false_positive"))
    return o.join(n, "id").filter(moved | wrong).select("id")


def affected_episodes(changed: DataFrame, bridge: DataFrame) -> DataFrame:
    """(episode_id) of the episodes that hold a changed event. bridge: episode_id, event_id."""
    return bridge.join(changed.select(F.col("id").alias("event_id")), "event_id", "left_semi").select("episode_id").distinct()


def episode_metrics(events: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row per episode of the bridge: events without false positives, span, sums, centre and box. Without any, counts are 0 and the rest NULL."""
    e = events.filter(~F.col("status").eqNullSafe(F.lit("false_positive")))
    rows = bridge.join(e.withColumnRenamed("id", "event_id"), "event_id", "left")
    return rows.groupBy("episode_id").agg(
        F.count("lat").alias("n_events"),
        F.min("start_date").alias("start_date"),
        F.max("end_date").alias("end_date"),
        F.coalesce(F.sum("total_detections"), F.lit(0)).alias("detections"),
        F.max("max_frp").alias("max_frp"),
        F.round(F.avg("lat") + 1e-9, 6).alias("centre_lat"),
        F.round(F.avg("lon") + 1e-9, 6).alias("centre_lon"),
        *[F.round(f(c) + 1e-9, 6).alias(n) for f, c, n in ((F.min, "lat", "south"), (F.max, "lat", "north"), (F.min, "lon", "west"), (F.max, "lon", "east"))],
    )


def refreshed(stored: DataFrame, events: DataFrame, bridge: DataFrame, affected: DataFrame) -> DataFrame:
    """Stored metrics with those of the affected episodes computed anew, from their events alone."""
    some = bridge.join(affected, "episode_id", "left_semi")
    theirs = events.join(some.select(F.col("event_id").alias("id")).distinct(), "id", "left_semi")
    return stored.join(affected, "episode_id", "left_anti").unionByName(episode_metrics(theirs, some))


# Merges into stored tables


def merge_into(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str) -> None:
    """Upsert into a table partitioned by ``partition``: only partitions that ``new`` touches are read and replaced, each at once.

    The partition must follow from the keys (a key stays in its partition). A rerun gives the same table.
    """
    touched = [r[0] for r in new.select(partition).distinct().collect()]  # partitions, not rows
    old = spark.read.parquet(path).filter(F.col(partition).isin(touched)) if touched else None
    if old is None:
        return
    merged = spatial.written(old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(old.columns)))
    merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def rebuild(path: str, rows: DataFrame, partition: str, truncate: bool) -> None:
    """Truncate and write anew, or append."""
    rows.repartition(partition).write.mode("overwrite" if truncate else "append").partitionBy(partition).parquet(path)


# Revisions


def revisions(logs: DataFrame, updates: DataFrame, fields: list[str], key: str, edit_minutes: int = 30) -> DataFrame:
    """One row per accepted update: key, revision, valid_from, valid_to, before, after (JSON of the fields).

    logs: key, first_submitted, fields. updates: key, update_id, made_at, fields, NULL where they stay. Updates later than
    ``edit_minutes`` after the first submission are refused. Ties in time go by update_id.
    """
    late = F.col("first_submitted") + F.make_dt_interval(mins=F.lit(edit_minutes))
    base = logs.select(key, "first_submitted", *[F.col(f).alias(f"{f}_0") for f in fields])
    rows = updates.join(base, key).filter(F.col("made_at") <= late)
    order = Window.partitionBy(key).orderBy("made_at", "update_id")
    until, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    image = lambda span: F.to_json(F.struct(*[F.coalesce(F.last(f, ignorenulls=True).over(span), F.col(f"{f}_0")).alias(f) for f in fields]))
    return rows.select(key, F.row_number().over(order).alias("revision"), F.col("made_at").alias("valid_from"), F.lead("made_at").over(order).alias("valid_to"), image(until).alias("before"), image(upto).alias("after"))


def state_at(logs: DataFrame, history: DataFrame, fields: list[str], key: str, at: str) -> DataFrame:
    """Each log as it was at a time: (key, state). Logs that were not yet submitted are left out."""
    t = F.lit(at).cast("timestamp_ntz")
    valid = history.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))).select(key, "after")
    first = F.to_json(F.struct(*fields))
    return logs.filter(F.col("first_submitted") <= t).join(valid, key, "left").select(key, F.coalesce("after", first).alias("state"))


def verified(requests: DataFrame, reports: DataFrame, audit: DataFrame) -> DataFrame:
    """report_id, found, is_valid, shown: given hashes against the stored ones, or else the newest audit event's.

    requests: report_id, given. reports: report_id, verification_hash. audit: action, details (JSON), created_at, audit_id.
    """
    newest = (
        audit.filter("action = 'report_generated'")
        .select(F.get_json_object("details", "$.report_id").alias("report_id"), F.get_json_object("details", "$.verification_hash").alias("audited"), "created_at", "audit_id")
        .groupBy("report_id")
        .agg(F.max_by("audited", F.struct("created_at", "audit_id")).alias("audited"))
    )
    empty = lambda c: F.when(F.length(c) > 0, F.col(c))
    rows = requests.join(reports, "report_id", "left").join(newest, "report_id", "left").withColumn("stored", F.coalesce(empty("verification_hash"), empty("audited")))
    shown = F.concat(F.substring("stored", 1, 16), F.lit("..."), F.right("stored", F.lit(16)))
    return rows.select("report_id", F.col("stored").isNotNull().alias("found"), (F.lower("stored") == F.lower("given")).alias("is_valid"), shown.alias("shown"))


def one_of(column: str, values: list[str]) -> Column:
    """Membership of an array column."""
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values]))
