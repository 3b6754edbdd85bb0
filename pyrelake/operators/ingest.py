"""Ingest of detections: time, confidence, hash, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import in_box
from ..functions.scoring import confidence

#: The country's box (west, south, east, north).
COUNTRY = (-74.0, -56.0, -53.0, -21.0)


def detected_at(day: Column, hhmm: Column) -> Column:
    """A date and digits like 5, 45 or 1345 as a time of that day: the last four count, none or NULL is midnight."""
    t = F.right(F.concat(F.lit("0000"), F.regexp_replace(F.coalesce(hhmm, F.lit("")), "[^0-9]", "")), F.lit(4))
    return F.to_timestamp_ntz(F.concat_ws(" ", day, F.concat_ws(":", F.substring(t, 1, 2), F.substring(t, 3, 2))), F.lit("yyyy-MM-dd HH:mm"))


def instrument(satellite: Column) -> Column:
    """VIIRS satellites by name, MODIS for the others."""
    return F.when(F.upper(satellite).contains("VIIRS"), "VIIRS").otherwise("MODIS")


def detection_hash(satellite: Column, by: Column, at: Column, lat: Column, lon: Column, frp: Column, sure: Column) -> Column:
    """SHA-256 over satellite, instrument, time in UTC, position, power and confidence."""
    time = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.sha2(F.concat_ws("|", satellite, by, time, F.format_string("%.5f", lat), F.format_string("%.5f", lon), F.format_string("%.2f", frp), sure.cast("string")), 256)


def legacy_hash(satellite: Column, at: Column, lat: Column, lon: Column) -> Column:
    """The older key: 16 digits of an MD5 over position, day, time and satellite."""
    return F.substring(F.md5(F.concat_ws("|", F.format_string("%.5f", lat), F.format_string("%.5f", lon), F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "HH:mm:ss"), satellite)), 1, 16)


def normalize(raw: DataFrame, least: int = 50) -> DataFrame:
    """CSV rows as detections: bands of either instrument, confidence, time, hash; inside the country and sure enough."""
    rows = raw.select(
        F.replace(F.regexp_replace("satellite", "_NRT$", ""), F.lit("_"), F.lit("-")).alias("satellite"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.coalesce("brightness", "bright_ti4").alias("bt_mir"), F.coalesce("bright_t31", "bright_ti5").alias("bt_tir"),
        "frp", confidence(F.col("confidence")).alias("confidence"), detected_at(F.col("acq_date"), F.col("acq_time")).alias("detected_at"), "daynight",
    )
    rows = rows.filter(in_box(F.col("lat"), F.col("lon"), *COUNTRY)).filter(F.col("confidence") >= least)
    return hashed(rows.withColumn("instrument", instrument(F.col("satellite"))))


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("detection_hash", detection_hash(*[F.col(c) for c in ("satellite", "instrument", "detected_at", "lat", "lon", "frp", "confidence")]))


def on_days_of(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Known detections of the days of a batch: equal hashes are of one time, so no others can repeat. A batch looks back over some days at most."""
    day = lambda rows: rows.withColumn("_day", F.to_date("detected_at"))
    return day(known).join(day(batch).select("_day").distinct(), "_day", "left_semi").drop("_day")


def new_only(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Of a batch the first row of each hash that is not known yet."""
    first = batch.withColumn("_place", F.row_number().over(Window.partitionBy("detection_hash").orderBy("id"))).filter("_place = 1").drop("_place")
    return first.join(known.select("detection_hash"), "detection_hash", "left_anti")
