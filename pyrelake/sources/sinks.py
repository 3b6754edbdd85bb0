"""Sinks: exports, append with duplicate suppression, upsert, newest-N table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the event export, in order.
EXPORT = ("id", "start_date", "end_date", "last_seen_at", "status", "province", "department", "lat", "lon", "total_detections", "max_frp", "avg_confidence", "estimated_area_hectares", "is_significant")


def export_csv(fires: DataFrame, path: str, max_records: int = 10_000) -> None:
    """The feature is a capped export: the first rows by start and id, one file."""
    fires.select(*EXPORT).orderBy("start_date", "id").limit(max_records).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_json(fires: DataFrame, path: str, filters: dict[str, str], exported_at: str, max_records: int = 10_000) -> None:
    """The capped export in one envelope."""
    top = fires.select(*EXPORT).orderBy("start_date", "id").limit(max_records)
    applied = F.create_map(*[F.lit(x) for kv in filters.items() for x in kv]) if filters else F.lit(None).cast("map<string,string>")
    top.agg(F.count(F.lit(1)).alias("total_records"), F.collect_list(F.struct(*EXPORT)).alias("fires")).select(F.lit(exported_at).alias("exported_at"), "total_records", applied.alias("filters_applied"), "fires").write.mode("overwrite").json(path)


def unseen(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Of rows of ``new`` whose key is not known, one a key: the smallest in the order of all columns."""
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("row")).select(key, "row.*") if len(new.columns) > 1 else new.distinct()
    return first.select(new.columns).join(known.select(key), key, "left_anti")


def append_unseen(new: DataFrame, known: DataFrame, key: str, path: str) -> None:
    unseen(new, known, key).write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def newest(rows: DataFrame, ts: str, key: str, keep: int = 1000) -> DataFrame:
    """The dead-letter table keeps the newest rows only; ties go by the key."""
    return rows.orderBy(F.col(ts).desc(), key).limit(keep)
