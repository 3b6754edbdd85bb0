"""Whole rows of lists, searches and details; audit search and verdict; candidates; recovery report; ledger; integrity classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.geo import haversine
from ..functions.text import plain
from ..streaming.state import folded
from . import monitoring

#: What stands before the name of a protected area, by its category.
PREFIXES = {
    "national_park": "Parque Nacional",
    "national_reserve": "Reserva Nacional",
    "natural_monument": "Monumento Natural",
    "provincial_reserve": "Reserva Provincial",
    "provincial_park": "Parque Provincial",
    "biosphere_reserve": "Reserva de Biosfera",
    "ramsar_site": "Sitio Ramsar",
    "world_heritage": "Patrimonio Mundial",
    "municipal_reserve": "Reserva Municipal",
    "private_reserve": "Reserva Privada",
    "wildlife_refuge": "Refugio de Vida Silvestre",
    "marine_park": "Parque Marino",
}
#: Jurisdictions by their raw names.
JURISDICTIONS = {"nacional": "national", "national": "national", "federal": "national", "provincial": "provincial", "municipal": "municipal", "privada": "private", "private": "private"}
#: Anomalies that make an event suspicious.
SUSPICIOUS = ("bare_soil", "no_recovery", "construction", "agriculture")
#: Images of one generation at most.
MOST_ITEMS = 12


def looked_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def display_name(category: Column, name: Column) -> Column:
    """The category in words, itself if it has none, and the name."""
    return F.concat_ws(" ", F.coalesce(looked_up(PREFIXES, category), category), name)


def jurisdiction(raw: Column) -> Column:
    """NULL if not known."""
    return looked_up(JURISDICTIONS, F.lower(F.trim(raw)))


# Rows


def status_of(as_of: str, monitoring_hours: int) -> Column:
    """The status, or without one what the time last seen tells: still to come, within the hours, or before."""
    now = F.lit(as_of).cast("timestamp_ntz")
    seen = F.coalesce("last_seen_at", "end_date", "start_date")
    told = F.when(seen > now, "active").when(seen >= now - F.make_dt_interval(hours=F.lit(monitoring_hours)), "monitoring").otherwise("extinct")
    return F.when(F.col("status").isin("active", "monitoring", "extinct", "false_positive"), F.col("status")).otherwise(told)


def with_imagery(fires: DataFrame, scenes: DataFrame) -> DataFrame:
    seen = scenes.select(F.col("event_id").alias("id")).distinct().withColumn("has_imagery", F.lit(True))
    return fires.join(seen, "id", "left").withColumn("has_imagery", F.coalesce("has_imagery", F.lit(False)))


def list_rows(fires: DataFrame, scenes: DataFrame, crossings: DataFrame, areas: DataFrame) -> DataFrame:
    """Every event with its position, whether it has images, and its protected areas: one of them (the smallest id), the largest overlap, how many."""
    named = crossings.join(areas.select("area_id", "official_name"), "area_id")
    own = named.groupBy("id").agg(
        F.min_by("official_name", "area_id").alias("protected_area_name"), F.min("area_id").alias("protected_area_id"), F.max("overlap").alias("overlap_percentage"), F.count(F.lit(1)).alias("n")
    )
    return with_imagery(fires, scenes).join(own, "id", "left").withColumn("protected_area_count", F.coalesce("n", F.lit(0))).drop("n")


def search_rows(fires: DataFrame, scenes: DataFrame, as_of: str, monitoring_hours: int = 48) -> DataFrame:
    """The slim rows of a search: an area or a confidence of 0 is none, the score is the confidence."""
    sure = F.nullif("avg_confidence", F.lit(0.0))
    return with_imagery(fires, scenes).select(
        "id", "start_date", "end_date", "province", "department", F.nullif("estimated_area_hectares", F.lit(0.0)).alias("estimated_area_hectares"), sure.alias("avg_confidence"), sure.alias("quality_score"),
        F.coalesce("total_detections", F.lit(0)).alias("total_detections"), F.col("has_imagery").alias("has_satellite_imagery"), F.coalesce("lat", F.lit(0.0)).alias("latitude"), F.coalesce("lon", F.lit(0.0)).alias("longitude"),
        status_of(as_of, monitoring_hours).alias("status"),
    )


def detail_rows(fires: DataFrame, detections: DataFrame, crossings: DataFrame, areas: DataFrame, climate: DataFrame, most: int = 500) -> DataFrame:
    """Events with their protected areas (by overlap, then id), the largest overlap, up to ``most`` latest detections, and whether there is climate data.

    detections: fire_id, id, detected_at. climate: id. The cap on detections is the feature; Spark drops the others before it shuffles.
    """
    place = F.row_number().over(Window.partitionBy("fire_id").orderBy(F.desc("detected_at"), "id"))
    latest = detections.withColumn("place", place).filter(F.col("place") <= most)
    latest = latest.groupBy(F.col("fire_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "detected_at"))), lambda d: d.dropFields("place")).alias("detections"))
    own = crossings.join(areas.select("area_id", "official_name"), "area_id").groupBy("id")
    own = own.agg(F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("order"), "area_id", "official_name", "overlap"))).alias("protected_areas"), F.max("overlap").alias("overlap_percentage"))
    has = climate.select("id").distinct().withColumn("has_climate_data", F.lit(True))
    rows = fires.join(own, "id", "left").join(latest, "id", "left").join(has, "id", "left")
    return rows.withColumns({"protected_areas": F.transform("protected_areas", lambda a: a.dropFields("order")), "has_climate_data": F.coalesce("has_climate_data", F.lit(False))})


def saved_filters(rows: DataFrame) -> DataFrame:
    """The default first, then the last used, those never used last, then the newest."""
    return rows.orderBy(F.desc("is_default"), F.desc_nulls_last("last_used_at"), F.desc("created_at"), "id")


# Audits


def audit_search(episodes: DataFrame, areas: DataFrame, q: str, limit: int = 20, point: tuple[float, float] | None = None, radius_km: float = 10.0) -> DataFrame:
    """The newest episodes of a place: a province by its plain name, else a protected area whose plain name holds the text, else those around a point (25 km at least).

    episodes: episode_id, province, area_id, lat, lon, start_date, end_date (a row for each area, area_id NULL if none).
    Rows are resolved_type, label, episode_id, start_date, total, earliest, latest. Nothing found: no row.
    """
    wanted = plain(F.lit(q.strip()))
    province = episodes.filter(plain(F.col("province")) == wanted).select("province").limit(1).collect()
    area = None
    if province:
        kind, label = "province", province[0][0]
        rows = episodes.filter(F.col("province") == label)
    elif area := areas.filter(plain(F.col("official_name")).contains(wanted)).orderBy("official_name").select("area_id", "official_name").first():
        kind, label = "protected_area", area[1]
        rows = episodes.filter(F.col("area_id") == area[0])
    elif point:
        kind, label = "address", q.strip()
        rows = episodes.filter(haversine(F.lit(point[0]), F.lit(point[1]), F.col("lat"), F.col("lon")) <= max(radius_km, 25.0) * 1000)
    else:
        kind, label, rows = "none", q, episodes.limit(0)
    rows = rows.groupBy("episode_id").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
    stats = rows.agg(F.count(F.lit(1)).alias("total"), F.min("start_date").alias("earliest"), F.max("end_date").alias("latest"))
    top = rows.orderBy(F.desc("start_date"), "episode_id").limit(limit)
    return top.crossJoin(stats).select(F.lit(kind).alias("resolved_type"), F.lit(label).alias("label"), "episode_id", "start_date", "total", "earliest", "latest")  # one row of stats


def audit_verdict(rows: DataFrame, as_of: str) -> DataFrame:
    """One row over the events of an audit: the last prohibition and what follows from it, and a hash over its evidence. Without events nothing is prohibited."""
    today = F.lit(as_of).cast("date")
    last = rows.agg(F.count(F.lit(1)).alias("n_events"), F.max("prohibition_until").alias("prohibition_until"), F.count_if(F.col("prohibition_until") > today).alias("n_prohibiting"))
    # An audit looks at one place, so its evidence is short.
    proof = rows.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "id", F.col("prohibition_until").cast("string"))))), 256).alias("evidence_hash"))
    left = F.greatest(F.lit(0), F.floor(F.datediff("prohibition_until", today) / 365)).cast("int")
    row = last.crossJoin(proof).withColumn("years_remaining", F.coalesce(left, F.lit(0)))  # a row each
    return row.select("n_events", "n_prohibiting", "prohibition_until", F.coalesce(F.col("prohibition_until") > today, F.lit(False)).alias("is_prohibited"), "years_remaining", S.violation(F.col("years_remaining")).alias("severity"), "evidence_hash")


# Candidates


def closure_candidates(fires: DataFrame, crossings: DataFrame, reports: DataFrame, as_of: str, retry_days: int, least_area: float, limit: int) -> DataFrame:
    """Extinct events in a protected area without a report, extinct within the retry days and large enough, the latest first."""
    since = F.date_sub(F.lit(as_of).cast("date"), retry_days).cast("timestamp_ntz")
    rows = fires.filter((F.col("status") == "extinct") & (F.col("extinct_at") >= since) & (F.col("estimated_area_hectares") >= least_area))
    rows = rows.join(crossings.select("id"), "id", "left_semi").join(reports.select("id"), "id", "left_anti")
    return rows.orderBy(F.desc("extinct_at"), "id").limit(limit).select("id", "start_date", "extinct_at", "estimated_area_hectares")


def episode_status(episodes: DataFrame, events: DataFrame, bridge: DataFrame, as_of: str, days: int = 15) -> DataFrame:
    """(episode_id, status): closed without events, active if one is, monitoring if the last went out within the days, else extinct."""
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = episodes.select("episode_id").join(bridge, "episode_id", "left").join(events.select(F.col("id").alias("event_id"), "status", F.coalesce("extinct_at", "end_date").alias("out"), F.lit(True).alias("there")), "event_id", "left")
    g = rows.groupBy("episode_id").agg(F.count("there").alias("n"), F.coalesce(F.bool_or(F.col("status") == "active"), F.lit(False)).alias("active"), F.max("out").alias("out"))
    status = F.when(F.col("n") == 0, "closed").when(F.col("active"), "active").when(F.col("out") > now - F.make_dt_interval(days=F.lit(days)), "monitoring").otherwise("extinct")
    return g.select("episode_id", status.alias("status"))


def image_candidates(episodes: DataFrame, sort: str = "frp_sum", hours: int = 24, detections: int = 10, frp_sum: float | None = None, frp_max: float | None = None, most: int = 100) -> DataFrame:
    """(episode_id, priority): live episodes that last and burn enough, the first ``most`` by one of five keys. Unknown keys mean frp_sum."""
    keys = {"frp_sum": "frp_sum", "frp_max": "max_frp", "detections": "detections", "area_estimated": "hectares", "recent": "end_date"}
    rows = episodes.filter(F.col("status").isin("active", "monitoring") & (F.col("end_date") - F.col("start_date") >= F.make_dt_interval(hours=F.lit(hours))) & (F.col("detections") >= detections))
    for column, least in (("frp_sum", frp_sum), ("max_frp", frp_max)):
        rows = rows if least is None else rows.filter(F.col(column) >= least)
    order = [F.desc_nulls_last(keys.get(sort, "frp_sum")), F.col("episode_id")]
    return rows.orderBy(*order).limit(most).select("episode_id", F.row_number().over(Window.orderBy(*order)).alias("priority"))  # ``most`` rows


def recovery_report(fires: DataFrame, scenes: DataFrame, as_of: str, least_months: int = 3, province: str | None = None) -> DataFrame:
    """(status, n) of the events that began long enough ago, from their newest scenes; without one an event is unknown."""
    old = fires.filter(F.col("start_date") < F.add_months(F.lit(as_of).cast("date"), -least_months).cast("timestamp_ntz"))
    old = old if province is None else old.filter(F.col("province") == province)
    seen = monitoring.observed(scenes)
    kind = monitoring.anomaly(F.col("base"), F.col("ndvi"), F.col("months"), F.col("pct"))["kind"]
    order = F.struct("acquired_on", "scene_id", "nir", "red")
    last = seen.groupBy(F.col("event_id").alias("id")).agg(F.max_by(F.struct("pct", kind.alias("kind")), order).alias("last"))
    rows = old.select("id").join(last, "id", "left")
    suspicious = F.coalesce(F.col("last.kind").isin(*SUSPICIOUS), F.lit(False))
    return rows.groupBy(monitoring.summary_status(F.col("last.pct"), suspicious).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# Ledger


def ledger(entries: DataFrame) -> DataFrame:
    """(user_id, entry_id, outcome, balance): grants add credits; a generation costs one credit an image.

    entries: user_id, entry_id, at, kind (grant, generate), amount, investigation. A generation of an investigation that has one
    already costs nothing (repeated); no images or over ``MOST_ITEMS`` are refused (invalid), as is what the balance does
    not cover (insufficient). State a user: the balance and the investigations that were paid for.
    """

    def step(state: list, row: dict) -> tuple[list, str]:
        balance, paid = state or (0, frozenset())
        if row["kind"] == "grant":
            balance, outcome = balance + row["amount"], "granted"
        elif row["investigation"] in paid:
            outcome = "repeated"
        elif not 0 < row["amount"] <= MOST_ITEMS:
            outcome = "invalid"
        elif balance < row["amount"]:
            outcome = "insufficient"
        else:
            balance, paid, outcome = balance - row["amount"], paid | {row["investigation"]}, "spent"
        return [balance, paid], f"{outcome} {balance}"

    rows = folded(entries.select("user_id", "entry_id", "at", "kind", "amount", "investigation"), ["user_id"], ["at", "entry_id"], step)
    parts = F.split("outcome", " ")
    return rows.select("user_id", "entry_id", parts[0].alias("outcome"), parts[1].cast("long").alias("balance"))


# Small columns


def image_integrity(episodes: DataFrame, bridge: DataFrame, events: DataFrame) -> DataFrame:
    """(episode_id, linked, same_id, result) of episodes with slides: whether events are linked, or one has the episode's own id."""
    shown = episodes.filter(F.json_array_length("slides_data") > 0).select("episode_id")
    linked = bridge.groupBy("episode_id").agg(F.count(F.lit(1)).alias("linked"))
    same = events.groupBy(F.col("id").alias("episode_id")).agg(F.count(F.lit(1)).alias("same_id"))
    rows = shown.join(linked, "episode_id", "left").join(same, "episode_id", "left").na.fill(0, ["linked", "same_id"])
    result = F.when(F.col("linked") > 0, "OK").when(F.col("same_id") > 0, "Fallback OK").otherwise("MISSING_EVENT")
    return rows.select("episode_id", "linked", "same_id", result.alias("result"))


def date_list(given: Column, base: Column, offsets: list[int], count: int, latest: str | None = None) -> Column:
    """Given dates, then offsets in months from a base, each once, none after ``latest``, ``count`` at most."""
    wanted = F.concat(F.coalesce(given, F.array().cast("array<string>")), F.when(base.isNull(), F.array().cast("array<string>")).otherwise(F.array(*[F.add_months(base, k).cast("string") for k in offsets])))
    allowed = F.filter(wanted, lambda d: d <= latest) if latest else wanted
    return F.slice(F.array_distinct(allowed), 1, count)


def normal_counts(before: Column, after: Column, most_before: int, most_after: int, most: int) -> Column:
    """Images before and after, within the limits of each side and of both; nothing at all means one after."""
    b = F.greatest(F.lit(0), F.least(F.lit(most_before), before))
    a = F.greatest(F.lit(0), F.least(F.lit(most_after), after))
    a = F.when(b + a == 0, 1).when(b + a > most, F.least(a, most - b)).otherwise(a)
    return F.struct(b.alias("before"), a.alias("after"))


def parsed_box(text: Column) -> Column:
    """west,south,east,north as a struct; NULL unless four numbers in range and in order."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    west, south, east, north = (F.get(parts, F.lit(k)).try_cast("double") for k in range(4))
    fits = (F.size(parts) == 4) & (west < east) & (south < north) & west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90)
    return F.when(fits, F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north")))


def box_or_point(aoi: Column, lat: Column, lon: Column, margin: float) -> Column:
    """The box of a JSON object with four numbers, else the one around a point, else NULL."""
    sides = ("west", "south", "east", "north")
    given = [F.get_json_object(aoi, f"$.{s}").try_cast("double") for s in sides]
    whole = given[0].isNotNull() & given[1].isNotNull() & given[2].isNotNull() & given[3].isNotNull()
    around = [lon - margin, lat - margin, lon + margin, lat + margin]
    return F.when(whole, F.struct(*[g.alias(s) for g, s in zip(given, sides, strict=True)])).when(lat.isNotNull() & lon.isNotNull(), F.struct(*[a.alias(s) for a, s in zip(around, sides, strict=True)]))


def with_history(value: Column, history: Column, at: Column) -> Column:
    """A JSON history array with one entry more; NULL or no array counts as empty."""
    kept = F.coalesce(F.from_json(history, "array<struct<at: string, value: string>>"), F.array().cast("array<struct<at: string, value: string>>"))
    return F.to_json(F.array_append(kept, F.struct(at.cast("string").alias("at"), value.cast("string").alias("value"))))


def parameters(rows: DataFrame, defaults: dict[str, str], strict: bool = False) -> dict[str, str]:
    """Stored parameters (key, JSON {"value": ...}) with defaults for what is missing; strict: a missing one is an error."""
    stored = {r["key"]: r["value"] for r in rows.filter(F.col("key").isin(*defaults)).select("key", F.get_json_object("value", "$.value").alias("value")).collect()}  # one a default
    if strict and (missing := [k for k in defaults if stored.get(k) is None]):
        raise KeyError(f"no stored value for {', '.join(missing)}")
    return {k: stored.get(k) or v for k, v in defaults.items()}


def export_logs(logs: DataFrame, path: str, date_from: str | None = None, date_to: str | None = None, shelter: str | None = None) -> None:
    """Visitor logs of a span and shelter as CSV, the newest visit first."""
    rows = logs
    for condition in (date_from and F.col("visit_date") >= F.lit(date_from).cast("date"), date_to and F.col("visit_date") <= F.lit(date_to).cast("date"), shelter and F.col("shelter_id") == shelter):
        rows = rows if condition is None else rows.filter(condition)
    columns = ["id", "shelter_id", "visit_date", "registration_type", "group_leader_name", "total_people", "created_at"]
    rows.select(*columns).orderBy(F.desc("visit_date"), "id").write.mode("overwrite").option("header", True).csv(path)
