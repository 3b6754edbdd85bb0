"""Fire events: filters, listing, pages, statistics, trends. Pure ``DataFrame -> DataFrame`` over the event columns."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import in_box
from ..functions.text import plain


@dataclass(frozen=True)
class Filters:
    """Conditions that are set; ``as_of`` stands for the present."""

    as_of: str
    provinces: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    status: str = "all"
    min_confidence: float | None = None
    min_detections: int | None = None
    department: str | None = None
    significant: bool | None = None
    search: str | None = None
    box: tuple[float, float, float, float] | None = None
    active_days: int = 7

    def conditions(self) -> list[Column]:
        out = []
        if self.provinces:
            out.append(F.col("province").isin(*self.provinces))
        if self.date_from:
            out.append(F.col("start_date") >= F.lit(self.date_from).cast("timestamp_ntz"))
        if self.date_to:
            out.append(F.col("start_date") < F.date_add(F.lit(self.date_to).cast("date"), 1).cast("timestamp_ntz"))
        live = F.coalesce(F.col("status").isin("active", "monitoring"), F.coalesce("end_date", "start_date") >= F.date_sub(F.lit(self.as_of).cast("date"), self.active_days).cast("timestamp_ntz"))
        if self.status == "active":
            out.append(live)
        elif self.status == "historical":
            out.append(~live)
        if self.min_confidence is not None:
            out.append(F.col("avg_confidence") >= self.min_confidence)
        if self.min_detections is not None:
            out.append(F.col("total_detections") >= self.min_detections)
        if self.search and len(self.search.strip()) >= 2:
            found = [F.coalesce(plain(F.col(c)).contains(plain(F.lit(self.search))), F.lit(False)) for c in ("province", "department")]
            out.append(found[0] | found[1])
        if self.department:
            out.append(F.col("department").ilike(f"%{self.department}%"))
        if self.significant is not None:
            out.append(F.col("is_significant") == self.significant)
        if self.box:
            out.append(in_box(F.col("lat"), F.col("lon"), *self.box, strict=True))
        return out

    def apply(self, fires: DataFrame) -> DataFrame:
        for c in self.conditions():
            fires = fires.filter(c)
        return fires


def hours(a: Column, b: Column) -> Column:
    return (F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))) / 3600


def items(fires: DataFrame) -> DataFrame:
    """List items: NULL metrics are 0, a duration in hours."""
    return fires.select(
        "id", "province", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce(hours(F.col("start_date"), F.col("end_date")), F.lit(0.0)).alias("duration_hours"), F.coalesce("max_frp", F.lit(0.0)).alias("max_frp"),
        F.coalesce("estimated_area_hectares", F.lit(0.0)).alias("area"), "total_detections",
    )


def page(rows: DataFrame, order: list[Column], number: int, size: int | None, largest: int = 100) -> DataFrame:
    """One page; sizes are clamped, the order must end with the key."""
    size = 20 if size is None else max(1, min(largest, size))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def keyset(rows: DataFrame, after: str, after_id: int, size: int) -> DataFrame:
    """The page that follows an event (start date and id), newest first; ties of the date go by id. Its last row is the next cursor."""
    start, at = F.col("start_date"), F.lit(after).cast("timestamp_ntz")
    return rows.filter((start < at) | ((start == at) & (F.col("id") > after_id))).orderBy(F.desc("start_date"), "id").limit(size)


def is_active(as_of: str) -> Column:
    """active, monitoring, or without status and seen since ``as_of``."""
    seen = F.coalesce("last_seen_at", "end_date", "start_date") >= F.lit(as_of).cast("timestamp_ntz")
    return F.coalesce(F.col("status").isin("active", "monitoring") | (F.col("status").isNull() & seen), F.lit(False))


def kpis(fires: DataFrame, as_of: str) -> DataFrame:
    """One row of totals; shares are guarded against an empty table."""
    total = F.count(F.lit(1))
    active = F.count_if(is_active(as_of))
    return fires.agg(
        total.alias("total"), active.alias("active"), F.greatest(total - active, F.lit(0)).alias("historical"), F.count_if("is_significant").alias("significant"), F.coalesce(F.sum("total_detections"), F.lit(0)).alias("detections"),
        F.round(F.coalesce(F.sum("estimated_area_hectares"), F.lit(0.0)), 2).alias("area"), F.round(F.coalesce(F.avg("avg_confidence"), F.lit(0.0)), 4).alias("confidence"), F.round(F.coalesce(F.avg("estimated_area_hectares"), F.lit(0.0)), 4).alias("mean_area"), F.round(F.when(total > 0, active * 100.0 / total).otherwise(0.0), 4).alias("active_share"),
    )


def median_area(fires: DataFrame) -> DataFrame:
    return fires.agg(F.round(F.coalesce(F.percentile("estimated_area_hectares", 0.5), F.lit(0.0)), 4).alias("median_area"))


def by_province(fires: DataFrame) -> DataFrame:
    return fires.groupBy(F.coalesce("province", F.lit("Unknown")).alias("province")).agg(F.count(F.lit(1)).alias("n"), F.max("start_date").alias("latest"))


def month(c: str) -> Column:
    return F.date_format(F.col(c), "yyyy-MM")


def by_month(fires: DataFrame) -> DataFrame:
    return fires.groupBy(month("start_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def strongest(fires: DataFrame, n: int = 10) -> DataFrame:
    return fires.orderBy(F.desc_nulls_last("max_frp"), "id").limit(n).select("id", "max_frp", "province")


def year_to_date(fires: DataFrame, as_of: str) -> DataFrame:
    """This year so far against the same days of the year before, in one pass."""
    d, start = F.lit(as_of).cast("date"), F.col("start_date").cast("date")
    this = start.between(F.trunc(d, "year"), d)
    last = start.between(F.add_months(F.trunc(d, "year"), -12), F.add_months(d, -12))
    both = fires.agg(F.count_if(this).alias("current"), F.count_if(last).alias("previous"))
    return both.select("current", "previous", (F.col("current") - F.col("previous")).alias("delta"), F.round(F.when(F.col("previous") > 0, (F.col("current") - F.col("previous")) * 100.0 / F.col("previous")), 2).alias("delta_pct"))


def public_stats(fires: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Day and province counts; months when the range is over 90 days, an error over 730."""
    from datetime import date

    days = (date.fromisoformat(date_to) - date.fromisoformat(date_from)).days
    if days > 730 or days < 0:
        raise ValueError(f"a range of {days} days")
    day = F.col("start_date").cast("date")
    period = F.trunc(day, "month") if days > 90 else day
    return fires.filter(day.between(date_from, date_to)).groupBy(period.alias("stat_date"), F.coalesce("province", F.lit("Unknown")).alias("province")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_detections").alias("detections"))


def series(fires: DataFrame) -> DataFrame:
    """Months in order with count and area; x is the row's place, gaps are not filled. The table of months is small."""
    m = fires.groupBy(month("start_date").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("estimated_area_hectares"), F.lit(0.0)), 2).alias("area"))
    return m.withColumn("x", F.row_number().over(Window.orderBy("period")) - 1)


def trend_granularity(date_from: str, date_to: str) -> str:
    """Months for more than 90 days, else days."""
    if date_to < date_from:
        raise ValueError("date_to must not be before date_from")
    return "month" if (date.fromisoformat(date_to) - date.fromisoformat(date_from)).days > 90 else "day"


def trend_series(fires: DataFrame, date_from: str, date_to: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """period, n, area, x: events that start from the first day to the midnight of the last, in a box (west, south, east, north), by month or day; periods without events are left out.

    There are as many rows as periods at most, so one window numbers them.
    """
    rows = fires.filter(F.col("start_date").between(F.lit(date_from).cast("timestamp_ntz"), F.lit(date_to).cast("timestamp_ntz")))
    if box:
        rows = rows.filter(in_box(F.col("lat"), F.col("lon"), *box))
    period = F.date_trunc(trend_granularity(date_from, date_to), F.col("start_date").cast("timestamp")).cast("date")
    p = rows.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("estimated_area_hectares"), F.lit(0.0)).alias("area"))
    return p.withColumn("x", F.row_number().over(Window.orderBy("period")) - 1)


def trend_summary(points: DataFrame, granularity: str) -> DataFrame:
    """One row: direction, rate a period and a year (percent), totals. Without events: stable, 0."""
    total = points.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_fires"), F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 2).alias("total_hectares"))
    yearly = F.round(F.col("rate") * (12 if granularity == "month" else 365), 2)
    return direction(points).crossJoin(total).select("direction", "rate", yearly.alias("annual_rate"), "total_fires", "total_hectares")  # a row each


def trend_next(points: DataFrame, granularity: str, periods: int = 3) -> DataFrame:
    """The next periods after the last one with events: events, area at the mean area of an event, band of a fifth."""
    last = points.agg(F.max("period").alias("last_period"), (F.sum("area") / F.sum("n")).alias("each")).filter("last_period IS NOT NULL")
    ahead = F.col("ahead")
    period = F.add_months("last_period", ahead) if granularity == "month" else F.date_add("last_period", ahead)
    step = F.col("rate") / 100 * F.col("last")
    value = F.greatest(F.col("last") + ahead * step, F.lit(0.0))
    rows = direction(points).crossJoin(last).select("rate", "last", "last_period", "each", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("ahead"))  # a row each
    return rows.select(period.alias("period"), F.round(value, 2).alias("n"), F.round(value * F.col("each"), 2).alias("area"), F.round(value * 0.8, 2).alias("low"), F.round(value * 1.2, 2).alias("high"))


def direction(points: DataFrame, band: float = 5.0) -> DataFrame:
    """Slope as percent of the mean a period, and its direction outside a dead band."""
    s = points.agg(F.regr_slope("n", "x").alias("slope"), F.avg("n").alias("mean"), F.max_by("n", "x").alias("last"))
    rate = F.coalesce(F.when(F.col("mean") > 0, F.col("slope") / F.col("mean") * 100), F.lit(0.0))
    return s.select(F.round(rate, 2).alias("rate"), F.when(rate > band, "increasing").when(rate < -band, "decreasing").otherwise("stable").alias("direction"), F.col("last").alias("last"))


def projection(points: DataFrame, periods: int = 3) -> DataFrame:
    """The next periods with a band of a fifth; never below 0."""
    step = F.col("rate") / 100 * F.col("last")
    k = direction(points).select("rate", "last", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("ahead"))
    value = F.greatest(F.col("last") + F.col("ahead") * step, F.lit(0.0))
    return k.select("ahead", F.round(value, 2).alias("n"), F.round(value * 0.8, 2).alias("low"), F.round(value * 1.2, 2).alias("high"))


def recurrence(fires: DataFrame, box: tuple[float, float, float, float], size: float = 0.5, most: int = 500) -> DataFrame:
    """Events a grid cell of a box (west, south, east, north): class and score; the report lists the ``most`` highest."""
    from ..functions.geo import cell

    g = fires.filter(in_box(F.col("lat"), F.col("lon"), *box)).groupBy(cell(F.col("lat"), F.col("lon"), size).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.max("max_frp").alias("max_frp"))
    return g.orderBy(F.least(F.col("n"), F.lit(10)).desc(), "cell").limit(most).select("cell", "n", "max_frp", F.when(F.col("n") >= 5, "high").when(F.col("n") >= 2, "medium").otherwise("low").alias("class"), F.round(F.least(F.col("n") / 10, F.lit(1.0)), 4).alias("score"))


def cell_count(fires: DataFrame, box: tuple[float, float, float, float], size: float = 0.5) -> DataFrame:
    """Cells with events in a box."""
    from ..functions.geo import cell

    return fires.filter(in_box(F.col("lat"), F.col("lon"), *box)).agg(F.countDistinct(cell(F.col("lat"), F.col("lon"), size)).alias("n"))


def guarded_recurrence(fires: DataFrame, box: tuple[float, float, float, float], size: float = 0.5, most_cells: int = 5000) -> DataFrame:
    """Recurrence, or an error where the box has too many cells."""
    if (n := cell_count(fires, box, size).first()["n"]) > most_cells:
        raise ValueError(f"{n} cells: reduce the area")
    return recurrence(fires, box, size)


def search_with_areas(fires: DataFrame, crossings: DataFrame, areas: DataFrame, text: str) -> DataFrame:
    """Events whose province, department or protected area holds a text, whatever its case and accents; shorter than two characters finds all."""
    if len(text.strip()) < 2:
        return fires
    holds = lambda c: F.coalesce(plain(F.col(c)).contains(plain(F.lit(text))), F.lit(False))
    named = crossings.filter("overlap = 100").join(areas.filter(holds("official_name")).select("area_id"), "area_id", "left_semi").select("id", F.lit(True).alias("named")).distinct()
    return fires.join(named, "id", "left").filter(holds("province") | holds("department") | F.col("named").isNotNull()).drop("named")


def recurrence_view(fires: DataFrame, as_of: str, size: float = 0.5) -> DataFrame:
    """Recurrence within one and five years of ``as_of``."""
    from ..functions.geo import cell

    d, day = F.lit(as_of).cast("date"), F.col("start_date").cast("date")
    n5, n1 = F.count_if(day >= F.add_months(d, -60)), F.count_if(day >= F.add_months(d, -12))
    g = fires.groupBy(cell(F.col("lat"), F.col("lon"), size).alias("cell")).agg(F.count(F.lit(1)).alias("n"), n5.alias("n5"), n1.alias("n1"))
    return g.select("cell", "n", "n5", "n1", F.when(F.col("n5") > 3, "high").when(F.col("n5") >= 1, "medium").otherwise("low").alias("class"), F.round(F.least(F.col("n5") / 5, F.lit(1.0)), 4).alias("score"))
