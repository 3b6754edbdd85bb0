"""Scores, classes and conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Half up by multiplication, as other engines can repeat it exactly; no negative zero."""
    return F.floor(x * 10.0**places + 0.5) / F.lit(10.0**places) + F.lit(0.0)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def confidence(raw: Column) -> Column:
    """Letters and words to 33, 66, 100; numbers truncated and clamped; anything else 0."""
    t = F.lower(F.trim(raw))
    return F.when(t.isin("l", "low"), 33).when(t.isin("n", "nominal"), 66).when(t.isin("h", "high"), 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(t.try_cast("double").cast("int"), F.lit(0)))))


def steps(x: Column, bounds: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """The name of the first bound that ``x`` reaches (or, if strict, exceeds); bounds fall."""
    out = None
    for bound, name in bounds:
        test = x > bound if strict else x >= bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def reliability(conf: Column, imagery: Column, climate: Column, independent: Column) -> Column:
    return clamp(conf * 0.4 + imagery * 0.2 + climate * 0.2 + independent * 0.2)


def reliability_class(score: Column) -> Column:
    return steps(score, [(80, "high"), (50, "medium")], "low")


def severity(dnbr: Column) -> Column:
    return steps(dnbr, [(0.66, "high"), (0.44, "moderate_high"), (0.27, "moderate_low"), (0.1, "low")], "unburned")


def cloud_quality(cover: Column) -> Column:
    return F.when(cover <= 10, "excellent").when(cover <= 20, "good").when(cover <= 30, "fair").when(cover <= 50, "poor").otherwise("unusable")


def recovery(current: Column, baseline: Column) -> Column:
    return F.when(baseline <= 0, F.when(current > 0.4, 100.0).otherwise(0.0)).otherwise(clamp(current / baseline * 100))


def recovery_class(pct: Column) -> Column:
    return steps(pct, [(90, "full_recovery"), (60, "advanced_recovery"), (30, "moderate_recovery"), (10, "early_recovery")], "no_recovery")


#: Expected share of vegetation back, by months after the fire.
EXPECTED = ((0, 0.0), (3, 0.15), (6, 0.30), (12, 0.50), (24, 0.70), (36, 0.85))


def expected_recovery(months: Column) -> Column:
    """Piecewise linear, flat after the last point."""
    out = F.lit(EXPECTED[-1][1])
    for (m0, v0), (m1, v1) in reversed(list(zip(EXPECTED, EXPECTED[1:], strict=False))):
        out = F.when(months <= m1, v0 + (months - m0) / (m1 - m0) * (v1 - v0)).otherwise(out)
    return F.when(months <= 0, 0.0).otherwise(out)


def violation(years: Column) -> Column:
    return steps(years, [(50, "critical"), (30, "high"), (10, "medium"), (0, "low")], "none", strict=True)


#: Credit packages and the price of one credit.
PACKAGES = ((5, "2.50"), (12, "5.00"), (25, "10.00"))


def credit_price(n: Column) -> Column:
    out = None
    for k, price in PACKAGES:
        out = F.when(n == k, F.lit(price).cast("decimal(10,2)")) if out is None else out.when(n == k, F.lit(price).cast("decimal(10,2)"))
    return out.otherwise((n * F.lit("0.50").cast("decimal(10,2)")).cast("decimal(10,2)"))


def heat(intensity: Column) -> Column:
    return steps(intensity, [(0.8, "very_high"), (0.6, "high"), (0.4, "medium"), (0.2, "low")], "very_low", strict=True)


def match(distance: Column, overlap_hours: Column, frp: Column, detections: Column, reach: float, buffer_days: float, weights: tuple[float, ...] = (0.4, 0.3, 0.2, 0.1)) -> Column:
    """How well an event fits an episode: nearness, shared time, power, size."""
    most = lambda x: F.least(x, F.lit(1.0))
    return weights[0] * (1 - most(distance / reach)) + weights[1] * most(overlap_hours / (buffer_days * 24)) + weights[2] * most(F.coalesce(frp, F.lit(0.0)) / 100) + weights[3] * most(detections / 50)


#: Categories of protected areas by their Spanish names.
CATEGORIES = {
    "parque nacional": "national_park",
    "reserva nacional": "national_reserve",
    "monumento natural": "natural_monument",
    "reserva natural estricta": "national_reserve",
    "reserva natural silvestre": "national_reserve",
    "parque provincial": "provincial_park",
    "reserva provincial": "provincial_reserve",
    "reserva natural provincial": "provincial_reserve",
    "area natural protegida": "provincial_reserve",
    "reserva de biosfera": "biosphere_reserve",
    "sitio ramsar": "ramsar_site",
    "patrimonio mundial": "world_heritage",
    "reserva municipal": "municipal_reserve",
    "reserva privada": "private_reserve",
    "refugio de vida silvestre": "wildlife_refuge",
    "area marina protegida": "marine_park",
    "parque marino": "marine_park",
}
#: Categories whose prohibition lasts 60 years; 30 for the others.
LONG_PROHIBITION = ("national_park", "national_reserve", "natural_monument", "biosphere_reserve", "world_heritage")


def area_category(raw: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(raw))), F.lit("other"))


def prohibition_years(category: Column) -> Column:
    return F.when(category.isin(*LONG_PROHIBITION), 60).otherwise(30)


def months_between(a: Column, b: Column) -> Column:
    """Calendar months, days ignored."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def add_months_28(d: Column, n: int) -> Column:
    """Adds months; a day that the month lacks becomes the 28th."""
    x = F.add_months(d, n)
    return F.when(F.day(d) > F.day(F.last_day(x)), F.make_date(F.year(x), F.month(x), F.lit(28))).otherwise(x)
