"""Scores: quality, trust, confidence, severity, change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import EVENT_FACTORS, LATITUDES, LONGITUDES, OFFICIAL_ORGANISATIONS, RIGHTS_ORGANISATIONS


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def percent_change(old: Column, new: Column) -> Column:
    """100 from zero to anything above, 0 from zero to zero."""
    return F.when(old == 0, F.when(new > 0, 100.0).otherwise(0.0)).otherwise(F.try_divide((new - old) * 100.0, old))


def severity_index(killed: Column, injured: Column, factor: Column) -> Column:
    """Weighted casualties times a factor of the event type, over 10, rounded half up, at most 10."""
    raw = (F.coalesce(killed, F.lit(0)) * 3 + F.coalesce(injured, F.lit(0))) * factor / 10
    return F.least(F.lit(10.0), F.floor(raw + 0.5).cast("double"))


def completeness(required: list[Column], optional: list[Column]) -> Column:
    """Share of fields present, required ones counting twice."""
    present = lambda c, w: F.when(c.isNotNull() & (c.cast("string") != ""), w).otherwise(0)
    total = 2 * len(required) + len(optional)
    parts = [present(c, 2) for c in required] + [present(c, 1) for c in optional]
    return sum(parts[1:], parts[0]) / F.lit(float(total))


def consistency(penalties: list[tuple[Column, float]]) -> Column:
    """1 less the penalties whose condition holds, not below 0."""
    score = F.lit(1.0)
    for holds, penalty in penalties:
        score = score - F.when(F.coalesce(holds, F.lit(False)), penalty).otherwise(0.0)
    return F.greatest(F.lit(0.0), score)


def record_consistency(date: Column, lat: Column, lon: Column, as_of: Column) -> Column:
    """``consistency`` of a canonical record: a date to come, coordinates out of bounds."""
    outside = lambda c, bounds: (c < bounds[0]) | (c > bounds[1])
    return consistency([(date > as_of, 0.2), (outside(lat, LATITUDES), 0.3), (outside(lon, LONGITUDES), 0.3)])


def source_accuracy(organisation: Column) -> Column:
    """1.0 for official organisations, 0.9 for rights groups, else 0.8, by parts of the name."""
    low = F.lower(F.coalesce(organisation, F.lit("")))
    of = lambda names: low.rlike("|".join(names))
    return F.when(of(OFFICIAL_ORGANISATIONS), 1.0).when(of(RIGHTS_ORGANISATIONS), 0.9).otherwise(0.8)


def event_factor(event_type: Column) -> Column:
    """Factor of the severity index."""
    pairs = F.create_map(*(F.lit(x) for kv in EVENT_FACTORS.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, event_type), F.lit(1.0))


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def half_life(base: Column, age: Column, half: Column) -> Column:
    return base * F.pow(F.lit(0.5), age / half)


def trust(confidence: Column, reliability: Column) -> Column:
    """Product with defaults 0.5 and 0.7, clamped to 0..1, three decimal places."""
    # to nine places first: products such as 0.0585 are not exact
    product = F.round(F.coalesce(confidence, F.lit(0.5)) * F.coalesce(reliability, F.lit(0.7)), 9)
    return F.round(clamp(product, 0, 1), 3)


def source_trust(base: Column) -> Column:
    return clamp(base, 0.2, 0.85)


#: What a severity adds to the confidence of an alert.
SEVERITY_BUMP = {"critical": 0.15, "high": 0.10, "medium": 0.0, "low": -0.10}


def alert_confidence(
    reliability: Column,
    severity: Column,
    has_area: Column,
    has_zone: Column,
    first_tier: Column,
    density: Column,
    certainty: Column,
    corroborations: Column,
    override: Column,
) -> Column:
    """Additive confidence of an alert, rounded to three places and clamped to 0..1."""
    bump = F.lit(0.0)
    for name, value in SEVERITY_BUMP.items():
        bump = F.when(severity == name, value).otherwise(bump)
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    total = (
        F.lit(0.5)
        + (reliability - 0.5) * 0.6
        + bump
        + flag(has_area, 0.05)
        + flag(has_zone, 0.05)
        + flag(first_tier, 0.05)
        + density * 0.10
        + F.when(certainty == "past", -0.20).when(certainty == "now", 0.05).otherwise(0.0)
        + F.least(F.lit(0.30), corroborations * 0.10)
        + F.greatest(F.lit(-0.30), F.coalesce(override, F.lit(0.0)))
    )
    return clamp(F.round(total, 3), 0, 1)


def air_quality_band(index: Column) -> Column:
    """Bands of the air quality index."""
    return (
        F.when(index.isNull(), None).when(index <= 50, "good").when(index <= 100, "moderate")
        .when(index <= 150, "unhealthy_sensitive").when(index <= 200, "unhealthy").when(index <= 300, "very_unhealthy")
        .otherwise("hazardous")
    )


#: Grams of a troy ounce.
OUNCE_GRAMS = 31.1035


def gold_price(ounce: Column, karat: int) -> Column:
    """Price of a gram of the given karat from that of a troy ounce."""
    return ounce / OUNCE_GRAMS * (karat / 24.0)
