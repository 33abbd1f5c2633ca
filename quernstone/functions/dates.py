"""Date and time expressions.  All take and give Columns; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ESCALATION_PHASES, LAST_ESCALATION_PHASE, LAST_PHASE, PHASES

BASELINE_DATE = "2023-10-07"

def iso_week(date: Column) -> Column:
    """``YYYY-Www`` with the ISO year."""
    return F.concat(F.date_format(F.date_add(F.date_trunc("week", date).cast("date"), 3), "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def calendar_year_week(date: Column) -> Column:
    """ISO week number with the calendar year: 2021-01-01 is ``2021-W53``."""
    return F.concat(F.year(date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def day_of_year_week(date: Column) -> Column:
    """``YYYY-Www`` with week = ceil(day of year / 7)."""
    week = F.ceil(F.dayofyear(date) / 7).cast("string")
    return F.concat(F.year(date).cast("string"), F.lit("-W"), F.lpad(week, 2, "0"))


def sunday_week(date: Column) -> Column:
    """``YYYY-Www`` with weeks that begin on Sunday, the first with January 1."""
    first = F.trunc(date, "year")
    week = F.ceil((F.datediff(date, first) + F.dayofweek(first)) / 7).cast("string")
    return F.concat(F.year(date).cast("string"), F.lit("-W"), F.lpad(week, 2, "0"))


_PERIODS = {
    "day": lambda d: F.date_format(d, "yyyy-MM-dd"),
    "week": calendar_year_week,
    "month": lambda d: F.date_format(d, "yyyy-MM"),
    "quarter": lambda d: F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")),
    "year": lambda d: F.year(d).cast("string"),
}
PERIODS = tuple(_PERIODS)


def period_key(date: Column, grain: str) -> Column:
    return _PERIODS[grain](date)


def week_bounds(date: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the ISO week."""
    monday = F.date_trunc("week", date).cast("date")
    return monday, F.date_add(monday, 6)


def normalised_date(text: Column) -> Column:
    """A bare year is its January 1; what does not parse is NULL."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike("^[0-9]{4}$"), F.try_to_timestamp(F.concat(trimmed, F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date")).otherwise(
        F.try_to_timestamp(F.substring(trimmed, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    )


def excel_date(serial: Column) -> Column:
    """Day number of a spreadsheet to a date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))


def month_number(name: Column) -> Column:
    """1 to 12 for an English month name or its first three letters, else NULL."""
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    at = F.array_position(F.array(*map(F.lit, months)), F.substring(F.lower(F.trim(name)), 1, 3))
    return F.when(at > 0, at).cast("int")


def days_since(date: Column, baseline: str = BASELINE_DATE) -> Column:
    return F.datediff(date, F.lit(baseline).cast("date"))


def against_baseline(date: Column, baseline: str = BASELINE_DATE) -> Column:
    day = F.lit(baseline).cast("date")
    return F.when(date < day, "before").when(date == day, "baseline").when(date > day, "after")


def season(date: Column) -> Column:
    month = F.month(date)
    return F.when(month.isin(12, 1, 2), "winter").when(month.between(3, 5), "spring").when(month.between(6, 8), "summer").when(month.between(9, 11), "autumn")


def _until(date: Column, ends: tuple, last: str) -> Column:
    found = F.lit(last)
    for end, name in reversed(ends):
        found = F.when(date < F.lit(end).cast("date"), name).otherwise(found)
    return F.when(date.isNotNull(), found)


def phase(date: Column) -> Column:
    """The phase of the conflict that a date is in; NULL without a date."""
    return _until(date, PHASES, LAST_PHASE)


def escalation_phase(date: Column) -> Column:
    """before, during and after the first months since the baseline date."""
    return _until(date, ESCALATION_PHASES, LAST_ESCALATION_PHASE)


def age_hours(at: Column, as_of: Column) -> Column:
    """Hours up to ``as_of``, to one decimal place; not below 0."""
    return F.round(F.greatest((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))) / 3600.0, F.lit(0.0)), 1)


def freshness_band(age: Column) -> Column:
    """live up to 1 h, recent up to 6 h, else stale; none without an age."""
    return F.when(age.isNull(), "none").when(age <= 1, "live").when(age <= 6, "recent").otherwise("stale")


def freshness_score(age: Column, half_life: float = 6.0) -> Column:
    """0.5 to the power of age over half-life; 0 without an age."""
    return F.coalesce(F.round(F.pow(F.lit(0.5), age / half_life), 3), F.lit(0.0))


def effective_status(status: Column, age: Column, permanent: Column) -> Column:
    """A permanent closure, else unknown when stale, else the status."""
    return F.when(permanent == "closed", "closed").when(age.isNull() | (age > 6), "unknown").otherwise(F.coalesce(status, F.lit("unknown")))


def staleness_warning(days: Column, frozen: Column, most_days: int = 90) -> Column:
    """Text for data older than ``most_days``, NULL for fresh or frozen data."""
    return F.when(~F.coalesce(frozen, F.lit(False)) & (days > most_days), F.format_string("data is %d days old", days))
