"""Predicates built from request parameters, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import severity_rank


def contains_ci(column: Column, needle: str) -> Column:
    """Case-insensitive substring; false for NULL."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(needle.lower()))


def any_contains(columns: list[Column], needle: str) -> Column:
    return reduce(lambda a, b: a | b, (contains_ci(c, needle) for c in columns))


def equals_ci(column: Column, value: str) -> Column:
    return F.coalesce(F.lower(column) == value.lower(), F.lit(False))


def date_range(column: Column, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive; the end is midnight of its day, so later times of that day are out."""
    keep = F.lit(True)
    if start:
        keep = keep & (column >= F.lit(start).cast("timestamp_ntz"))
    if end:
        keep = keep & (column <= F.lit(end).cast("timestamp_ntz"))
    return F.coalesce(keep, F.lit(False))


def at_least(column: Column, least: float) -> Column:
    """NULL counts as 0."""
    return F.coalesce(column, F.lit(0)) >= least


def min_confidence(column: Column, least: float, null_up_to: float | None = 0.5) -> Column:
    """NULL passes thresholds up to ``null_up_to``; every one if that is None."""
    passes = column >= least
    if null_up_to is None or least <= null_up_to:
        passes = column.isNull() | passes
    return F.coalesce(passes, F.lit(False))


def overlaps(first: Column, last: Column, start: str, end: str) -> Column:
    return (last >= F.lit(start).cast("date")) & (first <= F.lit(end).cast("date"))


def min_severity(column: Column, least: str) -> Column:
    return severity_rank(column) >= severity_rank(F.lit(least))


def year_range(year: Column, since: int | None = None, until: int | None = None) -> Column:
    """A missing year is year 0."""
    value = F.coalesce(year, F.lit(0))
    keep = F.lit(True)
    if since is not None:
        keep = keep & (value >= since)
    if until is not None:
        keep = keep & (value <= until)
    return keep


def where(df: DataFrame, spec: dict[str, tuple[str, str]], given: dict[str, object]) -> DataFrame:
    """Filters by a whitelist: ``spec`` maps a parameter to (column, kind).

    Kinds are eq, like (case-insensitive substring), min, max, in and not_in.
    Parameters outside the whitelist, and None, are ignored.
    """
    for name, (column, kind) in spec.items():
        value = given.get(name)
        if value is None:
            continue
        c = F.col(column)
        df = df.filter(
            {
                "eq": lambda: c == value,
                "like": lambda: contains_ci(c, str(value)),
                "min": lambda: c >= value,
                "max": lambda: c <= value,
                "in": lambda: c.isin(*value),
                "not_in": lambda: ~c.isin(*value),
            }[kind]()
        )
    return df


def in_scope(kind: Column, regional: list[str], scope: str = "default") -> Column:
    """default: without regional kinds; regional: only these; all: everything."""
    if scope == "all":
        return F.lit(True)
    return kind.isin(*regional) if scope == "regional" else ~kind.isin(*regional)


def licensed(df: DataFrame, sources: str, licenses: DataFrame, key: str) -> DataFrame:
    """Rows without any source that is known to forbid commercial use.

    ``licenses`` (alias, commercial_use) is a registry; names compare without
    case.  The names of a row are matched one by one, rows leave by an anti-join.
    """
    forbidden = licenses.filter("not commercial_use").select(F.lower("alias").alias("alias")).distinct()
    hidden = (
        df.select(key, F.explode(sources).alias("alias"))
        .withColumn("alias", F.lower("alias"))
        .join(forbidden, "alias", "left_semi")
        .select(key)
        .distinct()
    )
    return df.join(hidden, key, "left_anti")


def ghosts(metrics: list[Column], place: Column, text: Column) -> Column:
    """Rows that say nothing: no metric, place or text; or text with 'undefined'."""
    zero = reduce(lambda a, b: a & b, (F.coalesce(m, F.lit(0)) == 0 for m in metrics))
    empty = lambda c: c.isNull() | (F.trim(c) == "")
    return (zero & empty(place) & empty(text)) | contains_ci(text, "undefined")


def matches_rule(alert: dict[str, Column], rule: dict[str, Column]) -> Column:
    """Whether a subscription wants an alert.

    A rule's NULL means anything goes.  Areas match if either contains the
    other.  A missing confidence fails only thresholds above 0.5.
    """
    free = lambda name: rule[name].isNull()
    a, r = F.lower(alert["area"]), F.lower(rule["area"])
    by_area = free("area") | (alert["area"].isNotNull() & (F.contains(a, r) | F.contains(r, a)))
    by_conf = free("min_confidence") | F.when(alert["confidence"].isNull(), rule["min_confidence"] <= 0.5).otherwise(
        alert["confidence"] >= rule["min_confidence"]
    )
    keep = (
        (free("types") | F.array_contains(rule["types"], alert["type"]))
        & (free("min_severity") | (severity_rank(alert["severity"]) >= severity_rank(rule["min_severity"])))
        & by_area
        & by_conf
    )
    return F.coalesce(keep, F.lit(False))
