"""Aggregations over canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import iso_week, period_key
from ..functions.fixed import AREA_BASE
from ..functions.scores import percent_change


def record_stats() -> list[Column]:
    """Counts and sums of canonical records; missing metrics are 0."""
    conflict = F.col("category") == "conflict"
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return [
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(conflict, 1)).alias("incidents"),
        F.sum(zero("fatalities")).cast("bigint").alias("fatalities"),
        F.sum(zero("injuries")).cast("bigint").alias("injuries"),
        F.sum(zero("fatalities") + zero("injuries")).cast("bigint").alias("casualties"),
        F.countDistinct("place").alias("affected_locations"),
        F.countDistinct(F.when(conflict, F.col("event_type"))).alias("unique_event_types"),
    ]


def by_period(df: DataFrame, grain: str, stats: list[Column] | None = None) -> DataFrame:
    """Stats for each day, week, month, quarter or year; rows without date are left out."""
    dated = df.filter("date is not null").withColumn("period", period_key(F.col("date"), grain))
    return dated.groupBy("period").agg(*(stats or record_stats()))


def by_periods(df: DataFrame, grains: list[str]) -> DataFrame:
    """``by_period`` at several grains in one pass over the rows: each row has a period of each."""
    pairs = F.array(*(F.struct(F.lit(g).alias("grain"), period_key(F.col("date"), g).alias("period")) for g in grains))
    exploded = df.filter("date is not null").withColumn("__p", F.explode(pairs))
    return exploded.groupBy("__p.grain", "__p.period").agg(*record_stats())


def compared_with_previous(periods: DataFrame, key: str, metric: str, by: list[str] | None = None) -> DataFrame:
    """Change against the previous period present; the first period drops out."""
    order = Window.partitionBy(*(by or [])).orderBy(key)
    previous = F.lag(metric).over(order)
    return (
        periods.withColumns({"previous": previous})
        .filter(F.col("previous").isNotNull())
        .withColumns(
            {
                "change": F.col(metric) - F.col("previous"),
                "change_pct": F.round(percent_change(F.col("previous").cast("double"), F.col(metric).cast("double")), 4),
            }
        )
    )


def around_date(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Rows and metric before and from a date on, and their change in percent."""
    before = F.col("date") < F.lit(date).cast("date")
    value = F.coalesce(F.col(metric), F.lit(0))
    return df.filter("date is not null").agg(
        F.count(F.when(before, 1)).alias("records_before"),
        F.count(F.when(~before, 1)).alias("records_after"),
        F.coalesce(F.sum(F.when(before, value)), F.lit(0)).cast("bigint").alias("metric_before"),
        F.coalesce(F.sum(F.when(~before, value)), F.lit(0)).cast("bigint").alias("metric_after"),
    ).withColumn("change_pct", F.round(percent_change(F.col("metric_before").cast("double"), F.col("metric_after").cast("double")), 4))


def over_domain(df: DataFrame, column: str, domain: tuple[str, ...], stats: list[Column], other: str = "unknown") -> DataFrame:
    """Stats for every value of a fixed domain; what is outside counts as ``other``; none are 0."""
    value = F.when(F.col(column).isin(*domain), F.col(column)).otherwise(other)
    found = df.withColumn("__value", value).groupBy("__value").agg(*stats)
    names = [c for c in found.columns if c != "__value"]
    every = df.sparkSession.createDataFrame([(d,) for d in dict.fromkeys([*domain, other])], "value string")
    joined = every.join(found, F.col("value") == F.col("__value"), "left")
    fill = [F.coalesce(F.col(n), F.lit(0)).cast(found.schema[n].dataType).alias(n) if found.schema[n].dataType.typeName() in ("long", "integer", "double") else F.col(n) for n in names]
    return joined.select(F.col("value").alias(column), *fill)


def severity_per_incident() -> Column:
    """Sum of severities over incidents, not rows; 0 without incidents."""
    incidents = F.count(F.when(F.col("category") == "conflict", 1))
    return F.coalesce(F.round(F.try_divide(F.sum(F.coalesce("severity", F.lit(0))).cast("double"), F.nullif(incidents, F.lit(0))), 4), F.lit(0.0))


def cumulative_summary(df: DataFrame, region: str, metrics: list[str]) -> DataFrame:
    """Totals of cumulative counters: the largest of each region, summed over regions."""
    top = df.groupBy(region).agg(*(F.max(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in metrics))
    return top.agg(*(F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in metrics))


def cumulative_series(df: DataFrame, region: str, period: Column, metric: str) -> DataFrame:
    """Increments of a cumulative counter: the largest of region and period, summed,
    then the difference to the previous period present, not below 0; the first keeps its level.
    """
    level = (
        df.filter("date is not null").withColumn("period", period)
        .groupBy(region, "period").agg(F.max(F.coalesce(F.col(metric), F.lit(0))).alias("__top"))
        .groupBy("period").agg(F.sum("__top").cast("bigint").alias("level"))
    )
    before = F.lag("level").over(Window.orderBy("period"))
    return level.withColumn("increment", F.greatest(F.lit(0), F.col("level") - F.coalesce(before, F.lit(0))).cast("bigint"))


def nearest_rank(values: Column, share: float) -> Column:
    """sorted[min(n - 1, floor(n * share))] of a group's values; not interpolated."""
    ordered = F.sort_array(F.collect_list(values))
    at = F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * share).cast("int")) + 1
    return F.when(F.size(ordered) > 0, F.element_at(ordered, F.greatest(at, F.lit(1))))


def rolling_baselines(df: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """Totals, first and last date, counts of the last 30, 90 and 365 days, weekly rates.

    The 12-month mean and the 90th percentile are over weeks that occur only.
    """
    today = F.lit(as_of).cast("date")
    age = F.datediff(today, F.col("date"))
    dated = df.filter("date is not null").withColumn("__age", age)
    within = lambda n: F.count(F.when(F.col("__age").between(0, n), 1))
    weekly = (
        dated.filter("__age between 0 and 365").groupBy(*keys, F.date_trunc("week", "date").alias("__week"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .groupBy(*keys).agg(F.avg("__n").alias("avg_weekly_12m"), nearest_rank(F.col("__n"), 0.9).alias("p90_weekly"))
    )
    totals = dated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        within(30).alias("count_30d"), within(90).alias("count_90d"), within(365).alias("count_12m"),
    )
    return totals.join(weekly, keys, "left").withColumns(
        {
            "avg_weekly_90d": F.round(F.col("count_90d") / (90.0 / 7.0), 4),
            "avg_weekly_12m": F.round(F.coalesce("avg_weekly_12m", F.lit(0.0)), 4),
            "p90_weekly": F.coalesce("p90_weekly", F.lit(0)).cast("bigint"),
        }
    )


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows of each group and its most frequent value; ties to the smallest."""
    counted = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("value"))).alias("__first")
    return counted.groupBy(group).agg(F.sum("n").cast("bigint").alias("total"), first).select(group, "total", F.col("__first.value").alias("dominant"))


def weighted_rollup(df: DataFrame, fine: list[str], coarse: list[str], value: str) -> DataFrame:
    """Means of fine groups, rolled up weighted by their sizes."""
    means = df.groupBy(*fine).agg(F.count(value).alias("n"), F.avg(value).alias("m"))
    return means.groupBy(*coarse).agg(
        F.sum("n").cast("bigint").alias("n"), F.round(F.try_divide(F.sum(F.col("m") * F.col("n")), F.sum("n")), 4).alias("mean")
    )


def trailing_streak(df: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """Rows after the last good one of each key, and its share of good rows."""
    flagged = df.withColumn("__ok", ok)
    last = flagged.groupBy(key).agg(F.max(F.when(F.col("__ok"), F.col(order))).alias("__last"))
    return flagged.join(last, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"),
        F.max(order).alias("latest"),
        F.round(F.avg(F.col("__ok").cast("double")), 3).alias("success_rate"),
        F.count(F.when(F.col("__last").isNull() | (F.col(order) > F.col("__last")), 1)).alias("streak"),
    ).withColumn("health", F.when(F.col("streak") >= 3, "failing").when(F.col("streak") >= 1, "flaky").otherwise("healthy"))


def co_occurrence(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Unordered pairs of values that share a group, with the number of groups."""
    sets = df.groupBy(*group).agg(F.array_sort(F.collect_set(value)).alias("v")).filter("size(v) > 1")
    pairs = F.expr("flatten(transform(v, (a, i) -> transform(slice(v, i + 2, size(v)), b -> struct(a as a, b as b))))")
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def area_status(closed: Column, restricted: Column, forces: Column, total: Column) -> Column:
    """lockdown, military_presence, restricted or calm from counts of statuses."""
    return (
        F.when((F.coalesce(F.try_divide(closed, total), F.lit(0.0)) >= 0.5) | (forces >= 3), "lockdown")
        .when(forces >= 1, "military_presence").when((closed + restricted) > 0, "restricted").otherwise("calm")
    )


def area_score(status: Column, closed: Column, forces: Column, police: Column) -> Column:
    """0 to 10: a base by status, one for each closed place up to five, two for each with forces, one with police."""
    base = F.coalesce(*(F.when(status == s, n) for s, n in AREA_BASE.items()), F.lit(0))
    return F.least(F.lit(10).cast("bigint"), base + F.least(closed, F.lit(5)) + 2 * forces + police)


def cluster_members(records: DataFrame, place: str, admin: str, date: str) -> DataFrame:
    """A row for each cluster that a record is in: its place's week and its district's week.

    Adds cluster_key, place_kind and place_name to the columns; records without a
    date, or without both places, drop out.
    """
    week = iso_week(F.col(date))
    grains = F.array(
        F.when(F.col(place).isNotNull(), F.struct(F.concat_ws("|", F.col(place), week).alias("cluster_key"), F.lit("gazetteer").alias("place_kind"), F.col(place).alias("place_name"))),
        F.when(F.col(admin).isNotNull(), F.struct(F.concat(F.lit("admin2:"), F.lower(admin), F.lit("|"), week).alias("cluster_key"), F.lit("admin2").alias("place_kind"), F.col(admin).alias("place_name"))),
    )
    kept = records.filter(F.col(date).isNotNull())
    return kept.withColumn("__g", F.explode(F.filter(grains, lambda g: g.isNotNull()))).select(*records.columns, "__g.*")


def event_clusters(members: DataFrame, order: str, category: str, metrics: list[str], admins: list[str]) -> DataFrame:
    """One row for each cluster of ``cluster_members``: id, kind, categories, counts, sums and the first known admins.

    Members themselves are the rows of ``members`` with this ``cluster_key``; they
    are not gathered into one row, as a place may have very many.
    """
    first = [F.min_by(a, F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in admins]
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in metrics]
    found = members.groupBy("cluster_key", "place_kind").agg(
        F.min_by("place_name", order).alias("place_name"), F.count(F.lit(1)).alias("record_count"), F.array_sort(F.collect_set(category)).alias("categories"), *first, *sums
    )
    return found.withColumn("cluster_id", F.concat(F.lit("ev-"), F.substring(F.sha2("cluster_key", 256), 1, 16)))


def threat_level(critical: Column, high: Column, medium: Column) -> Column:
    return (
        F.when(critical > 0, "critical").when(high > 2, "high").when((high > 0) | (medium > 3), "elevated").otherwise("normal")
    )
