"""Time series (idx, value), idx from 0 without gaps, optionally by series.

Windows without a partition are used on series only, which have one row for
each point in time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def indexed(df: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, idx, value) in the order of a column; missing values are dropped first."""
    window = Window.partitionBy(*(by or [])).orderBy(order)
    kept = df.filter(F.col(value).isNotNull())
    return kept.select(*(by or []), (F.row_number().over(window) - 1).cast("bigint").alias("idx"), F.col(value).cast("double").alias("value"))


def _ols(x: Column, y: Column) -> dict[str, Column]:
    """Least squares from centred moments, which keep their digits; slope and r2 are 0 without spread."""
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    spread = F.var_pop(y) > 0
    return {
        "slope": slope,
        "intercept": F.coalesce(F.avg(y) - slope * F.avg(x), F.lit(0.0)),
        "r2": F.coalesce(F.when(spread, F.regr_r2(y, x)), F.lit(0.0)),
    }


def linear_trend(series: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """slope, intercept, r2 of least squares on idx, with direction and strength.

    Fewer than two points have slope 0 and are stable.
    """
    fit = series.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in _ols(F.col("idx").cast("double"), F.col("value")).items()))
    enough = F.col("n") >= 2
    slope = F.when(enough, F.col("slope")).otherwise(0.0)
    r2 = F.when(enough, F.col("r2")).otherwise(0.0)
    return fit.select(
        *(by or []),
        "n",
        F.round(slope, digits).alias("slope"),
        F.round("intercept", digits).alias("intercept"),
        F.round(r2, digits).alias("r2"),
        F.when(slope > 0.01, "increasing").when(slope < -0.01, "decreasing").otherwise("stable").alias("direction"),
        F.when(r2 > 0.7, "strong").when(r2 > 0.4, "moderate").otherwise("weak").alias("strength"),
    )


def acf(series: DataFrame, max_lag: int = 10, by: list[str] | None = None) -> DataFrame:
    """Autocorrelation at lags 0 to ``max_lag``: global mean and full-length denominator."""
    keys = by or []
    mean = series.groupBy(*keys).agg(F.avg("value").alias("__mean"))
    centred = (series.join(mean, keys) if keys else series.crossJoin(F.broadcast(mean))).withColumn("__d", F.col("value") - F.col("__mean"))
    order = Window.partitionBy(*keys).orderBy("idx")
    lagged = centred.select(
        *keys, "__d", *(F.lead("__d", lag).over(order).alias(f"l{lag}") for lag in range(max_lag + 1))
    )
    sums = lagged.groupBy(*keys).agg(
        F.sum(F.col("__d") * F.col("__d")).alias("all"),
        *(F.sum(F.col("__d") * F.col(f"l{lag}")).alias(f"s{lag}") for lag in range(max_lag + 1)),
    )
    rows = F.array(*(F.struct(F.lit(lag).alias("lag"), F.round(F.coalesce(F.try_divide(F.col(f"s{lag}"), F.nullif(F.col("all"), F.lit(0.0))), F.lit(0.0)), 4).alias("r")) for lag in range(max_lag + 1)))
    return sums.select(*keys, F.inline(rows))


def seasonality(series: DataFrame, period: int = 7, threshold: float = 0.3) -> DataFrame:
    """Autocorrelation at the period; seasonal beyond the threshold and with two periods at least."""
    n = series.agg(F.count(F.lit(1)).alias("n"))
    r = acf(series, period).filter(F.col("lag") == period).select("r")
    strength = F.when(F.col("n") >= 2 * period, F.col("r")).otherwise(0.0)
    return n.crossJoin(r).select(F.lit(period).alias("period"), strength.alias("strength"), (F.abs(strength) > threshold).alias("seasonal"))


def moving_average(series: DataFrame, size: int = 7, by: list[str] | None = None) -> DataFrame:
    """Trailing mean, over fewer points at the head, with the number of points."""
    frame = Window.partitionBy(*(by or [])).orderBy("idx").rowsBetween(-(size - 1), 0)
    return series.withColumns({"average": F.avg("value").over(frame), "window_size": F.count(F.lit(1)).over(frame)})


def ema(series: DataFrame, alpha: float = 0.3, by: list[str] | None = None) -> DataFrame:
    """Exponential moving average that begins with the first value.

    Weights fall by 1 - alpha with each step back, so a series is cut into
    blocks over which they fall below what a double holds: a point needs its own
    block's points up to it and the sum of the block before.  Only idx 0, whose
    weight is not reduced by alpha, differs.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    keys = by or []
    keep = 1.0 - alpha
    size = 1 if keep == 0 else max(1, math.ceil(math.log(1e-18) / math.log(keep)))
    fall = F.pow(F.lit(keep), F.col("__at"))
    first = F.when(F.col("idx") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    cut = series.withColumns({"__b": F.floor(F.col("idx") / size), "__at": (F.col("idx") % size).cast("double")})
    # the point's weight at the block's start; it falls from there to the point that looks back
    weighed = cut.withColumn("__x", first * F.col("value") / fall)
    within = Window.partitionBy(*keys, "__b").orderBy("idx")
    summed = weighed.withColumn("__sum", F.sum("__x").over(within) * fall)
    ends = summed.groupBy(*keys, (F.col("__b") + 1).alias("__b")).agg(F.max_by("__sum", "idx").alias("__end"))
    carried = F.coalesce(F.col("__end") * fall * keep, F.lit(0.0))
    return summed.join(ends, [*keys, "__b"], "left").select(*keys, "idx", "value", (F.col("__sum") + carried).alias("ema"))


def decompose(series: DataFrame, period: int = 7) -> DataFrame:
    """trend (trailing mean), seasonal (mean of the rest by idx modulo period), residual."""
    trended = moving_average(series, period).withColumn("__rest", F.col("value") - F.col("average"))
    season = F.avg("__rest").over(Window.partitionBy(F.col("idx") % period))
    return trended.withColumn("seasonal", season).select(
        "idx", "value", F.col("average").alias("trend"), "seasonal", (F.col("__rest") - F.col("seasonal")).alias("residual")
    )


def forecast_linear(series: DataFrame, horizon: int = 7) -> DataFrame:
    """Continued trend, not below 0, with r2 as confidence."""
    trend = linear_trend(series, digits=12)
    ahead = F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step")
    return trend.select("n", "slope", "intercept", "r2", ahead).select(
        (F.col("step") + 1).alias("step"),
        F.round(F.greatest(F.lit(0.0), F.col("slope") * (F.col("n") + F.col("step")) + F.col("intercept")), 4).alias("forecast"),
        F.round("r2", 4).alias("confidence"),
    )


def forecast_exponential(series: DataFrame, horizon: int = 7, alpha: float = 0.3) -> DataFrame:
    """The last exponential average, not below 0, for each step ahead."""
    last = ema(series, alpha).agg(F.max_by("ema", "idx").alias("e"))
    return last.select(F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), F.round(F.greatest(F.lit(0.0), F.col("e")), 4).alias("forecast"))


def change_points(series: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Inner points far from the mean that also leap from or to a neighbour by more than the spread."""
    order = Window.orderBy("idx")
    stats = series.agg(F.avg("value").alias("__mean"), F.stddev_pop("value").alias("__sd"))
    joined = series.withColumns({"__before": F.lag("value").over(order), "__after": F.lead("value").over(order)}).crossJoin(F.broadcast(stats))
    z = F.try_divide(F.col("value") - F.col("__mean"), F.nullif(F.col("__sd"), F.lit(0.0)))
    leap = (F.abs(F.col("value") - F.col("__before")) > F.col("__sd")) | (F.abs(F.col("__after") - F.col("value")) > F.col("__sd"))
    inner = F.col("__before").isNotNull() & F.col("__after").isNotNull()
    return joined.withColumn("z", z).filter(inner & (F.abs("z") > threshold) & leap).select(
        "idx", "value", F.round("z", 4).alias("z"), F.when(F.col("z") > 0, "spike").otherwise("drop").alias("kind")
    )


def growth(series: DataFrame) -> DataFrame:
    """Percent from the first to the last value that is not 0, and the yearly rate of growth."""
    some = series.filter("value <> 0").agg(F.min_by("value", "idx").alias("first"), F.max_by("value", "idx").alias("last"), (F.max("idx") - F.min("idx")).alias("steps"))
    usable = (F.col("first") > 0) & (F.col("last") > 0) & (F.col("steps") > 0)
    return some.select(
        F.round(F.coalesce(F.try_divide((F.col("last") - F.col("first")) * 100, F.col("first")), F.lit(0.0)), 4).alias("growth_pct"),
        F.round(F.when(usable, (F.pow(F.col("last") / F.col("first"), F.lit(1.0) / F.col("steps")) - 1) * 100).otherwise(0.0), 4).alias("cagr_pct"),
    )


def rolling_days(daily: DataFrame, days: int, aggregate, date: str = "date", by: list[str] | None = None) -> Column:
    """An aggregate over dates in [date - days, date], both ends included."""
    frame = Window.partitionBy(*(by or [])).orderBy(F.unix_date(date)).rangeBetween(-days, 0)
    return aggregate.over(frame)


def cumulative(daily: DataFrame, key: str, metric: str) -> DataFrame:
    return daily.withColumn("cumulative", F.sum(metric).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))


def indicator_analysis(df: DataFrame, by: str, order: str, value: str, baseline: Column, latest: bool = True) -> DataFrame:
    """Per row: trend, mean growth, spread, change to the previous point and to a baseline point.

    The baseline point is the latest (or else the earliest) one up to ``baseline``.
    Growth skips steps from 0.
    """
    series = indexed(df, order, value, [by])
    trend = linear_trend(series, [by]).select(by, "slope", "n")
    ordered = Window.partitionBy(by).orderBy(order)
    steps = df.withColumn("__prev", F.lag(value).over(ordered))
    rate = F.when(F.col("__prev") != 0, F.try_divide((F.col(value) - F.col("__prev")) * 100.0, F.col("__prev")))
    pick = F.max_by if latest else F.min_by
    early = F.when(F.col(order) <= baseline, F.col(order))
    stats = steps.groupBy(by).agg(
        F.round(F.coalesce(F.avg(rate), F.lit(0.0)), 4).alias("avg_growth"),
        F.round(F.coalesce(F.stddev_pop(value), F.lit(0.0)), 4).alias("spread"),
        pick(F.col(value), early).alias("__base"),
    )
    return steps.join(trend, by).join(stats, by).select(
        by, order, value, "n", "slope", "avg_growth", "spread",
        F.round(rate, 4).alias("recent_change"),
        F.round(F.try_divide((F.col(value) - F.col("__base")) * 100.0, F.nullif(F.col("__base"), F.lit(0.0))), 4).alias("baseline_change"),
    )


def frequency(mean_days: Column, rows: Column) -> Column:
    return (
        F.when(rows < 3, "unknown").when(mean_days <= 2, "daily").when(mean_days <= 10, "weekly")
        .when(mean_days <= 40, "monthly").when(mean_days <= 100, "quarterly").otherwise("yearly")
    )


#: Days that a frequency leads one to expect between rows.
EXPECTED_DAYS = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 91, "yearly": 365}


def gaps(dates: DataFrame, date: str = "date", by: list[str] | None = None, most: int = 30) -> DataFrame:
    """Steps of more than twice the expected length: start, end, days, error beyond ``most`` days."""
    keys = by or []
    step = F.datediff(F.col(date), F.lag(date).over(Window.partitionBy(*keys).orderBy(date)))
    stepped = dates.withColumns({"__days": step, "__from": F.lag(date).over(Window.partitionBy(*keys).orderBy(date))})
    kind = stepped.groupBy(*keys).agg(frequency(F.avg("__days"), F.count(F.lit(1))).alias("frequency"))
    joined = stepped.join(kind, keys) if keys else stepped.crossJoin(F.broadcast(kind))
    expected = F.lit(None).cast("int")
    for name, days in EXPECTED_DAYS.items():
        expected = F.when(F.col("frequency") == name, days).otherwise(expected)
    return joined.filter(F.col("__days") > 2 * expected).select(
        *keys, "frequency", F.col("__from").alias("gap_start"), F.col(date).alias("gap_end"), F.col("__days").alias("days"),
        F.when(F.col("__days") > most, "error").otherwise("warning").alias("level"),
    )


def fill_missing(series: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Missing values as the mean of the value before, filled or not, and the next known one.

    A run of missing values approaches the next one: v_j = next + (previous - next) / 2^j.
    Without a known value on both sides a value stays missing.
    """
    keys = by or []
    back = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.col("idx"))
    marked = series.withColumns(
        {
            "__p": F.last("value", ignorenulls=True).over(back),
            "__n": F.first("value", ignorenulls=True).over(ahead),
            "__at": F.max(known).over(back),
        }
    )
    guess = F.col("__n") + (F.col("__p") - F.col("__n")) / F.pow(F.lit(2.0), F.col("idx") - F.col("__at"))
    return marked.withColumn("filled", F.coalesce("value", guess)).drop("__p", "__n", "__at")


def volume_anomalies(events: DataFrame, keys: list[str], time: str, as_of: Column, sigma: float = 3.0, least_hours: int = 6, least: int = 3) -> DataFrame:
    """Recent hours with far more rows than the 24 before ``as_of``.

    24 hourly counts per key, zeros included; the last two are flagged if they
    have ``least`` rows and exceed mean + sigma * max(spread, 0.5), given
    ``least_hours`` hours with rows.
    """
    end = F.unix_seconds(F.date_trunc("hour", as_of).cast("timestamp"))
    hour = F.floor((end - F.unix_seconds(F.date_trunc("hour", time).cast("timestamp"))) / 3600)
    counted = events.withColumn("back", hour).filter("back between 0 and 23").groupBy(*keys, "back").agg(F.count(F.lit(1)).alias("n"))
    # zeros are those of 24 hours that have no row: no need to write them out
    stats = counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hours"), (F.sum("n") / 24).alias("mean"), (F.sum(F.col("n") * F.col("n")) / 24).alias("square")
    ).withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))))
    limit = F.col("mean") + sigma * F.greatest(F.col("sd"), F.lit(0.5))
    return counted.filter("back <= 1").join(stats, keys).filter((F.col("hours") >= least_hours) & (F.col("n") >= least) & (F.col("n") > limit)).select(
        *keys, "back", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"),
        F.round((F.col("n") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(0.5)), 4).alias("sigma"),
    )


def elevated(monthly: DataFrame, by: str, month: str, value: str) -> DataFrame:
    """The latest month but one against the mean of the five before it; needs seven months."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(month)))
    ranked = monthly.withColumn("__i", nth)
    agg = ranked.groupBy(by).agg(
        F.count(F.lit(1)).alias("months"),
        F.max(F.when(F.col("__i") == 2, F.col(value))).cast("double").alias("recent"),
        F.avg(F.when(F.col("__i").between(3, 7), F.col(value))).alias("baseline"),
    )
    enough = F.col("months") >= 7
    return agg.select(by, "months", "recent", F.round("baseline", 4).alias("baseline"), F.coalesce(enough & (F.col("recent") >= 5) & (F.col("recent") > F.col("baseline") * 1.5), F.lit(False)).alias("elevated"))


def halves_status(series: DataFrame, by: str, outage: float = 0.5, degraded: float = 0.8) -> DataFrame:
    """The last known value against the mean of the first half: outage, degraded or normal."""
    half = F.count(F.lit(1)).over(Window.partitionBy(by)) / 2
    marked = series.withColumn("__first", F.col("idx") < F.floor(half))
    agg = marked.groupBy(by).agg(
        F.avg(F.when(F.col("__first"), F.col("value"))).alias("baseline"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("idx"))).alias("last"),
    )
    ratio = F.try_divide(F.col("last"), F.nullif(F.col("baseline"), F.lit(0.0)))
    return agg.select(by, F.round(ratio, 4).alias("ratio"), F.when(ratio.isNull(), "unknown").when(ratio < outage, "outage").when(ratio < degraded, "degraded").otherwise("normal").alias("status"))


def positive_diff(df: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Steps of a cumulative column, not below 0; NULL where either side is."""
    before = F.lag(value).over(Window.partitionBy(*(by or [])).orderBy(order))
    step = F.when(F.col(value).isNotNull() & before.isNotNull(), F.greatest(F.lit(0).cast(df.schema[value].dataType), F.col(value) - before))
    return df.withColumn("step", step)


def state_durations(log: DataFrame, key: str, status: str, time: str, start: Column, end: Column) -> DataFrame:
    """Seconds and share of [start, end] that each key spends in each status.

    The status before ``start`` carries in; the share is of the whole window.
    """
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    order = Window.partitionBy(key).orderBy(time, status)
    spans = log.filter(F.col(time) < end).withColumn("__to", F.coalesce(F.lead(time).over(order), end))
    length = F.greatest(F.lit(0), seconds(F.least(F.col("__to"), end)) - seconds(F.greatest(F.col(time), start)))
    timed = spans.withColumns({"__s": length, "__in": (F.col(time) >= start).cast("int")}).filter((F.col("__s") > 0) | (F.col("__in") == 1))
    return timed.groupBy(key, status).agg(F.sum("__s").cast("bigint").alias("seconds"), F.sum("__in").cast("bigint").alias("transitions")).withColumn(
        "share_pct", F.round(F.col("seconds") * 100.0 / (seconds(end) - seconds(start)), 4)
    )


def validation_score(errors: Column, warnings: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - errors * 20 - warnings * 5))
