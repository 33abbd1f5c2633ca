"""Statistics, time series, dates, geometry and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, geo, scores, text
from ..operators import statistics as st
from ..operators import timeseries as ts
from .base import alerts, daily, econ, events, orders, query, records, series, table, updates

_Z = "coalesce(round({0}, 4), 0)"


@query("d12_comprehensive", """
SELECT l_returnflag AS flag, count(*) AS count, round(sum(l_extendedprice), 4) AS sum, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median,
 CAST((SELECT v FROM (SELECT l_extendedprice AS v, count(*) AS n FROM lineitem x WHERE x.l_returnflag = l.l_returnflag GROUP BY 1 ORDER BY n DESC, v LIMIT 1)) AS DOUBLE) AS mode,
 round(stddev_pop(l_extendedprice), 2) AS stddev, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max, round(max(l_extendedprice) - min(l_extendedprice), 4) AS range,
 round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
FROM lineitem l GROUP BY l_returnflag""")
def comprehensive(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    full = st.comprehensive(rows, "l_extendedprice", ["flag"])
    return full.select("flag", "count", "sum", "mean", "median", "mode", F.round("stddev", 2).alias("stddev"), "min", "max", "range", "p10", "p25", "p90", "p99")


@query("d06_hinges", """
WITH s AS (SELECT event_type, list_sort(list(value)) AS l FROM v_events GROUP BY event_type), h AS (SELECT event_type, l, len(l) // 2 AS h FROM s)
SELECT event_type, round(list_median(l[1:h]), 4) AS q1, round(list_median(l), 4) AS q2, round(list_median(l[len(l) - h + 1:]), 4) AS q3 FROM h""")
def hinges(spark, d):
    q = st.hinges(events(spark, d), "value", ["event_type"])
    return q.select("event_type", *(F.round(c, 4).alias(c) for c in ("q1", "q2", "q3")))


@query("d08_range", "SELECT region, min(value) AS min, max(value) AS max, round(max(value) - min(value), 4) AS range FROM v_records GROUP BY region")
def value_range(spark, d):
    return records(spark, d).groupBy("region").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.max("value") - F.min("value"), 4).alias("range"))


@query("d09_iqr_outliers", """
WITH s AS (SELECT list_sort(list(value * value)) AS l FROM v_events), h AS (SELECT list_median(l[1:len(l) // 2]) AS q1, list_median(l[len(l) - len(l) // 2 + 1:]) AS q3 FROM s)
SELECT event_id, round(value * value, 4) AS v FROM v_events, h WHERE value * value > q3 + 0.5::DOUBLE * (q3 - q1) OR value * value < q1 - 0.5::DOUBLE * (q3 - q1)""")
def iqr_outliers(spark, d):
    rows = events(spark, d).withColumn("v", F.col("value") * F.col("value"))
    return st.iqr_outliers(rows, "v", k=0.5).select("event_id", F.round("v", 4).alias("v"))


@query("d10_z_outliers", """
WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM v_events GROUP BY 1)
SELECT event_id, event_type, round((value - m) / s, 4) AS z FROM v_events JOIN m USING (event_type) WHERE abs((value - m) / s) > 1.6""")
def z_outliers(spark, d):
    return st.z_outliers(events(spark, d), "value", ["event_type"], 1.6).select("event_id", "event_type", F.round("z", 4).alias("z"))


@query("d13_multi_field", """
WITH u AS (SELECT 'l_discount' AS field, l_discount AS v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)
SELECT field, count(*) AS count, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_pop(v), 4) AS stddev, round(quantile_cont(v, 0.95), 4) AS p95 FROM u GROUP BY field""")
def multi_field(spark, d):
    return st.multi_field(table(spark, d, "lineitem"), ["l_discount", "l_quantity", "l_tax"]).select("field", "count", "mean", "median", "stddev", "p95")


@query("d15_corr_matrix", " UNION ALL ".join(
    f"SELECT '{x}' AS a, '{y}' AS b, round(corr({x}, {y}), 4) AS r FROM lineitem" for x in ("l_quantity", "l_extendedprice", "l_tax") for y in ("l_quantity", "l_extendedprice", "l_tax")))
def corr_matrix(spark, d):
    return st.correlation_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


_OLS = """SELECT count(*) AS n, sum(idx::DOUBLE) AS sx, sum(value) AS sy, sum(idx::DOUBLE * idx) AS sxx, sum(idx * value) AS sxy, sum(value * value) AS syy FROM v_series"""
_FIT = f"""WITH s AS ({_OLS}), t AS (SELECT n, coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0) AS slope, n * sxy - sx * sy AS cov, n * sxx - sx * sx AS dx, n * syy - sy * sy AS dy, sx, sy FROM s),
f AS (SELECT n, slope, (sy - slope * sx) / n AS intercept, coalesce(cov * cov / nullif(dx * dy, 0), 0) AS r2 FROM t)"""


@query("t01_trend", _FIT + """ SELECT n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r2,
 CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction, CASE WHEN r2 > 0.7 THEN 'strong' WHEN r2 > 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM f""")
def trend(spark, d):
    return ts.linear_trend(series(spark, d))


_ACF = """WITH m AS (SELECT avg(value) AS m FROM v_series), c AS (SELECT idx, value - m AS x FROM v_series, m), g AS (SELECT CAST(unnest(range(0, 11)) AS INTEGER) AS lag)
, r AS (SELECT lag, round(coalesce((SELECT sum(a.x * b.x) FROM c a JOIN c b ON b.idx = a.idx + lag) / (SELECT sum(x * x) FROM c), 0), 4) AS r FROM g)"""


@query("t04_acf", _ACF + " SELECT lag, r FROM r")
def autocorrelation(spark, d):
    return ts.acf(series(spark, d))


@query("t02_seasonality", _ACF + " SELECT 7 AS period, r AS strength, abs(r) > 0.3 AS seasonal FROM r WHERE lag = 7")
def seasonality(spark, d):
    return ts.seasonality(series(spark, d))


@query("t05_moving_average", "SELECT idx, round(avg(value) OVER (ORDER BY idx ROWS 6 PRECEDING), 4) AS average, count(*) OVER (ORDER BY idx ROWS 6 PRECEDING) AS window_size FROM v_series")
def moving_average(spark, d):
    return ts.moving_average(series(spark, d)).select("idx", F.round("average", 4).alias("average"), "window_size")


_EMA = "WITH RECURSIVE e AS (SELECT idx, value, value AS ema FROM v_series WHERE idx = 0 UNION ALL SELECT s.idx, s.value, 0.3::DOUBLE * s.value + 0.7::DOUBLE * e.ema FROM e JOIN v_series s ON s.idx = e.idx + 1)"


@query("t06_ema", _EMA + " SELECT idx, round(ema, 4) AS ema FROM e")
def ema(spark, d):
    return ts.ema(series(spark, d)).select("idx", F.round("ema", 4).alias("ema"))


@query("t07_decompose", """
WITH t AS (SELECT idx, value, avg(value) OVER (ORDER BY idx ROWS 6 PRECEDING) AS trend FROM v_series), s AS (SELECT *, avg(value - trend) OVER (PARTITION BY idx % 7) AS seasonal FROM t)
SELECT idx, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(value - trend - seasonal, 4) AS residual FROM s""")
def decompose(spark, d):
    return ts.decompose(series(spark, d)).select("idx", *(F.round(c, 4).alias(c) for c in ("trend", "seasonal", "residual")))


@query("t08_forecast_linear", _FIT + ", h AS (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS i) SELECT i + 1 AS step, round(greatest(0, slope * (n + i) + intercept), 4) AS forecast, round(r2, 4) AS confidence FROM f, h")
def forecast_linear(spark, d):
    return ts.forecast_linear(series(spark, d))


@query("t09_forecast_ema", _EMA + " SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS step, round(greatest(0, arg_max(ema, idx)), 4) AS forecast FROM e")
def forecast_ema(spark, d):
    return ts.forecast_exponential(series(spark, d))


@query("t10_change_points", """
WITH m AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM v_series), l AS (SELECT idx, value, lag(value) OVER (ORDER BY idx) AS p, lead(value) OVER (ORDER BY idx) AS n FROM v_series)
SELECT idx, value, round((value - m) / s, 4) AS z, CASE WHEN value > m THEN 'spike' ELSE 'drop' END AS kind FROM l, m WHERE p IS NOT NULL AND n IS NOT NULL AND abs((value - m) / s) > 1.2 AND (abs(value - p) > s OR abs(n - value) > s)""")
def change_points(spark, d):
    return ts.change_points(series(spark, d), 1.2)


@query("t11_growth", """
WITH g AS (SELECT arg_min(value, idx) AS a, arg_max(value, idx) AS b, max(idx) - min(idx) AS n FROM v_series WHERE value <> 0)
SELECT round((b - a) * 100 / a, 4) AS growth_pct, round((pow(b / a, 1.0::DOUBLE / n) - 1) * 100, 4) AS cagr_pct FROM g""")
def growth(spark, d):
    return ts.growth(series(spark, d))


@query("t13_analyze", _FIT + """, m AS (SELECT avg(value) AS m FROM v_series), c AS (SELECT idx, value - m AS x FROM v_series, m)
SELECT n, round(slope, 4) AS slope, round(r2, 4) AS r2, round((SELECT sum(a.x * b.x) FROM c a JOIN c b ON b.idx = a.idx + 7) / (SELECT sum(x * x) FROM c), 4) AS seasonality,
 round((SELECT stddev_pop(value) FROM v_series), 4) AS volatility FROM f""")
def analyze(spark, d):
    s = series(spark, d)
    return (
        ts.linear_trend(s).select("n", "slope", "r2").crossJoin(ts.seasonality(s).select(F.col("strength").alias("seasonality")))
        .crossJoin(s.agg(F.round(F.stddev_pop("value"), 4).alias("volatility")))
    )


@query("t14_rolling", """
SELECT date, CAST(sum(fatalities) OVER (ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS fatalities, CAST(sum(n) OVER (ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS records FROM v_daily""")
def rolling(spark, d):
    rows = daily(spark, d)
    return rows.select("date", ts.rolling_days(rows, 7, F.sum("fatalities")).alias("fatalities"), ts.rolling_days(rows, 7, F.sum("n")).alias("records"))


@query("t14_rolling_distinct", """
WITH p AS (SELECT DISTINCT date, source, place FROM v_records), days AS (SELECT DISTINCT date FROM p)
SELECT d.date, count(DISTINCT p.place || p.source) AS places FROM days d JOIN p ON p.date BETWEEN d.date - 7 AND d.date GROUP BY d.date""")
def rolling_distinct(spark, d):
    # each day's values go to the days they are seen from, then distinct per day
    pairs = records(spark, d).select("date", F.concat("place", "source").alias("v")).distinct()
    days = pairs.select("date").distinct()
    seen = pairs.select(F.explode(F.sequence("date", F.date_add("date", 7))).alias("date"), "v")
    return seen.join(days, "date", "left_semi").groupBy("date").agg(F.countDistinct("v").alias("places"))


@query("t15_cumulative", "SELECT date, fatalities, CAST(sum(fatalities) OVER (ORDER BY date) AS BIGINT) AS cumulative FROM v_daily")
def cumulative(spark, d):
    return ts.cumulative(daily(spark, d).select("date", "fatalities"), "date", "fatalities")


_INDICATOR = """
WITH i AS (SELECT indicator, year, value, row_number() OVER (PARTITION BY indicator ORDER BY year) - 1 AS idx, lag(value) OVER (PARTITION BY indicator ORDER BY year) AS prev FROM v_econ),
f AS (SELECT indicator, count(*) AS n, (count(*) * sum(idx * value) - sum(idx) * sum(value)) / (count(*) * sum(idx * idx) - sum(idx) * sum(idx))::DOUBLE AS slope FROM i GROUP BY 1),
g AS (SELECT indicator, avg((value - prev) * 100 / prev) AS ag, stddev_pop(value) AS sp, {pick}(value, year) FILTER (WHERE year <= 1998) AS base FROM i GROUP BY 1)
SELECT indicator, year, value, n, round(round(slope, 4), 2) AS slope, round(round(ag, 4), 2) AS avg_growth, round(round(sp, 4), 2) AS spread, round(round((value - prev) * 100 / prev, 4), 2) AS recent_change, round(round((value - base) * 100 / base, 4), 2) AS baseline_change FROM i JOIN f USING (indicator) JOIN g USING (indicator)"""


def _rounded(df):
    return df.select("indicator", "year", "value", "n", *(F.round(c, 2).alias(c) for c in ("slope", "avg_growth", "spread", "recent_change", "baseline_change")))


@query("t16_indicator", _INDICATOR.format(pick="arg_min"))
def indicator(spark, d):
    return _rounded(ts.indicator_analysis(econ(spark, d), "indicator", "year", "value", F.lit(1998), latest=False))


@query("t17_indicator_latest", _INDICATOR.format(pick="arg_max"))
def indicator_latest(spark, d):
    return _rounded(ts.indicator_analysis(econ(spark, d), "indicator", "year", "value", F.lit(1998)))


@query("t32_first_last", """
SELECT indicator, CASE WHEN count(*) < 2 THEN NULL WHEN (arg_max(value, year) - arg_min(value, year)) * 100 / arg_min(value, year) > 5 THEN 'increasing' WHEN (arg_max(value, year) - arg_min(value, year)) * 100 / arg_min(value, year) < -5 THEN 'decreasing' ELSE 'stable' END AS trend FROM v_econ GROUP BY indicator""")
def first_last(spark, d):
    first, last = F.min_by("value", "year"), F.max_by("value", "year")
    change = F.when(first == 0, 0.0).otherwise(F.try_divide((last - first) * 100, first))
    return econ(spark, d).groupBy("indicator").agg(F.when(F.count(F.lit(1)) >= 2, F.when(change > 5, "increasing").when(change < -5, "decreasing").otherwise("stable")).alias("trend"))


_GAPS = """WITH q AS (SELECT DISTINCT nation, date FROM v_orders WHERE status = 'P' AND priority = '1-URGENT'), s AS (SELECT nation, date, lag(date) OVER (PARTITION BY nation ORDER BY date) AS p FROM q),
f AS (SELECT nation, count(*) AS n, avg(date_diff('day', p, date)) AS m FROM s GROUP BY 1),
k AS (SELECT nation, CASE WHEN n < 3 THEN 'unknown' WHEN m <= 2 THEN 'daily' WHEN m <= 10 THEN 'weekly' WHEN m <= 40 THEN 'monthly' WHEN m <= 100 THEN 'quarterly' ELSE 'yearly' END AS frequency FROM f)"""


def _sparse(spark, d):
    return orders(spark, d).filter("status = 'P' and priority = '1-URGENT'").select("nation", "date").distinct()


@query("t18_frequency", _GAPS + " SELECT nation, frequency FROM k")
def frequency(spark, d):
    step = F.datediff("date", F.lag("date").over(Window.partitionBy("nation").orderBy("date")))
    return _sparse(spark, d).withColumn("s", step).groupBy("nation").agg(ts.frequency(F.avg("s"), F.count(F.lit(1))).alias("frequency"))


@query("t19_gaps", _GAPS + """ SELECT nation, frequency, p AS gap_start, date AS gap_end, CAST(date_diff('day', p, date) AS INTEGER) AS days, CASE WHEN date_diff('day', p, date) > 30 THEN 'error' ELSE 'warning' END AS level
FROM s JOIN k USING (nation) WHERE date_diff('day', p, date) > 2 * CASE frequency WHEN 'daily' THEN 1 WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 91 WHEN 'yearly' THEN 365 END""")
def gaps(spark, d):
    return ts.gaps(_sparse(spark, d), by=["nation"])


@query("t22_fill", """
WITH RECURSIVE s AS (SELECT idx, CASE WHEN idx % 4 IN (1, 2) THEN NULL ELSE value END AS v FROM v_series), n AS (SELECT idx, v, first_value(v IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM s),
e AS (SELECT idx, v AS filled FROM n WHERE idx = 0 UNION ALL SELECT n.idx, coalesce(n.v, (e.filled + n.nx) / 2) FROM e JOIN n ON n.idx = e.idx + 1)
SELECT idx, round(filled, 4) AS filled FROM e""")
def fill(spark, d):
    holes = series(spark, d).withColumn("value", F.when(~(F.col("idx") % 4).isin(1, 2), F.col("value")))
    return ts.fill_missing(holes).select("idx", F.round("filled", 4).alias("filled"))


@query("t24_validation_score", """
SELECT source, CAST(greatest(0, least(100, 100 - 20 * (count(*) FILTER (WHERE k = 3)) - 5 * (count(*) FILTER (WHERE k = 5)))) AS BIGINT) AS score FROM v_records WHERE date = DATE '2024-01-05' GROUP BY source""")
def validation_score(spark, d):
    rows = records(spark, d).filter(F.col("date") == F.lit("2024-01-05").cast("date"))
    return rows.groupBy("source").agg(ts.validation_score(F.count_if(F.col("k") == 3), F.count_if(F.col("k") == 5)).alias("score"))


@query("t25_date_validation", """
SELECT CASE WHEN try_cast(substr(t, 1, 10) AS DATE) IS NULL THEN 'error' WHEN try_cast(substr(t, 1, 10) AS DATE) > DATE '2024-01-25' THEN 'future' ELSE 'ok' END AS level, count(*) AS n
FROM (SELECT CASE WHEN k = 1 THEN 'n/a' ELSE CAST(date AS VARCHAR) END AS t FROM v_records) GROUP BY 1""")
def date_validation(spark, d):
    t = F.when(F.col("k") == 1, "n/a").otherwise(F.col("date").cast("string"))
    parsed = dates.normalised_date(t)
    level = F.when(parsed.isNull(), "error").when(parsed > F.lit("2024-01-25").cast("date"), "future").otherwise("ok")
    return records(spark, d).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("t26_volume_anomaly", """
WITH h AS (SELECT type, source, CAST(date_diff('hour', date_trunc('hour', ts), TIMESTAMP '2024-01-29 12:00:00') AS BIGINT) AS back FROM v_alerts), c AS (SELECT type, source, back, count(*) AS n FROM h WHERE back BETWEEN 0 AND 23 GROUP BY 1, 2, 3),
s AS (SELECT type, source, count(*) AS hours, sum(n) / 24::DOUBLE AS mean, sqrt(greatest(0, sum(n * n) / 24::DOUBLE - (sum(n) / 24::DOUBLE) * (sum(n) / 24::DOUBLE))) AS sd FROM c GROUP BY 1, 2)
SELECT type, source, back, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round((n - mean) / greatest(sd, 0.5), 4) AS sigma FROM c JOIN s USING (type, source) WHERE back <= 1 AND hours >= 3 AND n >= 1 AND n > mean + 1.0 * greatest(sd, 0.5)""")
def volume_anomaly(spark, d):
    as_of = F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    return ts.volume_anomalies(alerts(spark, d), ["type", "source"], "ts", as_of, sigma=1.0, least_hours=3, least=1)


@query("t27_elevated", """
WITH m AS (SELECT nation, strftime(date, '%Y-%m') AS month, count(*) AS n FROM v_orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY month DESC) AS i FROM m)
SELECT nation, count(*) AS months, max(n) FILTER (WHERE i = 2)::DOUBLE AS recent, round(avg(n) FILTER (WHERE i BETWEEN 3 AND 7), 4) AS baseline,
 coalesce(count(*) >= 7 AND max(n) FILTER (WHERE i = 2) >= 5 AND max(n) FILTER (WHERE i = 2) > 1.5 * avg(n) FILTER (WHERE i BETWEEN 3 AND 7), false) AS elevated FROM r GROUP BY nation""")
def elevated(spark, d):
    monthly = orders(spark, d).groupBy("nation", dates.period_key(F.col("date"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return ts.elevated(monthly, "nation", "month", "n")


@query("t28_halves", """
WITH i AS (SELECT indicator, value, row_number() OVER (PARTITION BY indicator ORDER BY year) - 1 AS idx, count(*) OVER (PARTITION BY indicator) AS n FROM v_econ),
h AS (SELECT indicator, avg(value) FILTER (WHERE idx < n // 2) AS b, arg_max(value, idx) AS l FROM i GROUP BY 1)
SELECT indicator, round(l / b, 4) AS ratio, CASE WHEN l / b < 0.5 THEN 'outage' WHEN l / b < 0.8 THEN 'degraded' ELSE 'normal' END AS status FROM h""")
def halves(spark, d):
    return ts.halves_status(ts.indexed(econ(spark, d), "year", "value", ["indicator"]), "indicator")


@query("t29_positive_diff", """
SELECT date, CAST(CASE WHEN v IS NOT NULL AND p IS NOT NULL THEN greatest(0, v - p) END AS BIGINT) AS step FROM (SELECT date, v, lag(v) OVER (ORDER BY date) AS p FROM (SELECT date, CASE WHEN day(date) % 6 <> 0 THEN fatalities END AS v FROM v_daily))""")
def positive_diff(spark, d):
    rows = daily(spark, d).select("date", F.when(F.dayofmonth("date") % 6 != 0, F.col("fatalities")).alias("v"))
    return ts.positive_diff(rows, "date", "v").select("date", "step")


@query("t30_uptime", """
WITH s AS (SELECT key, status, ts, lead(ts, 1, TIMESTAMP '2024-01-20') OVER (PARTITION BY key ORDER BY ts, status) AS t FROM v_updates WHERE ts < TIMESTAMP '2024-01-20'),
c AS (SELECT key, status, CAST(greatest(0, floor(epoch(least(t, TIMESTAMP '2024-01-20'))) - floor(epoch(greatest(ts, TIMESTAMP '2024-01-10')))) AS BIGINT) AS s, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN 1 ELSE 0 END AS i FROM s)
SELECT key, status, CAST(sum(s) AS BIGINT) AS seconds, CAST(sum(i) AS BIGINT) AS transitions, round(sum(s) * 100.0::DOUBLE / 864000, 4) AS share_pct FROM c WHERE s > 0 OR i = 1 GROUP BY 1, 2""")
def uptime(spark, d):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return ts.state_durations(updates(spark, d), "key", "status", "ts", at("2024-01-10"), at("2024-01-20"))


@query("k01_week_keys", """
SELECT date, CAST(isoyear(date) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(date) AS VARCHAR), 2, '0') AS iso, CAST(year(date) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(date) AS VARCHAR), 2, '0') AS calendar,
 CAST(year(date) AS VARCHAR) || '-W' || lpad(CAST(CAST(ceil(dayofyear(date) / 7.0) AS INTEGER) AS VARCHAR), 2, '0') AS by_day,
 CAST(year(date) AS VARCHAR) || '-W' || lpad(CAST(CAST(ceil((dayofyear(date) - 1 + dayofweek(date_trunc('year', date)) + 1) / 7.0) AS INTEGER) AS VARCHAR), 2, '0') AS sunday FROM (SELECT DISTINCT date FROM v_orders)""")
def week_keys(spark, d):
    c = F.col("date")
    return orders(spark, d).select("date").distinct().select(
        "date", dates.iso_week(c).alias("iso"), dates.calendar_year_week(c).alias("calendar"), dates.day_of_year_week(c).alias("by_day"), dates.sunday_week(c).alias("sunday")
    )


@query("k07_context", """
SELECT date, CAST(date_diff('day', DATE '2000-01-01', date) AS INTEGER) AS days, CASE WHEN date < DATE '2000-01-01' THEN 'before' WHEN date = DATE '2000-01-01' THEN 'baseline' ELSE 'after' END AS side,
 CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) <= 5 THEN 'spring' WHEN month(date) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
 CASE WHEN date >= DATE '2001-01-01' THEN 'second-intifada' ELSE 'oslo-period' END AS phase FROM (SELECT DISTINCT date FROM v_orders)""")
def context(spark, d):
    c = F.col("date")
    return orders(spark, d).select("date").distinct().select(
        "date", dates.days_since(c, "2000-01-01").alias("days"), dates.against_baseline(c, "2000-01-01").alias("side"), dates.season(c).alias("season"), dates.phase(c).alias("phase")
    )


@query("k09_freshness", """
WITH a AS (SELECT id, key, status, round(greatest(0, (epoch(TIMESTAMP '2024-01-30') - floor(epoch(ts))) / 3600.0::DOUBLE), 1) AS age FROM v_updates)
SELECT id, age, CASE WHEN age <= 1 THEN 'live' WHEN age <= 6 THEN 'recent' ELSE 'stale' END AS band, round(pow(0.5, age / 6), 3) AS score, CASE WHEN key = 'cp3' THEN 'closed' WHEN age > 6 THEN 'unknown' ELSE status END AS effective FROM a""")
def freshness(spark, d):
    age = dates.age_hours(F.col("ts"), F.lit("2024-01-30").cast("timestamp_ntz"))
    rows = updates(spark, d).withColumn("age", age)
    permanent = F.when(F.col("key") == "cp3", "closed")
    return rows.select("id", "age", dates.freshness_band(F.col("age")).alias("band"), dates.freshness_score(F.col("age")).alias("score"), dates.effective_status(F.col("status"), F.col("age"), permanent).alias("effective"))


@query("k11_excel_dates", "SELECT k, CAST(DATE '1899-12-30' + CAST(45000 + k AS INTEGER) AS DATE) AS day, ((k % 12) + 1)::INTEGER AS month FROM (SELECT DISTINCT k FROM v_records)")
def excel_dates(spark, d):
    name = F.date_format(F.make_date(F.lit(2024), F.col("k") % 12 + 1, F.lit(1)), "MMMM")
    return records(spark, d).select("k").distinct().select("k", dates.excel_date(F.col("k") + 45000).alias("day"), dates.month_number(name).alias("month"))


@query("g01_haversine", """
SELECT id, round(2 * 6371.0::DOUBLE * atan2(sqrt(a), sqrt(1 - a)), 4) AS km FROM (SELECT id, pow(sin(radians(31.5::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(31.5::DOUBLE)) * pow(sin(radians(34.45::DOUBLE - lon) / 2), 2) AS a FROM v_records)""")
def haversine(spark, d):
    return records(spark, d).select("id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(31.5), F.lit(34.45)), 4).alias("km"))


@query("g04_border_distance", """
SELECT id, round(CASE WHEN lat BETWEEN 31.2 AND 31.6 AND lon BETWEEN 34.2 AND 34.6 THEN least(abs(lat - 31.2::DOUBLE), abs(lat - 31.6::DOUBLE), abs(lon - 34.2::DOUBLE), abs(lon - 34.6::DOUBLE)) * 111000 END, 4) AS metres FROM v_records""")
def border_distance(spark, d):
    return records(spark, d).select("id", F.round(geo.border_distance_m(F.col("lat"), F.col("lon"), ((31.2, 34.2, 31.6, 34.6),)), 4).alias("metres"))


@query("g07_segment_distance", """
WITH p AS (SELECT id, lat, 111320.0::DOUBLE * cos(radians(lat)) AS px, lon FROM v_records), q AS (SELECT id, (34.3::DOUBLE - lon) * px AS ax, (31.3::DOUBLE - lat) * 111320.0::DOUBLE AS ay, (35.0::DOUBLE - 34.3::DOUBLE) * px AS dx, (32.0::DOUBLE - 31.3::DOUBLE) * 111320.0::DOUBLE AS dy FROM p),
t AS (SELECT *, greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM q) SELECT id, round(sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy)), 3) AS metres FROM t""")
def segment_distance(spark, d):
    m = geo.segment_distance_m(F.col("lat"), F.col("lon"), F.lit(31.3), F.lit(34.3), F.lit(32.0), F.lit(35.0))
    return records(spark, d).select("id", F.round(m, 3).alias("metres"))


@query("g11_severity", """
SELECT id, least(10.0::DOUBLE, floor((3 * fatalities + injuries) * CASE event_type WHEN 'error' THEN 1.5::DOUBLE WHEN 'view' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END / 10 + 0.5)) AS severity_index FROM v_records""")
def severity(spark, d):
    kind = F.when(F.col("event_type") == "error", "airstrike").when(F.col("event_type") == "view", "raid").otherwise(F.col("event_type"))
    return records(spark, d).select("id", scores.severity_index(F.col("fatalities"), F.col("injuries"), scores.event_factor(kind)).alias("severity_index"))


@query("g13_half_life", "SELECT id, round(0.85::DOUBLE * pow(0.5, date_diff('day', date, DATE '2024-03-01') / 120.0::DOUBLE), 4) AS confidence FROM v_records")
def half_life(spark, d):
    age = F.datediff(F.lit("2024-03-01").cast("date"), "date")
    return records(spark, d).select("id", F.round(scores.half_life(F.lit(0.85), age, F.lit(120.0)), 4).alias("confidence"))


@query("g14_trust", "SELECT id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, round(coalesce(confidence, 0.5) * reliability, 9))), 3) AS trust FROM v_alerts")
def trust(spark, d):
    return alerts(spark, d).select("id", scores.trust(F.col("confidence"), F.col("reliability")).alias("trust"))


@query("g16_bands", "SELECT CASE WHEN value <= 50 THEN 'good' WHEN value <= 100 THEN 'moderate' WHEN value <= 150 THEN 'unhealthy_sensitive' WHEN value <= 200 THEN 'unhealthy' WHEN value <= 300 THEN 'very_unhealthy' ELSE 'hazardous' END AS band, count(*) AS n, round(sum(value / 31.1035::DOUBLE * (21 / 24.0::DOUBLE)), 2) AS gold FROM v_records GROUP BY 1")
def bands(spark, d):
    v = F.col("value")
    return records(spark, d).groupBy(scores.air_quality_band(v).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(scores.gold_price(v, 21)), 2).alias("gold"))


@query("x04_strip_html", """
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages""")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_markup(F.col("html")).alias("text"))


@query("x04_title", """SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages""")
def title(spark, d):
    return table(spark, d, "pages").select("page_id", text.tag_content(F.col("html"), "title").alias("title"))


@query("x05_snippet", """
WITH b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(substr(t, 1, 200), ' [^ ]*$', '') || '...' END AS snippet FROM b""")
def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("x06_statistics", """
SELECT doc_id, CAST(replace(m, ',', '') AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([0-9][0-9,]*) (?:the|and|of|de|la|der)', 1)) AS m FROM documents)""")
def statistics(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.numbers_before(F.col("text"), "the|and|of|de|la|der")).alias("n"))


@query("x07_entities", """
SELECT name, count(*) AS n FROM (SELECT unnest(['The', 'Licensed', 'MIT', 'Apache', 'GNU']) AS name) e JOIN documents ON contains(text, name) GROUP BY 1""")
def entities_found(spark, d):
    names = ["The", "Licensed", "MIT", "Apache", "GNU"]
    return table(spark, d, "documents").select(F.explode(text.found_in(F.col("text"), names)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("x08_urgency", """
SELECT CASE WHEN contains(lower(text), 'licensed') OR contains(lower(text), 'akia') THEN 'high' WHEN contains(lower(text), '@') THEN 'medium' ELSE 'low' END AS urgency, count(*) AS n FROM documents GROUP BY 1""")
def urgency(spark, d):
    u = text.urgency(F.col("text"), ["licensed", "AKIA"], ["@"])
    return table(spark, d, "documents").groupBy(u.alias("urgency")).agg(F.count(F.lit(1)).alias("n"))


@query("x09_digest", """
SELECT source, count(*) FILTER (WHERE contains(lower(text), 'licensed')) AS high, count(*) AS total, array_to_string(list_slice(list_sort(list(doc_id) FILTER (WHERE contains(lower(text), 'licensed'))), 1, 5), ',') AS top FROM documents GROUP BY source""")
def digest(spark, d):
    from ..operators.paging import capped_list

    high = text.contains_any(F.col("text"), ["licensed"])
    top = capped_list(F.when(high, F.col("doc_id")), 5).cast("array<string>")
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(high).alias("high"), F.count(F.lit(1)).alias("total"), F.nullif(F.array_join(top, ","), F.lit("")).alias("top"))


@query("x12_plausible_count", """
SELECT doc_id, CAST(list_max(list_filter(list_transform(regexp_extract_all(lower(text), '([0-9][0-9,]*) (?:[a-z]+)', 1), lambda x: CAST(replace(x, ',', '') AS BIGINT)), lambda x: x BETWEEN 1 AND 500)) AS BIGINT) AS n FROM documents""")
def plausible_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.plausible_count(F.col("text"), "[a-z]+").alias("n"))


@query("x13_signal", """
SELECT doc_id, round(least(1.0::DOUBLE, len(regexp_extract_all(lower(text), 'the|der|les')) / sqrt(greatest(len(regexp_split_to_array(trim(text), '[ \\t\\r\\n]+')), 1))), 4) AS density FROM documents""")
def signal(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.signal_density(F.col("text"), "the|der|les"), 4).alias("density"))


@query("x14_confidence", """
SELECT id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, round(0.5::DOUBLE + (reliability - 0.5::DOUBLE) * 0.6::DOUBLE + CASE severity WHEN 'critical' THEN 0.15::DOUBLE WHEN 'high' THEN 0.10::DOUBLE WHEN 'low' THEN -0.10::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN area IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN admin1 IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN k > 50 THEN 0.05::DOUBLE ELSE 0 END + (k / 100.0::DOUBLE) * 0.10::DOUBLE
 + CASE WHEN k % 4 = 0 THEN -0.20::DOUBLE WHEN k % 4 = 1 THEN 0.05::DOUBLE ELSE 0 END + least(0.30::DOUBLE, (k % 5) * 0.10::DOUBLE) + greatest(-0.30::DOUBLE, coalesce(CASE WHEN k % 7 = 0 THEN -0.4::DOUBLE END, 0)), 3))) AS confidence FROM v_alerts""")
def confidence(spark, d):
    k = F.col("k")
    certainty = F.when(k % 4 == 0, "past").when(k % 4 == 1, "now")
    return alerts(spark, d).select("id", scores.alert_confidence(
        F.col("reliability"), F.col("severity"), F.col("area").isNotNull(), F.col("admin1").isNotNull(), k > 50, k / 100.0, certainty, k % 5, F.when(k % 7 == 0, -0.4)
    ).alias("confidence"))


@query("x15_rules", """
SELECT CASE WHEN regexp_matches(lower(text), 'newsletter') THEN NULL WHEN regexp_matches(lower(text), 'licensed') AND NOT regexp_matches(lower(text), 'mit') THEN 'license' WHEN regexp_matches(lower(text), 'copyright|@') THEN 'contact' WHEN regexp_matches(lower(text), '[0-9]{3}') THEN 'number' END AS label, count(*) AS n FROM documents GROUP BY 1""")
def rules(spark, d):
    from ..operators.rules import Rule, classify

    found = classify(F.col("text"), [Rule("license", "high", "licensed", "mit"), Rule("contact", "medium", "copyright|@"), Rule("number", "low", "[0-9]{3}")], "newsletter")
    return table(spark, d, "documents").groupBy(found["label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("x17_search_text", "SELECT doc_id, length(lower(lang || ' ' || source || ' ' || text)) AS n FROM documents")
def search_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(F.lower(F.concat_ws(" ", "lang", "source", "text"))).cast("bigint").alias("n"))


@query("x18_search", """
WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS length FROM p GROUP BY 1), s AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
h AS (SELECT *, greatest(CASE WHEN term = 'licensed' THEN 1.0 WHEN starts_with(term, 'licensed') THEN 0.75 WHEN levenshtein(term, 'licensed') <= 2 THEN 0.5 ELSE 0 END, CASE WHEN term = 'apache' THEN 1.0 WHEN starts_with(term, 'apache') THEN 0.75 WHEN levenshtein(term, 'apache') <= 1 THEN 0.5 ELSE 0 END)::DOUBLE AS weight FROM p),
f AS (SELECT term, count(*) AS df FROM h WHERE weight > 0 GROUP BY 1)
SELECT doc_id, round(sum(weight * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 4) AS score FROM h JOIN f USING (term) JOIN l USING (doc_id), s WHERE weight > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def search(spark, d):
    from ..operators.rules import search as bm25

    return bm25(table(spark, d, "documents"), "doc_id", "text", "licensed apache")


@query("x21_canonical_key", "SELECT DISTINCT regexp_replace(trim(lower(p_type)), '\\s+', '_', 'g') AS key FROM part")
def canonical_key(spark, d):
    return table(spark, d, "part").select(text.canonical_key(F.col("p_type")).alias("key")).distinct()
