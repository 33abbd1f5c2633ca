"""Aggregations over records, alerts and status logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.scores import trust
from ..operators import aggregates as a

from ..schema import REGIONS
from .base import alerts, daily, econ, entities, orders, query, records, table, updates

_STATS = """count(*) AS total_records, count(*) FILTER (WHERE category = 'conflict') AS incidents,
  CAST(sum(fatalities) AS BIGINT) AS fatalities, CAST(sum(injuries) AS BIGINT) AS injuries, CAST(sum(fatalities + injuries) AS BIGINT) AS casualties,
  count(DISTINCT place) AS affected_locations, count(DISTINCT event_type) FILTER (WHERE category = 'conflict') AS unique_event_types"""
_KEYS = {
    "day": "strftime(date, '%Y-%m-%d')",
    "week": "CAST(year(date) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(date) AS VARCHAR), 2, '0')",
    "month": "strftime(date, '%Y-%m')",
    "quarter": "CAST(year(date) AS VARCHAR) || '-Q' || CAST(quarter(date) AS VARCHAR)",
    "year": "CAST(year(date) AS VARCHAR)",
}

for _grain, _key in _KEYS.items():
    query(f"a01_period_{_grain}", f"SELECT {_key} AS period, {_STATS} FROM v_records GROUP BY 1")(
        lambda spark, d, grain=_grain: a.by_period(records(spark, d), grain)
    )


@query("a03_period_comparison", """
WITH m AS (SELECT strftime(date, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS n FROM v_orders GROUP BY 1),
l AS (SELECT period, n, lag(n) OVER (ORDER BY period) AS previous FROM m)
SELECT period, n, previous, n - previous AS change, round(CASE WHEN previous = 0 THEN CASE WHEN n > 0 THEN 100.0 ELSE 0 END ELSE (n - previous) * 100.0::DOUBLE / previous END, 4) AS change_pct
FROM l WHERE previous IS NOT NULL""")
def period_comparison(spark, d):
    monthly = orders(spark, d).groupBy(dates.period_key(F.col("date"), "month").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return a.compared_with_previous(monthly, "period", "n")


@query("a04_baseline_split", """
SELECT count(*) FILTER (WHERE date < DATE '2024-01-15') AS records_before, count(*) FILTER (WHERE date >= DATE '2024-01-15') AS records_after,
 CAST(sum(fatalities) FILTER (WHERE date < DATE '2024-01-15') AS BIGINT) AS metric_before, CAST(sum(fatalities) FILTER (WHERE date >= DATE '2024-01-15') AS BIGINT) AS metric_after,
 round((sum(fatalities) FILTER (WHERE date >= DATE '2024-01-15') - sum(fatalities) FILTER (WHERE date < DATE '2024-01-15')) * 100.0::DOUBLE / sum(fatalities) FILTER (WHERE date < DATE '2024-01-15'), 4) AS change_pct
FROM v_records""")
def baseline_split(spark, d):
    return a.around_date(records(spark, d), "2024-01-15", "fatalities")


@query("a05_multi_period", " UNION ALL ".join(f"SELECT '{g}' AS grain, {_KEYS[g]} AS period, {_STATS} FROM v_records GROUP BY 2" for g in ("day", "month", "year")))
def multi_period(spark, d):
    return a.by_periods(records(spark, d), ["day", "month", "year"])


_DOMAIN = "(SELECT unnest(['gaza', 'west_bank', 'east_jerusalem', 'unknown']) AS region)"


@query("a06_region", f"""
WITH r AS (SELECT CASE WHEN region IN ('gaza', 'west_bank', 'east_jerusalem', 'unknown') THEN region ELSE 'unknown' END AS region, category, fatalities, injuries, place, event_type FROM v_records),
s AS (SELECT region, {_STATS} FROM r GROUP BY region)
SELECT d.region, coalesce(total_records, 0) AS total_records, coalesce(incidents, 0) AS incidents, coalesce(fatalities, 0) AS fatalities, coalesce(injuries, 0) AS injuries,
 coalesce(casualties, 0) AS casualties, coalesce(affected_locations, 0) AS affected_locations, coalesce(unique_event_types, 0) AS unique_event_types FROM {_DOMAIN} d LEFT JOIN s USING (region)""")
def region(spark, d):
    return a.over_domain(records(spark, d), "region", REGIONS, a.record_stats())


@query("a07_governorate", """
WITH r AS (SELECT CASE WHEN CAST(substr(governorate, 2) AS INTEGER) < 16 THEN governorate ELSE 'unknown' END AS governorate FROM v_records WHERE place <> 'P3'),
dom AS (SELECT 'G' || CAST(i AS VARCHAR) AS governorate FROM range(16) t(i) UNION ALL SELECT 'unknown')
SELECT dom.governorate, count(r.governorate) AS n FROM dom LEFT JOIN r USING (governorate) GROUP BY 1""")
def governorate(spark, d):
    domain = tuple(f"G{i}" for i in range(16))
    return a.over_domain(records(spark, d).filter("place <> 'P3'"), "governorate", domain, [F.count(F.lit(1)).alias("n")])


@query("a08_custom_boundary", "SELECT coalesce(region, 'unknown') AS boundary, count(*) AS n FROM v_records GROUP BY 1")
def custom_boundary(spark, d):
    return records(spark, d).groupBy(F.coalesce("region", F.lit("unknown")).alias("boundary")).agg(F.count(F.lit(1)).alias("n"))


@query("a09_region_stats", """
SELECT region, count(*) FILTER (WHERE category = 'conflict') AS incidents, min(date) AS first, max(date) AS last, count(DISTINCT place) AS places,
 coalesce(round(sum(severity)::DOUBLE / nullif(count(*) FILTER (WHERE category = 'conflict'), 0), 4), 0) AS severity_index FROM v_records GROUP BY region""")
def region_stats(spark, d):
    return records(spark, d).groupBy("region").agg(
        F.count(F.when(F.col("category") == "conflict", 1)).alias("incidents"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.countDistinct("place").alias("places"), a.severity_per_incident().alias("severity_index"),
    )


@query("a10_daily_series", "SELECT date, n, fatalities FROM v_daily")
def daily_series(spark, d):
    return daily(spark, d)


@query("a11_pivot_regions", """
SELECT event_type, count(*) FILTER (WHERE region = 'gaza') AS gaza, count(*) FILTER (WHERE region = 'west_bank') AS west_bank FROM v_records GROUP BY event_type""")
def pivot_regions(spark, d):
    return records(spark, d).groupBy("event_type").pivot("region", ["gaza", "west_bank"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a12_summary", """
WITH m AS (SELECT region, max(fatalities) AS f, max(injuries) AS i FROM v_records WHERE category = 'conflict' GROUP BY region)
SELECT CAST(sum(f) AS BIGINT) AS fatalities, CAST(sum(i) AS BIGINT) AS injuries FROM m""")
def summary(spark, d):
    return a.cumulative_summary(records(spark, d).filter("category = 'conflict'"), "region", ["fatalities", "injuries"])


@query("a13_stats_rollup", """
SELECT coalesce(category, 'all') AS category, count(*) AS n, CAST(sum(fatalities) AS BIGINT) AS fatalities FROM v_records GROUP BY ROLLUP (category)""")
def stats_rollup(spark, d):
    return records(spark, d).rollup("category").agg(F.count(F.lit(1)).alias("n"), F.sum("fatalities").alias("fatalities")).withColumn("category", F.coalesce("category", F.lit("all")))


@query("a14_timeseries_week", """
SELECT CAST(year(date) AS VARCHAR) || '-W' || lpad(CAST(CAST(ceil(dayofyear(date) / 7.0) AS INTEGER) AS VARCHAR), 2, '0') AS week, count(*) AS n, CAST(sum(injuries) AS BIGINT) AS injuries
FROM v_records WHERE region = 'gaza' GROUP BY 1""")
def timeseries_week(spark, d):
    week = dates.day_of_year_week(F.col("date"))
    return records(spark, d).filter("region = 'gaza'").groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("n"), F.sum("injuries").alias("injuries"))


@query("a15_cumulative_timeseries", """
WITH t AS (SELECT region, date, max(k) AS top FROM v_records GROUP BY 1, 2), l AS (SELECT strftime(date, '%Y-%m-%d') AS period, CAST(sum(top) AS BIGINT) AS level FROM t GROUP BY 1)
SELECT period, level, CAST(greatest(0, level - coalesce(lag(level) OVER (ORDER BY period), 0)) AS BIGINT) AS increment FROM l""")
def cumulative_timeseries(spark, d):
    return a.cumulative_series(records(spark, d), "region", dates.period_key(F.col("date"), "day"), "k")


@query("a16_monthly_cumulative", """
WITH t AS (SELECT nation, strftime(date, '%Y-%m') AS period, max(CAST(floor(value) AS BIGINT)) AS top FROM v_orders GROUP BY 1, 2), l AS (SELECT period, CAST(sum(top) AS BIGINT) AS level FROM t GROUP BY 1)
SELECT period, level, CAST(greatest(0, level - coalesce(lag(level) OVER (ORDER BY period), 0)) AS BIGINT) AS increment FROM l""")
def monthly_cumulative(spark, d):
    o = orders(spark, d).withColumn("v", F.floor("value"))
    return a.cumulative_series(o, "nation", dates.period_key(F.col("date"), "month"), "v")


@query("a17_running_totals", """
SELECT date, n, CAST(sum(n) OVER (ORDER BY date) AS BIGINT) AS running, CAST(sum(fatalities) OVER (ORDER BY date) AS BIGINT) AS running_fatalities FROM v_daily""")
def running_totals(spark, d):
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily(spark, d).select("date", "n", F.sum("n").over(w).alias("running"), F.sum("fatalities").over(w).alias("running_fatalities"))


@query("a18_demographics", """
SELECT coalesce(sex, 'unknown') AS sex, CASE WHEN age IS NULL THEN 'unknown' WHEN age < 18 THEN 'child' WHEN age < 60 THEN 'adult' ELSE 'elderly' END AS band, count(*) AS n,
 round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM v_entities GROUP BY 1, 2""")
def demographics(spark, d):
    band = F.when(F.col("age").isNull(), "unknown").when(F.col("age") < 18, "child").when(F.col("age") < 60, "adult").otherwise("elderly")
    counted = entities(spark, d).groupBy(F.coalesce("sex", F.lit("unknown")).alias("sex"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


@query("a19_baselines", """
WITH r AS (SELECT *, date_diff('day', date, DATE '2024-01-30') AS age FROM v_records),
w AS (SELECT region, event_type, date_trunc('week', date) AS wk, count(*) AS n FROM r WHERE age BETWEEN 0 AND 365 GROUP BY 1, 2, 3),
p AS (SELECT region, event_type, avg(n) AS m, list_sort(list(n)) AS l FROM w GROUP BY 1, 2),
t AS (SELECT region, event_type, count(*) AS total, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (WHERE age BETWEEN 0 AND 30) AS count_30d,
 count(*) FILTER (WHERE age BETWEEN 0 AND 90) AS count_90d, count(*) FILTER (WHERE age BETWEEN 0 AND 365) AS count_12m FROM r WHERE region IS NOT NULL GROUP BY 1, 2)
SELECT t.*, round(m, 4) AS avg_weekly_12m, CAST(l[least(len(l) - 1, CAST(floor(len(l) * 0.9) AS INTEGER)) + 1] AS BIGINT) AS p90_weekly, round(count_90d / (90.0::DOUBLE / 7), 4) AS avg_weekly_90d
FROM t JOIN p USING (region, event_type)""")
def baselines(spark, d):
    return a.rolling_baselines(records(spark, d).filter("region is not null"), ["region", "event_type"], "2024-01-30")


@query("a20_databank_summary", """
SELECT substr(CAST(date AS VARCHAR), 1, 7) AS bucket, status, count(*) AS n, round(sum(value), 2) AS total FROM v_orders GROUP BY 1, 2""")
def databank_summary(spark, d):
    return orders(spark, d).groupBy(F.substring(F.col("date").cast("string"), 1, 7).alias("bucket"), "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("a21_alert_stats", """
WITH dom AS (SELECT unnest(['low', 'medium', 'high', 'critical']) AS severity), s AS (SELECT severity, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29') AS last_24h FROM v_alerts WHERE area = 'A3' GROUP BY 1)
SELECT dom.severity, coalesce(n, 0) AS n, coalesce(last_24h, 0) AS last_24h FROM dom LEFT JOIN s USING (severity)""")
def alert_stats(spark, d):
    from ..schema import SEVERITIES

    recent = F.count(F.when(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"), 1)).alias("last_24h")
    found = a.over_domain(alerts(spark, d).filter("area = 'A3'"), "severity", SEVERITIES, [F.count(F.lit(1)).alias("n"), recent], "low")
    return found


@query("a22_source_summary", """
SELECT channel, source_type, count(*) AS n, count(DISTINCT key) AS keys, max(ts) AS latest FROM v_updates WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def source_summary(spark, d):
    return updates(spark, d).filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("channel", "source_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"), F.max("ts").alias("latest")
    )


@query("a23_having_overrides", """
SELECT type, source, count(*) AS n, CAST(-0.1 AS DOUBLE) AS delta FROM v_alerts WHERE status = 'retracted' AND source <> 'ch1' GROUP BY 1, 2 HAVING count(*) >= 7""")
def having_overrides(spark, d):
    known = spark.createDataFrame([("ch1",)], "source string")
    mined = alerts(spark, d).filter("status = 'retracted'").groupBy("type", "source").agg(F.count(F.lit(1)).alias("n")).filter("n >= 7")
    return mined.join(known, "source", "left_anti").withColumn("delta", F.lit(-0.1))


@query("a24_reliability", """
SELECT source, count(*) AS total, count(*) FILTER (WHERE status = 'retracted') AS retracted, round(count(*) FILTER (WHERE status = 'retracted') / count(*)::DOUBLE, 4) AS fp_rate FROM v_alerts GROUP BY source""")
def reliability(spark, d):
    bad = F.count(F.when(F.col("status") == "retracted", 1))
    return alerts(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("total"), bad.alias("retracted"), F.round(F.try_divide(bad, F.count(F.lit(1))), 4).alias("fp_rate"))


@query("a25_reason_buckets", """
SELECT CASE WHEN event_type LIKE 'si%' THEN 'start' WHEN event_type LIKE 'c%' THEN 'touch' ELSE 'other' END AS reason, count(*) AS n FROM v_records GROUP BY 1""")
def reason_buckets(spark, d):
    t = F.col("event_type")
    return records(spark, d).groupBy(F.when(t.startswith("si"), "start").when(t.startswith("c"), "touch").otherwise("other").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("a26_weighted_means", """
WITH f AS (SELECT type, admin1, count(confidence) AS n, avg(confidence) AS m FROM v_alerts GROUP BY 1, 2)
SELECT type, CAST(sum(n) AS BIGINT) AS n, round(sum(m * n) / sum(n), 4) AS mean FROM f GROUP BY type""")
def weighted_means(spark, d):
    return a.weighted_rollup(alerts(spark, d), ["type", "admin1"], ["type"], "confidence")


@query("a27_dominant", """
WITH c AS (SELECT region, event_type, count(*) AS n FROM v_records GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, event_type) AS i, CAST(sum(n) OVER (PARTITION BY region) AS BIGINT) AS total FROM c)
SELECT region, total, event_type AS dominant FROM r WHERE i = 1""")
def dominant(spark, d):
    return a.dominant(records(spark, d), "region", "event_type")


@query("a28_threat", """
SELECT area, CASE WHEN c > 0 THEN 'critical' WHEN h > 2 THEN 'high' WHEN h > 0 OR m > 3 THEN 'elevated' ELSE 'normal' END AS threat, c, h, m FROM (
 SELECT area, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h, count(*) FILTER (WHERE severity = 'medium') AS m
 FROM v_alerts WHERE ts >= TIMESTAMP '2024-01-29 18:00:00' GROUP BY area)""")
def threat(spark, d):
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    recent = alerts(spark, d).filter(F.col("ts") >= F.lit("2024-01-29 18:00:00").cast("timestamp_ntz"))
    counted = recent.groupBy("area").agg(n("critical").alias("c"), n("high").alias("h"), n("medium").alias("m"))
    return counted.withColumn("threat", a.threat_level(F.col("c"), F.col("h"), F.col("m")))


@query("a29_today_counts", """
SELECT count(*) FILTER (WHERE type = 'click') AS injuries, count(DISTINCT area) FILTER (WHERE type = 'error') AS raids, count(DISTINCT coalesce(area, source)) FILTER (WHERE type = 'view') AS detentions
FROM v_alerts WHERE CAST(ts AS DATE) = DATE '2024-01-10' AND admin1 IS DISTINCT FROM 'Gaza Strip'""")
def today_counts(spark, d):
    keep = (F.col("ts").cast("date") == F.lit("2024-01-10").cast("date")) & ~F.col("admin1").eqNullSafe("Gaza Strip")
    t = F.col("type")
    return alerts(spark, d).filter(keep).agg(
        F.count(F.when(t == "click", 1)).alias("injuries"),
        F.countDistinct(F.when(t == "error", F.col("area"))).alias("raids"),
        F.countDistinct(F.when(t == "view", F.coalesce("area", "source"))).alias("detentions"),
    )


@query("a30_area_status", """
WITH c AS (SELECT key, count(*) AS total, count(*) FILTER (WHERE status = 'closed') AS closed, count(*) FILTER (WHERE status IN ('inspection')) AS restricted, count(*) FILTER (WHERE status = 'idf') AS forces, count(*) FILTER (WHERE status = 'congested') AS police
 FROM v_updates WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY key)
, s AS (SELECT *, CASE WHEN closed::DOUBLE / total >= 0.5 OR forces >= 3 THEN 'lockdown' WHEN forces >= 1 THEN 'military_presence' WHEN closed + restricted + police > 0 THEN 'restricted' ELSE 'calm' END AS status FROM c)
SELECT key, total, status, least(10, CASE status WHEN 'restricted' THEN 2 WHEN 'military_presence' THEN 5 WHEN 'lockdown' THEN 8 ELSE 0 END + least(closed, 5) + 2 * forces + police) AS score FROM s""")
def area_status(spark, d):
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    recent = updates(spark, d).filter(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))
    c = recent.groupBy("key").agg(F.count(F.lit(1)).alias("total"), n("closed").alias("closed"), n("inspection").alias("restricted"), n("idf").alias("forces"), n("congested").alias("police"))
    # congested stands for police here, as the reports have none
    status = a.area_status(F.col("closed"), F.col("restricted") + F.col("police"), F.col("forces"), F.col("total"))
    return c.withColumn("status", status).select("key", "total", "status", a.area_score(F.col("status"), F.col("closed"), F.col("forces"), F.col("police")).alias("score"))


@query("a31_status_summary", """
WITH l AS (SELECT key, status, ts, row_number() OVER (PARTITION BY key ORDER BY ts DESC, status DESC) AS i FROM v_updates)
SELECT status, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 HOUR) AS fresh_1h, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 6 HOUR) AS fresh_6h FROM l WHERE i = 1 GROUP BY status""")
def status_summary(spark, d):
    latest = updates(spark, d).groupBy("key").agg(F.max(F.struct("ts", "status")).alias("l"))
    since = lambda t: F.count(F.when(F.col("l.ts") >= F.lit(t).cast("timestamp_ntz"), 1))
    return latest.groupBy("l.status").agg(F.count(F.lit(1)).alias("n"), since("2024-01-29 23:00:00").alias("fresh_1h"), since("2024-01-29 18:00:00").alias("fresh_6h"))


@query("a32_phase_population", """
WITH q AS (SELECT 1 + c_custkey % 5 AS phase, CAST(sum(CAST(c_custkey AS BIGINT)) AS BIGINT) AS pop, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS areas FROM customer GROUP BY 1)
SELECT phase, pop, areas, CAST((SELECT sum(pop) FROM q WHERE phase >= 3) AS BIGINT) AS crisis FROM q""")
def phase_population(spark, d):
    c = F.col("c_custkey")
    q = table(spark, d, "customer").groupBy((1 + c % 5).alias("phase")).agg(F.sum(c).alias("pop"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("areas"))
    return q.withColumn("crisis", F.sum(F.when(F.col("phase") >= 3, F.col("pop"))).over(Window.partitionBy()))


@query("a33_by_category_year", "SELECT nation, year(date)::INTEGER AS year, count(*) AS n, round(sum(value), 2) AS total FROM v_orders GROUP BY 1, 2")
def by_category_year(spark, d):
    return orders(spark, d).groupBy("nation", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


_TOPICS = {"access": "license|copyright", "contact": "@|\\+1", "market": "the.*of"}


@query("a34_topics", """
WITH t AS (SELECT lang, list_filter(['access', 'contact'], lambda x: CASE x WHEN 'access' THEN regexp_matches(lower(text), 'license|copyright') ELSE regexp_matches(lower(text), '@|\\+1') END) AS topics FROM documents)
SELECT lang, topic, count(*) AS n FROM (SELECT lang, unnest(CASE WHEN len(topics) > 0 THEN topics ELSE ['general'] END) AS topic FROM t) GROUP BY 1, 2""")
def topics(spark, d):
    from ..functions.text import topics as topics_of

    rules = {k: v for k, v in _TOPICS.items() if k != "market"}
    rows = table(spark, d, "documents").select("lang", F.explode(topics_of(F.col("text"), rules)).alias("topic"))
    return rows.groupBy("lang", "topic").agg(F.count(F.lit(1)).alias("n"))


@query("a35_quality_snapshot", """
SELECT event_type AS category, count(*) AS n, round(count(*) FILTER (WHERE region IS NULL OR region = 'unknown') * 100.0::DOUBLE / count(*), 2) AS unknown_pct, max(date) AS latest,
 CAST(date_diff('day', max(date), DATE '2024-05-30') AS INTEGER) AS age, date_diff('day', max(date), DATE '2024-05-30') > 90 AS stale FROM v_records GROUP BY 1""")
def quality_snapshot(spark, d):
    unknown = F.count(F.when(F.col("region").isNull() | (F.col("region") == "unknown"), 1))
    age = F.datediff(F.lit("2024-05-30").cast("date"), F.max("date"))
    return records(spark, d).groupBy(F.col("event_type").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.round(unknown * 100.0 / F.count(F.lit(1)), 2).alias("unknown_pct"), F.max("date").alias("latest"), age.alias("age"), (age > 90).alias("stale")
    )


@query("a36_latest_per_metric", """
SELECT status, value FROM (SELECT status, value, row_number() OVER (PARTITION BY status ORDER BY date DESC, id DESC) AS i FROM v_orders) WHERE i = 1""")
def latest_per_metric(spark, d):
    return orders(spark, d).groupBy("status").agg(F.max_by("value", F.struct("date", "id")).alias("value"))


@query("a37_usage_rollup", """
SELECT customer, count(*) AS days, CAST(sum(n) AS BIGINT) AS month_total FROM (SELECT customer, date, count(*) AS n FROM v_orders WHERE year(date) = 1996 GROUP BY 1, 2) GROUP BY customer""")
def usage_rollup(spark, d):
    per_day = orders(spark, d).filter(F.year("date") == 1996).groupBy("customer", "date").agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy("customer").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("month_total"))


@query("a38_status_counts", "SELECT status, count(*) AS n FROM v_updates GROUP BY status")
def status_counts(spark, d):
    return updates(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("a39_history", """
WITH s AS (SELECT key, status, count(*) AS n FROM v_updates GROUP BY 1, 2), t AS (SELECT key, status, row_number() OVER (PARTITION BY key ORDER BY n DESC, status) AS i FROM s)
SELECT u.key, count(DISTINCT u.direction) AS variants, count(*) FILTER (WHERE source_type = 'admin') AS admin_mentions, count(*) FILTER (WHERE source_type = 'crowd') AS crowd_mentions, min(ts) AS first_seen, max(ts) AS last_seen, any_value(t.status) AS common
FROM v_updates u JOIN t ON u.key = t.key AND t.i = 1 GROUP BY u.key""")
def history(spark, d):
    u = updates(spark, d)
    common = a.dominant(u, "key", "status").select("key", F.col("dominant").alias("common"))
    n = lambda s: F.count(F.when(F.col("source_type") == s, 1))
    return u.groupBy("key").agg(
        F.countDistinct("direction").alias("variants"), n("admin").alias("admin_mentions"), n("crowd").alias("crowd_mentions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    ).join(common, "key")


@query("a40_vocab", """
WITH w AS (SELECT source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM (SELECT lang AS source, text FROM documents)), c AS (SELECT word, source, count(*) AS n FROM w GROUP BY 1, 2),
t AS (SELECT word, source AS label, n, CAST(sum(n) OVER (PARTITION BY word) AS BIGINT) AS total, row_number() OVER (PARTITION BY word ORDER BY n DESC, source) AS i FROM c)
SELECT word, total, label, round(n / total::DOUBLE, 4) AS share FROM t WHERE i = 1 AND total >= 20 AND n / total::DOUBLE >= 0.8""")
def vocab(spark, d):
    from ..operators.rules import dominant_words

    return dominant_words(table(spark, d, "documents"), "doc_id", "text", "lang", 20)


@query("a41_validation_report", """
SELECT source, count(*) FILTER (WHERE text IS NOT NULL AND length(text) = n_chars) AS passed, count(*) FILTER (WHERE NOT (text IS NOT NULL AND length(text) = n_chars)) AS failed, round(avg(CASE WHEN length(text) = n_chars THEN 1.0::DOUBLE ELSE 0 END), 4) AS score FROM documents GROUP BY source""")
def validation_report(spark, d):
    ok = F.col("text").isNotNull() & (F.length("text") == F.col("n_chars"))
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.round(F.avg(ok.cast("double")), 4).alias("score"))


@query("a43_distinct_counts", "SELECT count(DISTINCT place) AS places, count(DISTINCT source) AS sources, count(DISTINCT region) AS regions FROM v_records")
def distinct_counts(spark, d):
    return records(spark, d).agg(F.countDistinct("place").alias("places"), F.countDistinct("source").alias("sources"), F.countDistinct("region").alias("regions"))


@query("a44_attributions", "SELECT DISTINCT 'Data: ' || upper(source) AS attribution FROM v_records")
def attributions(spark, d):
    named = records(spark, d).select(F.explode(F.array("source")).alias("s")).distinct()
    return named.select(F.concat(F.lit("Data: "), F.upper("s")).alias("attribution")).orderBy("attribution")


@query("a45_compare_datasets", """
WITH b AS (SELECT avg(value) AS m, quantile_cont(value, 0.5) AS q, stddev_pop(value) AS s FROM v_records WHERE category = 'conflict'), o AS (SELECT avg(value) AS m, quantile_cont(value, 0.5) AS q, stddev_pop(value) AS s FROM v_records WHERE category <> 'conflict')
SELECT round(o.m - b.m, 4) AS mean_difference, round(o.q - b.q, 4) AS median_difference, round(o.s - b.s, 4) AS sd_difference FROM b, o""")
def compare_datasets(spark, d):
    from ..operators.statistics import compare

    r = records(spark, d)
    return compare(r.filter("category = 'conflict'"), r.filter("category <> 'conflict'"), "value")


@query("a46_indicator_baseline", """
SELECT indicator, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year, arg_min(value, year) AS first_value, arg_max(value, year) AS last_value, round(avg(value), 2) AS mean, count(*) AS n,
 arg_max(value, year) > arg_min(value, year) AS rising, round((arg_max(value, year) - arg_min(value, year)) * 100 / arg_min(value, year), 4) AS change_pct FROM v_econ GROUP BY indicator""")
def indicator_baseline(spark, d):
    first, last = F.min_by("value", "year"), F.max_by("value", "year")
    return econ(spark, d).groupBy("indicator").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), first.alias("first_value"), last.alias("last_value"), F.round(F.avg("value"), 2).alias("mean"),
        F.count(F.lit(1)).alias("n"), (last > first).alias("rising"), F.round(F.try_divide((last - first) * 100, first), 4).alias("change_pct"),
    )


@query("a47_cooccurrence", """
WITH g AS (SELECT DISTINCT date, place, event_type FROM v_records)
SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM g a JOIN g b ON a.date = b.date AND a.place = b.place AND a.event_type < b.event_type GROUP BY 1, 2""")
def cooccurrence(spark, d):
    return a.co_occurrence(records(spark, d), ["date", "place"], "event_type")


@query("a48_run_health", """
WITH r AS (SELECT source AS job, id, value >= 60 AS ok FROM v_records), l AS (SELECT job, max(id) FILTER (WHERE ok) AS last FROM r GROUP BY job)
SELECT r.job, count(*) AS runs, max(id) AS latest, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 3) AS success_rate, count(*) FILTER (WHERE last IS NULL OR id > last) AS streak,
 CASE WHEN count(*) FILTER (WHERE last IS NULL OR id > last) >= 3 THEN 'failing' WHEN count(*) FILTER (WHERE last IS NULL OR id > last) >= 1 THEN 'flaky' ELSE 'healthy' END AS health FROM r JOIN l USING (job) GROUP BY r.job""")
def run_health(spark, d):
    rows = records(spark, d).select(F.col("source").alias("job"), "id", "value")
    return a.trailing_streak(rows, "job", "id", F.col("value") >= 60)


@query("a49_incident_members", """
SELECT area, type, max(confidence) AS top_confidence, max(round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, round(coalesce(confidence, 0.5) * reliability, 9))), 3)) AS top_trust, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM v_alerts WHERE status = 'active' GROUP BY 1, 2""")
def incident_members(spark, d):
    return alerts(spark, d).filter("status = 'active'").groupBy("area", "type").agg(
        F.max("confidence").alias("top_confidence"), F.max(trust(F.col("confidence"), F.col("reliability"))).alias("top_trust"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"),
    )


@query("a50_row_sums", """
SELECT o_orderpriority AS priority, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE, 4) AS rate, CAST(sum(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 1 END, 0) + coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 2 END, 0)) AS BIGINT) AS held FROM orders GROUP BY 1""")
def row_sums(spark, d):
    k = F.col("o_orderkey")
    held = F.coalesce(F.when(k % 3 == 0, 1), F.lit(0)) + F.coalesce(F.when(k % 5 == 0, 2), F.lit(0))
    rate = F.round(F.try_divide(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))), 4)
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(rate.alias("rate"), F.sum(held).alias("held"))


@query("l06_top_regions", "SELECT nation, round(sum(value), 2) AS total FROM v_orders GROUP BY nation ORDER BY total DESC, nation LIMIT 5")
def top_regions(spark, d):
    return orders(spark, d).groupBy("nation").agg(F.round(F.sum("value"), 2).alias("total")).orderBy(F.desc("total"), "nation").limit(5)


_MEMBERS = """r AS (SELECT *, CAST(isoyear(date) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(date) AS VARCHAR), 2, '0') AS week FROM v_records),
m AS (SELECT *, place || '|' || week AS cluster_key, 'gazetteer' AS place_kind, place AS place_name FROM r UNION ALL SELECT *, 'admin2:' || lower(governorate) || '|' || week, 'admin2', governorate FROM r)"""


@query("q08_clusters", f"""WITH {_MEMBERS}
SELECT 'ev-' || substr(sha256(cluster_key), 1, 16) AS cluster_id, cluster_key, place_kind, min(place_name) AS place_name, count(*) AS record_count, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS categories,
 arg_min(region, id) FILTER (WHERE region IS NOT NULL) AS region, CAST(sum(fatalities) AS BIGINT) AS fatalities, CAST(sum(injuries) AS BIGINT) AS injuries FROM m GROUP BY cluster_key, place_kind""")
def clusters(spark, d):
    """Clusters of a place's week and of a district's week."""
    members = a.cluster_members(records(spark, d), "place", "governorate", "date")
    found = a.event_clusters(members, "id", "event_type", ["fatalities", "injuries"], ["region"])
    return found.withColumn("categories", F.array_join("categories", ","))


@query("q08_members", f"""WITH {_MEMBERS} SELECT cluster_key, event_type AS category, id, date FROM m""")
def members(spark, d):
    found = a.cluster_members(records(spark, d), "place", "governorate", "date")
    return found.select("cluster_key", F.col("event_type").alias("category"), "id", "date")
