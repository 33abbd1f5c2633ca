"""Single operators and window shapes, each on its own."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, geo, scores, text
from ..operators import aggregates as ag
from ..operators import facts as fa
from ..operators import filters as fl
from ..operators import identity as idn
from ..operators import joins as j
from ..operators import paging as pg
from ..operators import statistics as st
from ..operators import timeseries as ts
from ..scratch import scratch_path
from ..sources import files, snapshots, workbooks
from .base import alerts, daily, econ, orders, query, records, series, table, updates


def _scratch(spark, name: str) -> str:
    """A fresh folder below the shared one."""
    return scratch_path(spark, name)


# --- scans and sinks: written, read back, compared with what was written


@query("s01_scan_category", "SELECT category, count(*) AS n FROM v_records GROUP BY category")
def scan_category(spark, d):
    path = _scratch(spark, "category")
    records(spark, d).write.parquet(path)
    return files.read_category(spark, path).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("s02_scan_partitions", "SELECT CAST(year(date) AS VARCHAR) || '-Q' || CAST(quarter(date) AS VARCHAR) AS quarter, count(*) AS n FROM v_orders GROUP BY 1")
def scan_partitions(spark, d):
    path = _scratch(spark, "partitions")
    snapshots.write_partitioned(orders(spark, d), path, least=1)
    return spark.read.parquet(path).groupBy("quarter").agg(F.count(F.lit(1)).alias("n"))


@query("s04_catalog", "SELECT 'records_view' AS name, true AS temporary")
def catalog(spark, d):
    records(spark, d).createOrReplaceTempView("records_view")
    found = [(n, t) for n, t in files.catalog(spark).items() if n == "records_view"]
    return spark.createDataFrame(found, "name string, temporary boolean")


@query("s05_json_source", "SELECT type, count(*) AS n, max(id) AS last FROM v_alerts GROUP BY type")
def json_source(spark, d):
    path = _scratch(spark, "json")
    rows = alerts(spark, d).select("id", "type")
    shaped = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(64)).alias("p")).agg(F.to_json(F.collect_list(F.struct("id", "type"))).alias("a"))
    # a third each: bare arrays, {data: [...]}, {data: {results: [...]}}
    value = F.when(F.col("p") % 3 == 0, F.col("a")).when(F.col("p") % 3 == 1, F.concat(F.lit('{"data":'), "a", F.lit("}"))).otherwise(F.concat(F.lit('{"data":{"results":'), "a", F.lit("}}")))
    shaped.select("p", value.alias("value")).repartition("p").write.partitionBy("p").text(path)
    return files.read_json(spark, path, rows.schema).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


@query("s06_csv_source", "SELECT doc_id, length(text) AS n FROM documents")
def csv_source(spark, d):
    path = _scratch(spark, "csv")
    table(spark, d, "documents").select("doc_id", "text").write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)
    return files.read_csv(spark, path, table(spark, d, "documents").select("doc_id", "text").schema).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("s07_workbook_source", """
SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 2) AS price, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority || ' & <' || o_orderstatus || '>' END AS note FROM orders""")
def workbook_source(spark, d):
    note = F.when(F.col("o_orderkey") % 7 > 0, F.concat("o_orderpriority", F.lit(" & <"), "o_orderstatus", F.lit(">")))
    serial = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), serial.alias("date"), F.col("o_totalprice").cast("double").alias("price"), note.alias("note"))

    def book(group: pd.DataFrame) -> pd.DataFrame:
        found = [(int(k), int(day), float(p), n) for k, day, p, n in zip(group["k"], group["date"], group["price"], group["note"])]
        return pd.DataFrame({"path": [f"{group['k'].iloc[0]}.xlsx"], "content": [workbooks.workbook(["k", "date", "price", "note"], found)]})

    # a workbook for each thousand keys
    books = rows.groupBy(F.floor(F.col("k") / 1000).alias("book")).applyInPandas(book, "path string, content binary")
    cell = lambda c: F.col("cells").getItem(c)
    return workbooks.sheets_of(books).select(
        cell("k").cast("bigint").alias("k"), dates.excel_date(cell("date").cast("double")).alias("date"),
        F.round(cell("price").cast("double"), 2).alias("price"), cell("note").alias("note"),
    )


@query("s08_geojson_source", "SELECT round(lat, 4) AS lat, round(lon, 4) AS lon FROM (SELECT DISTINCT lat, lon FROM v_records)")
def geojson_source(spark, d):
    path = _scratch(spark, "geojson")
    points = records(spark, d).select("lat", "lon").distinct()
    one = points.groupBy(F.pmod(F.xxhash64("lat", "lon"), F.lit(16)).alias("p")).agg(F.array_join(F.collect_list(geo.feature(F.col("lat"), F.col("lon"), n=F.lit(1))), ",").alias("f"))
    one.select("p", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).repartition("p").write.partitionBy("p").text(path)
    return files.read_geojson(spark, path).select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query("s09_feed_source", "SELECT page_id, 'p' || CAST(page_id AS VARCHAR) AS guid, url AS link FROM pages")
def feed_source(spark, d):
    raw = table(spark, d, "pages").select("page_id", F.concat(F.lit("<rss><item><guid>p"), F.col("page_id").cast("string"), F.lit("</guid><link>"), F.col("url"), F.lit("</link></item></rss>")).alias("x"))
    return files.feed_items(raw, "x", "page_id").select("page_id", "guid", "link")


@query("s11_delta_rows", "SELECT key, id, status FROM v_updates")
def delta_rows(spark, d):
    w = Window.partitionBy("key").orderBy("id")
    u = updates(spark, d).withColumn("same", F.coalesce(F.lag("status").over(w) == F.col("status"), F.lit(False)))
    coded = u.select("key", "id", F.when(F.col("same"), F.array().cast("array<string>")).otherwise(F.array("status")).alias("c"), F.col("same").cast("int").alias("r"), F.lit(0).alias("o"))
    return files.decode_delta_rows(coded, "key", "id", "c", "r", "o", ["status"])


@query("s13_chunks", "SELECT count(*) AS n FROM (SELECT day(date) AS c FROM v_records) WHERE c BETWEEN 2 AND 4")
def chunks(spark, d):
    path = _scratch(spark, "chunks")
    records(spark, d).withColumn("chunk", F.dayofmonth("date")).write.partitionBy("chunk").parquet(path)
    return files.read_chunks(spark, path, 2, 4).agg(F.count(F.lit(1)).alias("n"))


@query("s14_partition_sink", "SELECT count(*) AS n, count(DISTINCT quarter(date) + 10 * year(date)) AS quarters FROM v_orders")
def partition_sink(spark, d):
    path = _scratch(spark, "sink")
    snapshots.write_partitioned(orders(spark, d), path, least=1)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("quarter").alias("quarters"))


@query("s17_gzip_json", "SELECT count(*) AS n, round(sum(value), 2) AS total FROM v_records")
def gzip_json(spark, d):
    path = _scratch(spark, "gzip")
    files.write_gzip_json(records(spark, d).select("id", "value"), path)
    return spark.read.schema("id bigint, value double").json(path).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


# --- projections and filters


@query("p01_field_list", "SELECT id, place FROM v_records")
def field_list(spark, d):
    return pg.select_fields(records(spark, d), "id, place, nope")


@query("p03_drop_heavy", "SELECT doc_id, lang, source, n_chars FROM documents")
def drop_heavy(spark, d):
    return table(spark, d, "documents").drop("text")


@query("p05_synonym_columns", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value, o_orderstatus AS kind FROM orders")
def synonym_columns(spark, d):
    from ..sources.normalise import normalised

    t = table(spark, d, "orders").withColumn("when", F.col("o_orderdate").cast("date").cast("string"))
    columns = {"id": ("id", "o_orderkey"), "date": ("date", "when"), "value": ("amount", "o_totalprice"), "kind": ("kind", "o_orderstatus")}
    out = normalised(t, columns, ("value",), ("date",))
    return out.withColumn("id", F.col("id").cast("bigint"))


@query("p08_envelope", """
WITH a AS (SELECT id, key, status, round(greatest(0, (epoch(TIMESTAMP '2024-01-30') - floor(epoch(ts))) / 3600.0::DOUBLE), 1) AS age, source_type FROM v_updates)
SELECT id, CASE WHEN age > 6 THEN 'unknown' ELSE status END AS status, CASE WHEN age <= 1 THEN 'live' WHEN age <= 6 THEN 'recent' ELSE 'stale' END AS band, CASE source_type WHEN 'admin' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS trust FROM a""")
def envelope(spark, d):
    age = dates.age_hours(F.col("ts"), F.lit("2024-01-30").cast("timestamp_ntz"))
    trust = scores.source_trust(F.when(F.col("source_type") == "admin", 0.95).otherwise(0.5))
    e = F.struct(dates.effective_status(F.col("status"), F.col("age"), F.lit(None).cast("string")).alias("status"), dates.freshness_band(F.col("age")).alias("band"), trust.alias("trust"))
    return updates(spark, d).withColumn("age", age).select("id", e.alias("e")).select("id", "e.status", "e.band", "e.trust")


@query("p09_live_reshape", "SELECT 'live-' || CAST(id AS VARCHAR) AS id, type AS event_type, coalesce(area, admin1, 'unknown') AS place, CAST(ts AS DATE) AS date FROM v_alerts")
def live_reshape(spark, d):
    return alerts(spark, d).select(F.concat(F.lit("live-"), F.col("id").cast("string")).alias("id"), F.col("type").alias("event_type"), F.coalesce("area", "admin1", F.lit("unknown")).alias("place"), F.col("ts").cast("date").alias("date"))


@query("f04_min_killed", "SELECT count(*) AS n FROM v_records WHERE coalesce(CASE WHEN region = 'gaza' THEN fatalities END, 0) >= 4")
def min_killed(spark, d):
    killed = F.when(F.col("region") == "gaza", F.col("fatalities"))
    return records(spark, d).filter(fl.at_least(killed, 4)).agg(F.count(F.lit(1)).alias("n"))


@query("f14_admin_filter", "SELECT n_nationkey AS code, n_name AS name FROM nation WHERE contains(lower(n_name), 'n_1') OR n_nationkey = 7")
def admin_filter(spark, d):
    return table(spark, d, "nation").filter(fl.contains_ci(F.col("n_name"), "n_1") | (F.col("n_nationkey") == 7)).select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))


@query("f17_subscription_match", "SELECT count(*) AS n FROM v_alerts WHERE type IN ('click', 'view') AND severity IN ('medium', 'high', 'critical') AND (confidence IS NULL OR confidence >= 0.4)")
def subscription_match(spark, d):
    alert = {c: F.col(c) for c in ("type", "severity", "area", "confidence")}
    rule = {"types": F.array(F.lit("click"), F.lit("view")), "min_severity": F.lit("medium"), "area": F.lit(None).cast("string"), "min_confidence": F.lit(0.4)}
    return alerts(spark, d).filter(fl.matches_rule(alert, rule)).agg(F.count(F.lit(1)).alias("n"))


# --- aggregates and statistics


@query("a02_period_stats", """
SELECT count(*) AS total_records, count(*) FILTER (WHERE category = 'conflict') AS incidents, CAST(sum(fatalities) AS BIGINT) AS fatalities, CAST(sum(injuries) AS BIGINT) AS injuries, CAST(sum(fatalities + injuries) AS BIGINT) AS casualties,
 count(DISTINCT place) AS affected_locations, count(DISTINCT event_type) FILTER (WHERE category = 'conflict') AS unique_event_types FROM v_records""")
def period_stats(spark, d):
    return records(spark, d).agg(*ag.record_stats())


@query("a42_monitoring", """
WITH r AS (SELECT source, count(*) AS runs, round(avg(CASE WHEN value >= 40 THEN 1.0::DOUBLE ELSE 0 END), 4) AS ok FROM v_records GROUP BY 1) SELECT source, runs, ok, CASE WHEN ok < 0.45 THEN 'critical' WHEN ok < 0.9 THEN 'warning' ELSE 'healthy' END AS level FROM r""")
def monitoring(spark, d):
    ok = F.round(F.avg((F.col("value") >= 40).cast("double")), 4)
    r = records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("runs"), ok.alias("ok"))
    return r.withColumn("level", F.when(F.col("ok") < 0.45, "critical").when(F.col("ok") < 0.9, "warning").otherwise("healthy"))


@query("d01_mean", "SELECT l_returnflag AS flag, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1")
def mean(spark, d):
    return _by_flag(spark, d, "mean")


def _by_flag(spark, d, *columns: str, rename: bool = True):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    full = st.comprehensive(rows, "l_extendedprice", ["flag"])
    return full.select("flag", *(F.col(c).alias("v") if rename else F.col(c) for c in columns))


def _percentile_by_flag(spark, d, share: float):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return st.percentiles(rows, "l_extendedprice", {"v": share}, ["flag"]).select("flag", F.round("v", 4).alias("v"))


@query("d02_median", "SELECT l_returnflag AS flag, round(median(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1")
def median(spark, d):
    return _percentile_by_flag(spark, d, 0.5)


@query("d03_mode", "SELECT flag, q AS v FROM (SELECT l_returnflag AS flag, l_quantity AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS i FROM lineitem GROUP BY 1, 2) WHERE i = 1")
def mode(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    return st.modes(rows, "l_quantity", ["flag"]).withColumnRenamed("mode", "v")


@query("d04_spread", "SELECT l_returnflag AS flag, round(stddev_pop(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS variance FROM lineitem GROUP BY 1")
def spread(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.stddev_pop("l_quantity"), 4).alias("sd"), F.round(F.var_pop("l_quantity"), 4).alias("variance"))


@query("d07_iqr", """
WITH s AS (SELECT event_type, list_sort(list(value)) AS l FROM v_events GROUP BY 1) SELECT event_type, round(list_median(l[len(l) - len(l) // 2 + 1:]) - list_median(l[1:len(l) // 2]), 4) AS iqr FROM s""")
def iqr(spark, d):
    from .base import events

    q = st.hinges(events(spark, d), "value", ["event_type"])
    return q.select("event_type", F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"))


@query("d11_percentile", "SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.9), 4) AS v FROM lineitem GROUP BY 1")
def percentile(spark, d):
    return _percentile_by_flag(spark, d, 0.9)


@query("d14_correlation", "SELECT l_returnflag AS flag, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem GROUP BY 1")
def correlation(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(st.correlation(F.col("l_quantity"), F.col("l_extendedprice")), 4).alias("r"))


# --- time series


@query("t03_autocorrelation", """
WITH m AS (SELECT avg(value) AS m FROM v_series), c AS (SELECT idx, value - m AS x FROM v_series, m) SELECT round((SELECT sum(a.x * b.x) FROM c a JOIN c b ON b.idx = a.idx + 3) / (SELECT sum(x * x) FROM c), 4) AS r""")
def autocorrelation(spark, d):
    return ts.acf(series(spark, d), 3).filter("lag = 3").select("r")


@query("t12_cagr", "SELECT indicator, round((pow(arg_max(value, year) / arg_min(value, year), 1.0::DOUBLE / (count(*) - 1)) - 1) * 100, 4) AS cagr FROM v_econ GROUP BY 1")
def cagr(spark, d):
    first, last, n = F.min_by("value", "year"), F.max_by("value", "year"), F.count(F.lit(1)) - 1
    ok = (first > 0) & (last > 0) & (n > 0)
    return econ(spark, d).groupBy("indicator").agg(F.round(F.when(ok, (F.pow(last / first, F.lit(1.0) / n) - 1) * 100).otherwise(0.0), 4).alias("cagr"))


@query("t20_outliers", "WITH m AS (SELECT avg(n) AS m, stddev_pop(n) AS s FROM v_daily) SELECT date, n FROM v_daily, m WHERE abs((n - m) / s) > 1.5")
def outliers(spark, d):
    return st.z_outliers(daily(spark, d), "n", threshold=1.5).select("date", "n")


_FIT_ECON = """WITH i AS (SELECT indicator, value, row_number() OVER (PARTITION BY indicator ORDER BY year) - 1 AS x FROM v_econ),
f AS (SELECT indicator, count(*) AS n, (count(*) * sum(x * value) - sum(x) * sum(value)) / (count(*) * sum(x * x) - sum(x) * sum(x))::DOUBLE AS slope, pow(corr(x, value), 2) AS r2 FROM i GROUP BY 1)"""


@query("t21_trend_validation", _FIT_ECON + " SELECT indicator, CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction, round(r2, 4) < 0.1 AS weak FROM f")
def trend_validation(spark, d):
    t = ts.linear_trend(ts.indexed(econ(spark, d), "year", "value", ["indicator"]), ["indicator"])
    return t.select("indicator", "direction", (F.col("r2") < 0.1).alias("weak"))


@query("t23_seasonal_adjustment", "SELECT idx, value AS adjusted FROM v_series")
def seasonal_adjustment(spark, d):
    return series(spark, d).select("idx", (F.col("value") / 1.0).alias("adjusted"))


@query("t31_comprehensive_analysis", _FIT_ECON + ", s AS (SELECT indicator, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM v_econ GROUP BY 1) SELECT indicator, n, round(slope, 3) AS slope, mean, median FROM f JOIN s USING (indicator)")
def comprehensive_analysis(spark, d):
    e = econ(spark, d)
    t = ts.linear_trend(ts.indexed(e, "year", "value", ["indicator"]), ["indicator"], 3).select("indicator", "n", "slope")
    s = st.comprehensive(e, "value", ["indicator"]).select("indicator", "mean", "median")
    return t.join(s, "indicator")


# --- window shapes


@query("w01_latest_row", "SELECT key, direction, status FROM (SELECT *, row_number() OVER (PARTITION BY key, direction ORDER BY ts DESC, id DESC) AS i FROM v_updates) WHERE i = 1")
def latest_row(spark, d):
    return j.latest_per_key(updates(spark, d), ["key", "direction"], ["ts", "id"]).select("key", "direction", "status")


@query("w02_previous_value", "SELECT indicator, year, round(value - lag(value) OVER (PARTITION BY indicator ORDER BY year), 2) AS delta FROM v_econ")
def previous_value(spark, d):
    return econ(spark, d).select("indicator", "year", F.round(F.col("value") - F.lag("value").over(Window.partitionBy("indicator").orderBy("year")), 2).alias("delta"))


@query("w04_running_total", "SELECT date, CAST(sum(n) OVER (ORDER BY date) AS BIGINT) AS total FROM v_daily")
def running_total(spark, d):
    return ts.cumulative(daily(spark, d), "date", "n").select("date", F.col("cumulative").alias("total"))


@query("w05_trailing_rows", "SELECT indicator, year, CAST(floor(avg(value) OVER (PARTITION BY indicator ORDER BY year ROWS 2 PRECEDING)) AS BIGINT) AS average FROM v_econ")
def trailing_rows(spark, d):
    w = Window.partitionBy("indicator").orderBy("year").rowsBetween(-2, 0)
    return econ(spark, d).select("indicator", "year", F.floor(F.avg("value").over(w)).alias("average"))


@query("w06_trailing_days", "SELECT date, CAST(sum(n) OVER (ORDER BY date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n3 FROM v_daily")
def trailing_days(spark, d):
    rows = daily(spark, d)
    return rows.select("date", ts.rolling_days(rows, 3, F.sum("n")).alias("n3"))


@query("w07_z_beside_rows", "SELECT indicator, year, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 4) AS z FROM v_econ WINDOW w AS (PARTITION BY indicator)")
def z_beside_rows(spark, d):
    w = Window.partitionBy("indicator")
    return econ(spark, d).select("indicator", "year", F.round(F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)), 4).alias("z"))


@query("w08_seasonal_modulo", "SELECT idx, round(avg(value) OVER (PARTITION BY idx % 7), 4) AS seasonal FROM v_series")
def seasonal_modulo(spark, d):
    return series(spark, d).select("idx", F.round(F.avg("value").over(Window.partitionBy(F.col("idx") % 7)), 4).alias("seasonal"))


@query("w11_carry_forward", "SELECT id, last_value(CASE WHEN status = 'closed' THEN id END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS last_closed FROM v_updates")
def carry_forward(spark, d):
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return updates(spark, d).select("id", F.last(F.when(F.col("status") == "closed", F.col("id")), ignorenulls=True).over(w).alias("last_closed"))


@query("w12_nth_newest", "SELECT indicator, max(value) FILTER (WHERE i = 2) AS second, round(avg(value) FILTER (WHERE i BETWEEN 3 AND 5), 2) AS before FROM (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY year DESC) AS i FROM v_econ) GROUP BY 1")
def nth_newest(spark, d):
    r = econ(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("indicator").orderBy(F.desc("year"))))
    return r.groupBy("indicator").agg(F.max(F.when(F.col("i") == 2, F.col("value"))).alias("second"), F.round(F.avg(F.when(F.col("i").between(3, 5), F.col("value"))), 2).alias("before"))


@query("l03_route_page", "SELECT id, value FROM v_records ORDER BY value DESC, id LIMIT 100 OFFSET 200")
def route_page(spark, d):
    return pg.page_of(records(spark, d), [F.desc("value"), F.col("id")], 3, 9999, most=100).select("id", "value")


@query("l05_desc_nulls_last", "SELECT id, area FROM v_alerts ORDER BY area DESC NULLS LAST, id LIMIT 40")
def desc_nulls_last(spark, d):
    return alerts(spark, d).orderBy(pg.ordering("area", True), "id").select("id", "area").limit(40)


@query("l08_events_order", "SELECT place, min(date) AS start, count(*) AS n FROM v_records GROUP BY place ORDER BY start DESC, n DESC, place LIMIT 10")
def events_order(spark, d):
    g = records(spark, d).groupBy("place").agg(F.min("date").alias("start"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("start"), F.desc("n"), "place").limit(10)


# --- identity


@query("u07_global_dedupe", "SELECT count(*) AS n FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)")
def global_dedupe(spark, d):
    t = table(spark, d, "part").select("p_brand", "p_type", "p_size")
    return t.withColumn("sid", idn.content_id(t)).dropDuplicates(["sid"]).agg(F.count(F.lit(1)).alias("n"))


@query("u10_stable_id_parts", "SELECT s_suppkey AS id, substr(sha256(lower(trim(s_name)) || '|' || CAST(s_nationkey AS VARCHAR) || '|'), 1, 32) AS sid FROM supplier")
def stable_id_parts(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), idn.stable_id([F.col("s_name"), F.col("s_nationkey"), F.lit(None).cast("string")]).alias("sid"))


@query("u17_set_difference", "SELECT DISTINCT place FROM v_records WHERE event_type = 'view' AND place NOT IN (SELECT place FROM v_records WHERE value > 480)")
def set_difference(spark, d):
    r = records(spark, d)
    return r.filter("event_type = 'view'").select("place").distinct().exceptAll(r.filter("value > 480").select("place").distinct())


# --- text


#: Spellings and what they fold to.
SPELLINGS = [("أَحْمَد", "احمد"), ("إبراهيم", "ابراهيم"), ("آمنة", "امنه"), ("مصطفى", "مصطفي"), ("مدرســـة", "مدرسه"), ("ٱلقدس", "القدس"), ("هٰذا", "هذا"), ("حاجز", "حاجز")]


@query("x02_fold_arabic", f"SELECT c_custkey AS k, ([{', '.join(f"'{y}'" for _, y in SPELLINGS)}])[c_custkey % {len(SPELLINGS)} + 1] || ' ' || c_name AS folded FROM customer")
def fold_arabic(spark, d):
    written = F.element_at(F.array(*(F.lit(x) for x, _ in SPELLINGS)), (F.col("c_custkey") % len(SPELLINGS) + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), text.fold_arabic(F.concat_ws(" ", written, "c_name")).alias("folded"))


@query("x03_name_candidates", """
WITH n AS (SELECT DISTINCT lower(p_type) || ' camp' AS name FROM part) SELECT name, regexp_replace(name, ' (governorate|district|city|town|village|camp|refugee camp)$', '') AS second FROM n""")
def name_candidates(spark, d):
    n = table(spark, d, "part").select(F.concat(F.lower("p_type"), F.lit(" camp")).alias("name")).distinct()
    return n.select("name", F.element_at(text.name_candidates(F.col("name")), 2).alias("second"))


@query("x10_topic_labels", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[sc]e') AND regexp_matches(lower(text), '@') THEN 'contact,license' WHEN regexp_matches(lower(text), '@') THEN 'contact' WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'license' ELSE 'general' END AS topics FROM documents")
def topic_labels(spark, d):
    labels = text.topics(F.col("text"), {"contact": "@", "license": "licen[sc]e"})
    return table(spark, d, "documents").select("doc_id", F.array_join(labels, ",").alias("topics"))


@query("x19_csv_quoting", """SELECT doc_id, '"' || doc_id || '","' || replace(replace(coalesce(source, ''), chr(10), ' '), '"', '""') || '","' || replace(replace(coalesce(text, ''), chr(10), ' '), '"', '""') || '"' AS line FROM documents""")
def csv_quoting(spark, d):
    return table(spark, d, "documents").select("doc_id", text.csv_line(F.col("doc_id"), F.col("source"), F.col("text")).alias("line"))


@query("x20_simple_hash", """
SELECT n_name AS name, CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END AS h FROM (
 SELECT n_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, u: (h * 31 + u) % 4294967296) AS h FROM nation)""")
def simple_hash(spark, d):
    from ..functions.canonical import simple_hash as hashed

    rows = table(spark, d, "nation")
    # base 36 back to a number, as the other side has no base 36
    return rows.select(F.col("n_name").alias("name"), F.conv(hashed(F.col("n_name")), 36, 10).cast("bigint").alias("h"))


# --- dates


def _week(name: str, sql: str, expression):
    def run(spark, d):
        return orders(spark, d).groupBy(expression(F.col("date")).alias("week")).agg(F.count(F.lit(1)).alias("n"))

    query(name, f"SELECT {sql} AS week, count(*) AS n FROM v_orders GROUP BY 1")(run)


_pad = "lpad(CAST({} AS VARCHAR), 2, '0')"
_week("k02_week_calendar_year", "CAST(year(date) AS VARCHAR) || '-W' || " + _pad.format("weekofyear(date)"), dates.calendar_year_week)
_week("k03_week_iso", "CAST(isoyear(date) AS VARCHAR) || '-W' || " + _pad.format("weekofyear(date)"), dates.iso_week)
_week("k04_week_of_days", "CAST(year(date) AS VARCHAR) || '-W' || " + _pad.format("CAST(ceil(dayofyear(date) / 7.0) AS INTEGER)"), dates.day_of_year_week)
_week("k05_week_sunday", "CAST(year(date) AS VARCHAR) || '-W' || " + _pad.format("CAST(ceil((dayofyear(date) + dayofweek(date_trunc('year', date))) / 7.0) AS INTEGER)"), dates.sunday_week)


@query("k06_normalised_date", "SELECT kind, count(*) AS n, count(day) AS parsed, max(day) AS latest FROM (SELECT o_orderstatus AS kind, CASE o_orderstatus WHEN 'F' THEN make_date(year(o_orderdate), 1, 1) WHEN 'O' THEN CAST(o_orderdate AS DATE) END AS day FROM orders) GROUP BY 1")
def normalised_date(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate").cast("string")).when(F.col("o_orderstatus") == "O", F.col("o_orderdate").cast("string")).otherwise("pending")
    t = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), dates.normalised_date(raw).alias("day"))
    return t.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("day").alias("parsed"), F.max("day").alias("latest"))


@query("k08_classify_period", "SELECT CASE WHEN date < DATE '2024-01-15' THEN 'before' WHEN date = DATE '2024-01-15' THEN 'baseline' ELSE 'after' END AS side, count(*) AS n FROM v_records GROUP BY 1")
def classify_period(spark, d):
    return records(spark, d).groupBy(dates.against_baseline(F.col("date"), "2024-01-15").alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("k10_effective_status", """
WITH a AS (SELECT status, key, round(greatest(0, (epoch(TIMESTAMP '2024-01-30') - floor(epoch(ts))) / 3600.0::DOUBLE), 1) AS age FROM v_updates) SELECT CASE WHEN key = 'cp7' THEN 'closed' WHEN age > 6 THEN 'unknown' ELSE status END AS status, count(*) AS n FROM a GROUP BY 1""")
def effective_status(spark, d):
    age = dates.age_hours(F.col("ts"), F.lit("2024-01-30").cast("timestamp_ntz"))
    status = dates.effective_status(F.col("status"), age, F.when(F.col("key") == "cp7", "closed"))
    return updates(spark, d).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("k12_staleness_warning", "SELECT event_type, CASE WHEN event_type <> 'click' AND date_diff('day', max(date), DATE '2024-05-30') > 90 THEN 'data is ' || CAST(date_diff('day', max(date), DATE '2024-05-30') AS VARCHAR) || ' days old' END AS warning FROM v_records GROUP BY 1")
def staleness_warning(spark, d):
    g = records(spark, d).groupBy("event_type").agg(F.datediff(F.lit("2024-05-30").cast("date"), F.max("date")).alias("days"))
    return g.select("event_type", dates.staleness_warning(F.col("days"), F.col("event_type") == "click").alias("warning"))


# --- geometry


@query("g02_first_box", "SELECT CASE WHEN lat BETWEEN 31.2 AND 31.7 AND lon BETWEEN 34.2 AND 34.8 THEN 'one' WHEN lat BETWEEN 31.5 AND 32.2 AND lon BETWEEN 34.5 AND 35.2 THEN 'two' END AS box, count(*) AS n FROM v_records GROUP BY 1")
def first_box(spark, d):
    at = lambda *b: geo.in_box(F.col("lat"), F.col("lon"), *b)
    box = F.when(at(31.2, 34.2, 31.7, 34.8), "one").when(at(31.5, 34.5, 32.2, 35.2), "two")
    return records(spark, d).groupBy(box.alias("box")).agg(F.count(F.lit(1)).alias("n"))


@query("g03_nearest_city", "SELECT name, count(*) AS n FROM (SELECT id, arg_min(name, (lat - a) * (lat - a) + pow(cos(radians(31.9::DOUBLE)) * (lon - b), 2)) AS name FROM v_records, (VALUES ('far', 10.0::DOUBLE, 10.0::DOUBLE), ('near', 31.9::DOUBLE, 34.9::DOUBLE)) c(name, a, b) GROUP BY id) GROUP BY 1")
def nearest_city(spark, d):
    places = spark.createDataFrame([("far", 10.0, 10.0), ("near", 31.9, 34.9)], "name string, p_lat double, p_lon double")
    return j.nearest(records(spark, d), places, "id").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("g05_region_lookup", "SELECT CASE WHEN place IN ('P1', 'P2') THEN 'coast' WHEN place IN ('P3') THEN 'hills' ELSE 'other' END AS kind, count(*) AS n FROM v_records GROUP BY 1")
def region_lookup(spark, d):
    pairs = F.create_map(*map(F.lit, ("P1", "coast", "P2", "coast", "P3", "hills")))
    return records(spark, d).groupBy(F.coalesce(F.try_element_at(pairs, F.col("place")), F.lit("other")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("g06_in_ring", "SELECT count(*) FILTER (WHERE lat > 31.25 AND lat < 31.75 AND lon > 34.25 AND lon < 34.95) AS inside, count(*) AS total FROM v_records")
def in_ring(spark, d):
    corners = ((34.25, 31.25), (34.95, 31.25), (34.95, 31.75), (34.25, 31.75), (34.25, 31.25))
    ring = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in corners))
    return records(spark, d).agg(F.count_if(geo.in_ring(F.col("lat"), F.col("lon"), ring)).alias("inside"), F.count(F.lit(1)).alias("total"))


@query("g08_valid_coordinates", "SELECT count(*) FILTER (WHERE lat + fatalities * 20 BETWEEN -90 AND 90) AS valid FROM v_records")
def valid_coordinates(spark, d):
    return records(spark, d).agg(F.count_if(geo.valid_coordinates(F.col("lat") + F.col("fatalities") * 20, F.col("lon"))).alias("valid"))


@query("g10_avoid_box", "SELECT DISTINCT round(lon - 100 / (111320.0::DOUBLE * cos(radians(lat))), 6) AS west, round(lat + 100 / 111320.0::DOUBLE, 6) AS north FROM v_records")
def avoid_box(spark, d):
    ring = geo.box_ring(F.col("lat"), F.col("lon"), 100.0)
    return records(spark, d).select(F.round(F.element_at(ring, 1)[0], 6).alias("west"), F.round(F.element_at(ring, 3)[1], 6).alias("north")).distinct()


@query("g17_representative_point", "SELECT DISTINCT round((4 * lon + lon + 1) / 5, 4) AS x, round((4 * lat + 2) / 5 + 0.2::DOUBLE * lat - 0.4::DOUBLE, 4) AS y FROM v_records")
def representative_point(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    ring = F.array(*(F.array(a, b) for a, b in ((lon, lat), (lon + 1, lat), (lon, lat), (lon, lat), (lon, lat))))
    mean = geo.ring_mean(ring)
    return records(spark, d).select(F.round(mean[0], 4).alias("x"), F.round(mean[1], 4).alias("y")).distinct()


@query("g15_percent_change", "SELECT indicator, year, round(CASE WHEN p = 0 THEN CASE WHEN value > 0 THEN 100.0::DOUBLE ELSE 0 END ELSE (value - p) * 100 / p END, 2) AS pct FROM (SELECT *, lag(value) OVER (PARTITION BY indicator ORDER BY year) AS p FROM v_econ)")
def percent_change(spark, d):
    before = F.lag("value").over(Window.partitionBy("indicator").orderBy("year"))
    return econ(spark, d).select("indicator", "year", F.round(scores.percent_change(before, F.col("value")), 2).alias("pct"))


# --- arrays, maps, JSON


@query("m01_distinct_union", "SELECT place, array_to_string(list_sort(list_distinct(list(source) || ['src9'])), ',') AS sources FROM v_records GROUP BY place")
def distinct_union(spark, d):
    both = F.array_sort(F.array_distinct(F.concat(F.collect_set("source"), F.array(F.lit("src9")))))
    return records(spark, d).groupBy("place").agg(F.array_join(both, ",").alias("sources"))


@query("m02_unnest_json", "SELECT topic, count(*) AS n FROM (SELECT unnest([lang, source]) AS topic FROM documents) GROUP BY 1")
def unnest_json(spark, d):
    coded = table(spark, d, "documents").select(F.to_json(F.array("lang", "source")).alias("j"))
    return coded.select(F.explode(F.from_json("j", "array<string>")).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("m03_inverted_index", "SELECT source, count(*) AS clusters FROM (SELECT DISTINCT source, place FROM v_records) GROUP BY 1")
def inverted_index(spark, d):
    clusters = records(spark, d).groupBy("place").agg(F.collect_set("source").alias("members"))
    inverted = clusters.select(F.explode("members").alias("source"), "place").groupBy("source").agg(F.collect_list("place").alias("places"))
    return inverted.select("source", F.size("places").cast("bigint").alias("clusters"))


@query("m04_canonical_json", """
SELECT doc_id, '{"a":{"k":[1,{"x":"' || source || '","y":null}],"z":' || CAST(n_chars AS VARCHAR) || '},"lang":"' || coalesce(lang, '') || '"}' AS json FROM documents WHERE source IS NOT NULL""")
def canonical_json(spark, d):
    """Free JSON with its names in any order, two levels deep and in arrays."""
    from ..functions.canonical import canonical_text

    t = table(spark, d, "documents").filter("source is not null")
    free = F.format_string('{"lang": "%s", "a": {"z": %d, "k": [1, {"y": null, "x": "%s"}]}}', F.coalesce("lang", F.lit("")), F.col("n_chars"), F.col("source"))
    return t.select("doc_id", canonical_text(free).alias("json"))


@query("m06_source_names", "SELECT DISTINCT source AS name FROM v_records")
def source_names(spark, d):
    objects = F.array(F.struct(F.col("source").alias("name"), F.lit(None).cast("string").alias("organization")))
    names = F.transform(objects, lambda s: F.coalesce(s["name"], s["organization"]))
    return records(spark, d).select(F.explode(names).alias("name")).distinct()


@query("m07_extras", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def extras(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("extras"))
    return t.select(F.col("n_nationkey").alias("k"), F.get_json_object("extras", "$.n_name").alias("name"))


# --- stream operators in their batch form


@query("r01_offsets", "SELECT channel, max(id) AS last_id, count(*) FILTER (WHERE id > 5000) AS fresh FROM v_updates GROUP BY 1")
def offsets(spark, d):
    return updates(spark, d).groupBy("channel").agg(F.max("id").alias("last_id"), F.count_if(F.col("id") > 5000).alias("fresh"))


@query("r02_exact_dedupe", "SELECT count(*) AS n FROM (SELECT DISTINCT channel, id FROM v_updates)")
def exact_dedupe(spark, d):
    u = updates(spark, d)
    return u.unionAll(u).dropDuplicates(["channel", "id"]).agg(F.count(F.lit(1)).alias("n"))


@query("r04_classify", "SELECT CASE WHEN regexp_matches(status, 'closed|idf') THEN 'closure' WHEN status = 'open' THEN 'opening' END AS label, count(*) AS n FROM v_updates WHERE status <> 'inspection' GROUP BY 1")
def classified(spark, d):
    from ..operators.rules import Rule, classify

    found = classify(F.col("status"), [Rule("closure", "high", "closed|idf"), Rule("opening", "low", "open")])
    return updates(spark, d).filter("status <> 'inspection'").groupBy(found["label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


_SESSIONS = """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY type, area ORDER BY ts, id) AS p FROM v_alerts), s AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR floor(epoch(ts)) - floor(epoch(p)) > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY type, area ORDER BY ts, id) AS BIGINT) AS incident FROM l)"""


@query("r09_stale_incidents", _SESSIONS + " SELECT count(*) AS incidents, count(*) FILTER (WHERE last < TIMESTAMP '2024-01-29 20:00:00') AS resolved FROM (SELECT max(ts) AS last FROM s GROUP BY type, area, incident)")
def stale_incidents(spark, d):
    g = fa.sessions(alerts(spark, d), ["type", "area"], "ts").groupBy("type", "area", "incident").agg(F.max("ts").alias("last"))
    return g.agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("last") < F.lit("2024-01-29 20:00:00").cast("timestamp_ntz")).alias("resolved"))


@query("r10_narrative", _SESSIONS + """ SELECT type, area, incident, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, CAST(sum(k) AS BIGINT) AS total, CAST(floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60) AS BIGINT) AS minutes FROM s WHERE status = 'active' GROUP BY 1, 2, 3""")
def narrative(spark, d):
    s = fa.sessions(alerts(spark, d), ["type", "area"], "ts").filter("status = 'active'")
    sec = lambda c: F.unix_seconds(c.cast("timestamp"))
    return s.groupBy("type", "area", "incident").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.sum("k").alias("total"),
        F.floor((sec(F.max("ts")) - sec(F.min("ts"))) / 60).alias("minutes"),
    )


@query("r12_transitions", "SELECT key, count(*) FILTER (WHERE p IS DISTINCT FROM status) AS changes, count(*) AS n FROM (SELECT key, status, lag(status) OVER (PARTITION BY key ORDER BY ts, id) AS p FROM v_updates) GROUP BY 1")
def transitions(spark, d):
    before = F.lag("status").over(Window.partitionBy("key").orderBy("ts", "id"))
    u = updates(spark, d).withColumn("changed", ~before.eqNullSafe(F.col("status")))
    return u.groupBy("key").agg(F.count_if("changed").alias("changes"), F.count(F.lit(1)).alias("n"))


@query("r15_feedback", "SELECT source, type, count(*) AS n FROM v_alerts WHERE status = 'retracted' AND ts >= TIMESTAMP '2024-01-01' GROUP BY 1, 2 HAVING count(*) >= 5")
def feedback(spark, d):
    a = alerts(spark, d).filter((F.col("status") == "retracted") & (F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")))
    return a.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("r17_fan_out", "SELECT rule, count(*) AS n FROM v_alerts JOIN (VALUES ('x', 'click'), ('y', 'error')) r(rule, kind) ON type = kind GROUP BY rule")
def fan_out(spark, d):
    rules = spark.createDataFrame([("x", "click"), ("y", "error")], "rule string, kind string")
    return alerts(spark, d).join(rules, F.col("type") == F.col("kind")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("r18_rate_windows", "SELECT channel, date_trunc('minute', ts) AS start, count(*) AS n FROM v_updates GROUP BY 1, 2")
def rate_windows(spark, d):
    g = updates(spark, d).groupBy("channel", F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("channel", F.col("w.start").alias("start"), "n")


@query("s21_stream_sink", "SELECT severity, count(*) AS n FROM v_alerts GROUP BY 1")
def stream_sink(spark, d):
    from ..streaming import jobs
    from .streams import _as_stream, _folder

    folder = _folder(spark)
    out = f"{folder}/sink-{uuid.uuid4().hex}"
    rules = spark.createDataFrame([("all",)], "rule string")
    rows = alerts(spark, d).select("id", "ts", "severity")
    writer = jobs.fan_out(_as_stream(rows, folder, "alerts"), rules, F.lit(True), lambda batch, number: batch.write.mode("append").parquet(out))
    writer.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
