"""Filters, pages, projections and scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, scores
from ..operators import filters as f
from ..operators import paging as p
from ..operators.rules import mapped
from ..sources.snapshots import as_of_snapshot, partition_index, pruned_snapshots
from .base import alerts, events, orders, query, records, table


@query("f01_unified_page", """
SELECT id, date, place, region, fatalities FROM v_records
WHERE (contains(lower(place), 'p1') OR contains(lower(coalesce(region, '')), 'p1') OR contains(lower(governorate), 'p1'))
  AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20' AND coalesce(fatalities, 0) >= 2
ORDER BY fatalities DESC NULLS LAST, id LIMIT 50 OFFSET 50""")
def unified_page(spark, d):
    rows = records(spark, d).filter(
        f.any_contains([F.col("place"), F.col("region"), F.col("governorate")], "p1")
        & f.date_range(F.col("ts"), "2024-01-03", "2024-01-20")
        & f.at_least(F.col("fatalities"), 2)
    )
    page = p.page_of(rows, [p.ordering("fatalities", True), F.col("id")], 2, 50)
    return p.select_fields(page, "id,date,place,region,fatalities,nonexistent")


@query("f02_region_filter", """
SELECT region, count(*) AS n FROM v_records
WHERE contains(lower(region), 'gaza') OR lower(governorate) = 'g3' GROUP BY region""")
def region_filter(spark, d):
    keep = f.contains_ci(F.col("region"), "GAZA") | f.equals_ci(F.col("governorate"), "g3")
    return records(spark, d).filter(keep).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("f03_date_range", """
SELECT count(*) AS n, min(ts) AS first, max(ts) AS last FROM v_records
WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'""")
def date_range(spark, d):
    return records(spark, d).filter(f.date_range(F.col("ts"), "2024-01-05", "2024-01-10")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


@query("f05_where_spec", """
SELECT severity, count(*) AS n FROM v_alerts
WHERE type IN ('click', 'error') AND contains(lower(area), 'a1') AND confidence >= 0.3 GROUP BY severity""")
def where_spec(spark, d):
    spec = {"types": ("type", "in"), "area": ("area", "like"), "conf": ("confidence", "min"), "st": ("status", "eq")}
    given = {"types": ["click", "error"], "area": "a1", "conf": 0.3, "st": None, "unknown": 1}
    return f.where(alerts(spark, d), spec, given).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("f06_alert_filter", """
SELECT id, confidence FROM v_alerts
WHERE type NOT IN ('view') AND contains(lower(area), 'a1') AND (confidence IS NULL OR confidence >= 0.5) AND severity = 'high'""")
def alert_filter(spark, d):
    return alerts(spark, d).filter(
        ~F.col("type").isin("view") & f.contains_ci(F.col("area"), "a1") & f.min_confidence(F.col("confidence"), 0.5) & (F.col("severity") == "high")
    ).select("id", "confidence")


@query("f07_export_filter", """
SELECT count(*) AS strict, (SELECT count(*) FROM v_alerts WHERE confidence IS NULL OR confidence >= 0.51) AS export
FROM v_alerts WHERE confidence >= 0.51""")
def export_filter(spark, d):
    c = F.col("confidence")
    return alerts(spark, d).agg(
        F.count_if(f.min_confidence(c, 0.51)).alias("strict"), F.count_if(f.min_confidence(c, 0.51, None)).alias("export")
    )


@query("f08_scope", """
SELECT 'default' AS scope, count(*) AS n FROM v_alerts WHERE type NOT IN ('view', 'signup')
UNION ALL SELECT 'regional', count(*) FROM v_alerts WHERE type IN ('view', 'signup')
UNION ALL SELECT 'all', count(*) FROM v_alerts""")
def scope(spark, d):
    scopes = F.array(*(F.struct(F.lit(s).alias("scope"), f.in_scope(F.col("type"), ["view", "signup"], s).alias("keep")) for s in ("default", "regional", "all")))
    return alerts(spark, d).select(F.inline(scopes)).groupBy("scope").agg(F.count_if("keep").alias("n"))


@query("f09_bbox", """
SELECT place, count(*) AS n FROM v_records WHERE lat BETWEEN 31.4 AND 31.9 AND lon BETWEEN 34.3 AND 35.1 GROUP BY place""")
def bbox(spark, d):
    return records(spark, d).filter(geo.in_box(F.col("lat"), F.col("lon"), 31.4, 34.3, 31.9, 35.1)).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query("f10_license_anti", """
WITH forbidden AS (SELECT 'src1' AS alias UNION ALL SELECT 'src4')
SELECT category, count(*) AS n FROM v_records WHERE lower(source) NOT IN (SELECT alias FROM forbidden) GROUP BY category""")
def license_anti(spark, d):
    registry = spark.createDataFrame([("SRC1", False), ("src2", True), ("Src4", False)], "alias string, commercial_use boolean")
    rows = records(spark, d).withColumn("sources", F.array("source"))
    return f.licensed(rows, "sources", registry, "id").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("f12_interval_overlap", """
WITH c AS (SELECT place, event_type, min(date) AS first, max(date) AS last, count(*) AS n FROM v_records GROUP BY 1, 2)
SELECT place, event_type, n FROM c WHERE last >= DATE '2024-01-10' AND first <= DATE '2024-01-12' AND n >= 2""")
def interval_overlap(spark, d):
    clusters = records(spark, d).groupBy("place", "event_type").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"))
    return clusters.filter(f.overlaps(F.col("first"), F.col("last"), "2024-01-10", "2024-01-12") & (F.col("n") >= 2)).select("place", "event_type", "n")


@query("f11_array_filter", """
WITH c AS (SELECT place, date, count(*) AS n, list(DISTINCT category) AS cats FROM v_records GROUP BY 1, 2)
SELECT place, date, n FROM c WHERE list_contains(cats, 'conflict') AND len(cats) >= 2 AND n >= 3""")
def array_filter(spark, d):
    c = records(spark, d).groupBy("place", "date").agg(F.count(F.lit(1)).alias("n"), F.collect_set("category").alias("cats"))
    return c.filter(F.array_contains("cats", "conflict") & (F.size("cats") >= 2) & (F.col("n") >= 3)).select("place", "date", "n")


@query("f13_multi_column_like", """
SELECT count(*) AS n FROM part WHERE contains(lower(p_name), 'a') AND (contains(lower(p_brand), '3') OR contains(lower(p_type), 'e'))""")
def multi_column_like(spark, d):
    t = table(spark, d, "part")
    return t.filter(f.contains_ci(F.col("p_name"), "a") & f.any_contains([F.col("p_brand"), F.col("p_type")], "3") | (f.contains_ci(F.col("p_name"), "a") & f.contains_ci(F.col("p_type"), "e"))).agg(F.count(F.lit(1)).alias("n"))


@query("f15_year_range", """
SELECT status, count(*) AS n FROM v_orders WHERE year(date) BETWEEN 1996 AND 1998 GROUP BY status""")
def year_range(spark, d):
    return orders(spark, d).filter(f.year_range(F.year("date"), 1996, 1998)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("f16_min_severity", """
SELECT area, count(*) AS n FROM v_alerts WHERE severity IN ('high', 'critical') GROUP BY area""")
def min_severity(spark, d):
    return alerts(spark, d).filter(f.min_severity(F.col("severity"), "high")).groupBy("area").agg(F.count(F.lit(1)).alias("n"))


@query("f18_ghosts", """
SELECT count(*) FILTER (WHERE fatalities = 0 AND injuries = 0 AND trim(coalesce(region, '')) = '') AS ghosts, count(*) AS total FROM v_records""")
def ghosts(spark, d):
    g = f.ghosts([F.col("fatalities"), F.col("injuries")], F.col("region"), F.lit(None).cast("string"))
    return records(spark, d).agg(F.count_if(g).alias("ghosts"), F.count(F.lit(1)).alias("total"))


@query("f19_keywords", """
SELECT lang, count(*) AS n FROM documents WHERE contains(lower(text), 'licensed') OR contains(lower(text), 'password') GROUP BY lang""")
def keywords(spark, d):
    from ..functions.text import contains_any

    return table(spark, d, "documents").filter(contains_any(F.col("text"), ["licensed", "password"])).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("f20_known_keys", """
SELECT o_orderpriority AS priority, count(*) AS n FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)) GROUP BY 1""")
def known_keys(spark, d):
    c = table(spark, d, "customer")
    first = c.agg(F.min("c_mktsegment").alias("s"))
    known = c.join(first, F.col("c_mktsegment") == F.col("s")).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(known, "o_custkey", "left_semi").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("p02_timeline_row", """
SELECT id, coalesce(lat, 0) AS lat, coalesce(lon, 0) AS lon, substr(place || ' ' || event_type || ' ' || coalesce(region, '?'), 1, 12) AS description, source AS attribution
FROM v_records""")
def timeline_row(spark, d):
    text = F.concat_ws(" ", "place", "event_type", F.coalesce("region", F.lit("?")))
    return records(spark, d).select(
        "id", F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"),
        F.substring(text, 1, 12).alias("description"), F.array_join(F.array("source"), ", ").alias("attribution"),
    )


@query("p04_canonical", """
SELECT id, CAST(fatalities AS DOUBLE) AS killed, CAST(0 AS DOUBLE) AS displaced, coalesce(region, 'none') AS region, '3.0.0' AS version FROM v_records""")
def canonical(spark, d):
    from ..schema import LOCATION, METRICS, SCHEMA_VERSION, with_defaults

    rows = records(spark, d)
    rows = with_defaults(rows, "metrics", METRICS, {"killed": F.col("fatalities"), "injured": F.col("injuries")})
    rows = with_defaults(rows, "location", LOCATION, {"name": F.col("place"), "region": F.col("region"), "lat": F.col("lat"), "lon": F.col("lon")})
    return rows.select(
        "id", "metrics.killed", "metrics.displaced", F.coalesce("location.region", F.lit("none")).alias("region"), F.lit(SCHEMA_VERSION).alias("version")
    )


@query("p06_enum_map", """
SELECT CASE event_type WHEN 'click' THEN 'airstrike' WHEN 'view' THEN 'raid' WHEN 'error' THEN 'armed clash' ELSE event_type END AS kind, count(*) AS n FROM v_records GROUP BY 1""")
def enum_map(spark, d):
    from ..functions.fixed import EVENT_TYPES

    t = F.col("event_type")
    reported = F.when(t == "click", " Aerial Bombardment").when(t == "view", "Incursion").when(t == "error", "CLASH").otherwise(t)
    kind = mapped(reported, EVENT_TYPES)
    return records(spark, d).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("p07_substring_case", """
SELECT CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'e') THEN 'e' ELSE 'other' END AS unit, count(*) AS n FROM part GROUP BY 1""")
def substring_case(spark, d):
    t = F.lower("p_type")
    unit = F.when(F.contains(t, F.lit("steel")), "steel").when(F.contains(t, F.lit("e")), "e").otherwise("other")
    return table(spark, d, "part").groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query("p10_column_rollup", """
SELECT l_returnflag AS flag, round(sum(coalesce(l_discount, 0) + coalesce(l_tax, 0)), 4) AS total FROM lineitem GROUP BY 1""")
def column_rollup(spark, d):
    from ..sources.normalise import column_sum

    t = table(spark, d, "lineitem")
    return t.groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.sum(column_sum(t, "_(discount|tax)$")), 4).alias("total"))


@query("g12_quality", """
SELECT id, round((c + s + a) / 3, 4) AS score, CASE WHEN (c + s + a) / 3 >= 0.8 THEN 'high' WHEN (c + s + a) / 3 >= 0.5 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT id,
  CAST(2 + 2 + 2 + CASE WHEN region IS NOT NULL THEN 1 ELSE 0 END + 1 AS DOUBLE) / 8 AS c,
  CAST(1 AS DOUBLE) - CASE WHEN date > DATE '2024-01-20' THEN CAST(0.2 AS DOUBLE) ELSE 0 END - CASE WHEN lat + CASE WHEN source = 'src5' THEN 3 ELSE 0 END > 34 THEN CAST(0.3 AS DOUBLE) ELSE 0 END - CASE WHEN lon < 33 OR lon > 36.5 THEN CAST(0.3 AS DOUBLE) ELSE 0 END AS s,
  CASE WHEN source = 'src0' THEN CAST(1 AS DOUBLE) WHEN source = 'src1' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS a FROM v_records)""")
def quality(spark, d):
    c = scores.completeness([F.col("id"), F.col("date"), F.col("category")], [F.col("region"), F.col("place")])
    s = scores.record_consistency(F.col("date"), F.col("lat") + F.when(F.col("source") == "src5", 3.0).otherwise(0.0), F.col("lon"), F.lit("2024-01-20").cast("date"))
    a = scores.source_accuracy(F.when(F.col("source") == "src0", "UN OCHA").when(F.col("source") == "src1", "Amnesty").otherwise("press"))
    score = (c + s + a) / 3
    return records(spark, d).select("id", F.round(score, 4).alias("score"), scores.quality_band(score).alias("band"))


@query("l01_nulls_last", """
SELECT id, confidence FROM v_alerts ORDER BY confidence DESC NULLS LAST, id LIMIT 25""")
def nulls_last(spark, d):
    return alerts(spark, d).select("id", "confidence").orderBy(p.ordering("confidence", True), "id").limit(25)


@query("l02_page_count", """
SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM v_alerts WHERE severity = 'high'""")
def page_count(spark, d):
    return p.page_count(alerts(spark, d).filter("severity = 'high'"), 50)


@query("l04_coalesced_order", """
SELECT id, coalesce(area, source) AS at FROM v_alerts ORDER BY coalesce(area, source) DESC, id LIMIT 30""")
def coalesced_order(spark, d):
    at = F.coalesce("area", "source")
    return alerts(spark, d).select("id", at.alias("at")).orderBy(F.desc("at"), "id").limit(30)


@query("l07_severity_then_newest", """
SELECT id, severity FROM v_alerts ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, ts DESC, id LIMIT 40""")
def severity_then_newest(spark, d):
    from ..schema import severity_rank

    return alerts(spark, d).orderBy(severity_rank(F.col("severity")).desc(), F.desc("ts"), "id").select("id", "severity").limit(40)


@query("l09_merged_timeline", """
WITH m AS (SELECT 'record' AS origin, id, ts FROM v_records WHERE category = 'conflict' UNION ALL SELECT 'alert', id, ts FROM v_alerts WHERE severity = 'critical')
SELECT *, (SELECT count(*) FROM m) > 60 AS truncated FROM m ORDER BY ts DESC, origin, id LIMIT 60""")
def merged_timeline(spark, d):
    a = records(spark, d).filter("category = 'conflict'").select(F.lit("record").alias("origin"), "id", "ts")
    b = alerts(spark, d).filter("severity = 'critical'").select(F.lit("alert").alias("origin"), "id", "ts")
    return p.merged_top([a, b], [F.desc("ts"), F.col("origin"), F.col("id")], 60)


@query("l10_retention", """
SELECT source, count(*) AS kept, min(ts) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) AS n FROM v_alerts) WHERE n <= 50 GROUP BY source""")
def retention(spark, d):
    return p.newest(alerts(spark, d), 50, [F.desc("ts"), F.desc("id")], ["source"]).groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.min("ts").alias("oldest"))


@query("l11_capped_list", """
SELECT area, array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') AS ids FROM v_alerts WHERE severity = 'critical' GROUP BY area""")
def capped_list(spark, d):
    ids = p.newest(alerts(spark, d).filter("severity = 'critical'"), 5, [F.col("id")], ["area"])
    return ids.groupBy("area").agg(F.array_join(p.capped_list(F.col("id"), 5).cast("array<string>"), ",").alias("ids"))


@query("s03_snapshot_asof", """
SELECT count(*) AS n, max(date) AS snapshot FROM v_records WHERE date = (SELECT max(date) FROM v_records WHERE date <= DATE '2024-01-15')""")
def snapshot_asof(spark, d):
    return as_of_snapshot(records(spark, d), "date", "2024-01-15").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("snapshot"))


@query("s15_partition_index", """
SELECT CAST(year(date) AS VARCHAR) || '-Q' || CAST(quarter(date) AS VARCHAR) AS quarter, count(*) AS n, min(date) AS first, max(date) AS last FROM v_orders GROUP BY 1""")
def index(spark, d):
    return partition_index(orders(spark, d), "date")


@query("s16_pruned_snapshots", """
SELECT DISTINCT date AS snapshot FROM v_records WHERE date NOT IN (SELECT DISTINCT date FROM v_records ORDER BY date DESC LIMIT 10)""")
def pruned(spark, d):
    return pruned_snapshots(records(spark, d), "date", 10)


@query("s18_geojson", """
SELECT id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || '0' || ']}}' AS shape FROM v_records""")
def geojson(spark, d):
    text = geo.feature(F.lit(0.0), F.lit(0.0), id=F.col("id"))
    return records(spark, d).filter("lat is not null").select("id", F.when(F.get_json_object(text, "$.geometry.type") == "Point", '{"type":"Feature","geometry":{"type":"Point","coordinates":[0]}}').alias("shape"))


@query("s19_ordered_export", "SELECT id, ts, type FROM v_alerts WHERE severity = 'high'")
def ordered_export(spark, d):
    return alerts(spark, d).filter("severity = 'high'").select("id", "ts", "type").orderBy("ts", "id")


@query("s20_manifest", """
SELECT category, count(*) AS n, min(date) AS first, max(date) AS last, count(DISTINCT source) AS sources FROM v_records GROUP BY category""")
def manifest(spark, d):
    return records(spark, d).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("source").alias("sources")
    )


@query("m05_map_of_counts", """
SELECT region, string_agg(event_type || ':' || CAST(n AS VARCHAR), ',' ORDER BY event_type) AS counts
FROM (SELECT region, event_type, count(*) AS n FROM v_records GROUP BY 1, 2) GROUP BY region""")
def map_of_counts(spark, d):
    counted = records(spark, d).groupBy("region", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["event_type"], F.lit(":"), e["n"].cast("string"))), ",")
    return counted.groupBy("region").agg(text.alias("counts"))


@query("m08_derived_counts", """
SELECT id, greatest(0, fatalities - CAST(floor(fatalities / 3) AS INTEGER) - CAST(floor(injuries / 4) AS INTEGER)) AS men FROM v_records""")
def derived_counts(spark, d):
    c, w = F.floor(F.col("fatalities") / 3).cast("int"), F.floor(F.col("injuries") / 4).cast("int")
    return records(spark, d).select("id", F.greatest(F.lit(0), F.col("fatalities") - c - w).alias("men"))


@query("w10_top_per_group", """
SELECT region, id, value FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY value DESC, id) AS n FROM v_records) WHERE n <= 3""")
def top_per_group(spark, d):
    return p.newest(records(spark, d), 3, [F.desc("value"), F.col("id")], ["region"]).select("region", "id", "value")


@query("w09_share_of_group", """
SELECT key, status, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY key) AS DOUBLE), 4) AS share FROM v_updates GROUP BY key, status""")
def share_of_group(spark, d):
    from .base import updates

    counted = updates(spark, d).groupBy("key", "status").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("key"))
    return counted.select("key", "status", F.round(share, 4).alias("share"))


@query("w13_streaks", """
WITH s AS (SELECT source, ts, id, (value < 250) AS bad,
  row_number() OVER (PARTITION BY source ORDER BY ts, id) - row_number() OVER (PARTITION BY source, value < 250 ORDER BY ts, id) AS g FROM v_records)
SELECT source, max(n) AS longest FROM (SELECT source, g, count(*) AS n FROM s WHERE bad GROUP BY source, g) GROUP BY source""")
def streaks(spark, d):
    rows = records(spark, d).withColumn("bad", F.col("value") < 250)
    order = lambda *k: Window.partitionBy(*k).orderBy("ts", "id")
    islands = rows.withColumn("g", F.row_number().over(order("source")) - F.row_number().over(order("source", "bad")))
    return islands.filter("bad").groupBy("source", "g").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("longest"))
