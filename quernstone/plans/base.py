"""Registry of queries and the projections of the driver's tables they run on.

Each projection exists twice: as a DataFrame and as a DuckDB common table
expression for the query's SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``{view}`` in its SQL stands for a projection."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            used, text = set(), sql
            for v in reversed(VIEWS):  # a view uses views above it only
                if v in text:
                    used.add(v)
                    text += VIEWS[v]
            ordered = [v for v in VIEWS if v in used]
            ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ordered)
            body = sql.strip()
            if ctes and body[:15].upper() == "WITH RECURSIVE ":
                body = f"WITH RECURSIVE {ctes},\n{body[15:]}"
            elif ctes and body[:5].upper() == "WITH ":
                body = f"WITH {ctes},\n{body[5:]}"
            elif ctes:
                body = f"WITH {ctes}\n{body}"
            ORACLE_SQL[name] = body
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VIEWS: dict[str, str] = {
    "v_events": """
  SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events""",
    "v_records": """
  SELECT event_id AS id, ts, CAST(ts AS DATE) AS date, k, event_type, value,
    CASE WHEN event_type IN ('error', 'purchase') THEN 'conflict' ELSE 'other' END AS category,
    'P' || CAST(user_id % 16 AS VARCHAR) AS place, 'G' || CAST(user_id % 20 AS VARCHAR) AS governorate,
    CASE user_id % 5 WHEN 0 THEN 'gaza' WHEN 1 THEN 'west_bank' WHEN 2 THEN 'east_jerusalem' WHEN 3 THEN 'unknown' END AS region,
    k % 7 AS fatalities, k % 11 AS injuries, k % 10 AS severity,
    CAST(31.2 AS DOUBLE) + (user_id % 100) * CAST(0.014 AS DOUBLE) AS lat,
    CAST(34.2 AS DOUBLE) + (user_id * 7 % 100) * CAST(0.014 AS DOUBLE) AS lon,
    'src' || CAST(user_id % 6 AS VARCHAR) AS source
  FROM v_events""",
    "v_alerts": """
  SELECT event_id AS id, ts, event_type AS type, 'ch' || CAST(user_id % 10 AS VARCHAR) AS source,
    CASE WHEN user_id % 15 <> 0 THEN 'A' || CAST(user_id % 15 AS VARCHAR) END AS area,
    CASE WHEN value >= 400 THEN 'critical' WHEN value >= 250 THEN 'high' WHEN value >= 100 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN k % 13 <> 0 THEN round(value / 500, 3) END AS confidence,
    CAST(0.5 AS DOUBLE) + (user_id % 10) * CAST(0.05 AS DOUBLE) AS reliability,
    CASE WHEN k % 20 = 0 THEN 'retracted' ELSE 'active' END AS status,
    CASE user_id % 3 WHEN 0 THEN 'Gaza Strip' WHEN 1 THEN 'West Bank' END AS admin1, k
  FROM v_events""",
    "v_updates": """
  SELECT event_id AS id, ts, 'cp' || CAST(user_id % 40 AS VARCHAR) AS key,
    CASE event_id % 3 WHEN 0 THEN 'inbound' WHEN 1 THEN 'outbound' ELSE 'both' END AS direction,
    CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'closed' WHEN 'signup' THEN 'congested' WHEN 'error' THEN 'idf' ELSE 'inspection' END AS status,
    CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'crowd' END AS source_type,
    'ch' || CAST(user_id % 10 AS VARCHAR) AS channel
  FROM v_events""",
    "v_orders": """
  SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value, o_orderstatus AS status,
    o_orderpriority AS priority, n_name AS nation, r_name AS region, c_custkey AS customer
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_econ": """
  SELECT nation AS indicator, CAST(year(date) AS INTEGER) AS year, round(sum(value), 2) AS value FROM v_orders GROUP BY 1, 2""",
    "v_daily": """
  SELECT date, count(*) AS n, CAST(sum(fatalities) AS BIGINT) AS fatalities FROM v_records GROUP BY date""",
    "v_series": """
  SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS idx, CAST(n AS DOUBLE) AS value FROM v_daily""",
    "v_entities": """
  SELECT c_custkey AS id, 'name ' || CAST(c_custkey % 700 AS VARCHAR) AS name, c_nationkey AS nation,
    CASE WHEN c_custkey % 4 <> 0 THEN CAST(18 + c_custkey % 70 AS INTEGER) END AS age,
    CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment,
    CASE c_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS sex, c_custkey % 97 AS created, 2020 + c_custkey % 3 AS year
  FROM customer""",
    "v_edges": """
  SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((3 * n_nationkey + 1) % 25 AS BIGINT) AS dst, CAST(5 + n_nationkey % 7 AS DOUBLE) AS cost FROM nation
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey + 7) % 25 AS BIGINT), CAST(3 + n_nationkey % 4 AS DOUBLE) FROM nation""",
}


def rounded(value, digits: int):
    """As SQL of doubles has it: scaled, rounded to a whole number, scaled back; ``F.round`` rounds the decimals shown."""
    scale = F.lit(10.0**digits)
    return F.round(value * scale, 0) / scale


def events(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))


def _tag(prefix: str, n: int):
    return F.concat(F.lit(prefix), (F.col("user_id") % n).cast("string"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Canonical records from ``events``."""
    u = F.col("user_id")
    region = F.when(u % 5 == 0, "gaza").when(u % 5 == 1, "west_bank").when(u % 5 == 2, "east_jerusalem").when(u % 5 == 3, "unknown")
    return events(spark, d).select(
        F.col("event_id").alias("id"), "ts", F.col("ts").cast("date").alias("date"), "k", "event_type", "value",
        F.when(F.col("event_type").isin("error", "purchase"), "conflict").otherwise("other").alias("category"),
        _tag("P", 16).alias("place"), _tag("G", 20).alias("governorate"), region.alias("region"),
        (F.col("k") % 7).alias("fatalities"), (F.col("k") % 11).alias("injuries"), (F.col("k") % 10).alias("severity"),
        (F.lit(31.2) + (u % 100) * F.lit(0.014)).alias("lat"), (F.lit(34.2) + (u * 7 % 100) * F.lit(0.014)).alias("lon"),
        _tag("src", 6).alias("source"),
    )


def alerts(spark: SparkSession, d: str) -> DataFrame:
    u, v = F.col("user_id"), F.col("value")
    return events(spark, d).select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("type"), _tag("ch", 10).alias("source"),
        F.when(u % 15 != 0, _tag("A", 15)).alias("area"),
        F.when(v >= 400, "critical").when(v >= 250, "high").when(v >= 100, "medium").otherwise("low").alias("severity"),
        F.when(F.col("k") % 13 != 0, rounded(v / 500, 3)).alias("confidence"),
        (F.lit(0.5) + (u % 10) * F.lit(0.05)).alias("reliability"),
        F.when(F.col("k") % 20 == 0, "retracted").otherwise("active").alias("status"),
        F.when(u % 3 == 0, "Gaza Strip").when(u % 3 == 1, "West Bank").alias("admin1"), "k",
    )


def updates(spark: SparkSession, d: str) -> DataFrame:
    e, t = F.col("event_id"), F.col("event_type")
    return events(spark, d).select(
        e.alias("id"), "ts", _tag("cp", 40).alias("key"),
        F.when(e % 3 == 0, "inbound").when(e % 3 == 1, "outbound").otherwise("both").alias("direction"),
        F.when(t == "click", "open").when(t == "view", "closed").when(t == "signup", "congested").when(t == "error", "idf").otherwise("inspection").alias("status"),
        F.when(F.col("user_id") % 10 == 0, "admin").otherwise("crowd").alias("source_type"), _tag("ch", 10).alias("channel"),
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their nation and region."""
    t = lambda n: table(spark, d, n)
    return (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("value"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
            F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_custkey").alias("customer"),
        )
    )


def econ(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy(F.col("nation").alias("indicator"), F.year("date").alias("year")).agg(F.round(F.sum("value"), 2).alias("value"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("fatalities").alias("fatalities"))


def series(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.timeseries import indexed

    return indexed(daily(spark, d), "date", "n")


def entities(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        c.alias("id"), F.concat(F.lit("name "), (c % 700).cast("string")).alias("name"), F.col("c_nationkey").alias("nation"),
        F.when(c % 4 != 0, (18 + c % 70).cast("int")).alias("age"), F.when(c % 5 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(c % 3 == 0, "female").when(c % 3 == 1, "male").alias("sex"), (c % 97).alias("created"), (2020 + c % 3).alias("year"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("bigint")
    nation = table(spark, d, "nation")
    return nation.select(n.alias("src"), ((3 * n + 1) % 25).alias("dst"), (5 + n % 7).cast("double").alias("cost")).unionAll(
        nation.select(n.alias("src"), ((n + 7) % 25).alias("dst"), (3 + n % 4).cast("double").alias("cost"))
    )
