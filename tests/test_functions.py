"""Literal cases of expressions and operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quernstone.functions import dates, geo, scores, text
from quernstone.operators import aggregates, facts, filters, identity, paging, rules, statistics, timeseries
from quernstone.schema import METRICS, severity_rank, with_defaults


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column):
    return one(spark.range(1).select(column.alias("v"))).v


@pytest.mark.parametrize(
    "day, iso, calendar, by_day",
    [
        ("2021-01-01", "2020-W53", "2021-W53", "2021-W01"),
        ("2020-12-31", "2020-W53", "2020-W53", "2020-W53"),
        ("2024-01-01", "2024-W01", "2024-W01", "2024-W01"),
    ],
)
def test_week_keys(spark, day, iso, calendar, by_day):
    d = F.lit(day).cast("date")
    assert value(spark, dates.iso_week(d)) == iso
    assert value(spark, dates.calendar_year_week(d)) == calendar
    assert value(spark, dates.day_of_year_week(d)) == by_day


def test_dates(spark):
    assert value(spark, dates.normalised_date(F.lit("1948"))) == dt.date(1948, 1, 1)
    assert value(spark, dates.normalised_date(F.lit("2023-10-07T10:00:00"))) == dt.date(2023, 10, 7)
    assert value(spark, dates.normalised_date(F.lit("soon"))) is None
    assert value(spark, dates.excel_date(F.lit(45206))) == dt.date(2023, 10, 7)
    assert value(spark, dates.month_number(F.lit("October"))) == 10
    assert value(spark, dates.month_number(F.lit("x"))) is None
    assert value(spark, dates.period_key(F.lit("2024-05-09").cast("date"), "quarter")) == "2024-Q2"


@pytest.mark.parametrize("age, band, status", [(0.5, "live", "open"), (6.0, "recent", "open"), (6.1, "stale", "unknown"), (None, "none", "unknown")])
def test_freshness(spark, age, band, status):
    a = F.lit(age).cast("double")
    assert value(spark, dates.freshness_band(a)) == band
    assert value(spark, dates.effective_status(F.lit("open"), a, F.lit(None).cast("string"))) == status
    assert value(spark, dates.effective_status(F.lit("open"), a, F.lit("closed"))) == "closed"


def test_geometry(spark):
    assert value(spark, F.round(geo.haversine_km(F.lit(31.5), F.lit(34.45), F.lit(31.5), F.lit(34.45)), 6)) == 0.0
    ring = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))))
    assert value(spark, geo.in_ring(F.lit(2.0), F.lit(2.0), ring)) is True
    assert value(spark, geo.in_ring(F.lit(5.0), F.lit(2.0), ring)) is False
    hole = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))))
    assert value(spark, geo.in_polygon(F.lit(2.0), F.lit(2.0), F.array(ring, hole))) is False
    assert value(spark, geo.in_polygon(F.lit(0.5), F.lit(0.5), F.array(ring, hole))) is True
    assert value(spark, geo.in_box(F.lit(None).cast("double"), F.lit(1.0), 0, 0, 2, 2)) is False
    points = one(spark.createDataFrame([("_izlhA~rlgdF_{geC~ywl@",)], "p string").select(geo.decoded_polyline("p").alias("v"))).v
    assert points == [[38.5, -120.2], [40.7, -120.95]]


def test_scores(spark):
    assert value(spark, scores.percent_change(F.lit(0.0), F.lit(3.0))) == 100.0
    assert value(spark, scores.percent_change(F.lit(0.0), F.lit(0.0))) == 0.0
    assert value(spark, scores.percent_change(F.lit(4.0), F.lit(3.0))) == -25.0
    assert value(spark, scores.severity_index(F.lit(100), F.lit(200), F.lit(1.0))) == 10.0
    assert value(spark, scores.trust(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.35
    assert value(spark, severity_rank(F.lit("critical"))) == 3
    assert value(spark, severity_rank(F.lit("none"))) is None


def test_text(spark):
    html = F.lit("<style>p{}</style><p>Hello&amp;  <b>you</b></p><script>x()</script>")
    assert value(spark, text.decode_entities(text.strip_markup(html))) == "Hello& you"
    assert value(spark, text.snippet(F.lit("alpha beta gamma"), 12)) == "alpha beta..."
    assert value(spark, text.numbers_before(F.lit("1,200 killed and 30 injured"), "killed|injured")) == [1200, 30]
    assert value(spark, text.plausible_count(F.lit("٣٠ injured, 900 injured"), "injured")) == 30
    assert value(spark, text.topics(F.lit("x"), {"a": "y"})) == ["general"]
    assert value(spark, text.jaccard(F.array(), F.array())) == 0.0
    named = spark.createDataFrame([("Ál-Khalīl (Hebron)",), (None,)], "n string").select(text.normalised_name(F.col("n")).alias("v")).collect()
    assert [r.v for r in named] == ["al khalil hebron", None]


def test_filters(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5), (3, 0.6)], "id int, c double")
    ids = lambda f: sorted(r.id for r in df.filter(f).collect())
    assert ids(filters.min_confidence(F.col("c"), 0.5)) == [1, 2, 3]
    assert ids(filters.min_confidence(F.col("c"), 0.51)) == [3]
    assert ids(filters.min_confidence(F.col("c"), 0.51, None)) == [1, 3]
    late = spark.createDataFrame([("2024-01-10 00:00:00",), ("2024-01-10 08:00:00",)], "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert late.filter(filters.date_range(F.col("t"), None, "2024-01-10")).count() == 1
    assert filters.where(df, {"c": ("c", "min")}, {"c": 0.55, "nope": 1}).count() == 1


def test_paging(spark):
    df = spark.createDataFrame([(i, None if i == 3 else i) for i in range(5)], "id int, v int")
    assert paging.clamp_page(0, 9999) == (1, 500)
    assert [r.id for r in df.orderBy(paging.ordering("v")).collect()][-1] == 3
    assert [r.id for r in df.orderBy(paging.ordering("v", True)).collect()][-1] == 3
    assert paging.select_fields(df, "v,zzz").columns == ["v"]


def test_statistics_edges(spark):
    empty = spark.createDataFrame([], "v double")
    row = one(statistics.comprehensive(empty, "v"))
    assert (row["count"], row["mean"], row["median"], row["mode"], row["stddev"]) == (0, 0.0, 0.0, None, 0.0)
    nine = spark.createDataFrame([(float(i),) for i in range(1, 10)], "v double")
    q = one(statistics.hinges(nine, "v"))
    assert (q.q1, q.q2, q.q3) == (2.5, 5.0, 7.5)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert one(flat.agg(statistics.correlation(F.col("x"), F.col("y")).alias("r"))).r == 0.0
    assert statistics.z_outliers(flat, "x").count() == 0
    single = one(statistics.hinges(spark.createDataFrame([(4.0,)], "v double"), "v"))
    assert (single.q1, single.q2, single.q3) == (0.0, 4.0, 0.0)


def test_time_series_edges(spark):
    series = lambda vs: spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "idx bigint, value double")
    t = one(timeseries.linear_trend(series([5.0])))
    assert (t.slope, t.direction) == (0.0, "stable")
    assert one(timeseries.linear_trend(series([2.0, 2.0, 2.0]))).r2 == 0.0
    assert [round(r.ema, 4) for r in timeseries.ema(series([1.0, 2.0, 3.0])).orderBy("idx").collect()] == [1.0, 1.3, 1.81]
    assert [r.ema for r in timeseries.ema(series([7.0])).collect()] == [7.0]
    filled = timeseries.fill_missing(series([1.0, None, None, 5.0])).orderBy("idx").collect()
    assert [r.filled for r in filled] == [1.0, 3.0, 4.0, 5.0]
    assert timeseries.change_points(series([1.0, 1.0, 1.0])).count() == 0
    assert one(timeseries.growth(series([0.0, 2.0, 4.0, 0.0]))).growth_pct == 100.0


def test_cumulative_series(spark):
    rows = [("2024-01-01", "a", 5), ("2024-01-01", "a", 7), ("2024-01-01", "b", 1), ("2024-01-03", "a", 6), ("2024-01-03", "b", 9)]
    df = spark.createDataFrame(rows, "d string, region string, k int").withColumn("date", F.col("d").cast("date"))
    got = aggregates.cumulative_series(df, "region", dates.period_key(F.col("date"), "day"), "k").orderBy("period").collect()
    assert [(r.level, r.increment) for r in got] == [(8, 8), (15, 7)]


def reports(spark, rows):
    now = dt.datetime(2024, 1, 1, 12)
    data = [("k", s, t, now - dt.timedelta(minutes=a)) for s, t, a in rows]
    df = spark.createDataFrame(data, "key string, status string, source_type string, ts timestamp_ntz")
    return facts.consensus(df, ["key"], F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).collect()


def test_consensus(spark):
    got = reports(spark, [("open", "crowd", 0)])[0]
    assert (got.status, got.confidence, got.ratio) == ("open", "medium", 1.0)
    got = reports(spark, [("closed", "admin", 0), ("closed", "crowd", 1), ("closed", "crowd", 1)])[0]
    assert (got.status, got.confidence) == ("closed", "high")
    got = reports(spark, [("open", "crowd", 1)] * 5 + [("closed", "crowd", 0)])[0]
    assert (got.status, got.confidence) == ("open", "medium") and got.ratio >= 0.75
    assert reports(spark, [("open", "crowd", 0)] * 3 + [("closed", "admin", 0)])[0].status == "closed"
    assert reports(spark, [("open", "crowd", 120), ("closed", "crowd", 0)])[0].status == "closed"
    assert reports(spark, [("open", "crowd", 0)] * 3 + [("closed", "crowd", 0)] * 3)[0].ratio <= 0.5
    assert reports(spark, [("open", "crowd", 400)]) == []


def test_rules(spark):
    found = rules.classify(F.lit("Gate closed by army"), [rules.Rule("closure", "high", "closed", "re-?opened"), rules.Rule("any", "low", ".")], "newsletter")
    assert value(spark, found["label"]) == "closure"
    assert value(spark, rules.classify(F.lit("newsletter: closed"), [rules.Rule("c", "high", "closed")], "newsletter")) is None
    messages = spark.createDataFrame([(1, "North Gate: closed inbound\nSouth gate: open\nhello")], "id int, t string")
    got = rules.parse_statuses(messages, "id", "t", {"closed": "closed", "open": "open"}, {"inbound": "inbound"}).collect()
    assert sorted((r.name, r.status, r.direction) for r in got) == [("north_gate", "closed", "inbound"), ("south_gate", "open", "both")]
    docs = spark.createDataFrame([(1, "apache license here"), (2, "apach licence"), (3, "nothing")], "id int, t string")
    assert [r.id for r in rules.search(docs, "id", "t", "apache license").collect()] == [1, 2]


def test_identity(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    rows = lambda df: sorted((r.k, r.v) for r in df.select("k", "v").collect())
    assert rows(identity.upsert(a, b, ["k"])) == [(1, "x"), (2, "z"), (3, "w")]
    assert rows(identity.insert_new(a, b, ["k"])) == [(1, "x"), (2, "y"), (3, "w")]
    assert rows(identity.last_wins([a, b], ["k"], "v")) == [(1, "x"), (2, "z"), (3, "w")]
    same = spark.createDataFrame([("A ", None), ("a", "")], "x string, y string").select(identity.stable_id([F.col("x"), F.col("y")]).alias("i"))
    assert same.distinct().count() == 1
    assert value(spark, identity.entity_key(F.lit(" "), F.lit(3), F.lit(2024))) is None


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 1.0), (1, 3, None), (3, 4, 1.0)], "src bigint, dst bigint, cost double")
    got = {r.node: r.cost for r in facts.shortest_paths(edges, 0).collect()}
    assert got == {0: 0.0, 2: 1.0, 1: 2.0}


def test_defaults(spark):
    row = one(with_defaults(spark.createDataFrame([(None,)], "k int"), "metrics", METRICS, {"killed": F.col("k")}))
    assert row.metrics.killed == 0.0 and row.metrics.unit is None
    with pytest.raises(ValueError):
        with_defaults(spark.range(1), "metrics", METRICS, {"other": F.lit(1)})
