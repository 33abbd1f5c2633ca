"""Forms made for large inputs against plain Python over small ones."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone import scratch
from quernstone.operators import facts, identity, joins, statistics, timeseries


def km_apart(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("lat, lon, km", [(31.5, 34.5, 1.0), (75.0, 20.0, 1.0), (80.0, 179.999, 3.0), (89.99, 0.0, 2.0), (-89.999, -180.0, 5.0), (0.0, 180.0, 2.0)])
def test_grid_join_anywhere(spark, lat, lon, km):
    rnd = random.Random(lat)
    spread = 4 * km / 111
    wide = min(180.0, spread / max(0.001, math.cos(math.radians(lat))))

    def some(n):
        at = [(max(-90.0, min(90.0, lat + rnd.uniform(-spread, spread))), (lon + rnd.uniform(-wide, wide) + 180) % 360 - 180) for _ in range(n)]
        return [(i, *p) for i, p in enumerate(at + at[:5])]

    left, right = some(120), some(150)
    kind = "id int, lat double, lon double"
    got = joins.grid_join(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), km)
    want = {(i, k) for i, a, b in left for k, c, d in right if km_apart(a, b, c, d) <= km}
    assert {(r.id, r.r_id) for r in got.collect()} == want and len(want) > 5
    assert got.count() == len(want)


@pytest.mark.parametrize("few", [5, 50])
def test_nearest_in_chunks(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "CHUNK", 7)
    monkeypatch.setattr(joins, "FEW", few)
    rnd = random.Random(2)
    points = [(i, rnd.uniform(30, 33), rnd.uniform(34, 36)) for i in range(60)]
    places = [(f"p{i}", rnd.uniform(30, 33), rnd.uniform(34, 36)) for i in range(40)] + [("twin", 31.0, 35.0), ("a twin", 31.0, 35.0)]
    df, small = spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(places, "name string, p_lat double, p_lon double")
    got = {r.id: r.name for r in joins.nearest(df, small, "id").collect()}
    assert got == {i: min((km_apart(a, b, c, d), n) for n, c, d in places)[1] for i, a, b in points}
    assert joins.nearest(df, small.limit(0), "id").count() == 0
    monkeypatch.setattr(joins, "MOST_CHUNKS", 2)
    monkeypatch.setattr(joins, "FEW", 5)
    with pytest.raises(ValueError):
        joins.nearest(df, small, "id")


def test_polygons_over_cells(spark):
    box = lambda a, b, c, d: [[[b, a], [d, a], [d, c], [b, c], [b, a]]]
    shapes = [(0, "small", 0.2, 0.2, 0.4, 0.4), (1, "wide", -3.5, -2.5, 4.5, 9.5)]
    polygons = spark.createDataFrame([(*s, box(*s[2:])) for s in shapes], "ord int, polygon string, min_lat double, min_lon double, max_lat double, max_lon double, rings array<array<array<double>>>")
    rnd = random.Random(3)
    points = [(i, rnd.uniform(-6, 6), rnd.uniform(-6, 12)) for i in range(300)] + [(300, 0.3, 0.3), (301, None, 1.0)]
    got = {r.id: r.polygon for r in joins.point_in_polygon(spark.createDataFrame(points, "id int, lat double, lon double"), polygons, "id").collect()}
    inside = lambda s, a, b: a is not None and s[2] < a < s[4] and s[3] < b < s[5]
    assert got == {i: next(s[1] for s in shapes if inside(s, a, b)) for i, a, b in points if any(inside(s, a, b) for s in shapes)}
    assert got[300] == "small"


def test_sibling_counts(spark):
    rows = [(1, "a"), (2, "a"), (3, "a"), (1, "b"), (4, "b"), (5, "c"), (1, "a")]
    df = spark.createDataFrame(rows, "record int, cluster string")
    pairs = Counter(r.record for r in joins.siblings(df.distinct()).collect())
    assert {r.record: r.n for r in joins.sibling_counts(df).collect()} == dict(pairs)


def halves(values):
    v = sorted(values)
    med = lambda x: float(np.median(x)) if x else 0.0
    return med(v[: len(v) // 2]), med(v), med(v[len(v) - len(v) // 2 :])


@pytest.mark.parametrize("stretches", [1, 3, 1024])
def test_ranks_from_counts(spark, monkeypatch, stretches):
    monkeypatch.setattr(statistics, "STRETCHES", stretches)
    rnd = random.Random(4)
    groups = {
        "even": [rnd.uniform(-5, 5) for _ in range(200)], "odd": [float(rnd.randrange(9)) for _ in range(101)], "one": [7.0],
        "two": [1.0, 2.0], "three": [3.0, 1.0, 2.0], "flat": [2.5] * 30, "far": [1.0] * 50 + [1e12, -1e9] + [1.0 + i * 1e-6 for i in range(20)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", float("nan")), ("odd", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    q = {r.g: (r.q1, r.q2, r.q3) for r in statistics.hinges(df, "v", ["g"]).collect()}
    assert q == {g: pytest.approx(halves(vs)) for g, vs in groups.items()}
    names = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.973, "e": 1.0}
    got = {r.g: [r[n] for n in names] for r in statistics.percentiles(df, "v", names, ["g"]).collect()}
    assert got == {g: pytest.approx([float(np.quantile(vs, p)) for p in names.values()]) for g, vs in groups.items()}
    least = {g: min(v for v, n in Counter(vs).items() if n == max(Counter(vs).values())) for g, vs in groups.items()}
    assert {r.g: r.mode for r in statistics.modes(df, "v", ["g"]).collect()} == least
    whole = [v for vs in groups.values() for v in vs]
    one = statistics.hinges(df, "v").first()
    assert (one.q1, one.q2, one.q3) == pytest.approx(halves(whole))
    none = df.limit(0)
    assert tuple(statistics.hinges(none, "v").first()) == (0.0, 0.0, 0.0) and statistics.hinges(none, "v", ["g"]).count() == 0


@pytest.mark.parametrize("alpha", [0.3, 0.9, 1.0, 0.02])
def test_ema_over_blocks(spark, alpha):
    rnd = random.Random(5)
    rows = [(s, i, rnd.uniform(-100, 100)) for s, n in (("a", 5000), ("b", 1), ("c", 117), ("d", 118)) for i in range(n)]
    want, last = {}, None
    for s, i, v in rows:
        last = v if i == 0 else alpha * v + (1 - alpha) * last
        want[s, i] = last
    got = timeseries.ema(spark.createDataFrame(rows, "s string, idx bigint, value double").repartition(3), alpha, ["s"]).collect()
    assert {(r.s, r.idx): r.ema for r in got} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_trend_of_large_values_with_little_spread(spark):
    rows = [(i, 1e9 + 0.001 * i) for i in range(1000)]
    t = timeseries.linear_trend(spark.createDataFrame(rows, "idx bigint, value double"), digits=6).first()
    assert (t.slope, t.r2) == (pytest.approx(0.001, abs=1e-6), pytest.approx(1.0, abs=1e-4))


def test_routes_of_any_length(spark):
    edges = [(i, i + 1, 1.0) for i in range(100)] + [(0, 50, 60.0), (3, 200, None)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, cost double")
    paths = facts.shortest_paths(df, 0).cache()
    assert {r.node: r.cost for r in paths.collect()} == {i: float(i) for i in range(101)}
    assert facts.path_to(paths, 7) == list(range(8)) and facts.path_to(paths, 200) == []
    with pytest.raises(ValueError):
        facts.shortest_paths(spark.createDataFrame([(0, 1, -1.0)], "src bigint, dst bigint, cost double"), 0)


def test_near_duplicates_equal_all_pairs(spark):
    rnd = random.Random(6)
    words = ["red", "gate", "north", "closed", "open", "army", "road", "blocked", "now", "again"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 6]))), rnd.randrange(0, 9000)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, body string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.id, r.other): r.similarity for r in identity.near_duplicates(df, "id", "body", "ts", most=7).collect()}
    want = {}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    for n, (i, text, s) in enumerate(order):
        for k, other, t in [r for r in order[:n] if s - r[2] <= 1800][-7:]:
            a, b = set(text.split()), set(other.split())
            if len(text) >= 15 and len(other) >= 15 and round(len(a & b) / len(a | b), 4) > 0.6:
                want[i, k] = round(len(a & b) / len(a | b), 4)
    assert got == want and len(want) > 20


def test_greedy_route_dedup(spark):
    rnd = random.Random(7)
    rows = [(r, i, rnd.choice("abcdefghijklmnop") + str(rnd.randrange(3)), rnd.choice(["open", "closed"]), rnd.uniform(0, 900), 31 + rnd.uniform(0, 0.03), 35 + rnd.uniform(0, 0.03)) for r in ("x", "y") for i in range(60)]
    got = identity.greedy_route_dedup(spark.createDataFrame(rows, "route string, id int, name string, status string, metres double, lat double, lon double"), "route")
    want = set()
    for route in ("x", "y"):
        kept = []
        for row in sorted((r for r in rows if r[0] == route), key=lambda r: (r[3] != "closed", r[4], r[2])):
            near = lambda o: math.hypot((row[5] - o[5]) * 111_320.0, (row[6] - o[6]) * 111_320.0 * math.cos(math.radians(row[5]))) <= 200.0  # noqa: E731, B023
            if not any(o[2] == row[2] or near(o) for o in kept):
                kept.append(row)
        want |= {(route, r[1]) for r in kept}
    assert {(r.route, r.id) for r in got.collect()} == want


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = spark.conf

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            scratch.shared_folder(Session())
    assert scratch.shared_folder(spark)
