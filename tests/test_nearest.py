import random

import numpy as np
import pytest

from quernstone.operators import joins, nearest


def brute(points, places):
    out = {}
    for i, lat, lon in points:
        if lat is None or lon is None or not (-90 <= lat <= 90 and -180 <= lon <= 180):
            continue
        km = [(float(nearest.haversine(lat, lon, b, c)), a) for a, b, c in places]
        out[i] = min(km) if km else None
    return {i: v for i, v in out.items() if v}


def places_of(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if rnd.random() < 0.6:  # a dense town
            lat, lon = 31.9 + rnd.gauss(0, 0.01), 35.2 + rnd.gauss(0, 0.01)
        elif rnd.random() < 0.5:
            lat, lon = rnd.uniform(-90, 90), rnd.uniform(-180, 180)
        else:  # on both sides of the date line, and the poles
            lat, lon = rnd.choice([-90.0, 90.0, 0.0, 89.5]), rnd.choice([-180.0, 180.0, 179.9, -179.9])
        out.append((f"p{i}", lat, lon))
    return out + [("twin b", 10.0, 10.0), ("twin a", 10.0, 10.0)]


@pytest.mark.parametrize("seed,leaf", [(1, 8), (2, 64), (3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, leaf):
    monkeypatch.setattr(nearest, "LEAF", leaf)
    monkeypatch.setattr(nearest, "PART", 50)
    places = places_of(seed, 500)
    rnd = random.Random(seed)
    points = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(150)]
    points += [(200 + i, 31.9 + rnd.gauss(0, 0.05), 35.2 + rnd.gauss(0, 0.05)) for i in range(150)]
    points += [(400, 90.0, 0.0), (401, -90.0, 7.0), (402, 0.0, 180.0), (403, 0.0, -180.0), (404, 10.0, 10.0), (405, None, 1.0), (406, 91.0, 0.0), (407, float("nan"), 0.0)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    p = spark.createDataFrame([*places, ("bad", None, 3.0), ("worse", 99.0, 3.0)], "name string, p_lat double, p_lon double")
    got = {r.id: (r.km, r.name) for r in nearest.nearest_of_many(df, p, "id").collect()}
    want = brute(points, places)
    assert got.keys() == want.keys()
    assert {i: n for i, (_, n) in got.items()} == {i: n for i, (_, n) in want.items()}
    assert max(abs(got[i][0] - want[i][0]) for i in want) < 1e-9
    assert got[404][1] == "twin a"
    near = nearest.nearest_of_many(df, p, "id", most_km=50.0).collect()
    assert {r.id for r in near} == {i for i, (km, _) in want.items() if km <= 50.0}


def test_awkward(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0)], "id int, lat double, lon double")
    p = spark.createDataFrame([("a", 1.0, 2.0)], "name string, p_lat double, p_lon double")
    assert nearest.nearest_of_many(df, p.limit(0), "id").collect() == []
    assert nearest.nearest_of_many(df.limit(0), p, "id").collect() == []
    assert [r.name for r in nearest.nearest_of_many(df, p, "id").collect()] == ["a", "a"]


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, c = rng.uniform(-90, 80), rng.uniform(-180, 170)
        box = (a, a + rng.uniform(0, 10), c, c + rng.uniform(0, 10))
        y, x = rng.uniform(-90, 90), rng.uniform(-180, 180)
        inside = nearest.haversine(y, x, rng.uniform(box[0], box[1], 200), rng.uniform(box[2], box[3], 200)).min()
        assert nearest.least_km(y, y, x, x, np.array(box)[:, None])[0] <= inside


def test_many_places_without_refusal(spark):
    """Forty thousand places, more than once were allowed, take the other way by themselves."""
    rng = np.random.default_rng(6)
    n = 40_000
    p = spark.createDataFrame(list(zip([f"p{i}" for i in range(n)], rng.uniform(29, 34, n).tolist(), rng.uniform(33, 37, n).tolist())), "name string, p_lat double, p_lon double")
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform([28, 32], [35, 38], (100, 2)))], "id int, lat double, lon double")
    got = {r.id: r.name for r in joins.nearest(df, p, "id").collect()}
    rows = p.collect()
    y, x = np.array([r.p_lat for r in rows]), np.array([r.p_lon for r in rows])
    assert got == {r.id: rows[int(nearest.haversine(r.lat, r.lon, y, x).argmin())].name for r in df.collect()}
