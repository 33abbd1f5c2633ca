"""Nearest places, however many there are, by leaves of places that lie together.

Places are sorted along a space-filling curve and cut into leaves, which are small
where places are dense.  What a task must know of the leaves is bounded: their boxes,
and one place of each.  From these a point learns the
leaves that can hold its nearest place, mostly one to four, and only there distances
are computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Places of a leaf, if there are not so many that there would be more than LEAVES of them.
LEAF, LEAVES = 512, 50_000
#: Places that a task cuts into leaves.
RUN = 500_000
#: Points that meet a leaf in one task.
PART = 20_000
#: Level of the cells of points that share a list of leaves.
POINT_LEVEL = 11
RADIUS_KM = 6371.0


def haversine(lat1, lon1, lat2, lon2) -> np.ndarray:
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))


def _apart(low1, high1, low2, high2, around: bool):
    """Least difference of two ranges of degrees, in radians; ``around`` the earth the shorter way."""
    gap = np.maximum(np.maximum(low2 - high1, low1 - high2), 0.0)
    if around:
        gap = np.minimum(gap, np.maximum(360.0 - np.maximum(high2 - low1, high1 - low2), 0.0))
    return np.radians(gap)


def least_km(lat_low, lat_high, lon_low, lon_high, box) -> np.ndarray:
    """What any two places of two boxes are apart at least; a point is a box too."""
    a, b, c, d = box
    lat, lon = _apart(lat_low, lat_high, a, b, False), _apart(lon_low, lon_high, c, d, True)
    cos = np.cos(np.radians(np.maximum(np.abs(lat_low), np.abs(lat_high)))) * np.cos(np.radians(np.maximum(np.abs(a), np.abs(b))))
    h = np.sin(lat / 2) ** 2 + np.maximum(cos, 0.0) * np.sin(np.minimum(lon, np.pi) / 2) ** 2
    # a little less, as distances are rounded
    return np.maximum(2 * RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0))) * (1 - 1e-9) - 1e-9, 0.0)


def _spread(c: Column) -> Column:
    """The low 31 bits with a zero between any two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def leaves(places: DataFrame, leaf: int) -> DataFrame:
    """``places`` (name, lat, lon) with the ``leaf`` they are in, of ``leaf`` places at most.

    They are sorted along a curve that goes through a cell of any size before it
    leaves it, and cut into runs.
    """
    scaled = lambda c, low, width: F.floor((F.col(c) - low) / width * ((1 << 30) - 1)).cast("bigint")
    curve = _spread(scaled("lat", -90.0, 180.0)) * 2 + _spread(scaled("lon", -180.0, 360.0))
    tasks = max(1, -(-places.count() // RUN))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        for pdf in batches:
            at = (np.arange(len(pdf)) + n) // leaf
            n += len(pdf)
            yield pdf[["name", "lat", "lon"]].assign(leaf=[f"{task}:{i}" for i in at.tolist()])

    dealt = places.withColumn("curve", curve).repartitionByRange(tasks, "curve").sortWithinPartitions("curve", "lat", "lon")
    return dealt.mapInPandas(number, "name string, lat double, lon double, leaf string")


def nearest_of_many(points: DataFrame, places: DataFrame, key: str, name: str = "name", most_km: float | None = None) -> DataFrame:
    """(key, name, km): for each point (lat, lon) the nearest of ``places`` (name, p_lat, p_lon), ties by name.

    Any number of either.  Rows without coordinates, or with ones that are no
    latitude and longitude, take no part; no places, no rows.
    """
    on_earth = "lat between -90 and 90 and lon between -180 and 180"
    # of places at one spot the first by name is the nearest
    spots = places.select(F.col("p_lat").cast("double").alias("lat"), F.col("p_lon").cast("double").alias("lon"), F.col(name).cast("string").alias("name"))
    spots = spots.filter(on_earth).groupBy("lat", "lon").agg(F.min("name").alias("name"))
    spots = written(spots, "nearest-spots")
    size = max(LEAF, -(-spots.count() // LEAVES))
    spots = written(leaves(spots, size), "nearest-leaves")
    boxes = spots.groupBy("leaf").agg(
        F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"), F.min(F.struct("lat", "lon")).alias("one")
    )
    known = boxes.select("leaf", "a", "b", "c", "d", "one.lat", "one.lon").orderBy("leaf").toPandas()  # a few times LEAVES at most
    names, table = known["leaf"].to_numpy(), known[["a", "b", "c", "d", "lat", "lon"]].to_numpy(dtype=float)
    shared = points.sparkSession.sparkContext.broadcast((names, table))
    where = points.select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).filter(on_earth).distinct()

    def able(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, t = shared.value
        side = 180.0 / (1 << POINT_LEVEL)
        for pdf in batches:
            lat, lon = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
            cells = np.stack([np.floor((lat + 90.0) / side), np.floor((lon + 180.0) / side)], axis=1)
            _, first, of = np.unique(cells, axis=0, return_index=True, return_inverse=True)
            rows, found = [], []
            order = np.argsort(of.ravel(), kind="stable")
            for at in np.split(order, np.cumsum(np.bincount(of.ravel()))[:-1]) if len(order) else []:
                low = cells[at[0]] * side - (90.0, 180.0)
                mid, high = low + side / 2, low + side
                reach = RADIUS_KM * np.radians(side)  # of the middle to any place of the cell
                within = (haversine(mid[0], mid[1], t[:, 4], t[:, 5]) + reach).min(initial=np.inf)
                near = np.flatnonzero(least_km(low[0], high[0], low[1], high[1], t[:, :4].T) <= within)
                for k in range(0, len(at), 4096):
                    part = at[k : k + 4096]
                    y, x = lat[part, None], lon[part, None]
                    upper = haversine(y, x, t[near, 4], t[near, 5]).min(1, keepdims=True, initial=np.inf) * (1 + 1e-9) + 1e-9
                    i, j = np.nonzero(least_km(y, y, x, x, t[near, :4].T) <= upper)
                    rows.append(part[i])
                    found.append(near[j])
            at = np.concatenate([np.empty(0, dtype=np.int64), *rows]).astype(np.int64)
            leaf = np.concatenate([np.empty(0, dtype=np.int64), *found]).astype(np.int64)
            yield pd.DataFrame({"lat": lat[at], "lon": lon[at], "leaf": ids[leaf]})

    asked = written(where.mapInPandas(able, "lat double, lon double, leaf string"), "nearest-asked")
    # a leaf that many points ask goes to several tasks; there are a few times LEAVES of them at most
    parts = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    asked = asked.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("lat", "lon"), F.col("parts")).cast("int"))
    given = spots.join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("name")
        label, y, x = right["name"].to_numpy(), right["lat"].to_numpy(), right["lon"].to_numpy()
        best, km = [], []
        for k in range(0, len(left), 2048):
            far = haversine(left["lat"].to_numpy()[k : k + 2048, None], left["lon"].to_numpy()[k : k + 2048, None], y, x)
            at = far.argmin(1)  # the first by name
            best.append(label[at])
            km.append(far[np.arange(len(at)), at])
        return pd.DataFrame({"lat": left["lat"], "lon": left["lon"], "name": np.concatenate(best), "km": np.concatenate(km)})

    keys = ["leaf", "part"]
    met = asked.select("lat", "lon", *keys).groupBy(*keys).cogroup(given.select("lat", "lon", "name", *keys).groupBy(*keys))
    met = met.applyInPandas(lambda left, right: meet(left, right) if len(left) and len(right) else _NONE, "lat double, lon double, name string, km double")
    found = met.groupBy("lat", "lon").agg(F.min(F.struct("km", "name")).alias("m")).select("lat", "lon", "m.name", "m.km")
    if most_km is not None:
        found = found.filter(F.col("km") <= most_km)
    rows = points.select(key, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return rows.join(found, ["lat", "lon"]).select(key, "name", "km")


_NONE = pd.DataFrame({"lat": pd.Series(dtype=float), "lon": pd.Series(dtype=float), "name": pd.Series(dtype=str), "km": pd.Series(dtype=float)})
