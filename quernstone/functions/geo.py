"""Geometry expressions: distances, boxes, rings, lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0
KM_A_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_box(lat: Column, lon: Column, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> Column:
    """Inclusive; false for missing coordinates."""
    return F.coalesce(lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon), F.lit(False))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of [lon, lat] pairs, by crossing parity."""
    size = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, size).otherwise(i - 1))
        ax, ay, bx, by = a[0], a[1], b[0], b[1]
        at = (bx - ax) * F.try_divide(lat - ay, by - ay) + ax
        return ((ay > lat) != (by > lat)) & (lon < at)

    hits = F.filter(F.sequence(F.lit(1), size), lambda i: F.coalesce(crosses(i), F.lit(False)))
    return F.size(hits) % 2 == 1


def in_polygon(lat: Column, lon: Column, rings: Column) -> Column:
    """Inside the first ring and in none of the others, which are holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1)))
    in_hole = F.when(F.size(rings) > 1, F.exists(holes, lambda r: in_ring(lat, lon, r))).otherwise(False)
    return in_ring(lat, lon, F.element_at(rings, 1)) & ~in_hole


def segment_distance_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to a segment in metres on a local plane around the point."""
    per_lat = 111_320.0
    per_lon = F.cos(F.radians(lat)) * per_lat
    ax, ay = (lon1 - lon) * per_lon, (lat1 - lat) * per_lat
    dx, dy = (lon2 - lon1) * per_lon, (lat2 - lat1) * per_lat
    t = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def border_distance_m(lat: Column, lon: Column, boxes: tuple) -> Column:
    """Least axis distance to the sides of the first box around the point, else NULL."""
    found = F.lit(None).cast("double")
    for south, west, north, east in reversed(boxes):
        least = F.least(F.abs(lat - south), F.abs(lat - north), F.abs(lon - west), F.abs(lon - east)) * 111_000.0
        found = F.when(in_box(lat, lon, south, west, north, east), least).otherwise(found)
    return found


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def line_middle(line: Column) -> Column:
    """The middle vertex."""
    return F.element_at(line, F.floor(F.size(line) / 2).cast("int") + 1)


def ring_mean(ring: Column) -> Column:
    """Mean of all vertices, the closing one included."""
    total = F.aggregate(
        ring, F.array(F.lit(0.0), F.lit(0.0)), lambda s, p: F.array(s[0] + p[0], s[1] + p[1])
    )
    return F.array(total[0] / F.size(ring), total[1] / F.size(ring))


def box_ring(lat: Column, lon: Column, half_m: float) -> Column:
    """A square ring of [lon, lat] around a point, to be avoided by routes."""
    dlat = F.lit(half_m / 111_320.0)
    dlon = half_m / (111_320.0 * F.cos(F.radians(lat)))
    corner = lambda a, b: F.array(lon + a * dlon, lat + b * dlat)
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def decoded_polyline(encoded: pd.Series) -> pd.Series:
    """[lat, lon] pairs of an encoded polyline of precision 6."""

    def decode(text: str | None) -> list[list[float]] | None:
        if text is None:
            return None
        numbers, shift, value = [], 0, 0
        for char in text:
            five = ord(char) - 63
            value |= (five & 31) << shift
            shift += 5
            if five < 32:
                numbers.append(~(value >> 1) if value & 1 else value >> 1)
                shift = value = 0
        points, lat, lon = [], 0, 0
        for dlat, dlon in zip(numbers[::2], numbers[1::2]):
            lat, lon = lat + dlat, lon + dlon
            points.append([lat / 1e6, lon / 1e6])
        return points

    return encoded.map(decode)


def feature(lat: Column, lon: Column, **properties: Column) -> Column:
    """GeoJSON text of a point feature."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
            F.struct(*(c.alias(n) for n, c in properties.items())).alias("properties"),
        )
    )
