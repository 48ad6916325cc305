"""Geometry on a sphere as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_KM = 6371.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    turn = F.radians(lon2 - lon1)
    x = F.sin(turn) * F.cos(F.radians(lat2))
    y = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return whole_turn(F.degrees(F.atan2(x, y)))


def whole_turn(angle: Column) -> Column:
    """An angle as 0 to 360, step by step like the SQL: pmod's last digit is another, which shows at thresholds."""
    return (angle % 360 + 360) % 360


def angle_between(a: Column, b: Column) -> Column:
    """Absolute difference of two angles in degrees, at most 180."""
    return F.abs(whole_turn(a - b + 180) - 180)


def libm(f, n: int = 1):
    """A function of the C library on columns: Java's sin, cos and atan2 differ from it in the last place for some angles
    (atan2 for one in six of those on a threshold of whole degrees a second), and then fall on its other side than in SQL."""

    def run(*rows):
        return pa.array([None if None in row else f(*row) for row in zip(*(c.to_pylist() for c in rows))], pa.float64())

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return F.arrow_udf([one, two][n - 1], DoubleType())


sin_libm, cos_libm, atan2_libm = libm(math.sin), libm(math.cos), libm(math.atan2, 2)


def signed_turn(sin1: Column, cos1: Column, sin0: Column, cos0: Column) -> Column:
    """Degrees from unit vector 0 to unit vector 1, by atan2 of cross and dot."""
    return F.degrees(atan2_libm(sin1 * cos0 - cos1 * sin0, sin1 * sin0 + cos1 * cos0))


def rounded_half(value: Column, digits: int) -> Column:
    """value to so many digits by its binary product, as SQL engines do; Spark's round goes by the shortest decimal text,
    so the two differ where a value is a tie in one of these only."""
    scaled = value * 10.0**digits
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 10.0**digits


def destination(lat: Column, lon: Column, speed_ms: Column, track: Column, seconds: Column) -> tuple[Column, Column]:
    """Latitude and longitude after moving along a great circle."""
    far = speed_ms * seconds / 1000.0 / EARTH_KM
    lat1, course = F.radians(lat), F.radians(track)
    lat2 = F.asin(F.sin(lat1) * F.cos(far) + F.cos(lat1) * F.sin(far) * F.cos(course))
    lon2 = F.radians(lon) + F.atan2(F.sin(course) * F.sin(far) * F.cos(lat1), F.cos(far) - F.sin(lat1) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + 540, F.lit(360.0)) - 180


def along(lat1: Column, lon1: Column, lat2: Column, lon2: Column, part: Column) -> tuple[Column, Column]:
    """The point a given part of the way along the great circle between two points."""
    d = haversine_km(lat1, lon1, lat2, lon2) / EARTH_KM
    a = F.when(d == 0, 1 - part).otherwise(F.sin((1 - part) * d) / F.sin(d))
    b = F.when(d == 0, part).otherwise(F.sin(part * d) / F.sin(d))
    r = F.radians
    x = a * F.cos(r(lat1)) * F.cos(r(lon1)) + b * F.cos(r(lat2)) * F.cos(r(lon2))
    y = a * F.cos(r(lat1)) * F.sin(r(lon1)) + b * F.cos(r(lat2)) * F.sin(r(lon2))
    z = a * F.sin(r(lat1)) + b * F.sin(r(lat2))
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def geohash5(lat: Column, lon: Column) -> Column:
    """Five base-32 characters: 13 bits of longitude and 12 of latitude, interleaved, longitude first."""
    x = F.least(F.lit(8191), F.floor((lon + 180) / 360 * 8192)).cast("long")
    y = F.least(F.lit(4095), F.floor((lat + 90) / 180 * 4096)).cast("long")
    bit = lambda i: F.floor((x if i % 2 == 0 else y) / F.lit(1 << ((12 if i % 2 == 0 else 11) - i // 2))) % 2
    letters = [F.substring(F.lit(BASE32), (sum((bit(5 * k + j) * (1 << (4 - j)) for j in range(1, 5)), bit(5 * k) * 16) + 1).cast("int"), F.lit(1)) for k in range(5)]
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*letters))


def cell10(lat: Column, lon: Column) -> Column:
    """Name of the 10-degree cell of a point; null without a position."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat_ws("_", F.floor(lat / 10).cast("string"), F.floor(lon / 10).cast("string")))


def circular_mean(track: Column) -> Column:
    """Aggregate: mean direction in degrees."""
    return whole_turn(F.degrees(F.atan2(F.avg(F.sin(F.radians(track))), F.avg(F.cos(F.radians(track))))))
