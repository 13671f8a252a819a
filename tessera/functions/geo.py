"""Geometry on a sphere as column expressions. Angles in degrees and distances in kilometres unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius used by distance functions, and the one that distances between consecutive positions use.
EARTH_RADIUS = 6371.0
TRACK_RADIUS = 6373.0


def great_circle_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Haversine distance."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) ** 2
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))  # least() would skip a null


def bearing_radians(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.cos(p2) * F.sin(d), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course from the first point to the second."""
    return F.degrees(bearing_radians(lat1, lon1, lat2, lon2))


def destination(lat: Column, lon: Column, distance: Column, course: Column, radius: float = EARTH_RADIUS) -> tuple[Column, Column]:
    """Latitude and longitude after a distance on an initial course."""
    p, a, c = F.radians(lat), distance / F.lit(radius), F.radians(course)
    q = F.asin(F.sin(p) * F.cos(a) + F.cos(p) * F.sin(a) * F.cos(c))
    d = F.atan2(F.sin(c) * F.sin(a) * F.cos(p), F.cos(a) - F.sin(p) * F.sin(q))
    return F.degrees(q), F.degrees(F.radians(lon) + d)


def _truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def to_dms(x: Column) -> tuple[Column, Column, Column]:
    """Whole degrees with sign, whole minutes, seconds."""
    degrees = _truncate(x)
    minutes = F.abs(x - degrees) * 60
    return degrees, F.floor(minutes).cast("double"), (minutes - F.floor(minutes)) * 60


def from_dms(degrees: Column, minutes: Column, seconds: Column) -> Column:
    """Decimal degrees; the sign is that of the degrees, and -0.0 is negative."""
    negative = (degrees < 0) | (degrees.cast("double").cast("string") == "-0.0")
    size = F.abs(degrees) + minutes / 60 + seconds / 3600
    return F.when(negative, -size).otherwise(size)


def chord_distance(arc: Column, radius: float = EARTH_RADIUS) -> Column:
    """Straight line through the sphere for a distance along its surface."""
    return F.lit(2 * radius) * F.sin(arc / F.lit(2 * radius))


def satellite_angle(chord: Column, radius: float = EARTH_RADIUS) -> Column:
    """Angle, in radians, at the end of a chord between it and the outward vertical."""
    return F.lit(math.pi) - F.acos(chord / F.lit(2 * radius))


def satellite_vessel_distance(chord: Column, height: Column, angle: Column) -> Column:
    """Third side of the triangle of chord and height with the angle (radians) between them."""
    return F.sqrt(chord * chord + height * height - F.lit(2.0) * chord * height * F.cos(angle))
