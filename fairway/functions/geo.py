"""Geographic and circular expressions on columns. All stay in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairway.config import EARTH_RADIUS_M, METRES_PER_DEGREE, PEAK_HOURS, PERIODS


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_difference(a: Column, b: Column) -> Column:
    """Smaller angle between two directions, 0 to 180."""
    d = F.abs(a - b)
    return F.least(d, 360.0 - d)


def circular_mean(sin: Column, cos: Column) -> Column:
    """Direction of summed or averaged sines and cosines, in degrees."""
    return F.pmod(F.degrees(F.atan2(sin, cos)) + 360.0, F.lit(360.0))


def concentration(sin: Column, cos: Column) -> Column:
    """Length of the mean direction vector, 0 to 1."""
    return F.sqrt(sin * sin + cos * cos)


def octant(angle: Column) -> Column:
    return F.pmod(F.floor(angle / 45.0), F.lit(8)).cast("int")


def cell(x: Column, size: float) -> Column:
    """Grid index, cut towards zero."""
    return (x / F.lit(size)).cast("int")


def planar(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres east and north on the plane of 111 km a degree, east scaled by the point's own latitude."""
    return lon * METRES_PER_DEGREE * F.cos(F.radians(lat)), lat * METRES_PER_DEGREE


def point_line_distance(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres from a point to a segment on the plane of 111 km a degree."""
    (x, y), (x1, y1), (x2, y2) = planar(lat, lon), planar(lat1, lon1), planar(lat2, lon2)
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / square)))
    return F.hypot(x - x1 - t * dx, y - y1 - t * dy)


def point_segment_distance(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance to the foot of the perpendicular taken in degrees, kept on the segment."""
    dx, dy = lat2 - lat1, lon2 - lon1
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lat - lat1) * dx + (lon - lon1) * dy) / square)))
    return haversine(lat, lon, lat1 + t * dx, lon1 + t * dy)


def curvature(lats: list[Column], lons: list[Column]) -> Column:
    """Bend at the middle of three points: half the cross product times four over the product of the sides."""
    p = [planar(a, o) for a, o in zip(lats, lons, strict=True)]
    ux, uy, vx, vy = p[1][0] - p[0][0], p[1][1] - p[0][1], p[2][0] - p[1][0], p[2][1] - p[1][1]
    a, b, c = F.hypot(ux, uy), F.hypot(vx, vy), F.hypot(p[2][0] - p[0][0], p[2][1] - p[0][1])
    return F.when((a < 1e-6) | (b < 1e-6) | (c < 1e-6), 0.0).otherwise(2.0 * F.abs(ux * vy - uy * vx) / (a * b * c))


def hour_of(us: Column) -> Column:
    """Hour of the day of microseconds, in UTC whatever the session's zone."""
    return F.pmod(F.floor(us / F.lit(3_600_000_000)), F.lit(24)).cast("int")


def is_weekend(us: Column) -> Column:
    """1 on Saturdays and Sundays (day 0 is a Thursday)."""
    return (F.pmod(F.floor(us / F.lit(86_400_000_000)) + 3, F.lit(7)) >= 5).cast("int")


def time_period(hour: Column) -> Column:
    out = F.lit(PERIODS[-1][0])
    for name, _, end in reversed(PERIODS[:-1]):
        out = F.when(hour < end, name).otherwise(out)
    return out


def is_peak(hour: Column) -> Column:
    return hour.isin(*PEAK_HOURS).cast("int")


def mean_degrees(column: str) -> Column:
    """Mean to the whole nano-degree. Sums are of whole numbers, so the order of rows never shows."""
    nano = f"cast(round({column} * 1e9) as bigint)"
    return F.expr(f"cast((2 * sum({nano}) + count({nano})) div nullif(2 * count({nano}), 0) as double) / 1e9")
