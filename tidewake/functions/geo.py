"""Geodesy and plane geometry as column expressions (whole-stage code generation, no Python)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radii in metres: of the local plane and of great circles.
PLANE_RADIUS = 6_378_137.0
SPHERE_RADIUS = 6_371_000.0


def to_enu(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north metres from an origin, on a plane that touches the sphere there."""
    return F.radians(lon - lon0) * PLANE_RADIUS * F.cos(F.radians(lat0)), F.radians(lat - lat0) * PLANE_RADIUS


def from_enu(east: Column, north: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return lat0 + F.degrees(north / PLANE_RADIUS), lon0 + F.degrees(east / (PLANE_RADIUS * F.cos(F.radians(lat0))))


# The WGS84 ellipsoid.
FLATTENING = 1 / 298.257223563
POLAR_RADIUS = PLANE_RADIUS * (1 - FLATTENING)


def azimuthal(df: DataFrame, lat: Column, lon: Column, lat0: Column, lon0: Column, rounds: int = 6) -> DataFrame:
    """Adds ``east`` and ``north`` of the azimuthal equidistant projection: the geodesic's length in its first direction.

    Vincenty's inverse with a fixed number of rounds, each a projection of its
    own so that nothing is worked out twice. Not for points near the antipode.
    """
    reduced = lambda degrees: F.atan((1 - FLATTENING) * F.tan(F.radians(degrees)))
    df = df.withColumns({"_u": reduced(lat0), "_w": reduced(lat), "_l": F.radians(lon - lon0)})
    df = df.withColumns({"_su": F.sin("_u"), "_cu": F.cos("_u"), "_sw": F.sin("_w"), "_cw": F.cos("_w"), "_x": F.col("_l")})
    c = F.col

    def arc(df: DataFrame) -> DataFrame:
        df = df.withColumns({"_p": c("_cw") * F.sin("_x"), "_q": c("_cu") * c("_sw") - c("_su") * c("_cw") * F.cos("_x"), "_cos": c("_su") * c("_sw") + c("_cu") * c("_cw") * F.cos("_x")})
        df = df.withColumn("_sin", F.sqrt(c("_p") * c("_p") + c("_q") * c("_q")))
        df = df.withColumns({"_arc": F.atan2("_sin", "_cos"), "_tilt": F.when(c("_sin") == 0, 0.0).otherwise(c("_cu") * c("_p") / c("_sin"))})
        df = df.withColumn("_k", 1 - c("_tilt") * c("_tilt"))
        return df.withColumn("_mid", F.when(c("_k") == 0, 0.0).otherwise(c("_cos") - 2 * c("_su") * c("_sw") / c("_k")))

    for _ in range(rounds):
        df = arc(df).withColumn("_c", FLATTENING / 16 * c("_k") * (4 + FLATTENING * (4 - 3 * c("_k"))))
        bow = c("_arc") + c("_c") * c("_sin") * (c("_mid") + c("_c") * c("_cos") * (2 * c("_mid") * c("_mid") - 1))
        df = df.withColumn("_x", c("_l") + (1 - c("_c")) * FLATTENING * c("_tilt") * bow)
    df = arc(df).withColumn("_h", c("_k") * (PLANE_RADIUS**2 / POLAR_RADIUS**2 - 1))
    df = df.withColumns({"_a": 1 + c("_h") / 16384 * (4096 + c("_h") * (c("_h") * (320 - 175 * c("_h")) - 768)), "_b": c("_h") / 1024 * (256 + c("_h") * (c("_h") * (74 - 47 * c("_h")) - 128))})
    twice = 2 * c("_mid") * c("_mid") - 1
    less = c("_b") * c("_sin") * (c("_mid") + c("_b") / 4 * (c("_cos") * twice - c("_b") / 6 * c("_mid") * (4 * c("_sin") * c("_sin") - 3) * (4 * c("_mid") * c("_mid") - 3)))
    length = F.when(c("_sin") == 0, 0.0).otherwise(POLAR_RADIUS * c("_a") * (c("_arc") - less) / c("_sin"))
    df = df.withColumn("_r", length).withColumns({"east": c("_r") * c("_p"), "north": c("_r") * c("_q")})
    return df.drop(*"_u _w _l _su _cu _sw _cw _x _p _q _cos _sin _arc _tilt _k _mid _c _h _a _b _r".split())


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * SPHERE_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def wrap(angle: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def angle_between(a: Column, b: Column) -> Column:
    """Absolute difference on the circle; inputs differ by less than a turn."""
    d = F.abs(a - b)
    return F.least(d, 2 * math.pi - d)


def yaw_of_compass(heading_deg: Column) -> Column:
    """Compass degrees (clockwise from north) to mathematical yaw (counter-clockwise from east)."""
    return F.radians(90 - heading_deg)


def compass_of_yaw(yaw: Column) -> Column:
    return F.pmod(90 - F.degrees(yaw), F.lit(360.0))


def euler_rotation(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """Rz(yaw) Ry(pitch) Rx(roll), row by row."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
        sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr,
        -sp, cp * sr, cp * cr,
    ]


def along(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where the foot of a point lies on a segment, from 0 to 1; 0 on a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    share = ((px - x1) * dx + (py - y1) * dy) / F.when(length > 0, length)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(0.0))


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    at = along(px, py, x1, y1, x2, y2)
    return F.hypot(px - (x1 + at * (x2 - x1)), py - (y1 + at * (y2 - y1)))


def distance_text(metres: Column) -> Column:
    return F.when(metres < 1000, F.format_string("%d m", F.floor(metres + 0.5))).otherwise(F.format_string("%.1f km", metres / 1000))


def duration_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60 + 0.5)
    return F.when(minutes < 60, F.format_string("%d min", minutes)).otherwise(F.format_string("%d hr %d min", F.floor(minutes / 60), minutes % 60))


def remaining_time(duration: Column, remaining: Column, total: Column) -> Column:
    """A route's duration scaled by what is left of it, between 0 and the whole."""
    share = F.when(total > 0, remaining / total).otherwise(0.0)
    return duration * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
