"""Vehicle motion formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.80665
LEAN_LIMIT = math.radians(45)


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def lean_angle(speed: Column, yaw_rate: Column) -> Column:
    return F.greatest(F.lit(-LEAN_LIMIT), F.least(F.lit(LEAN_LIMIT), F.atan2(speed * yaw_rate, F.lit(GRAVITY))))


def lateral_sigma(sigma: float, lean: Column, two_wheeler: bool = True) -> Column:
    """The sideways constraint loosens as a two-wheeler leans; a car's is constant."""
    return sigma * (1 + 2 * F.sin(F.abs(lean))) if two_wheeler else F.lit(sigma)


def model_sigma(speed: Column) -> Column:
    return F.when(speed < 2, 0.6).when(speed < 10, 1.0).otherwise(1.8)


def blend_weight(step: Column, steps: int = 15) -> Column:
    """Cosine bell from 0 to 1 over ``steps`` rows since a position came back."""
    return F.when(step >= steps, 1.0).otherwise(0.5 * (1 - F.cos(math.pi * (step + 1) / steps)))


def severity(seconds: Column, metres: Column) -> Column:
    return F.when((seconds > 30) | (metres > 300), "SEVERE").when((seconds > 10) | (metres > 80), "MODERATE").otherwise("MILD")


def emission_log(distance: Column, sigma: float) -> Column:
    return -0.5 * F.pow(distance / sigma, 2) - math.log(math.sqrt(2 * math.pi) * sigma)


def transition_log(moved: Column, routed: Column, same_edge: Column, beta: float) -> Column:
    """Exponential in the difference of the distances, with 2 beta more where the edge changes."""
    return -(F.abs(moved - routed) + F.when(same_edge, 0.0).otherwise(2 * beta)) / beta - math.log(beta)


def leveling_sigma(sigma: float, gain: float, dynamic: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.sqrt(sigma * sigma + F.pow(gain * dynamic, 2))))


def kinematic_yaw_rate(lateral: Column, speed: Column) -> Column:
    return F.when(speed > 2, lateral / F.greatest(speed, F.lit(1.0))).otherwise(0.0)


def gravity_in_body(pitch: Column, roll: Column) -> tuple[Column, Column, Column]:
    return -GRAVITY * F.sin(roll) * F.cos(pitch), GRAVITY * F.sin(pitch), GRAVITY * F.cos(pitch) * F.cos(roll)


def tilt_heading(mx: Column, my: Column, mz: Column, roll: Column, pitch: Column) -> Column:
    """Heading of a tilted magnetometer, in [0, 2 pi)."""
    xh = mx * F.cos(pitch) + my * F.sin(roll) * F.sin(pitch) + mz * F.cos(roll) * F.sin(pitch)
    yh = my * F.cos(roll) - mz * F.sin(roll)
    return F.pmod(F.atan2(-yh, xh), F.lit(2 * math.pi))


def cardinal(heading_deg: Column) -> Column:
    names = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(names, (F.floor(heading_deg / 45 + 0.5) % 8 + 1).cast("int"))


def finite(value: Column, nan: float = 0.0, high: float = 0.0, low: float = 0.0) -> Column:
    """NaN and infinities replaced; null stays null."""
    return F.when(F.isnan(value), nan).when(value == float("inf"), high).when(value == float("-inf"), low).otherwise(value)
