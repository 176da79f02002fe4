"""Dead-reckoning baselines that are running sums: exact in SQL and linear at any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def order(keys: tuple[str, ...] = ("drive_id",), time: str = "t", tie: str = "event_id") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time, tie)


def running(value: Column, over: WindowSpec) -> Column:
    return F.sum(value).over(over.rowsBetween(Window.unboundedPreceding, 0))


def with_steps(df: DataFrame, keys: tuple[str, ...] = ("drive_id",)) -> DataFrame:
    """Adds ``step``: the distance from the row before, 0 at a drive's first row."""
    o = order(keys)
    return df.withColumn("step", F.coalesce(F.hypot(F.col("east") - F.lag("east").over(o), F.col("north") - F.lag("north").over(o)), F.lit(0.0)))


def integrated(df: DataFrame, dt: float = 0.1, keys: tuple[str, ...] = ("drive_id",), acc: str = "ax", rate: str = "gz", speed0: float = 0.0, heading0: float = 0.0) -> DataFrame:
    """Raw double integration: heading, speed, then position, each a running sum of the one before."""
    o = order(keys)
    df = df.withColumn("heading", heading0 + running(F.col(rate) * dt, o)).withColumn("v", speed0 + running(F.col(acc) * dt, o))
    df = df.withColumn("_de", F.col("v") * F.cos("heading") * dt).withColumn("_dn", F.col("v") * F.sin("heading") * dt)
    return df.withColumn("pe", running(F.col("_de"), o)).withColumn("pn", running(F.col("_dn"), o)).drop("_de", "_dn")


def constant_velocity(df: DataFrame, dt: float = 0.1, keys: tuple[str, ...] = ("drive_id",)) -> DataFrame:
    """The first row's speed and course kept: position by row number."""
    o = order(keys)
    n, v, h = F.row_number().over(o) - 1, F.first("speed").over(o), F.first("gz").over(o)
    return df.withColumn("pe", v * F.cos(h) * dt * n).withColumn("pn", v * F.sin(h) * dt * n)


def speed_and_rate(df: DataFrame, dt: float = 0.1, keys: tuple[str, ...] = ("drive_id",)) -> DataFrame:
    """Planar dead reckoning from measured speed and yaw rate."""
    o = order(keys)
    df = df.withColumn("heading", running(F.col("gz") * dt, o))
    df = df.withColumn("_de", F.col("speed") * F.cos("heading") * dt).withColumn("_dn", F.col("speed") * F.sin("heading") * dt)
    return df.withColumn("pe", running(F.col("_de"), o)).withColumn("pn", running(F.col("_dn"), o)).drop("_de", "_dn")


def finite_velocity(df: DataFrame, dt: float = 0.1, least_course: float = 1.5, least_step: float = 0.1, keys: tuple[str, ...] = ("drive_id",)) -> DataFrame:
    """Velocity and course of fixes by differences; course only when moving, velocity only on a real step."""
    o = order(keys)
    de, dn = F.col("east") - F.lag("east").over(o), F.col("north") - F.lag("north").over(o)
    step = F.hypot(de, dn)
    return df.withColumn("course", F.when(step / dt >= least_course, F.atan2(dn, de))).withColumn("ve", F.when(step > least_step, de / dt)).withColumn("vn", F.when(step > least_step, dn / dt))
