"""Checks and guards: ingest contracts, allow-lists, authenticity, calibration, leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of device information that may be kept.
DEVICE_KEYS = ("model", "manufacturer", "os_version", "app_version", "sensor_rate")


def contract(df: DataFrame, least_rows: int = 50, most_acc: float = 50.0, most_gyro: float = 25.0, low_speed: float = -1.0, most_speed: float = 80.0) -> DataFrame:
    """One row per drive: ``n`` and the broken rules, joined by ``; ``. One shuffle: the step and the sums share a partitioning."""
    most = lambda *c: F.max(F.greatest(*[F.abs(x) for x in c]))
    step = F.col("t") - F.lag("t").over(Window.partitionBy("drive_id").orderBy("t", "event_id"))
    odd = F.max(F.isnan("val") | (F.abs("val") == float("inf")))
    rules = [
        (F.count("*") < least_rows, "too few rows"),
        (F.coalesce(F.min("_dt"), F.lit(1.0)) <= 0, "time does not increase"),
        (odd, "not finite"),
        (most("ax", "ay", "az") > most_acc, "acceleration out of range"),
        (most("gx", "gy", "gz") > most_gyro, "rotation out of range"),
        ((F.min("speed") < low_speed) | (F.max("speed") > most_speed), "speed out of range"),
    ]
    errors = F.array_join(F.array_compact(F.array(*[F.when(broken, text) for broken, text in rules])), "; ")
    return df.withColumn("_dt", step).groupBy("drive_id").agg(F.count("*").alias("n"), errors.alias("errors"))


def allowed(info: Column, keys: tuple[str, ...] = DEVICE_KEYS) -> Column:
    """Device information without anything that is not on the list."""
    return F.map_filter(info, lambda k, _: k.isin(*keys))


def authentic(path: Column) -> Column:
    """The same as ``require_authentic`` on a column of paths."""
    return F.lower(path).contains("authentic")


def require_authentic(path: str) -> None:
    if "authentic" not in path.lower():
        raise ValueError(f"{path} is not an authentic recording")


def heading_is_absolute(flag: Column, webkit: Column, yaw: Column) -> Column:
    """The flag where it is set; else a webkit heading; else any yaw."""
    return F.coalesce(flag, F.lit(False)) | webkit | (flag.isNull() & yaw.isNotNull())


def calibrated(parts: list[Column], bias: tuple[float, ...], scale: tuple[float, ...]) -> list[Column]:
    return [(p - b) * s for p, b, s in zip(parts, bias, scale, strict=True)]


def iron_fit(df: DataFrame, parts: tuple[str, str, str], keys: list[str], least: int = 50) -> DataFrame:
    """Hard- and soft-iron parameters: centres, and the mean semi-axis over each (floored at 1)."""
    semi = [F.greatest((F.max(p) - F.min(p)) / 2, F.lit(1.0)) for p in parts]
    mean = reduce(lambda a, b: a + b, semi) / 3
    columns = [((F.max(p) + F.min(p)) / 2).alias(f"bias_{p}") for p in parts] + [(mean / s).alias(f"scale_{p}") for p, s in zip(parts, semi, strict=True)]
    return df.groupBy(*keys).agg(*columns, F.count("*").alias("n")).where(F.col("n") >= least)


def leakage(df: DataFrame, *keys: str) -> DataFrame:
    """Invariants of a gated stream, whole or by ``keys``: rows with an outage flag never carry a navigation fix; the reference is always there."""
    return df.groupBy(*keys).agg(
        F.bool_and(~F.col("is_outage") | F.col("nav_east").isNull()).alias("hidden_inside"),
        F.bool_and(F.col("is_outage") | (F.col("nav_east") == F.col("ref_east"))).alias("shown_outside"),
        F.bool_and(F.col("ref_east").isNotNull()).alias("reference_whole"),
    )


def signals(headers: DataFrame, name: str, header: Column) -> DataFrame:
    """Per file whether its header names a yaw, heading, speed or steering channel."""
    words = {"yaw": "yaw", "heading": "heading", "speed": "speed|velocity", "steering": "steering"}
    return headers.select(name, *[F.lower(header).rlike(pattern).alias(signal) for signal, pattern in words.items()])
