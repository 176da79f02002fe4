"""From recordings to training windows: align, segment, window, scale, count. One lazy plan per stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import segments


def windows(stream: DataFrame, split: Column, size: int = 50, stride: int = 10, gap: float = 0.35, channels: tuple[str, ...] = ("ax", "ay", "az", "gx", "gy", "gz")) -> DataFrame:
    """Channel-first windows with their split; windows never cross a gap."""
    found = segments.sliding_windows(stream, size, stride, gap, arrays=channels)
    return found.withColumn("split", split)


def channel_scaler(rows: DataFrame, split: str = "train") -> DataFrame:
    """Mean and population deviation per channel over the training windows' samples."""
    long = rows.where(F.col("split") == split).select(F.posexplode("window").alias("channel", "w")).select("channel", F.explode("w").alias("x"))
    std = F.stddev_pop(F.col("x").cast("double"))
    return long.groupBy("channel").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.when(std <= 1e-6, 1.0).otherwise(std).alias("std"), F.count("*").alias("n"))


def counts(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("split", "drive_id").agg(F.count("*").alias("n"))
    return per.groupBy("split").agg(F.sum("n").alias("windows"), F.count("*").alias("drives"))
