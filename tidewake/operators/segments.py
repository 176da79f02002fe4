"""Gap-free segments and the windows cut from them.

A drive's rows meet in one shuffle and one sort; segments, row numbers and
window statistics are all window functions over that order. Window arrays are
built only at the rows where a window ends, from the segment's rows around it,
so the frame is not collected for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_segments(df: DataFrame, gap: float, least: int = 1, keys: tuple[str, ...] = ("drive_id",), time: str = "t", tie: str = "event_id") -> DataFrame:
    """Adds ``segment`` (0-based among kept segments) and ``rn`` (0-based in the segment); drops short segments."""
    order = Window.partitionBy(*keys).orderBy(time, tie)
    new = F.when(F.col(time) - F.lag(time).over(order) > gap, 1).otherwise(0)
    df = df.withColumn("_new", new)
    df = df.withColumn("_raw", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy(*keys, "_raw"))
    df = df.withColumn("_n", size).where(F.col("_n") >= least)
    df = df.withColumn("segment", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_raw")) - 1)
    rn = F.row_number().over(Window.partitionBy(*keys, "_raw").orderBy(time, tie)) - 1
    return df.withColumn("rn", rn).drop("_new", "_raw", "_n")


def segments(df: DataFrame, gap: float, least: int = 1, keys: tuple[str, ...] = ("drive_id",), time: str = "t", tie: str = "event_id") -> DataFrame:
    """One row per segment: its number, row count and first and last time."""
    return with_segments(df, gap, least, keys, time, tie).groupBy(*keys, "segment").agg(F.count("*").alias("n"), F.min(time).alias("t_start"), F.max(time).alias("t_end"))


def _field(column: str, name: str) -> Column:
    return F.transform(column, lambda x: x[name])


def sliding_windows(df: DataFrame, size: int, stride: int, gap: float, statistics: dict[str, Column] | None = None, target: str = "speed", arrays: tuple[str, ...] = (), keys: tuple[str, ...] = ("drive_id",), time: str = "t", tie: str = "event_id") -> DataFrame:
    """Windows of ``size`` rows every ``stride`` rows of a segment, never across a gap.

    One row per window: keys, segment, ``start``, ``end`` (rows in the segment,
    end exclusive), ``t_start``, ``t_end``, ``target`` (the last row's value),
    the given aggregate ``statistics`` over the window, and ``window``: one
    array per name in ``arrays``, channel first.
    """
    rows = with_segments(df, gap, size, keys, time, tie)
    order = Window.partitionBy(*keys, "segment").orderBy(time, tie)
    frame = order.rowsBetween(1 - size, 0)
    ends = (F.col("rn") >= size - 1) & ((F.col("rn") - (size - 1)) % stride == 0)
    out = rows.select(
        *keys, "segment", "rn", (F.col("rn") - (size - 1)).alias("start"), (F.col("rn") + 1).alias("end"),
        F.min(time).over(frame).alias("t_start"), F.col(time).alias("t_end"), F.col(target).alias("target"),
        *[c.over(frame).alias(n) for n, c in (statistics or {}).items()],
    ).where(ends)
    if not arrays:
        return out.drop("rn")
    # rows belong to at most ceil(size / stride) windows: deal them out, then collect each window once
    last = F.floor(F.col("rn") / stride)
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - (size - 1)) / stride))
    dealt = rows.select(*keys, "segment", "rn", *arrays, F.explode(F.sequence(first, last)).alias("k"))
    packed = F.sort_array(F.collect_list(F.struct("rn", *arrays)))
    windows = dealt.groupBy(*keys, "segment", "k").agg(packed.alias("_w")).where(F.size("_w") == size)
    channels = F.array(*[_field("_w", a).cast("array<float>") for a in arrays])
    windows = windows.select(*keys, "segment", (F.col("k") * stride).alias("start"), channels.alias("window"))
    return out.drop("rn").join(windows, [*keys, "segment", "start"])


def padded_windows(df: DataFrame, value: str, size: int, order) -> DataFrame:
    """For every row the last ``size`` values, short ones filled up on the left with the first value."""
    seen = F.collect_list(value).over(order.rowsBetween(1 - size, 0))
    df = df.withColumn("_seen", seen)
    return df.withColumn("window", F.concat(F.array_repeat(F.element_at("_seen", 1), size - F.size("_seen")), F.col("_seen"))).drop("_seen")


def unwrapped(angle: Column, order) -> Column:
    """Running correction by whole turns; a step of exactly half a turn keeps its sign."""
    import math

    step = angle - F.lag(angle).over(order)
    turns = F.when(F.abs(step) > math.pi, -2 * math.pi * F.floor((step + math.pi) / (2 * math.pi))).otherwise(0.0)
    return turns
