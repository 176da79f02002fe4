"""Time: filling, overlap, step lengths, interpolating joins, clock offsets.

Two streams meet by one union, one shuffle by drive and one sort; the values
before and after each row are running last and first non-null values. Nothing
here is a range join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import scan


def filled(df: DataFrame, value: str, position: str, keys: list[str]) -> DataFrame:
    """Nulls filled linearly by row position; leading ones take the next value, trailing ones the last."""
    before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(position).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("i"), F.col(value).alias("v")))
    df = df.withColumn("_low", F.last(at, True).over(before)).withColumn("_high", F.first(at, True).over(after))
    low, high = F.col("_low"), F.col("_high")
    share = (F.col(position) - low["i"]) / (high["i"] - low["i"])
    line = F.when(low["i"] == high["i"], low["v"]).otherwise(low["v"] + (high["v"] - low["v"]) * share)
    return df.withColumn(value, F.coalesce(line, low["v"], high["v"])).drop("_low", "_high")


def zero_based(df: DataFrame, time: str, keys: list[str]) -> DataFrame:
    return df.withColumn(time, F.col(time) - F.min(time).over(Window.partitionBy(*keys)))


def inside_overlap(left: DataFrame, right: DataFrame, offset: Column | float = 0.0, key: str = "drive_id", time: str = "t") -> DataFrame:
    """Rows of ``left`` whose time less ``offset`` lies within ``right``'s recording."""
    bounds = right.groupBy(key).agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    shift = F.lit(offset) if not isinstance(offset, Column) else offset
    return left.join(bounds, key).where((F.col(time) - shift).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def dt_source(gap: Column, nominal: float = 0.1, low: float = 0.001, high: float = 0.5) -> tuple[Column, Column]:
    """(where a step length comes from, the step length)."""
    source = F.when(gap.isNull(), "first").when(gap <= 0, "out_of_order").when(gap.between(low, high), "event").otherwise("clamped")
    return source, F.when(gap.between(low, high), gap).otherwise(nominal)


def _tagged(left: DataFrame, right: DataFrame, value: str, key: str, time: str, tie: str, offset: Column | float) -> DataFrame:
    shift = F.lit(offset) if not isinstance(offset, Column) else offset
    l_rows = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), (F.col(time) - shift).alias("_t"), F.lit(1).alias("_own"))
    r_rows = right.select(F.col(key), F.col(value).alias("_v"), F.col(time).alias("_t"), F.lit(0).alias("_own"), F.col(tie).alias("_tie"))
    return l_rows.withColumn("_tie", F.col(tie)).unionByName(r_rows, allowMissingColumns=True)


def interpolated(left: DataFrame, right: DataFrame, value: str, out: str, offset: Column | float = 0.0, key: str = "drive_id", time: str = "t", tie: str = "event_id") -> DataFrame:
    """``left`` with ``right``'s value at each row's time, linear between its neighbours; rows outside are dropped."""
    both = _tagged(left, right, value, key, time, tie, offset)
    at = F.when(F.col("_own") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    before = Window.partitionBy(key).orderBy("_t", "_own", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy("_t", F.desc("_own"), "_tie").rowsBetween(0, Window.unboundedFollowing)
    low, high = F.col("_low"), F.col("_high")
    line = F.when(high["t"] > low["t"], low["v"] + (high["v"] - low["v"]) * (F.col("_t") - low["t"]) / (high["t"] - low["t"])).otherwise(low["v"])
    both = both.withColumn("_low", F.last(at, True).over(before)).withColumn("_high", F.first(at, True).over(after))
    return both.where((F.col("_own") == 1) & low.isNotNull() & high.isNotNull()).withColumn(out, line).select(*left.columns, out)


def latest(left: DataFrame, right: DataFrame, columns: list[str], key: str = "drive_id", time: str = "t", tie: str = "event_id", most_age: float | None = None) -> DataFrame:
    """``left`` with the last row of ``right`` at or before each time, as ``columns`` and ``age``; null where there is none or it is older than ``most_age``."""
    l_rows = left.select("*", F.lit(1).alias("_own"), F.col(time).alias("_t"), F.col(tie).alias("_tie"))
    packed = F.struct(F.col(time).alias("_at"), *columns)
    r_rows = right.select(F.col(key), F.lit(0).alias("_own"), F.col(time).alias("_t"), F.col(tie).alias("_tie"), packed.alias("_fix"))
    order = Window.partitionBy(key).orderBy("_t", "_own", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = l_rows.unionByName(r_rows, allowMissingColumns=True).withColumn("_fix", F.last("_fix", True).over(order)).where("_own = 1")
    age = F.col("_t") - F.col("_fix._at")
    fresh = age.isNotNull() & (age <= most_age if most_age is not None else F.lit(True))
    return both.select(*left.columns, *[F.when(fresh, F.col(f"_fix.{c}")).alias(c) for c in columns], age.alias("age"))


def fresh(frames: DataFrame, keys: list[str], time_slack: float = 1e-4, place_slack: float = 1e-9) -> DataFrame:
    """Per frame (t, event_id, fix_t, lat, lon, denied) whether its fix is a new one: (keys, ``event_id``, ``fresh``).

    A fix is repeated in frames until the receiver has another. New is what
    differs from the last fix that was taken as new, in its time or its place;
    a fix without a time is told by its place. Frames without a finite place,
    and denied ones, have none and change nothing.
    """

    def machine():
        last = None

        def step(t, event, fix_t, lat, lon, denied):
            nonlocal last
            if denied or lat is None or lon is None or not (math.isfinite(lat) and math.isfinite(lon)):
                return ((event, False),)
            timed = last is not None and fix_t is not None and last[0] is not None
            new = last is None or (timed and abs(fix_t - last[0]) > time_slack) or abs(lat - last[1]) > place_slack or abs(lon - last[2]) > place_slack
            if new:
                last = fix_t, lat, lon
            return ((event, new),)

        return step

    return scan(frames, keys, ["t", "event_id"], ["fix_t", "lat", "lon", "denied"], machine, "event_id long, fresh boolean")


def lag_correlations(p: np.ndarray, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correlation of p[k] with v[k - m] over the points that both have, for every lag m from -most to most at once.

    NaN marks points without a value. Sums, squares and products over the
    overlap of each lag are correlations themselves, all by FFT. Returns
    (correlation, overlapping points, variance of v in the overlap).
    """
    shift = lambda x: np.nan_to_num(x - np.nanmean(x)) if np.isfinite(x).any() else np.zeros_like(x)
    a, b, ka, kb = shift(p), shift(v), np.isfinite(p).astype(float), np.isfinite(v).astype(float)
    size = 1 << (len(a) + len(b) + 2 * most).bit_length()
    fft = {name: np.fft.rfft(x, size) for name, x in {"a": a, "aa": a * a, "ka": ka, "b": b, "bb": b * b, "kb": kb}.items()}
    lags = np.arange(-most, most + 1)
    of = lambda x, y: np.fft.irfft(fft[x] * np.conj(fft[y]), size)[lags % size]
    n = np.rint(of("ka", "kb"))
    some = np.maximum(n, 1)
    ma, mb = of("a", "kb") / some, of("ka", "b") / some
    va, vb = of("aa", "kb") / some - ma**2, of("ka", "bb") / some - mb**2
    r = (of("a", "b") / some - ma * mb) / np.sqrt(np.maximum(va * vb, 1e-30))
    return np.where((va > 1e-8) & (vb > 1e-8), r, -2.0), n, vb


def on_grid(t: np.ndarray, x: np.ndarray, step: float) -> np.ndarray:
    """A signal at its first time and every ``step`` after it, linear between its values; NaN values are left out."""
    known = np.isfinite(x)
    at = t[0] + step * np.arange(int(np.floor((t[-1] - t[0]) / step + 1e-6)) + 1)
    if not known.any():
        return np.full(len(at), np.nan)
    return np.where((at >= t[known][0] - 1e-9) & (at <= t[known][-1] + 1e-9), np.interp(at, t[known], x[known]), np.nan)


def clock_offsets(phone: DataFrame, vehicle: DataFrame, window: float = 60.0, step: float = 0.1, least: int = 50) -> DataFrame:
    """Per drive the clock offset (``tau``), the nominal one (``tau0``) and their correlation (``r``).

    Both tables have drive_id, t and speed. Offsets up to ``window`` seconds
    around the difference of the first times are tried; one needs over
    ``least`` overlapping points and speeds that vary. Both signals are put on
    a grid of ``step`` seconds and all offsets are evaluated at once by FFT; of
    equal ones the nominal offset is taken, then the smallest.
    """

    def search(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("t"), b.sort_values("t")
        if not len(a) or not len(b):
            return pd.DataFrame({"drive_id": [key[0]], "tau": [0.0], "tau0": [0.0], "r": [0.0]})
        tp, tv, sp, sv = (x.to_numpy(float) for x in (a["t"], b["t"], a["speed"], b["speed"]))
        tau0, most = tp[0] - tv[0], int(round(window / step))
        valid = np.isfinite(sp)
        if valid.sum() < least or np.isfinite(sv).sum() < least or np.std(sp[valid]) < 1e-3:
            return pd.DataFrame({"drive_id": [key[0]], "tau": [tau0], "tau0": [tau0], "r": [1.0]})
        r, n, _ = lag_correlations(on_grid(tp, sp, step), on_grid(tv, sv, step), most)
        r = np.where(n > least, r, -2.0)
        order = np.r_[most, 0:most, most + 1 : 2 * most + 1]  # the nominal offset first
        best = order[np.flatnonzero(r[order] >= r.max() - 1e-9)[0]]
        if r[best] <= -1.5:
            return pd.DataFrame({"drive_id": [key[0]], "tau": [tau0], "tau0": [tau0], "r": [-1.0]})
        return pd.DataFrame({"drive_id": [key[0]], "tau": [tau0 + (best - most) * step], "tau0": [tau0], "r": [float(r[best])]})

    kind = phone.schema["drive_id"].dataType.simpleString()
    return phone.select("drive_id", "t", "speed").groupBy("drive_id").cogroup(vehicle.select("drive_id", "t", "speed").groupBy("drive_id")).applyInPandas(search, f"drive_id {kind}, tau double, tau0 double, r double")
