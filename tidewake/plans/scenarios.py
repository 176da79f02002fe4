"""Outage scenarios: found by prefix sums, classified, picked, perturbed and crossed with configurations.

A scenario is a row (drive, first, last), never a copy of samples; samples
meet it in an equi-join on the drive with a range condition on the row number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import drawn, normal
from ..operators.estimators import order, with_steps
from ..operators.fold import scan
from ..operators.numbering import numbered
from ..shared import saved


def outages(df: DataFrame, length: int, first: int, every: int, least_metres: float) -> DataFrame:
    """Candidate outages of ``length`` rows: (drive_id, first, last exclusive, dist, yaw, sd)."""
    o = order()
    ahead = o.rowsBetween(0, length - 1)
    df = with_steps(df).withColumn("idx", F.row_number().over(o) - 1)
    dist = F.sum("step").over(o.rowsBetween(1, length - 1))
    full = F.count("*").over(ahead) == length
    df = df.select("drive_id", F.col("idx").alias("first"), (F.col("idx") + length).alias("last"), dist.alias("dist"), F.avg(F.abs("gz")).over(ahead).alias("yaw"), F.stddev_pop("speed").over(ahead).alias("sd"), full.alias("full"))
    return df.where((F.col("first") >= first) & (F.col("first") % every == 0) & F.col("full") & (F.col("dist") >= least_metres)).drop("full")


def classified(scenarios: DataFrame, most_yaw: float = 0.02, most_sd: float = 2.0) -> DataFrame:
    return scenarios.withColumn("class", F.when(F.col("yaw") > most_yaw, "curve").when(F.col("sd") > most_sd, "variation").otherwise("straight"))


#: Motion regimes in the order in which a window asks for them (m/s and degrees a second).
REGIMES = {
    "turning": "yaw > 5",
    "accel_decel": "delta > 6",
    "high_speed": "mean > 15 AND yaw < 2.5",
    "low_speed": "mean < 4",
    "straight": "yaw < 2 AND mean >= 4",
}


def candidates(df: DataFrame, lengths: tuple[int, ...], first: int, every: int, after: int, dt: float = 0.1) -> DataFrame:
    """Windows of each length from row ``first`` on, ``every`` rows apart, with more than ``after`` rows behind them.

    All lengths share one sort. Returns (drive_id, length, first, mean, delta,
    yaw, dist): speed's mean and range, mean yaw rate in degrees, metres driven.
    """
    o = order()
    behind = F.count("*").over(Window.partitionBy("drive_id")) - F.row_number().over(o) + 1
    found = []
    for n in lengths:
        ahead = o.rowsBetween(0, n - 1)
        of = lambda a, c: a(c).over(ahead)  # noqa: B023, E731
        found.append(F.struct(F.lit(n).alias("length"), of(F.avg, "speed").alias("mean"), (of(F.max, "speed") - of(F.min, "speed")).alias("delta"), F.degrees(of(F.avg, F.abs("gz"))).alias("yaw"), (of(F.sum, "speed") * dt).alias("dist")))
    rows = df.select("drive_id", (F.row_number().over(o) - 1).cast("long").alias("first"), behind.alias("behind"), F.array(*found).alias("found"))
    rows = rows.where((F.col("first") >= first) & ((F.col("first") - first) % every == 0)).select("drive_id", "first", "behind", F.explode("found").alias("w"))
    return rows.where(F.col("behind") > F.col("w.length") + after).select("drive_id", "w.length", "first", "w.mean", "w.delta", "w.yaw", "w.dist")


def picked(windows: DataFrame, rules: dict[str, str] = REGIMES) -> DataFrame:
    """Per drive and length the first window of each regime: each window takes the first of its regimes that is still free."""
    fits = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
    rows = windows.withColumn("fits", fits)

    def machine():
        seen = set()

        def step(first, fits, mean, dist):
            regime = next((r for r in fits if r not in seen), None)
            if regime is None:
                return ()
            seen.add(regime)
            return ((first, regime, mean, dist),)

        return step

    return scan(rows, ["drive_id", "length"], ["first"], ["fits", "mean", "dist"], machine, "first long, regime string, mean double, dist double")


def grid(scenarios: DataFrame, configs: tuple[str, ...]) -> DataFrame:
    """Every scenario with every configuration (column ``config``): the axis along which work is dealt."""
    return scenarios.withColumn("config", F.explode(F.array(*map(F.lit, configs))))


def samples_of(scenarios: DataFrame, samples: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Each scenario's rows, with ``before`` and ``after`` more around; ``inside`` marks the outage itself."""
    s, x = F.col("s.first"), F.col("x.idx")
    near = x.between(s - before, F.col("s.last") + after - 1)
    rows = scenarios.alias("s").join(samples.alias("x"), (F.col("s.drive_id") == F.col("x.drive_id")) & near)
    extra = [F.col(f"x.{c}") for c in samples.columns if c != "drive_id"]
    return rows.select("s.*", *extra, ((x >= s) & (x < F.col("s.last"))).alias("inside"))


def perturbed(scenarios: DataFrame, target: int, seed: int = 42, acc_span: float = 0.3, gyro_span: float = 0.01) -> DataFrame:
    """Copies with uniform accelerometer and gyro biases, round after round, until ``target`` rows are there.

    Copy 0 is the scenario itself. The first rows in the order (drive, first)
    get one copy more than the others. Places come from sorted ranges and
    prefix counts, so no step sees all scenarios in one task; as many as there
    are or none at all stay as they are.
    """
    placed = numbered(saved(scenarios, "scenarios"), [], ["drive_id", "first"], "_idx", "_all")
    copies = F.greatest(F.floor((F.lit(target) - F.col("_idx") - 1) / F.col("_all")) + 1, F.lit(1))
    rows = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int")))).drop("_idx", "_all")
    bias = lambda span, name: F.when(F.col("copy") == 0, 0.0).otherwise((drawn(seed, name, "drive_id", "first", "copy") * 2 - 1) * span)
    return rows.withColumns({"acc_bias": bias(acc_span, "acc"), "gyro_bias": bias(gyro_span, "gyro")})


def disturbed(samples: DataFrame, seed: int = 42, acc_noise: float = 0.05, gyro_noise: float = 0.002) -> DataFrame:
    """Samples of perturbed scenarios (:func:`samples_of`) with their copy's biases and white noise on the channels, copy 0 as it is."""
    keys = ("drive_id", "first", "copy", "idx")
    noise = lambda c, bias, size: F.col(c) + F.when(F.col("copy") == 0, 0.0).otherwise(F.col(bias) + size * normal(seed, c, *keys))
    return samples.withColumns({c: noise(c, "acc_bias", acc_noise) for c in ("ax", "ay", "az")} | {c: noise(c, "gyro_bias", gyro_noise) for c in ("gx", "gy", "gz")})


def grouped(df: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """GROUPING SETS over the given key lists."""
    keys = reduce(lambda seen, s: seen + [k for k in s if k not in seen], sets, [])
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggregates)
