"""Generated recordings: one for every row of a table of profiles, which may be of any size; noise follows from keys.

Profiles are rows of (drive_id, cruise), cruise in m/s. No row of a profile is
an empty recording table. Profiles, small as they are, are dealt by drive into
the session's number of partitions; samples are exploded where the profile lies
and stay there for the running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import normal
from ..shared import dealt

GRAVITY = 9.80665
STEP = 0.1


def _samples(profiles: DataFrame, rows: int, dark: tuple[int, int]) -> DataFrame:
    """Steps of 0.1 s of every profile; ``dark`` is the first and the end of the span without fixes."""
    found = dealt(profiles.select("drive_id", "cruise"), "drive_id").select("drive_id", "cruise", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("idx"))
    return found.withColumns({"t": F.col("idx") * STEP, "dark": (F.col("idx") >= dark[0]) & (F.col("idx") < dark[1])})


def _moved(samples: DataFrame, speed: Column, rate: Column, noise: float, seed: int) -> DataFrame:
    """The recording of a vehicle with this speed and yaw rate: channels, heading and track."""
    o = Window.partitionBy("drive_id").orderBy("idx")
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    shake = lambda c, size: size * noise * normal(seed, c, "drive_id", "idx") if noise else F.lit(0.0)
    df = samples.withColumn("speed", speed).withColumn("_rate", rate)
    df = df.withColumn("heading", F.sum(F.col("_rate") * STEP).over(upto)).withColumn("ax", F.coalesce((F.col("speed") - F.lag("speed").over(o)) / STEP, F.lit(0.0)) + shake("ax", 1.0))
    df = df.withColumn("ay", F.col("speed") * F.col("_rate") + shake("ay", 1.0)).withColumn("az", F.lit(GRAVITY) + shake("az", 1.0))
    df = df.withColumn("gx", F.lit(0.0)).withColumn("gy", F.lit(0.0)).withColumn("gz", F.col("_rate") + shake("gz", 0.1))
    along = lambda turn: F.sum(F.col("speed") * turn("heading") * STEP).over(upto)
    return df.withColumn("east", along(F.cos)).withColumn("north", along(F.sin)).drop("_rate")


def drive(profiles: DataFrame, rows: int = 1200, dark: tuple[int, int] = (450, 750), noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Vehicle drives: pulling away, cruising, a turn, braking; a tunnel without fixes."""
    share = F.col("idx") / rows
    speed = F.when(share < 0.1, share * 10 * F.col("cruise")).when(share < 0.8, F.col("cruise")).otherwise(F.greatest(F.lit(0.0), (1 - share) * 5 * F.col("cruise")))
    return _moved(_samples(profiles, rows, dark), speed, F.when(share.between(0.4, 0.5), 0.1).otherwise(0.0), noise, seed)


def walk(profiles: DataFrame, rows: int = 900, dark: tuple[int, int] = (500, 700), noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Walks at a tenth of the cruising speed, with bobbing steps twice a second."""
    found = _moved(_samples(profiles, rows, dark), F.col("cruise") / 10, F.lit(0.0), noise, seed)
    return found.withColumn("az", F.col("az") + 2 * F.sin(F.col("t") * 4 * F.pi()))


def outage_kilometre(profiles: DataFrame) -> DataFrame:
    """Drives with 65 s in the dark: a kilometre at 15 m/s."""
    return drive(profiles, 1200, (300, 950))


def two_wheeler(profiles: DataFrame, rows: int = 600, dark: tuple[int, int] = (200, 400)) -> DataFrame:
    """S-curves with the lean that balances them."""
    df = _moved(_samples(profiles, rows, dark), F.col("cruise"), 0.3 * F.sin(F.col("t") * 0.5), 0.0, 0)
    return df.withColumn("lean", F.atan2(F.col("speed") * F.col("gz"), F.lit(GRAVITY)))
