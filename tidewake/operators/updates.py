"""Filters' single steps on independent rows, and the audits of their motion model and derivatives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .. import shared
from .kernels import rotation
from .kernels.inertial import GRAVITY, Inertial

Arrays = dict[str, np.ndarray]


def each(df: DataFrame, key: str, inputs: tuple[str, ...], outputs: str, step: Callable[[Arrays], Arrays]) -> DataFrame:
    """``step`` on Arrow batches of rows, every row a filter of its own; nothing is shuffled.

    ``outputs`` is a schema string without the key.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key].to_numpy(), **step({c: pdf[c].to_numpy(float) for c in inputs})})

    return df.select(key, *inputs).mapInPandas(work, f"{key} {df.schema[key].dataType.simpleString()}, {outputs}")


def motions(df: DataFrame, dt: float = 0.1) -> DataFrame:
    """The inertial filter's prediction of constant motions: (motion, steps, force_x, force_y, rate, speed) to its end state.

    A motion starts at the origin, level and eastward, and is predicted ``steps`` times.
    """

    def step(x: Arrays) -> Arrays:
        n = len(x["speed"])
        f, zero = Inertial.start(n), np.zeros(n)
        f.v[:, 0] = x["speed"]
        force, rate = np.stack([x["force_x"], x["force_y"], zero], 1) - GRAVITY, np.stack([zero, zero, x["rate"]], 1)
        p, v, q = f.p, f.v, f.q
        for k in range(int(x["steps"].max())):
            f.predict(force, rate, dt)
            on = (k < x["steps"])[:, None]
            p, v, q = np.where(on, f.p, p), np.where(on, f.v, v), np.where(on, f.q, q)
        angles = rotation.euler(rotation.matrix(q))
        return {"east": p[:, 0], "north": p[:, 1], "up": p[:, 2], "speed": np.linalg.norm(v, axis=1), "roll": angles[:, 0], "pitch": angles[:, 1], "yaw": angles[:, 2]}

    return each(shared.dealt(df, "motion"), "motion", ("steps", "force_x", "force_y", "rate", "speed"), "east double, north double, up double, speed double, roll double, pitch double, yaw double", step)


def jacobian_errors(df: DataFrame, key: str, eps: float = 1e-6) -> DataFrame:
    """Per row (velocity ve, vn, vu; rotation vector rx, ry, rz) how far the body velocity's derivative is from central differences."""

    def step(x: Arrays) -> Arrays:
        f = Inertial.start(len(x["ve"]))
        f.v = np.stack([x["ve"], x["vn"], x["vu"]], 1)
        f.q = rotation.exponential(np.stack([x["rx"], x["ry"], x["rz"]], 1))
        given, v, q = f.velocity_jacobian((0, 1, 2)), f.v, f.q
        worst = np.abs(given[:, :, [0, 1, 2, *range(9, 15)]]).max((1, 2))
        for k in range(6):
            ends = []
            for sign in (1, -1):
                nudge = np.zeros((len(v), 3))
                nudge[:, k % 3] = sign * eps
                f.v, f.q = (v + nudge, q) if k < 3 else (v, rotation.product(q, rotation.exponential(nudge)))
                ends.append(f.body_velocity)
            off = np.abs((ends[0] - ends[1]) / (2 * eps) - given[:, :, 3 + k])
            worst = np.maximum(worst, off.max(1))
        return {"worst": worst}

    return each(df, key, ("ve", "vn", "vu", "rx", "ry", "rz"), "worst double", step)
