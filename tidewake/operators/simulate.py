"""Navigation runs over a scenario grid: one parameterised simulator for all baselines and ablations.

Runs (scenario x configuration) are dealt into buckets of many runs; a bucket
is one grouped map in which the kernels advance all its runs together, step by
step. Work per task follows the bucket size, not a scenario's popularity.
"""

from __future__ import annotations

import copy
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from .kernels import rotation
from .kernels.inertial import GRAVITY, Inertial
from .kernels.planar import Planar

CHANNELS = ("ax", "ay", "az", "gx", "gy", "gz", "ref_e", "ref_n", "speed", "model_speed", "inside")


@dataclass(frozen=True)
class Config:
    """What a run uses during the outage; oracle flags replace an input by the truth."""

    name: str
    filter: str = "planar"  # planar, inertial or none (speed and heading kept)
    model_speed: bool = True
    sideways: bool = True
    policy: str = "decouple"
    zero_bias: bool = False
    true_speed: bool = False
    true_yaw: bool = False
    true_force: bool = False
    leveling: str = ""  # a name of LEVELING, or none


@dataclass(frozen=True)
class Leveling:
    """When the inertial filter is levelled, and how far motion widens the deviation along (0) and across (1)."""

    sigma: float = 0.3
    widen: tuple[float, float] = (0.0, 0.0)
    most_sigma: float = 5.0
    most_excess: float = np.inf  # of the specific force's norm over gravity's
    most_forward: float = np.inf
    most_rate: float = np.inf

    def apply(self, f: Inertial, acc: np.ndarray, forward: np.ndarray) -> np.ndarray:
        rate = f.rate[:, 2] - f.bg[:, 2]
        across = rate * f.body_velocity[:, 0]
        excess = np.abs(np.linalg.norm(acc, axis=1) - 9.80665)
        calm = (excess <= self.most_excess) & (np.abs(forward) < self.most_forward) & (np.abs(rate) < self.most_rate)
        wide = np.hypot(self.sigma, np.stack([self.widen[0] * forward, self.widen[1] * across], 1))
        return f.gravity(acc, np.clip(wide, self.sigma, self.most_sigma), forward, calm)


# The levelling policies compared.
LEVELING = {
    "fixed": Leveling(most_forward=2.0, most_rate=0.2),
    "adaptive": Leveling(widen=(0.6, 0.8), most_excess=10.0),
    "steady": Leveling(most_excess=1.2),
    "full": Leveling(sigma=0.25, widen=(0.5, 0.6), most_excess=1.8),
}

BASELINES = (
    Config("inertial_only", "inertial", model_speed=False, sideways=False),
    Config("model", "inertial", sideways=False),
    Config("full", "inertial"),
    Config("planar", "planar"),
    Config("constant_velocity", "none"),
)


def run(batch: dict[str, np.ndarray], config: Config, dt: float = 0.1, begun: dict | None = None) -> np.ndarray:
    """Positions (runs, steps, 2). Channels are (runs, steps); NaN marks steps a run does not have.

    ``begun`` keeps the filters at the batch's first dark step for the
    configurations that do not differ before it, so that those steps are taken once.
    """
    n, steps = batch["ax"].shape
    out = np.full((n, steps, 2), np.nan)
    fill = {k: np.nan_to_num(v) for k, v in batch.items()}
    inside = fill["inside"] > 0.5
    ref = np.stack([fill["ref_e"], fill["ref_n"], np.zeros((n, steps))], 2)
    first = ref[:, min(1, steps - 1)] - ref[:, 0]
    yaw = np.arctan2(first[:, 1], first[:, 0])
    speed = fill["speed"]
    course = np.arctan2(np.gradient(ref[..., 1], axis=1), np.gradient(ref[..., 0], axis=1)) if steps > 1 else np.zeros((n, steps))
    if config.filter == "none":
        held = np.where(inside, 0, np.arange(steps))
        last = np.maximum.accumulate(held, 1)
        rows = np.arange(n)[:, None]
        since = (np.arange(steps) - last) * dt
        move = (speed[rows, last] * since)[..., None] * np.stack([np.cos(course[rows, last]), np.sin(course[rows, last])], 2)
        return np.where(np.isnan(batch["ax"])[..., None], np.nan, ref[rows, last][..., :2] + move)
    if config.filter == "planar":
        f = Planar.start(n, dt)
        f.x[:, :3], f.x[:, 6] = ref[:, 0], yaw
        f.x[:, 3], f.x[:, 4] = speed[:, 0] * np.cos(yaw), speed[:, 0] * np.sin(yaw)
    else:
        f = Inertial.start(n)
        f.level(np.stack([fill[c][:, 0] for c in ("ax", "ay", "az")], 1), yaw)
        f.p, f.v = ref[:, 0].copy(), np.stack([speed[:, 0] * np.cos(yaw), speed[:, 0] * np.sin(yaw), np.zeros(n)], 1)
    driven = speed[..., None] * np.stack([np.cos(course), np.sin(course), np.zeros((n, steps))], 2)
    ahead, start = speed[:, 0], 0
    lit = int(np.flatnonzero(inside.any(0))[0]) if inside.any() else steps
    alike = (config.filter, config.zero_bias, config.true_yaw, config.leveling)
    if begun and alike in begun:
        f, ahead, out[:, :lit] = copy.deepcopy(begun[alike])
        start = lit
    for t in range(start, steps):
        if t == lit and begun is not None:
            begun[alike] = copy.deepcopy((f, ahead, out[:, :lit]))
        acc, gyro = (np.stack([fill[c][:, t] for c in names], 1) for names in (("ax", "ay", "az"), ("gx", "gy", "gz")))
        if config.filter == "planar":
            f.predict(acc[:, 0], gyro[:, 2])
        else:
            if config.zero_bias:
                f.ba = np.zeros((n, 3))
            if config.true_yaw:
                roll, pitch, _ = rotation.euler(f.body).T
                f.q = rotation.of_euler(roll, pitch, course[:, t])
            if config.true_force:
                push = (driven[:, t] - driven[:, max(0, t - 1)]) / dt - GRAVITY
                acc = np.where(inside[:, t, None], (f.body.transpose(0, 2, 1) @ push[..., None])[..., 0], acc)
            f.predict(acc, gyro, dt)
            if config.leveling:
                before, ahead = ahead, f.body_velocity[:, 0]
                LEVELING[config.leveling].apply(f, acc, (ahead - before) / dt)
        dark = inside[:, t]
        f.position(ref[:, t], where=~dark)
        if config.sideways:
            f.sideways(where=dark) if config.filter == "planar" else f.sideways(policy=config.policy, where=dark)
        if config.model_speed or config.true_speed:
            f.speed(speed[:, t] if config.true_speed else fill["model_speed"][:, t], 3.0, where=dark)
        out[:, t] = (f.x if config.filter == "planar" else f.p)[:, :2]
    return np.where(np.isnan(batch["ax"])[..., None], np.nan, out)


def by_length(run: np.ndarray):
    """Masks of rows whose runs are of like length, at most twice apart: what is padded stays below the data."""
    lengths = np.bincount(run)
    size = np.floor(np.log2(lengths.max() / lengths)).astype(int)[run]
    for s in np.unique(size):
        yield size == s


def simulate(rows: DataFrame, configs: tuple[Config, ...] = BASELINES, runs_per_bucket: int = 256, dt: float = 0.1) -> DataFrame:
    """(run, config, step, east, north, err, inside, moved) from samples (run, step, channels of CHANNELS, metres ``moved``).

    ``run`` is any key of a scenario. Samples are dealt into buckets of runs in
    one shuffle; runs of like length are laid into arrays together, and every
    configuration runs over them.
    """

    def shown(keys, batch, found, err) -> dict:
        at, step = np.nonzero(~np.isnan(found[..., 0]))
        e, n = found[at, step].T
        return {"run": keys[at], "step": step, "east": e, "north": n, "err": err[at, step], "inside": batch["inside"][at, step] > 0.5, "moved": batch["moved"][at, step]}

    return _side_by_side(rows, configs, runs_per_bucket, dt, shown, "step int, east double, north double, err double, inside boolean, moved double", False)


def scores(rows: DataFrame, configs: tuple[Config, ...] = BASELINES, runs_per_bucket: int = 256, dt: float = 0.1) -> DataFrame:
    """(run, config, final, rmse, worst, distance) inside the outage, from the samples of :func:`simulate`.

    Added up where the positions are, so no row a step leaves the task; steps
    behind the last outage of a batch have no part in it and are not taken.
    """

    def scored(keys, batch, found, err) -> dict:
        inside = (batch["inside"] > 0.5) & ~np.isnan(found[..., 0])
        kept = inside.any(1)
        inside, err, moved = inside[kept], err[kept], batch["moved"][kept]
        last = inside.shape[1] - 1 - np.argmax(inside[:, ::-1], 1)
        known, gone = inside & ~np.isnan(err), inside & ~np.isnan(moved)
        n, some = known.sum(1), known.any(1)
        square = np.where(known, err * err, 0.0).sum(1)
        return {
            "run": keys[kept], "final": err[np.arange(len(err)), last], "rmse": np.where(some, np.sqrt(square / np.maximum(n, 1)), np.nan),
            "worst": np.where(some, np.where(known, err, -np.inf).max(1), np.nan), "distance": np.where(gone.any(1), np.where(gone, moved, 0.0).sum(1), np.nan),
        }

    return _side_by_side(rows, configs, runs_per_bucket, dt, scored, "final double, rmse double, worst double, distance double", True)


def _side_by_side(rows: DataFrame, configs: tuple[Config, ...], runs_per_bucket: int, dt: float, answer, columns: str, only_inside: bool) -> DataFrame:
    listed = [asdict(c) for c in configs]
    kind = rows.schema["run"].dataType.simpleString()

    def advance(pdf: pd.DataFrame) -> list[pd.DataFrame]:
        codes, keys = pd.factorize(pdf["run"])
        if only_inside:
            at = pdf.loc[pdf["inside"].astype(float) > 0.5, "step"]
            if at.empty:
                return []
            # two steps at least, as the first course needs them, and one more for the last course
            near = (pdf["step"] <= max(2, int(at.max()) + 1)).to_numpy()
            pdf, codes = pdf[near], codes[near]
        width = int(pdf["step"].max()) + 1
        batch = {c: np.full((len(keys), width), np.nan) for c in (*CHANNELS, "moved")}
        for c in batch:
            batch[c][codes, pdf["step"].to_numpy()] = pdf[c].astype(float).to_numpy()
        frames, begun = [], {}
        for c in listed:
            found = run({k: batch[k] for k in CHANNELS}, Config(**c), dt, begun)
            err = np.hypot(found[..., 0] - batch["ref_e"], found[..., 1] - batch["ref_n"])
            frames.append(pd.DataFrame({"config": c["name"], **answer(keys, batch, found, err)}))
        return frames

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["run", "config", *(c.split()[0] for c in columns.split(", "))]
        found = [f for part in by_length(pd.factorize(pdf["run"])[0]) for f in advance(pdf[part])]
        return pd.concat(found)[names] if found else pd.DataFrame({c: [] for c in names})

    # the number of buckets is one row, worked out within the job; few runs still give every partition a bucket
    runs, parts = F.approx_count_distinct("run"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = rows.agg(F.greatest(F.lit(1), F.floor(runs / runs_per_bucket), F.least(F.floor(runs * 2 / runs_per_bucket), F.lit(parts))).alias("_n"))
    dealt = rows.select("run", "step", *CHANNELS, "moved").join(F.broadcast(buckets)).withColumn("_bucket", F.pmod(F.xxhash64("run"), "_n"))
    return shared.dealt(dealt, "_bucket").groupBy("_bucket").applyInPandas(work, f"run {kind}, config string, {columns}")
