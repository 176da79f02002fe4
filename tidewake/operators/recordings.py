"""Grouped maps over whole recordings: alignment, filters, generated training triples, learned gains."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions.draws import normal
from .kernels import alignment, devices, unscented
from .kernels.inertial import Inertial
from .kernels.planar import Planar
from .models import Linear, normal_equations, ridge
from .simulate import Config, by_length, scores


def aligned(df: DataFrame, keys: list[str], still_speed: float = 5.0) -> DataFrame:
    """Per row (``event_id``) the staged alignment's state and rotation after it, in time order, without looking ahead."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"])
        machine, states, turns = alignment.Staged(), [], []
        for acc, speed in zip(pdf[["ax", "ay", "az"]].to_numpy(float), pdf["speed"].to_numpy(float), strict=True):
            states.append(machine.update(acc, speed < still_speed, speed))
            turns.append(np.round(machine.rotation.ravel(), 6).tolist())
        return pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "state": states, "rotation": turns})

    return df.select(*keys, "t", "event_id", "ax", "ay", "az", "speed").groupBy(*keys).applyInPandas(work, "event_id long, state string, rotation array<double>")


def batch_aligned(df: DataFrame, keys: list[str], gravity_rows: int, motion_rows: int) -> DataFrame:
    """Per recording its rotation and state: gravity from the first rows, the forward axis from those after."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        acc = pdf.sort_values(["t", "event_id"])[["ax", "ay", "az"]].to_numpy(float)
        turn, state = alignment.whole(acc[:gravity_rows], acc[gravity_rows : gravity_rows + motion_rows])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "state": [state], "rotation": [turn.ravel().tolist()]})

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*keys, "t", "event_id", "ax", "ay", "az").groupBy(*keys).applyInPandas(work, ", ".join(f"{k} {types[k]}" for k in keys) + ", state string, rotation array<double>")


#: Rows that a task steps at once.
MOST = 400_000


def side_by_side(df: DataFrame, keys: list[str], inputs: tuple[str, ...], outputs: dict[str, str], begin, step, last: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Recordings in order of time through a state machine, many at once: a row of ``outputs`` for every row, or for the last of each.

    ``begin(n)`` makes the state of n recordings; ``step(state, values, on)``
    gets the inputs by name, (n,) each, and a mask of the recordings that still
    run, and returns the outputs by name. Recordings are dealt by key in one
    shuffle and sorted; a task takes whole ones until it has about :data:`MOST`
    rows. Those of like length advance together, and leave once they have
    ended. ``carried`` are columns of ``df`` that the rows keep.
    """

    def advance(pdf: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
        lengths = np.unique(run, return_counts=True)[1]
        first = np.r_[0, np.cumsum(lengths)[:-1]]
        state, values = begin(len(lengths)), pdf[list(inputs)].astype(float).to_numpy()
        out = {c: np.empty(len(pdf), {"string": object, "boolean": bool}.get(t, float)) for c, t in outputs.items()}
        here = np.arange(len(lengths))
        for k in range(int(lengths.max())):
            on = k < lengths[here]
            if np.count_nonzero(on) < 0.9 * len(here):
                state, here, on = devices.taken(state, on), here[on], on[on]
            at = np.minimum(first[here] + k, len(pdf) - 1)
            found = step(state, dict(zip(inputs, values[at].T, strict=True)), on)
            for c in out:
                out[c][at[on]] = found[c][on]
        kept = first + lengths - 1 if last else slice(None)
        return pd.DataFrame({**{c: pdf[c].to_numpy()[kept] for c in named}, **{c: v[kept] for c, v in out.items()}})

    def numbered(pdf: pd.DataFrame) -> np.ndarray:
        return pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, most = [], 0, MOST
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= most:
                whole = pd.concat(held, ignore_index=True)
                run = numbered(whole)
                end = int((run < run[-1]).sum())  # the last recording may go on in the next batch
                for part in by_length(run[:end]) if end else ():
                    yield advance(whole[:end][part], run[:end][part])
                held, rows = [whole[end:]], len(whole) - end
                most = max(MOST, 2 * rows)
        if rows:
            whole = pd.concat(held, ignore_index=True)
            run = numbered(whole)
            for part in by_length(run):
                yield advance(whole[part], run[part])

    named = list(dict.fromkeys([*keys, "event_id", *carried]))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    taken = df.select(*named, *["t"] * ("t" not in (*inputs, *named)), *[F.col(c).cast("double") for c in inputs if c not in named])
    schema = [f"{c} {types[c]}" for c in named] + [f"{c} {t}" for c, t in outputs.items()]
    ordered = shared.dealt(taken, *keys).sortWithinPartitions(*keys, F.col("t").asc_nulls_last(), F.col("event_id").asc_nulls_last())
    return ordered.mapInPandas(work, ", ".join(schema))


def frames(df: DataFrame, keys: list[str], kind: str = "inertial", shown: tuple[str, ...] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """The live frame step over finished recordings: one row for each, with the columns of ``OUTPUTS`` or those ``shown``.

    ``df`` has ``event_id`` and the columns of ``INPUTS``; its columns ``carried`` stay.
    """
    from .kernels.frames import INPUTS, OUTPUTS, Frames

    outputs = {c: OUTPUTS[c] for c in shown or OUTPUTS}
    return side_by_side(df, keys, INPUTS, outputs, lambda n: Frames(n, kind), lambda machine, values, on: machine.step(values, on), carried=carried)


def fused(df: DataFrame, keys: list[str], kind: str = "planar", dark: str | None = None) -> DataFrame:
    """The fusion step over recordings' rows: predict, standstill, position fix or sideways and model-speed updates.

    Returns per row position, speed and the position deviation.
    """

    def step(f, at: dict[str, np.ndarray], on: np.ndarray) -> dict[str, np.ndarray]:
        acc, gyro = (np.stack([at[c] for c in group], 1) for group in (("ax", "ay", "az"), ("gx", "gy", "gz")))
        if kind == "planar":
            f.predict(acc[:, 0], gyro[:, 2])
        else:
            f.predict(acc, gyro)
        still, hidden = on & (at["speed"] < 0.5), on & (at["dark"] > 0.5)
        if still.any():
            f.standstill(gyro[:, 2] if kind == "planar" else gyro, where=still)
        f.position(np.stack([at["east"], at["north"], np.zeros(len(on))], 1), where=on & ~hidden)
        if hidden.any():
            f.sideways(where=hidden)
            f.speed(at["speed"], 3.0, where=hidden)
        x = f.x if kind == "planar" else np.concatenate([f.p, f.v], 1)
        cov = f.p if kind == "planar" else f.cov
        return {"pe": x[:, 0], "pn": x[:, 1], "v": np.hypot(x[:, 3], x[:, 4]), "sd": np.sqrt(np.maximum(cov[:, 0, 0], 0))}

    inputs = ("ax", "ay", "az", "gx", "gy", "gz", "east", "north", "speed", "dark")
    rows = df.withColumn("dark", F.expr(dark) if dark else F.lit(False))
    return side_by_side(rows, keys, inputs, dict.fromkeys(("pe", "pn", "v", "sd"), "double"), (Planar if kind == "planar" else Inertial).start, step)


def exported(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean deviations of the inertial filter's blocks after each recording's last row."""

    def step(f: Inertial, at: dict[str, np.ndarray], on: np.ndarray) -> dict[str, np.ndarray]:
        f.predict(*(np.stack([at[c] for c in group], 1) for group in (("ax", "ay", "az"), ("gx", "gy", "gz"))))
        f.position(np.stack([at["east"], at["north"], np.zeros(len(on))], 1), where=on)
        return f.deviations()

    inputs = ("ax", "ay", "az", "gx", "gy", "gz", "east", "north")
    return side_by_side(df, keys, inputs, dict.fromkeys(("position", "velocity", "attitude", "acc_bias", "gyro_bias"), "double"), Inertial.start, step, last=True)


def unscented_speed(df: DataFrame, keys: list[str], dt: float = 0.1) -> DataFrame:
    """Speed and its rate of change by an unscented filter of each recording's measured speeds."""
    noise = np.diag([0.01, 0.1])

    def step(state: dict, at: dict[str, np.ndarray], on: np.ndarray) -> dict[str, np.ndarray]:
        x, p = unscented.predict(state["x"], state["p"], lambda s: np.stack([s[:, 0] + dt * s[:, 1], s[:, 1]], 1), noise)
        state["x"], state["p"] = unscented.update(x, p, at["speed"][:, None], lambda s: s[:, :1], np.eye(1))
        return {"v": state["x"][:, 0], "rate": state["x"][:, 1]}

    return side_by_side(df, keys, ("speed",), {"v": "double", "rate": "double"}, lambda n: {"x": np.zeros((n, 2)), "p": np.tile(np.eye(2), (n, 1, 1))}, step)


def gain_triples(windows: DataFrame, seed: int = 42, keys: tuple[str, ...] = ("drive_id", "segment", "start")) -> DataFrame:
    """(innovation, state, gain) triples of planar filters, one for each window (keys, acc, rate: arrays of like length).

    A filter starts with a drawn velocity, is predicted through the window's
    forward acceleration and yaw rate and meets a fix with a drawn error. What
    is drawn follows from the window's keys. No windows give no triples.
    """
    several = lambda name, n, size: F.array(*[size * normal(seed, f"{name}{k}", *keys) for k in range(n)]).alias(name)

    def work(batches):
        for pdf in batches:
            n = len(pdf)
            if n:
                f, acc, rate = Planar.start(n), np.stack(pdf["acc"]), np.stack(pdf["rate"])
                f.x[:, 3:5] = np.stack(pdf["velocity"])
                for k in range(acc.shape[1]):
                    f.predict(acc[:, k], rate[:, k])
                s = f.p[:, :3, :3] + 9 * np.eye(3)
                gain = np.linalg.solve(s, f.p[:, :3, :]).transpose(0, 2, 1)
                yield pd.DataFrame({"innovation": list(np.stack(pdf["error"])), "state": f.x.tolist(), "gain": gain.reshape(n, 27).tolist()})

    seen = windows.select("acc", "rate", several("velocity", 2, 10.0), several("error", 3, 3.0))
    return seen.mapInPandas(work, "innovation array<double>, state array<double>, gain array<double>")


def blended_gain(gain: np.ndarray, learned: np.ndarray, most: float = 10.0) -> np.ndarray:
    """0.8 of a learned gain and 0.2 of the filter's; the filter's alone if the learned one is not finite or far larger."""
    odd = ~np.isfinite(learned).all((1, 2)) | (np.linalg.norm(np.nan_to_num(learned), axis=(1, 2)) > most * (np.linalg.norm(gain, axis=(1, 2)) + 1e-4))
    return np.where(odd[:, None, None], gain, 0.8 * np.nan_to_num(learned) + 0.2 * gain)


def _gain_features(pdf: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.stack(pdf["innovation"]), np.stack(pdf["state"]), np.ones((len(pdf), 1))], 1)


def gain_model(triples: DataFrame, l2: float = 1e-3) -> np.ndarray:
    """Ridge weights from innovation and state to the gain, fitted on all triples; the gain net's stand-in."""
    found = normal_equations(triples, lambda pdf: (_gain_features(pdf), np.stack(pdf["gain"])))
    if found is None:
        raise ValueError("no triples to learn a gain from")
    return ridge(*found, l2)


def with_learned_gain(triples: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds the model's gain as ``learned`` and the gain to be used as ``blended``."""

    def work(batches):
        for pdf in batches:
            if len(pdf):
                learned, gain = _gain_features(pdf) @ weights, np.stack(pdf["gain"])
                blended = blended_gain(gain.reshape(len(pdf), -1, 3), learned.reshape(len(pdf), -1, 3)).reshape(gain.shape)
                yield pdf.assign(learned=learned.tolist(), blended=blended.tolist())

    return triples.mapInPandas(work, "innovation array<double>, state array<double>, gain array<double>, learned array<double>, blended array<double>")


#: Devices that a call serves in the latency profile.
LIVE = 32


def latency(rows: DataFrame) -> DataFrame:
    """(part, calls, ms): the mean time that a row waits for each part of the step, called for every row on its channels.

    As in the stream, rows are served side by side, ``LIVE`` devices a call, and
    every row of a call waits for the whole of it. Each batch has inertial
    filters of its own and a warm-up; times are added inside batches first. No
    rows give no parts.
    """

    def work(batches):
        f, model = Inertial.start(LIVE), Linear(np.zeros((19, 1)))
        acc, gyro, origin, window = np.zeros((LIVE, 3)), np.zeros((LIVE, 3)), np.zeros((LIVE, 3)), np.zeros((LIVE, 6, 50))
        parts = {"predict": lambda: f.predict(acc, gyro), "sideways": f.sideways, "fix": lambda: f.position(origin), "inference": lambda: model.predict(window)}
        for _ in range(20):
            for call in parts.values():
                call()
        for pdf in batches:
            spent = dict.fromkeys(parts, 0.0)
            forces, rates = (pdf[list(c)].to_numpy(float) for c in (("ax", "ay", "az"), ("gx", "gy", "gz")))
            for k in range(0, len(pdf), LIVE):
                n = min(LIVE, len(pdf) - k)
                acc[:n], gyro[:n] = forces[k : k + n], rates[k : k + n]
                for name, call in parts.items():
                    begun = time.perf_counter()
                    call()
                    spent[name] += n * (time.perf_counter() - begun)
            yield pd.DataFrame({"part": list(spent), "calls": len(pdf), "seconds": list(spent.values())})

    timed = shared.dealt(rows.select("ax", "ay", "az", "gx", "gy", "gz"), "ax", "ay", "gx").mapInPandas(work, "part string, calls long, seconds double")
    return timed.groupBy("part").agg(F.sum("calls").alias("calls"), (F.sum("seconds") * 1000 / F.sum("calls")).alias("ms")).where("calls > 0")


def study(samples: DataFrame, configs: tuple[Config, ...]) -> DataFrame:
    """Errors inside the outage per run and configuration: distance, final error, drift, pass."""
    scored = scores(samples, configs)
    return scored.withColumn("drift", 100 * F.col("final") / F.greatest(F.col("distance"), F.lit(1.0))).withColumn("pass", F.col("drift") < 10)
