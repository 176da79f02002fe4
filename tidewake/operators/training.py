"""Iterative training: rounds of gradient sums over a distributed table of examples.

Examples are put into a random but fixed order (a hash of their key), numbered
by sorted ranges and packed into blocks of equal size, one block a row. Every
round sends the parameters out, each task works out the gradients of its
blocks, and the driver adds them up and takes an AdamW step. A block's gradient
is rounded to fixed-point integers before it is added to others, so the sums,
and with them the weights, are the same whatever the number of tasks, cores or
executors.

A round reads ``batch`` blocks, a parameter. An epoch has at most :data:`ROUNDS`
rounds: a larger table has larger batches, not more rounds, as each costs a job
however small it is. Every example counts in every epoch. What reaches the
driver from a round is at most a vector of the model's size for each of
:data:`SLICES` files.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import saved
from .numbering import numbered

#: Gradients are summed as multiples of this.
UNIT = 2.0**-32
#: Most rounds of an epoch, and most files of a batch, whose blocks are worked on side by side.
ROUNDS, SLICES = 64, 64


@dataclass(frozen=True)
class Schedule:
    """AdamW with a cosine rate from ``rate`` to ``least``, gradients clipped to a norm of ``clip``, and a loss: ``huber``
    (with ``delta``) or ``nll``, for networks that give means and then logarithms of variances."""

    epochs: int = 20
    rate: float = 3e-3
    least: float = 1e-5
    decay: float = 1e-4
    clip: float = 2.0
    delta: float = 1.0
    batch: int = 8
    seed: int = 42
    loss: str = "huber"

    def rate_at(self, epoch: int) -> float:
        return self.least + 0.5 * (self.rate - self.least) * (1 + math.cos(math.pi * epoch / self.epochs))


@dataclass
class Trained:
    """A network with its weights; ``history`` has a row for each epoch: rate, training and validation loss, whether it was the best."""

    net: object
    theta: np.ndarray
    history: list[dict] = field(default_factory=list)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Of (n, channels, length) windows or (n, features) rows."""
        x = windows.transpose(0, 2, 1) if windows.ndim == 3 else windows
        return self.net.forward(self.theta, x)[0]


def gaussian_nll(out: np.ndarray, y: np.ndarray, most: float = 6.0) -> tuple[np.ndarray, np.ndarray]:
    """Negative log-likelihood (without its constant) of ``y`` under means and log-variances, these clamped to +-``most``, and its derivative."""
    n = y.shape[1]
    error, raw = out[:, :n] - y, out[:, n:]
    s = np.clip(raw, -most, most)
    shrunk = error * np.exp(-s)
    inside = np.abs(raw) < most
    return 0.5 * (s + error * shrunk), np.concatenate([shrunk, np.where(inside, 0.5 * (1 - error * shrunk), 0.0)], 1)


def losses(schedule: Schedule, out: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return gaussian_nll(out, y) if schedule.loss == "nll" else huber(out - y, schedule.delta)


def huber(error: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative."""
    size = np.abs(error)
    return np.where(size <= delta, 0.5 * error**2, delta * (size - 0.5 * delta)), np.clip(error, -delta, delta)


def blocks(df: DataFrame, keys: list[str], inputs: str, target: str, rows: int = 256, batch: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """(``block``, ``n``, ``shape``, ``x``, ``y``, ``batch``): the examples packed as arrays of doubles, written once, a folder a batch.

    ``inputs`` is a window (channels of values) or an array of features,
    ``target`` a number or an array. Examples with a value that is not finite
    are left out. A batch is ``batch`` consecutive blocks, or as many as make
    ``rounds`` batches of the table; the last may be smaller.
    """
    mixed = saved(df.select(F.xxhash64(*keys).alias("_mix"), *keys, F.col(inputs).alias("_x"), F.col(target).alias("_y")), "examples")
    whole = -(-mixed.count() // rows)
    batch = max(batch, -(-whole // rounds))
    placed = numbered(mixed, [], ["_mix", *keys], "_idx", "_n").withColumn("block", F.floor(F.col("_idx") / rows))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        x = np.asarray([np.stack(v).T if np.ndim(v[0]) else v for v in pdf["_x"]], float)
        y = np.asarray(pdf["_y"].tolist(), float).reshape(len(pdf), -1)
        good = np.isfinite(x.reshape(len(x), -1)).all(1) & np.isfinite(y).all(1)
        return pd.DataFrame({"block": [key[0]], "n": [int(good.sum())], "shape": [list(x.shape[1:])], "x": [x[good].tobytes()], "y": [y[good].tobytes()]})

    packed = placed.groupBy("block").applyInPandas(pack, "block long, n long, shape array<long>, x binary, y binary").withColumn("batch", F.floor(F.col("block") / batch))
    # a file for each slice of a batch, of at least eight blocks: a round's tasks are its files
    slices = max(1, min(SLICES, batch // 8))
    return saved(packed.repartition("batch", F.col("block") % slices), "blocks", "batch")


def arrays(row) -> tuple[np.ndarray, np.ndarray]:
    n = int(row.n)
    return np.frombuffer(row.x).reshape(n, *[int(k) for k in row.shape]), np.frombuffer(row.y).reshape(n, -1)


def block_gradient(net, theta: np.ndarray, x: np.ndarray, y: np.ndarray, schedule: Schedule) -> tuple[np.ndarray, float]:
    """The gradient of a block's summed loss in multiples of :data:`UNIT`, and the loss."""
    out, kept = net.forward(theta, x)
    loss, d = losses(schedule, out, y)
    return np.rint(net.backward(theta, kept, d) / UNIT).astype(np.int64), float(loss.sum())


def _over(table: DataFrame, work: Callable, schema: str) -> list:
    return table.mapInPandas(work, schema).collect()


def gradient(table: DataFrame, net, theta: np.ndarray, schedule: Schedule) -> tuple[np.ndarray, float, int]:
    """Mean gradient and loss over the blocks of ``table``, one vector a task."""
    sent = table.sparkSession.sparkContext.broadcast(theta)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n = np.zeros(net.size, np.int64), 0.0, 0
        for pdf in batches:
            for row in pdf.itertuples():
                if row.n:
                    g, own = block_gradient(net, sent.value, *arrays(row), schedule)
                    total, loss, n = total + g, loss + own, n + int(row.n)
        if n:
            yield pd.DataFrame({"g": [total.tobytes()], "loss": [loss], "n": [n]})

    parts = _over(table.select("block", "n", "shape", "x", "y"), work, "g binary, loss double, n long")
    sent.destroy()
    n = sum(p["n"] for p in parts)
    total = sum((np.frombuffer(p["g"], np.int64) for p in parts), np.zeros(net.size, np.int64))
    return total * (UNIT / max(n, 1)), sum(p["loss"] for p in parts) / max(n, 1), n


def loss_over(table: DataFrame, net, theta: np.ndarray, schedule: Schedule) -> float:
    """Mean loss over all blocks; NaN where there are none."""
    sent = table.sparkSession.sparkContext.broadcast(theta)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*arrays(r), int(r.block)) for r in pdf.itertuples() if r.n]
            yield pd.DataFrame({"block": [b for *_, b in rows], "loss": [float(losses(schedule, net.forward(sent.value, x)[0], y)[0].sum()) for x, y, _ in rows], "n": [len(x) for x, *_ in rows]})

    # rounded like the gradients, so that the choice of the best epoch does not follow the layout
    parts = table.select("block", "n", "shape", "x", "y").mapInPandas(work, "block long, loss double, n long")
    found = parts.agg(F.sum(F.round(F.col("loss") * 2**20).cast("decimal(38,0)")).cast("double").alias("loss"), F.sum("n").alias("n")).first()
    return found["loss"] / 2**20 / found["n"] if found["n"] else float("nan")


class AdamW:
    def __init__(self, size: int, decay: float, clip: float, first: float = 0.9, second: float = 0.999):
        self.mean, self.square, self.step = np.zeros(size), np.zeros(size), 0
        self.decay, self.clip, self.first, self.second = decay, clip, first, second

    def update(self, theta: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        g = g * min(1.0, self.clip / (np.linalg.norm(g) + 1e-6))
        self.step += 1
        self.mean = self.first * self.mean + (1 - self.first) * g
        self.square = self.second * self.square + (1 - self.second) * g * g
        mean, square = self.mean / (1 - self.first**self.step), self.square / (1 - self.second**self.step)
        return theta * (1 - rate * self.decay) - rate * mean / (np.sqrt(square) + 1e-8)


def train(net, training: DataFrame, validation: DataFrame, schedule: Schedule = Schedule(), after: Callable[[int, np.ndarray], None] | None = None) -> Trained:
    """Rounds over the batches of ``training`` (see :func:`blocks`); the weights of the epoch with the least validation loss.

    ``after`` is called with each epoch's number and weights, for instance to
    store them. Without training blocks the start weights are returned, without
    validation blocks the last epoch's.
    """
    theta, step = net.start(schedule.seed), AdamW(net.size, schedule.decay, schedule.clip)
    batches = sorted(r["batch"] for r in training.select("batch").distinct().collect())  # at most the rounds of an epoch
    best, least, history = theta, float("inf"), []
    for epoch in range(schedule.epochs if batches else 0):
        rate, total, rows = schedule.rate_at(epoch), 0.0, 0
        for k in batches:
            g, loss, n = gradient(training.where(F.col("batch") == k), net, theta, schedule)
            theta = step.update(theta, g, rate) if n else theta
            total, rows = total + loss * n, rows + n
        held = loss_over(validation, net, theta, schedule)
        better = not held >= least
        if better:
            best, least = theta, held if held == held else least
        history.append({"epoch": epoch + 1, "rate": rate, "train_loss": total / max(rows, 1), "val_loss": held, "best": better})
        if after:
            after(epoch + 1, theta)
    return Trained(net, best, history)
