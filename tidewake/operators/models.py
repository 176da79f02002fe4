"""Window models: inference over Arrow batches, losses, augmentation, registries.

A model is anything with ``predict(windows: (n, channels, length)) -> (n, outputs)``.
ONNX files are run where onnxruntime is installed; the linear model is the
built-in stand-in and trains with least squares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ridge(xx: np.ndarray, xy: np.ndarray, l2: float) -> np.ndarray:
    return np.linalg.solve(xx + l2 * np.eye(len(xx)), xy)


def normal_equations(df: DataFrame, design: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    """X'X and X'Y over all rows (None if there are none): summed inside partitions, then across them.

    ``design`` makes (X, Y) of a batch. Rows with a value that is not finite
    are left out. The driver gets one number per entry, however many rows.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for pdf in batches:
            if len(pdf):
                x, y = design(pdf)
                both = np.concatenate([x, y], 1)
                good = np.isfinite(both).all(1)
                total = total + x[good].T @ both[good]
        if np.ndim(total):
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    entries = df.mapInPandas(work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not entries:
        return None
    n = max(r["i"] for r in entries) + 1
    out = np.zeros((n, max(r["j"] for r in entries) + 1))
    for r in entries:
        out[r["i"], r["j"]] = r["v"]
    return out[:, :n], out[:, n:]


def stacked(windows: pd.Series) -> np.ndarray:
    return np.asarray([np.stack(w) for w in windows], float)


def targets(column: pd.Series) -> np.ndarray:
    """One number or one array of numbers a row, as a matrix."""
    return np.asarray(column.tolist(), float).reshape(len(column), -1)


@dataclass
class Linear:
    """Ridge regression on a window's channel means, deviations and last values."""

    weights: np.ndarray
    low: float | None = 0.0
    high: float | None = None

    @staticmethod
    def features(windows: np.ndarray) -> np.ndarray:
        return np.concatenate([windows.mean(2), windows.std(2), windows[:, :, -1], np.ones((len(windows), 1))], 1)

    @staticmethod
    def fit(windows: np.ndarray, targets: np.ndarray, l2: float = 1e-3, **bounds) -> Linear:
        x = Linear.features(windows)
        return Linear(ridge(x.T @ x, x.T @ targets.reshape(len(x), -1), l2), **bounds)

    @staticmethod
    def fit_all(df: DataFrame, window: str, target: str, l2: float = 1e-3, **bounds) -> Linear:
        """Fit on all rows of a distributed table; without rows the weights are 0."""

        def design(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            return Linear.features(stacked(pdf[window])), targets(pdf[target])

        found = normal_equations(df.select(window, target), design)
        return Linear(np.zeros((19, 1)) if found is None else ridge(*found, l2), **bounds)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        out = self.features(windows) @ self.weights
        return out if self.low is None and self.high is None else np.clip(out, self.low, self.high)


@dataclass
class Displacement:
    """Means of a displacement and the logarithms of their variances, clamped to +-6."""

    mean: Linear
    log_variance: Linear

    @staticmethod
    def fit_all(df: DataFrame, window: str, target: str) -> Displacement:
        """Fit the means on all rows, then the logarithm of the squares that they leave."""
        mean = Linear.fit_all(df, window, target, low=None)

        def design(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            x = Linear.features(stacked(pdf[window]))
            return x, np.log((targets(pdf[target]) - x @ mean.weights) ** 2 + 1e-9) + 1.27  # E log of a squared normal is -1.27

        found = normal_equations(df.select(window, target), design)
        return Displacement(mean, Linear(np.zeros_like(mean.weights) if found is None else ridge(*found, 1e-3), -6.0, 6.0))

    def predict(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.mean.predict(windows), self.log_variance.predict(windows)], 1)


@dataclass
class Onnx:
    """A model file's bytes; the session is made once per task."""

    content: bytes

    def predict(self, windows: np.ndarray) -> np.ndarray:
        import onnxruntime

        if not hasattr(self, "_session"):
            self._session = onnxruntime.InferenceSession(self.content, providers=["CPUExecutionProvider"])
        name = self._session.get_inputs()[0].name
        return np.asarray(self._session.run(None, {name: windows.astype(np.float32)})[0]).reshape(len(windows), -1)


def infer(df: DataFrame, window: str, model, out: str = "prediction", size: int = 256) -> DataFrame:
    """Adds the model's outputs as an array; windows are arrays of channels."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [np.asarray([np.stack(w) for w in batch.iloc[k : k + size]], float) for k in range(0, len(batch), size)]
            yield pd.Series([row.tolist() for p in parts for row in np.asarray(model.predict(p))])

    return df.withColumn(out, run(window))


def infer_rows(df: DataFrame, features: str, model, out: str = "prediction", size: int = 4096) -> DataFrame:
    """Adds the model's outputs as an array; inputs are arrays of features, one a row."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [np.asarray(batch.iloc[k : k + size].tolist(), float) for k in range(0, len(batch), size)]
            yield pd.Series([row.tolist() for p in parts for row in np.asarray(model.predict(p))])

    return df.withColumn(out, run(features))


def gaussian_nll(error: Column, log_variance: Column) -> Column:
    """Negative log-likelihood of an error, its log-variance clamped to +-6."""
    s = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), log_variance))
    return 0.5 * (s + error * error * F.exp(-s))


def augmented(df: DataFrame, key: str, window: str, seed: int = 42, noise: float = 0.02, bias: float = 0.05) -> DataFrame:
    """Windows with seeded noise and a channel bias; the seed follows the row's key, not its partition."""

    @F.pandas_udf("array<array<double>>")
    def run(keys: pd.Series, windows: pd.Series) -> pd.Series:
        out = []
        for k, w in zip(keys, windows, strict=True):
            rng = np.random.default_rng([seed, int(k)])
            x = np.stack(w).astype(float)
            out.append((x + rng.normal(0, noise, x.shape) + rng.uniform(-bias, bias, (len(x), 1))).tolist())
        return pd.Series(out)

    return df.withColumn(window, run(key, window))


def require_known(name: str, content: bytes, registry: dict[str, str]) -> None:
    """A model may be used only if its SHA-256 is the registered one."""
    digest = hashlib.sha256(content).hexdigest()
    if registry.get(name) != digest:
        raise ValueError(f"{name}: {digest} is not registered")


def trainable(authenticity: Column) -> Column:
    """Whether a dataset may train a released model; an unknown authenticity is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown authenticity "), F.coalesce(authenticity, F.lit("null"))))
    return F.when(authenticity.isin("authentic", "field"), True).when(authenticity == "synthetic", False).otherwise(unknown.cast("boolean"))


def verified(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Model files (name, content) against a registry (name, sha256): ``known`` if registered with this content."""
    digests = files.select("name", F.sha2("content", 256).alias("_found"))
    return digests.join(registry, "name", "left").select("name", F.coalesce(F.col("_found") == F.col("sha256"), F.lit(False)).alias("known"))


def require_training_data(authenticity: str, allow_synthetic: bool = False) -> None:
    if authenticity not in ("synthetic", "authentic", "field"):
        raise ValueError(f"unknown authenticity {authenticity!r}")
    if authenticity == "synthetic" and not allow_synthetic:
        raise ValueError("synthetic data must not train a released model")
