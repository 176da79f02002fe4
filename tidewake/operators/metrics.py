"""Scores of navigation runs and models, as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def navigation(df: DataFrame, keys: list[str], err: str, step: str, idx: str, digits: int = 4) -> DataFrame:
    """Distance, final error, drift in percent, RMSE, MAE, largest error, CEP50 and 95th percentile per run."""
    final, distance, e = F.max_by(err, idx), F.sum(step), F.col(err)
    columns = {
        "distance": distance, "final": final, "drift": 100 * final / F.greatest(distance, F.lit(1.0)), "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(e), "worst": F.max(e), "cep50": F.percentile(e, F.lit(0.5)), "p95": F.percentile(e, F.lit(0.95)),
    }
    return df.groupBy(*keys).agg(*[F.round(c, digits).alias(n) for n, c in columns.items()])


def summary(value: Column, passed: Column, digits: int = 4) -> list[Column]:
    """Count, passes, mean, exact percentiles and the worst."""
    r = lambda c, n: F.round(c, digits).alias(n)
    return [
        F.count("*").alias("n"), F.count_if(passed).alias("passed"), r(100 * F.count_if(passed) / F.count("*"), "pass_pct"), r(F.avg(value), "mean"),
        r(F.percentile(value, F.lit(0.5)), "median"), r(F.percentile(value, F.lit(0.9)), "p90"), r(F.percentile(value, F.lit(0.95)), "p95"), r(F.max(value), "worst"),
    ]


def banded(err: Column, bands: dict[str, Column], digits: int = 5) -> list[Column]:
    """MAE, RMSE and bias inside each band; null where a band is empty. Bands may overlap."""
    out = []
    for name, inside in bands.items():
        e = F.when(inside, err)
        out += [F.round(F.avg(F.abs(e)), digits).alias(f"mae_{name}"), F.round(F.sqrt(F.avg(e * e)), digits).alias(f"rmse_{name}"), F.round(F.avg(e), digits).alias(f"bias_{name}")]
    return out


def best_lag(df: DataFrame, a: str, b: str, most: int, key: str = "drive_id", idx: str = "idx") -> DataFrame:
    """Lag within +-``most`` rows with the largest mean-removed product sum: lags are window offsets, so no self-join."""
    whole, order = Window.partitionBy(key), Window.partitionBy(key).orderBy(idx)
    df = df.select(key, idx, (F.col(a) - F.avg(a).over(whole)).alias("a"), (F.col(b) - F.avg(b).over(whole)).alias("b"))
    lags = range(-most, most + 1)
    sums = df.select(key, *[(F.col("a") * F.lead("b", k).over(order)).alias(f"p{k + most}") for k in lags]).groupBy(key).agg(*[F.sum(f"p{k + most}").alias(f"p{k + most}") for k in lags])
    best = F.array_max(F.array(*[F.struct(F.col(f"p{k + most}").alias("p"), F.lit(k).alias("lag")) for k in lags]))
    return sums.select(key, best.alias("m")).select(key, "m.lag", "m.p")


def principal_axes(df: DataFrame, channels: tuple[str, str, str], keys: list[str]) -> DataFrame:
    """The uncentred second-moment matrix (m00 to m22) and its eigenvalues, descending: six averages in the plan, a 3 x 3 solve per group."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    moments = df.groupBy(*keys).agg(*[F.avg(F.col(channels[i]) * F.col(channels[j])).alias(f"m{i}{j}") for i, j in pairs])

    @F.pandas_udf("array<double>")
    def eigen(m00: pd.Series, m01: pd.Series, m02: pd.Series, m11: pd.Series, m12: pd.Series, m22: pd.Series) -> pd.Series:
        s = np.stack([np.stack([m00, m01, m02], 1), np.stack([m01, m11, m12], 1), np.stack([m02, m12, m22], 1)], 1)
        return pd.Series(list(np.linalg.eigvalsh(s)[:, ::-1]))

    return moments.select("*", eigen(*[f"m{i}{j}" for i, j in pairs]).alias("eigenvalues"))
