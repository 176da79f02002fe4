"""Channel scaler: population mean and deviation over all window samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, column: str) -> DataFrame:
    """(``channel``, ``mean``, ``std``, ``n``) of an array column's places, in one grouped pass; a flat channel gets 1."""
    long = df.select(F.posexplode(column).alias("channel", "x")).select("channel", F.col("x").cast("double").alias("x"))
    std = F.stddev_pop("x")
    return long.groupBy("channel").agg(F.avg("x").alias("mean"), F.when(std <= 1e-6, 1.0).otherwise(std).alias("std"), F.count("*").alias("n"))


def apply(df: DataFrame, column: str, scaler: DataFrame) -> DataFrame:
    """(x - mean) / std at every place. The scaler has one row per channel and is sent to the tasks."""
    packed = scaler.agg(F.sort_array(F.collect_list(F.struct("channel", "mean", "std"))).alias("_p"))
    scaled = F.zip_with(column, "_p", lambda x, p: (x.cast("double") - p["mean"]) / p["std"])
    return df.join(F.broadcast(packed)).withColumn(column, scaled).drop("_p")
