"""Sinks: partitioned Parquet, telemetry CSV, GeoJSON, reports."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One directory per split that has rows; files follow the data's partitioning."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


#: Folders that session folders lie in, so that tasks can list them side by side.
BUCKETS = 1024


def write_folders(df: DataFrame, folder: str, name: str, order: tuple[str, ...] = ()) -> None:
    """A file ``name`` in a folder for every ``session``, its other columns as JSON lines sorted by ``order``.

    On a mounted folder tasks write the files themselves, each put in place by one rename, so an attempt that ends early
    leaves none behind: Hadoop's local file system starts a chmod process for every file and every folder. On other
    file systems Spark's writer does it.
    """
    named = df.withColumn("session", F.coalesce(F.col("session").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))).withColumn("bucket", F.pmod(F.hash("session"), F.lit(BUCKETS)))
    line = F.to_json(F.struct(*[c for c in df.columns if c != "session"])).alias("value")
    lines = shared.dealt(named, "session").sortWithinPartitions("bucket", "session", *order).select("bucket", "session", line)
    place = shared.mounted(df.sparkSession, folder)
    if place is None:
        lines.write.partitionBy("bucket", "session").text(f"{folder}/{name}")
        return

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, out, n = f".{name}.{TaskContext.get().taskAttemptId()}", None, None, 0

        def close() -> None:
            out.close()
            os.replace(f"{at}/{own}", f"{at}/{name}")

        for batch in batches:
            codes = batch.column("session").dictionary_encode()
            starts = [0, *(np.flatnonzero(np.diff(codes.indices.to_numpy())) + 1).tolist(), len(batch)] if len(batch) else []
            for a, b in zip(starts, starts[1:], strict=False):
                to = f"{place}/bucket={batch.column('bucket')[a]}/session={batch.column('session')[a]}"
                if to != at:
                    if out:
                        close()
                    os.makedirs(to, exist_ok=True)
                    at, out, n = to, open(f"{to}/{own}", "w", encoding="utf-8"), n + 1  # noqa: SIM115
                out.write("\n".join(batch.column("value").slice(a, b - a).to_pylist()) + "\n")
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    lines.mapInArrow(work, "files long").agg(F.sum("files")).collect()


def csv_number(value: Column) -> Column:
    """Telemetry text: six decimals, four in exponent form from 10,000 on, null as empty."""
    return F.when(value.isNull(), "").when(F.abs(value) >= 10000, F.format_string("%.4e", value)).otherwise(F.format_string("%.6f", value))


def csv_flag(value: Column) -> Column:
    return F.when(value.isNull(), "").when(value, "1").otherwise("0")


def telemetry(df: DataFrame) -> DataFrame:
    """Every column as telemetry text."""
    kinds = dict(df.dtypes)
    return df.select(*[(csv_flag if kinds[c] == "boolean" else csv_number if kinds[c] == "double" else lambda x: F.coalesce(x.cast("string"), F.lit("")))(F.col(c)).alias(c) for c in df.columns])


def feature(points: Column, properties: Column) -> Column:
    """A GeoJSON LineString of (lat, lon) structs."""
    line = F.transform(points, lambda p: F.array(F.round(p["lon"], 6), F.round(p["lat"], 6)))
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"), properties.alias("properties"))


def collection(features: DataFrame, keys: list[str], column: str = "feature") -> DataFrame:
    """One GeoJSON document per key, so that no task holds all features."""
    return features.groupBy(*keys).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(column).alias("features"))).alias("geojson"))


def json_safe(value: Column) -> Column:
    """Non-finite numbers become 0, as JSON has none."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def sessions(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Recorded sessions, newest first; one without metadata is INCOMPLETE."""
    return files.join(metadata, "name", "left").withColumn("status", F.coalesce("status", F.lit("INCOMPLETE"))).orderBy(F.desc("modified"), "name")
