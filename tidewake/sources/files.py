"""File sources: drive CSVs, ZIP members, telemetry, manifests, file listings."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from . import schema

LATIN = "ISO-8859-1"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, modified) of files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def folders(spark: SparkSession, folder: str) -> DataFrame:
    """(session, file, modified) of what ``sinks.write_folders`` wrote, as the files lie there; contents are not read.

    On a mounted folder every bucket's folder is listed by a task, and no file's name passes through the driver.
    """
    place = shared.mounted(spark, folder)
    if place is None:
        at = lambda k: F.regexp_extract("path", r"/([^/]+)/bucket=[^/]+/session=([^/]+)/[^/]+$", k)
        return listing(spark, folder).select(at(2).alias("session"), at(1).alias("file"), "modified")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in (b for batch in batches for b in batch.column("bucket").to_pylist()):
            with os.scandir(f"{place}/{bucket}") as sessions:
                found = [(s.name.removeprefix("session="), f.name, f.stat().st_mtime_ns // 1000) for s in sessions for f in os.scandir(s.path) if not f.name.startswith(".")]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["session", "file", "at"])

    buckets = spark.createDataFrame([(b,) for b in sorted(os.listdir(place))] if os.path.isdir(place) else [], "bucket string")  # at most sinks.BUCKETS
    return shared.dealt(buckets, "bucket").mapInArrow(listed, "session string, file string, at long").select("session", "file", F.timestamp_micros("at").alias("modified"))


def drive_id(name):
    """``S-M.csv`` and ``V-M.csv`` are drive M's phone and vehicle files."""
    return F.regexp_extract(name, r"^[SV]-(.+)\.csv$", 1)


def paired(files: DataFrame) -> DataFrame:
    """Drives that have both files."""
    named = files.select(drive_id(F.col("name")).alias("drive_id"), F.substring("name", 1, 1).alias("kind"), "path")
    phones, vehicles = (named.where(F.col("kind") == k).select("drive_id", F.col("path").alias(p)) for k, p in (("S", "phone"), ("V", "vehicle")))
    return phones.where("drive_id <> ''").join(vehicles, "drive_id")


def incomplete(files: DataFrame) -> DataFrame:
    named = files.select(drive_id(F.col("name")).alias("drive_id")).where("drive_id <> ''").distinct()
    return named.join(paired(files), "drive_id", "left_anti")


def channel_of(name):
    """What a per-channel file holds, by its name."""
    low = F.lower(name)
    return F.when(low.contains("acc"), "acc").when(low.contains("gyro"), "gyro").when(low.contains("gps"), "gps").when(low.contains("speed"), "speed")


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names only; no data is scanned."""
    return spark.read.option("header", "true").option("encoding", LATIN).csv(path).limit(0).columns


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(name, header): the first line of every file, which is the one with the least id of the file's first split."""
    lines = spark.read.schema("line string").option("encoding", LATIN).option("sep", "\u0001").option("quote", "").csv(path)
    first = lines.where("_metadata.file_block_start = 0").select("_metadata.file_path", "line", F.monotonically_increasing_id().alias("_id"))
    return first.groupBy("file_path").agg(F.min_by("line", "_id").alias("header")).select(F.element_at(F.split("file_path", "/"), -1).alias("name"), "header")


def detected(found: DataFrame) -> DataFrame:
    """(name, kind, canonical, source): each file of :func:`headers` as its header shows it. A phone file without inertial
    channels or a vehicle file without a speed is an error."""

    @F.pandas_udf("struct<kind:string,columns:map<string,string>>")
    def shown(header: pd.Series) -> pd.DataFrame:
        each = [schema.detect(h.split(",")) for h in header]
        return pd.DataFrame({"kind": [x.kind for x in each], "columns": [x.columns for x in each]})

    return found.select("name", shown("header").alias("s")).select("name", "s.kind", F.explode("s.columns").alias("canonical", "source"))


def located_pairs(found: DataFrame) -> DataFrame:
    """Drives whose phone and vehicle file both have positions (from :func:`headers`)."""
    low = F.lower("header")
    both = found.where(low.contains("latitude") & low.contains("longitude")).groupBy(drive_id(F.col("name")).alias("drive_id"))
    return both.agg(F.count_distinct(F.substring("name", 1, 1)).alias("_kinds")).where("drive_id <> '' AND _kinds = 2").select("drive_id")


def read_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Drives recorded as one CSV dataset a channel (acc, gyro, gps, speed by its name), each with drive_id and its own clock column.

    Rows of one drive and time are put together by one union and one shuffle; a
    channel without a row at that time stays null. Other datasets are left
    out, none at all is an error.
    """
    of = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    named = listing(spark, folder, "*.csv").select(of.alias("dataset")).distinct().where(channel_of(F.col("dataset")).isNotNull())
    parts = []
    for row in named.sort("dataset").collect():  # a dataset each, not a file
        raw = spark.read.option("header", "true").option("enforceSchema", "false").option("encoding", LATIN).csv(f"{folder}/{row['dataset']}")
        found = schema.detect([c for c in raw.columns if c != "drive_id"], "channel")
        parts.append(raw.select(F.col("drive_id").cast("long").alias("drive_id"), *[F.col(f"`{source}`").cast("double").alias(name) for name, source in found.columns.items()]))
    if not parts:
        raise ValueError(f"no channel files below {folder}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("drive_id", "timestamp").agg(*[F.max(c).alias(c) for c in rows.columns if c not in ("drive_id", "timestamp")])


def read_drives(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """CSV files of one layout as the canonical table, with the drive's id from the file name.

    Every file's header is checked against the first one's: a file of another
    layout is an error, it is not read by position. ``idx`` tells rows of a file apart and grows inside a file split; the clock
    column orders a drive.
    """
    raw = spark.read.option("header", "true").option("enforceSchema", "false").option("encoding", LATIN).csv(path)
    found = schema.detect(raw.columns, kind)
    columns = [F.col(f"`{source}`").cast("double").alias(name) for name, source in found.columns.items()]
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return raw.select(drive_id(name).alias("drive_id"), F.monotonically_increasing_id().alias("idx"), *columns)


def read_zipped(spark: SparkSession, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """Text columns of CSV members inside ZIP files; one task per archive, one member in memory at a time."""
    import fnmatch

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if fnmatch.fnmatch(name, pattern):
                            with archive.open(name) as f:
                                part = pd.read_csv(f, encoding="latin1", dtype=str)
                            yield part.reindex(columns=columns).assign(member=name)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(members, ", ".join(f"`{c}` string" for c in (*columns, "member")))


def replay(telemetry: DataFrame) -> DataFrame:
    """Frames of a recorded session: a fix only where the row had a new one with a position."""
    fresh = (F.col("has_new_gnss") == 1) & F.col("lat").isNotNull()
    fix = F.struct(F.col("t").alias("timestamp"), "lat", "lon", F.lit(3.0).alias("accuracy"))
    return telemetry.withColumn("gnss", F.when(fresh, fix))


FRAME = (
    "type string, imu struct<timestamp:double,acc_x:double,acc_y:double,acc_z:double,gyro_x:double,gyro_y:double,gyro_z:double,"
    "mag_x:double,mag_y:double,mag_z:double,orientation_yaw:double,orientation_pitch:double,orientation_roll:double,is_absolute:boolean>, "
    "gnss struct<timestamp:double,latitude:double,longitude:double,altitude:double,accuracy_m:double,speed_mps:double,heading_deg:double>"
)


def frames(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON frame lines, nested as live clients send them."""
    return lines.select(F.from_json(column, FRAME).alias("f")).select("f.*")


def flat_frames(lines: DataFrame, column: str = "value") -> DataFrame:
    """The flat form of the same frame."""
    found = frames(lines, column)
    return found.select("type", "imu.*", F.col("gnss.latitude").alias("lat"), F.col("gnss.longitude").alias("lon"), F.coalesce("gnss.accuracy_m", F.lit(3.0)).alias("accuracy"))


MANIFEST = "dataset_name string, source string, authenticity string, sensor_type string, sampling_rate_hz double, drive_ids array<string>"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Dataset manifests, one JSON file each: those that cannot be parsed, lack a field but the drives, or are of unknown authenticity are left out."""
    found = spark.read.text(path, wholetext=True).select(F.from_json("value", MANIFEST).alias("m")).select("m.*")
    whole = found.where("dataset_name IS NOT NULL AND source IS NOT NULL AND sensor_type IS NOT NULL AND sampling_rate_hz IS NOT NULL AND authenticity IN ('synthetic', 'authentic', 'field')")
    return whole.select(F.lower(F.trim("dataset_name")).alias("name"), "authenticity", F.col("sensor_type").alias("sensor"), F.col("sampling_rate_hz").alias("hz"), F.coalesce("drive_ids", F.array().cast("array<string>")).alias("drives"))
