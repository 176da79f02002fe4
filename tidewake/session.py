"""Sessions and the canonical stream view of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(name: str = "tidewake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The stream view's channels: arithmetic on events, the same text in Spark and DuckDB.
CHANNELS = {
    "ax": "((event_id * 37) % 200 - 100) / 10.0D",
    "ay": "((event_id * 53) % 120 - 60) / 20.0D",
    "az": "9.8D + ((event_id * 29) % 40 - 20) / 50.0D",
    "gx": "((event_id * 11) % 100 - 50) / 1000.0D",
    "gy": "((event_id * 13) % 100 - 50) / 1000.0D",
    "gz": "((event_id * 37) % 200 - 100) / 1000.0D",
    "speed": "value / 20.0D",
    "east": "((event_id * 41) % 2000) / 10.0D",
    "north": "((event_id * 43) % 2000) / 10.0D",
    "lat": "12.9D + ((event_id * 17) % 1000) / 100000.0D",
    "lon": "77.5D + ((event_id * 19) % 1000) / 100000.0D",
}


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a motion stream: drive, event time ``t`` in seconds, kind and channels. Catalyst prunes what a query leaves out."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t")
    channels = [F.expr(e).alias(c) for c, e in CHANNELS.items()]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("drive_id"), "event_id", t, F.col("event_type").alias("kind"), F.col("value").alias("val"), *channels)


def exact_mean(column: str):
    """Mean of a column to ten decimals, added up as decimals: the order of rows cannot turn a tie that is rounded afterwards."""
    return F.avg(F.col(column).cast("decimal(20,10)"))


def stored_mean(rows: DataFrame, column: str, places: int, name: str) -> DataFrame:
    """A drive's mean, rounded, to the last bit as one DuckDB thread gets it: doubles added up one by one as the rows are
    stored, then scaled, rounded half away from zero and scaled back. An exact tie so falls as in the SQL, whatever Spark's splits."""
    read = rows.select("drive_id", column, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    so_far = F.sum(column).over(Window.partitionBy("drive_id").orderBy("file", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    mean = F.max_by("so_far", F.struct("file", "row")) / F.count(column)
    return read.withColumn("so_far", so_far).groupBy("drive_id").agg((F.round(mean * 10**places) / 10**places).alias(name))


def by_time(*more: str):
    """The window of a drive in time order; the event id breaks ties."""
    return Window.partitionBy("drive_id", *more).orderBy("t", "event_id")


_CHANNEL_SQL = ", ".join(f"{e.replace('D', '::DOUBLE')} AS {c}" for c, e in CHANNELS.items())
#: The same view for DuckDB, as a CTE named s, with the row's number idx in its drive.
STREAM_SQL = f"""s AS (SELECT user_id AS drive_id, event_id, epoch_us(ts) / 1e6 AS t, event_type AS kind, value AS val, {_CHANNEL_SQL},
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"""
