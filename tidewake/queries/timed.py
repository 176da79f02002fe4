"""Streams in event time: timers, late rows, a stream-stream join, seek (STR, JOIN-04)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import CHANNELS, table
from ..shared import new_path
from ..streaming import live, timed
from . import query

_FILES = 4
#: A row of no device, days after all others: it moves the watermark past them.
_END = 400 * 86_400


def _parts(events):
    """The file that an event comes in: four in order of time."""
    return events.withColumn("_part", F.ntile(_FILES).over(Window.orderBy("_day")).cast("int"))


def _paced(spark, sf_dir, name, late=None):
    """``events`` as files in time order, one a micro-batch, those of ``late`` behind all others; at last a row that ends the stream.

    Days, not rows, are dealt to files, so the ordering is over a bounded table.
    """
    folder, events = new_path(spark, name), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    days = events.select(day.alias("_day")).distinct()
    parts = _parts(days).select("_day", "_part")
    rows = events.withColumn("_day", day).join(parts, "_day").drop("_day")
    if late is not None:
        rows = rows.withColumn("_part", F.when(late, _FILES + 1).otherwise(F.col("_part")))
    end = events.agg(F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(F.max(F.unix_micros("ts")) + _END * 1_000_000).alias("ts"), F.lit(-1).cast("long").alias("user_id"))
    end = end.withColumn("_part", F.lit(_FILES + 2)).withColumns({"event_type": F.lit("view"), "value": F.lit(0.0), "props": F.lit(None).cast("string")})
    files = timed.in_files(rows.unionByName(end), F.col("_part"), list(range(1, _FILES + 3)), f"{folder}/in")
    schema = rows.drop("_part").schema
    return folder, lambda: live.paced(spark, schema, f"{folder}/in", files).select(F.col("user_id").alias("drive_id"), "event_id", "ts", F.col("event_type").alias("kind"), F.col("value").alias("val"))


_GAP = 43_200
_OUTAGES = f"""WITH f AS (SELECT user_id AS drive_id, epoch_us(ts) AS micros, event_id FROM events WHERE event_type = 'view'),
n AS (SELECT drive_id, micros, lead(micros) OVER (PARTITION BY drive_id ORDER BY micros, event_id) AS next FROM f),
g AS (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY micros) AS number FROM n WHERE next IS NULL OR next - micros > {_GAP * 1_000_000})
SELECT drive_id, number, kind, micros FROM (SELECT drive_id, number, 'open' AS kind, micros + {_GAP * 1_000_000} AS micros FROM g UNION ALL SELECT drive_id, number, 'close', next FROM g WHERE next IS NOT NULL)"""


@query("str_06_outage_timers", _OUTAGES, stream=False)
def str_06_timers(spark, sf_dir):
    """Outages that open by a timer once fixes have stayed away, without a further row; one file of rows a micro-batch."""
    folder, rows = _paced(spark, sf_dir, "outages")
    found = timed.outages(rows().where("kind = 'view'"), _GAP)
    writer = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    timed.start_keyed(writer, spark).awaitTermination()
    out = spark.read.schema(timed.OUTAGES).parquet(f"{folder}/out")
    return out.where("drive_id >= 0").select("drive_id", "number", "kind", F.unix_micros("at").alias("micros"))


_LATE = f"""WITH d AS (SELECT day, ntile({_FILES}) OVER (ORDER BY day) AS part FROM (SELECT DISTINCT epoch_us(date_trunc('day', ts)) AS day FROM events)),
e AS (SELECT user_id AS drive_id, event_id, epoch_us(ts) AS us, day, part, event_id % 7 = 0 AS held FROM events JOIN d ON epoch_us(date_trunc('day', ts)) = day),
w AS (SELECT max(us) // 1000 * 1000 - 86400000000 AS mark FROM e WHERE NOT held AND part < {_FILES}),
k AS (SELECT *, held AND day + 86400000000 <= mark AS late FROM e, w)
SELECT CASE WHEN late THEN 'late' ELSE 'window' END AS kind, drive_id, day // 1000000 AS day, count(*) AS n FROM k GROUP BY ALL"""


@query("str_02_late_rows", _LATE, stream=False)
def str_02(spark, sf_dir):
    """Daily counts by the watermark, and the rows that came after their day had closed as a side output.

    Every seventh event comes in a file behind all others.
    """
    folder, rows = _paced(spark, sf_dir, "late", F.col("event_id") % 7 == 0)
    live.write_stream(timed.windows(rows(), "1 day", "1 day"), f"{folder}/windows", f"{folder}/state-windows", None).awaitTermination()
    timed.divert_late(rows(), 86_400, 86_400, folder, f"{folder}/state-late").awaitTermination()
    counted = spark.read.parquet(f"{folder}/windows").select(F.lit("window").alias("kind"), "drive_id", F.unix_seconds("window.start").alias("day"), "n")
    late = spark.read.parquet(f"{folder}/late").groupBy("drive_id", F.unix_seconds(F.date_trunc("day", "ts")).alias("day")).agg(F.count("*").alias("n"))
    return counted.unionByName(late.withColumn("kind", F.lit("late"))).where("drive_id >= 0").select("kind", "drive_id", "day", "n")


@query("join_04_stream_join", ", i AS (SELECT * FROM s WHERE kind <> 'view'), v AS (SELECT * FROM s WHERE kind = 'view') SELECT i.event_id, CASE WHEN i.t - v.t <= 172800 THEN v.event_id END AS fix_id FROM i ASOF LEFT JOIN v ON i.drive_id = v.drive_id AND i.t >= v.t")
def join_04_stream(spark, sf_dir):
    """The last fix of at most two days before each frame, from two streams that are joined while they run."""
    folder, rows = _paced(spark, sf_dir, "join")
    frames = rows().where("kind <> 'view' OR drive_id < 0").select("drive_id", "event_id", "ts")
    fixes = rows().where("kind = 'view'").select("drive_id", F.col("ts").alias("fix_ts"), F.col("event_id").alias("fix_id"))
    live.write_stream(timed.fixes_of_frames(frames, fixes, "2 DAYS", "1 hour"), f"{folder}/out", f"{folder}/state", None).awaitTermination()
    pairs = spark.read.parquet(f"{folder}/out").where("drive_id >= 0")
    return timed.last_fix(pairs, "event_id", ["fix_id"], "fix_id").select("event_id", "fix_id")


_AFTER = 1
_SEEK = f"""WITH d AS (SELECT day, ntile({_FILES}) OVER (ORDER BY day) AS part FROM (SELECT DISTINCT date_trunc('day', ts) AS day FROM events))
SELECT event_id, true AS same FROM events JOIN d ON date_trunc('day', ts) = day WHERE part > {_AFTER + 1}"""


@query("str_12_seek", _SEEK, stream=False)
def str_12_seek(spark, sf_dir):
    """A stateful run, and the same gone on from its second batch's stored state and offset: the rest, compared row by row."""
    folder, rows = _paced(spark, sf_dir, "seek")

    def run(name):
        read = rows().where("drive_id >= 0").withColumn("value", F.col("val"))
        channels = [F.expr(CHANNELS[c]).alias(c) for c in ("ax", "gz", "speed", "east", "north")]
        frames = read.select("drive_id", "event_id", (F.unix_micros("ts") / F.lit(1e6)).alias("t"), *channels, (F.col("kind") == "error").alias("dark"))
        live.write_batches(live.navigate(frames), f"{folder}/{name}", f"{folder}/state-{name}").awaitTermination()
        return spark.read.parquet(f"{folder}/{name}")

    uncut = run("uncut")
    timed.seek(spark, f"{folder}/state-uncut", _AFTER, f"{folder}/state-rest")
    rest = run("rest").withColumnsRenamed({c: f"{c}_" for c in ("pe", "pn", "v", "out_of_order")})
    same = (F.col("pe") == F.col("pe_")) & (F.col("pn") == F.col("pn_")) & (F.col("v") == F.col("v_")) & (F.col("out_of_order") == F.col("out_of_order_"))
    return rest.join(uncut.drop("drive_id", "t", "batch"), "event_id", "left").select("event_id", F.coalesce(same, F.lit(False)).alias("same"))
