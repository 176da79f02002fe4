"""Event time in streams: timers, late rows, stream-stream joins, restarts from a stored batch.

State that is asked by the clock and not by a row (an outage that opens when
fixes stay away) lives in a stateful processor with event-time timers. Rows
that come after their window has closed go to a side output, by a clock that is
stored with every micro-batch, so that a batch that is run again decides alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..shared import delete

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def start_keyed(writer, spark: SparkSession) -> StreamingQuery:
    """Start a query with a stateful processor, which needs the RocksDB state store; the session's setting stays."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(_PROVIDER, before)


# -- outages by timers ----------------------------------------------------

OUTAGES = "drive_id long, number long, kind string, at timestamp"


#: Groups of devices that share a timer and a state, whose calls cost more than their rows.
BUCKETS = 512


class Outages(StatefulProcessor):
    """Outages of a bucket of devices: ``open`` once ``gap`` microseconds have passed after a fix, ``close`` at the next one.

    Fixes wait in a list until the watermark has passed them, so they are
    taken in order of event time whatever batch they came in. Each device's
    last fix, number of outages and whether one is open are arrays in one
    value. One timer is set: at the first waiting fix or at the first moment at
    which an outage would open. An outage opens by the timer alone, without any
    further row of the device.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "fixes binary")
        self.state = handle.getValueState("state", "devices binary, timer long")

    def close(self) -> None:
        pass

    def _read(self) -> tuple:
        """(ids, last, number, open) of the devices with a fix taken, by id, and the timer."""
        if not self.state.exists():
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool)), None
        held, timer = self.state.get()
        return pickle.loads(held), timer

    def _keep(self, devices: tuple, timer, due) -> None:
        """Store the state with its timer moved to ``due`` (milliseconds or None)."""
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((pickle.dumps(devices), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([pdf[["drive_id", "at"]] for pdf in rows]).to_numpy(np.int64)
        self.waiting.appendList([(pickle.dumps(new),)])
        devices, timer = self._read()
        first = -(-int(new[:, 1].min()) // 1000)
        self._keep(devices, timer, first if timer is None else min(first, timer))
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [pickle.loads(x[0]) for x in self.waiting.get()] if self.waiting.exists() else []
        fixes = np.concatenate(waiting) if waiting else np.empty((0, 2), np.int64)
        past = fixes[:, 1] <= now
        devices, out = taken(self._read()[0], fixes[past], self.gap, now)
        rest = fixes[~past]
        if len(rest):
            self.waiting.put([(pickle.dumps(rest),)])
        elif waiting:
            self.waiting.clear()
        _, last, _, is_open = devices
        due = np.concatenate([rest[:, 1], last[~is_open] + self.gap])
        self._keep(devices, None, -(-int(due.min()) // 1000) if len(due) else None)  # the timer that fired is gone
        yield self._rows(out)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        parts = [pd.DataFrame({"drive_id": d, "number": n, "opens": np.full(len(d), o), "at": t}) for d, n, o, t in out]
        return pd.concat([pd.DataFrame({"drive_id": [], "number": [], "opens": [], "at": []}), *parts]).astype({"drive_id": "int64", "number": "int64", "opens": "bool", "at": "int64"})


def taken(devices: tuple, fixes: np.ndarray, gap: int, now: int) -> tuple[tuple, list[tuple]]:
    """The devices (ids, last, number, open) after ``fixes`` (rows of device and time up to ``now``) and what opened and closed: (ids, numbers, opens, times) each."""
    ids, last, number, is_open = devices
    fixes = fixes[np.lexsort((fixes[:, 1], fixes[:, 0]))]
    new = np.setdiff1d(fixes[:, 0], ids)
    known = np.r_[np.ones(len(ids), bool), np.zeros(len(new), bool)]
    ids, last, number, is_open = np.r_[ids, new], np.r_[last, np.zeros(len(new), np.int64)], np.r_[number, np.zeros(len(new), np.int64)], np.r_[is_open, np.zeros(len(new), bool)]
    order = np.argsort(ids)
    ids, last, number, is_open, known = (x[order] for x in (ids, last, number, is_open, known))
    out = []
    if len(fixes):
        at, place = fixes[:, 1], np.searchsorted(ids, fixes[:, 0])
        first, end = np.r_[True, place[1:] != place[:-1]], np.r_[place[1:] != place[:-1], True]
        before = np.where(first, last[place], np.r_[0, at[:-1]])
        late = (known[place] | ~first) & (at - before > gap)
        opens = late & ~(first & is_open[place])
        total = np.cumsum(opens)
        numbers = number[place] + total - (total - opens)[np.flatnonzero(first)][np.cumsum(first) - 1]
        out = [(fixes[opens, 0], numbers[opens], True, before[opens] + gap), (fixes[late, 0], numbers[late], False, at[late])]
        number[place[end]], last[place[end]], is_open[place[end]] = numbers[end], at[end], False
    gone = ~is_open & (last + gap < now)
    number, is_open = number + gone, is_open | gone
    return (ids, last, number, is_open), [*out, (ids[gone], number[gone], True, last[gone] + gap)]


def outages(fixes: DataFrame, gap_seconds: float = 6.0, time: str = "ts", late: str = "1 second", buckets: int = BUCKETS) -> DataFrame:
    """Openings and closings of a stream of fixes (drive_id and ``time``). Start it by :func:`start_keyed`."""
    rows = fixes.withWatermark(time, late).select(F.pmod(F.xxhash64("drive_id"), F.lit(buckets)).alias("_bucket"), "drive_id", time, F.unix_micros(time).alias("at"))
    found = rows.groupBy("_bucket").transformWithStateInPandas(Outages(round(gap_seconds * 1e6)), "drive_id long, number long, opens boolean, at long", "Append", "EventTime")
    return found.select("drive_id", "number", F.when(F.col("opens"), "open").otherwise("close").alias("kind"), F.timestamp_micros("at").alias("at"))


def outages_batch(fixes: DataFrame, gap_seconds: float = 6.0, time: str = "ts") -> DataFrame:
    """The same over a finished recording, every opening included."""
    from pyspark.sql import Window

    o, gap = Window.partitionBy("drive_id").orderBy("_at"), round(gap_seconds * 1e6)
    rows = fixes.select("drive_id", F.unix_micros(time).alias("_at")).withColumn("_next", F.lead("_at").over(o)).where(F.col("_next").isNull() | (F.col("_next") - F.col("_at") > gap))
    rows = rows.withColumn("number", F.row_number().over(o).cast("long"))
    both = F.array(F.struct(F.lit("open").alias("kind"), (F.col("_at") + gap).alias("at")), F.struct(F.lit("close").alias("kind"), F.col("_next").alias("at")))
    out = rows.select("drive_id", "number", F.explode(both).alias("e")).where(F.col("e.at").isNotNull())
    return out.select("drive_id", "number", "e.kind", F.timestamp_micros("e.at").alias("at"))


# -- windows and late rows ------------------------------------------------


def windows(rows: DataFrame, size: str, late: str, keys: tuple[str, ...] = ("drive_id",), time: str = "ts") -> DataFrame:
    """Counts of tumbling windows, each given once the watermark has passed its end."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))


def divert_late(rows: DataFrame, size_seconds: int, late_seconds: int, path: str, checkpoint: str, time: str = "ts") -> StreamingQuery:
    """Rows that come after their window has closed, in ``path``/late by micro-batch; the clock of every batch in ``path``/clock.

    A batch's clock is the largest event time up to it. A batch closes windows
    by the watermark that the batches before it leave, so a row finds its
    window closed where the clock of the last batch but one, less
    ``late_seconds``, has passed the window's end. It is read from that
    batch's file: a batch that is run again decides alike and replaces its own
    rows.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def clock(number: int) -> int | None:
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/clock/batch={number}")
        return spark.read.schema("newest long").parquet(f"{path}/clock/batch={number}").first()[0] if place.getFileSystem(conf).exists(place) else None

    def keep(batch: DataFrame, number: int) -> None:
        last, before = clock(number - 1), clock(number - 2)
        end = (F.floor(F.unix_micros(time) / (size_seconds * 1_000_000)) + 1) * (size_seconds * 1_000_000)
        shut = F.lit(False) if before is None else end <= before // 1000 * 1000 - late_seconds * 1_000_000
        batch.where(shut).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        newest = batch.agg(F.greatest(F.max(F.unix_micros(time)), F.lit(last).cast("long")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/clock/batch={number}")

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- streams that meet ----------------------------------------------------


def fixes_of_frames(frames: DataFrame, fixes: DataFrame, most_age: str, late: str, time: str = "ts") -> DataFrame:
    """Every frame with each fix of its device not older than ``most_age``, outer: frames without one come once that is certain.

    ``fixes`` has drive_id, fix_ts and further columns. Both sides' watermarks
    and the interval bound the state: rows are forgotten when no partner can
    come any more. The last fix of a frame is :func:`last_fix` of the output.
    """
    f, x = frames.withWatermark(time, late).alias("f"), fixes.withWatermark("fix_ts", late).withColumnRenamed("drive_id", "fix_drive").alias("x")
    near = F.expr(f"f.drive_id = x.fix_drive AND x.fix_ts <= f.{time} AND x.fix_ts >= f.{time} - INTERVAL {most_age}")
    return f.join(x, near, "left_outer").drop("fix_drive")


def last_fix(pairs: DataFrame, key: str, columns: list[str], tie: str) -> DataFrame:
    """Per frame ``key`` the latest of its fixes."""
    return pairs.groupBy(key).agg(F.max(F.struct("fix_ts", tie, *[c for c in columns if c != tie])).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in dict.fromkeys(["fix_ts", *columns])])


# -- seek -----------------------------------------------------------------


def seek(spark: SparkSession, checkpoint: str, batch: int, to: str) -> None:
    """Make ``to`` a checkpoint from which a query goes on after micro-batch ``batch`` of the run in ``checkpoint``.

    Offsets, commits, source logs and state versions up to that batch are
    copied, what came later is left out. The query that is started from it
    reads the same source from the stored offset with the stored state. The
    run's state store must still hold the batch (it keeps the last hundred).
    """
    sc = spark.sparkContext
    path, conf, util = sc._jvm.org.apache.hadoop.fs.Path, sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.FileUtil
    fs = path(checkpoint).getFileSystem(conf)
    if not fs.exists(path(f"{checkpoint}/commits/{batch}")):
        raise ValueError(f"batch {batch} is not committed in {checkpoint}")

    def wanted(parts: list[str]) -> bool:
        number = parts[-1].split(".")[0].split("_")[0]
        if parts[-1].startswith(".") or not number.isdigit():
            return not parts[-1].startswith(".")
        return int(number) <= batch + (parts[0] == "state")  # a batch writes the state version after its number

    def copy(parts: list[str]) -> None:
        for item in fs.listStatus(path("/".join([checkpoint, *parts]))):
            name = [*parts, item.getPath().getName()]
            if item.isDirectory():
                copy(name)
            elif wanted(name):
                util.copy(fs, item.getPath(), fs, path("/".join([to, *name])), False, conf)

    copy([])


def in_files(rows: DataFrame, part, numbers: list[int], folder: str, most_rows: int = 1_000_000) -> int:
    """Write ``rows`` as files for each number of column ``part``, one number after the other: the order in which a file stream takes them.

    Every number but the last gets as many files, which is returned: so many
    that a file of the largest part has about ``most_rows``, but one where a
    part is too small to fill them. The rows are dealt to them by a shuffle.
    """
    counts = {r["_k"]: r["n"] for r in rows.groupBy(part.alias("_k")).agg(F.count("*").alias("n")).collect()}  # a row for each number
    held = [counts[k] for k in numbers[:-1] if k in counts] or [0]
    files = max(1, -(-max(held) // most_rows)) if min(held) >= most_rows // 100 else 1
    for k in numbers if files == 1 else [k for k in numbers if k in counts]:
        rows.where(part == k).repartition(1 if k == numbers[-1] else files).write.mode("append").parquet(folder)
    return files


def forget(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        delete(spark, p)
