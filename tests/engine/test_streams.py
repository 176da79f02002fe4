"""Event time in streams: timers, late rows, joins of two streams, seek."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.shared import new_path
from tidewake.streaming import live, timed

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def files(spark, rows, schema):
    """rows: (file, ...); one file a micro-batch."""
    folder = new_path(spark, "stream")
    df = spark.createDataFrame(rows, "part int, " + schema)
    timed.in_files(df, F.col("part"), sorted({r[0] for r in rows}), f"{folder}/in")
    return folder, lambda: live.paced(spark, df.schema, f"{folder}/in", 1).drop("part")


def outages(spark, rows):
    folder, stream = files(spark, rows, "drive_id long, ts timestamp")
    found = timed.outages(stream(), 6.0)
    writer = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    timed.start_keyed(writer, spark).awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(timed.OUTAGES).parquet(f"{folder}/out").where("drive_id >= 0").collect())


def test_an_outage_opens_without_a_further_row_of_the_device(spark):
    rows = [(1, 7, at(0)), (1, 7, at(1)), (2, 8, at(60)), (3, 8, at(61))]  # device 7 falls silent, 8 moves the clock
    got = outages(spark, rows)
    assert [x[:3] for x in got] == [(7, 1, "open")] and got[0][3] == at(7).replace(tzinfo=None)


def test_outages_across_batches_and_out_of_order_equal_the_batch_answer(spark):
    rng, rows = random.Random(4), []
    for drive in range(4):
        t = rng.random()
        for k in range(40):
            t += rng.choice([0.5, 1.0, 5.9, 6.1, 20.0])
            rows.append((1 + int(t // 60), drive, at(t)))
    rows = [(part + (1 if rng.random() < 0.1 and at_ - START < datetime.timedelta(seconds=60 * part) and (at_ - START).total_seconds() % 60 > 59.2 else 0), d, at_) for part, d, at_ in rows]
    last = max(r[0] for r in rows) + 2
    finished = spark.createDataFrame([r[1:] for r in rows], "drive_id long, ts timestamp")
    want = sorted(tuple(r) for r in timed.outages_batch(finished, 6.0).collect())
    assert outages(spark, [*rows, (last, -1, at(10**6))]) == want


def test_a_bucket_of_devices_is_each_device(spark):
    """devices that share a state and a timer, in several steps of the clock."""
    rng = np.random.default_rng(6)
    fixes = np.column_stack([rng.integers(-3, 9, 400), rng.integers(0, 3000, 400)])
    steps, got, devices = [700, 701, 1500, 2900, 10_000], [], tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))
    for low, now in zip([-1, *steps[:-1]], steps, strict=True):
        devices, out = timed.taken(devices, fixes[(fixes[:, 1] > low) & (fixes[:, 1] <= now)], 60, now)
        got += [(d, n, "open" if o else "close", t) for ids, numbers, o, times in out for d, n, t in zip(ids.tolist(), numbers.tolist(), times.tolist(), strict=True)]
    df = spark.createDataFrame([(int(d), datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(microseconds=int(t))) for d, t in fixes], "drive_id long, ts timestamp")
    want = timed.outages_batch(df, 60e-6).select("drive_id", "number", "kind", F.unix_micros("at")).collect()
    assert sorted(got) == sorted(tuple(r) for r in want) and len(got) > 50


def test_late_rows_are_diverted_and_not_counted(spark):
    rows = [(1, 1, at(5)), (1, 1, at(15)), (2, 1, at(35)), (3, 1, at(36)), (4, 1, at(3)), (4, 1, at(37)), (5, 1, at(34)), (6, 1, at(500))]
    folder, stream = files(spark, rows, "drive_id long, ts timestamp")
    live.write_stream(timed.windows(stream(), "10 seconds", "2 seconds"), f"{folder}/windows", f"{folder}/s1", None).awaitTermination()
    timed.divert_late(stream(), 10, 2, folder, f"{folder}/s2").awaitTermination()
    counted = {r["window"]["start"]: r["n"] for r in spark.read.parquet(f"{folder}/windows").collect()}
    late = [r["ts"] for r in spark.read.parquet(f"{folder}/late").collect()]
    assert [x for x in late] == [at(3).replace(tzinfo=None)]
    assert counted[at(0).replace(tzinfo=None)] == 1 and counted[at(30).replace(tzinfo=None)] == 4


def test_a_diverted_batch_that_runs_again_decides_alike(spark):
    rows = [(1, 1, at(5)), (2, 1, at(35)), (3, 1, at(36)), (4, 1, at(3))]
    folder, stream = files(spark, rows, "drive_id long, ts timestamp")
    for checkpoint in ("a", "b"):  # the second run repeats every batch over the first one's files
        timed.divert_late(stream(), 10, 2, folder, f"{folder}/{checkpoint}").awaitTermination()
        assert spark.read.parquet(f"{folder}/late").count() == 1


def test_streams_join_on_time_with_outer_rows(spark):
    rows = [(1, "f", 1, 10, at(1)), (1, "x", 1, 90, at(0)), (2, "f", 1, 11, at(30)), (2, "f", 2, 12, at(31)), (3, "x", 1, 91, at(29)), (3, "f", 1, 13, at(200)), (4, "f", -1, -1, at(9000)), (4, "x", -1, -2, at(9000))]
    folder, stream = files(spark, rows, "what string, drive_id long, event_id long, ts timestamp")
    frames = stream().where("what = 'f'").drop("what")
    fixes = stream().where("what = 'x'").select("drive_id", F.col("ts").alias("fix_ts"), F.col("event_id").alias("fix_id"))
    live.write_stream(timed.fixes_of_frames(frames, fixes, "60 SECONDS", "10 seconds"), f"{folder}/out", f"{folder}/state", None).awaitTermination()
    pairs = spark.read.parquet(f"{folder}/out").where("drive_id > 0")
    assert {r["event_id"]: r["fix_id"] for r in timed.last_fix(pairs, "event_id", ["fix_id"], "fix_id").collect()} == {10: 90, 11: 91, 12: None, 13: None}


@pytest.mark.parametrize("batch", [0, 2])
def test_seek_goes_on_as_the_uncut_run(spark, batch):
    rng = random.Random(2)
    rows = [(1 + k // 8, k % 3, k, float(k), rng.random(), rng.random() / 10, 3.0, k * 0.3, k * 0.1, k % 4 == 0) for k in range(32)]
    folder, stream = files(spark, rows, "drive_id long, event_id long, t double, ax double, gz double, speed double, east double, north double, dark boolean")

    def run(name):
        live.write_batches(live.navigate(stream()), f"{folder}/{name}", f"{folder}/state-{name}").awaitTermination()
        return {r["event_id"]: tuple(r)[:-1] for r in spark.read.parquet(f"{folder}/{name}").collect()}

    uncut = run("uncut")
    timed.seek(spark, f"{folder}/state-uncut", batch, f"{folder}/state-rest")
    assert run("rest") == {k: v for k, v in uncut.items() if k >= 8 * (batch + 1)}
    with pytest.raises(ValueError):
        timed.seek(spark, f"{folder}/state-uncut", 99, f"{folder}/nowhere")
