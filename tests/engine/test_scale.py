"""What keeps work spread and cheap: few rows dealt before they grow, devices side by side, scores where the positions are."""

import datetime
import itertools

import numpy as np
from pyspark.sql import functions as F

from tidewake.operators import mapmatch, recordings
from tidewake.operators.kernels import alignment
from tidewake.operators.kernels.inertial import Inertial
from tidewake.operators.kernels.planar import Planar
from tidewake.operators.recordings import study
from tidewake.operators.simulate import BASELINES, simulate
from tidewake.session import stream
from tidewake.shared import new_path
from tidewake.sources import synthetic
from tidewake.streaming import live, timed


def test_the_blocks_of_a_step_are_its_whole_derivative():
    rng = np.random.default_rng(1)
    f = Inertial.start(5)
    for _ in range(3):
        f.predict(rng.normal(size=(5, 3)) + [0, 0, 9.8], rng.normal(size=(5, 3)))
    force, omega, dt = rng.normal(size=(5, 3)), rng.normal(size=(5, 3)), np.full(5, 0.1)
    whole = f.transition(force, omega, dt)
    assert np.allclose(f.moved(f.body, force, omega, dt), whole @ f.cov @ whole.transpose(0, 2, 1), rtol=1e-12, atol=1e-15)


def test_an_update_leaves_the_other_runs_untouched():
    f = Inertial.start(3)
    f.predict(np.tile([1.0, 0.0, 9.8], (3, 1)), np.zeros((3, 3)))
    before, cov = f.p.copy(), f.cov.copy()
    assert f.position(np.full((3, 3), 4.0), where=np.array([False, True, False])).tolist() == [False, True, False]
    assert (f.p[[0, 2]] == before[[0, 2]]).all() and (f.cov[[0, 2]] == cov[[0, 2]]).all() and (f.p[1] != before[1]).any()


def test_few_profiles_make_their_samples_in_every_partition(spark):
    profiles = spark.range(40).select(F.col("id").alias("drive_id"), F.lit(10.0).alias("cruise")).groupBy("drive_id").agg(F.max("cruise").alias("cruise"))
    made = synthetic.outage_kilometre(profiles)
    assert made.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_scores_are_those_of_the_listed_positions(spark):
    profiles = spark.createDataFrame([(1, 8.0), (2, 15.0), (3, 21.0)], "drive_id long, cruise double")
    made = synthetic.drive(profiles, 120, (30, 70), 0.2)
    rows = made.select(F.col("drive_id").cast("string").alias("run"), F.col("idx").alias("step"), "ax", "ay", "az", "gx", "gy", "gz", F.col("east").alias("ref_e"), F.col("north").alias("ref_n"), "speed", F.col("speed").alias("model_speed"), F.col("dark").alias("inside"), (F.col("speed") * 0.1).alias("moved"))
    listed = simulate(rows, BASELINES).where("inside").groupBy("run", "config").agg(F.max_by("err", "step"), F.sqrt(F.avg(F.col("err") * F.col("err"))), F.max("err"), F.sum("moved"))
    want = {(r[0], r[1]): tuple(r)[2:] for r in listed.collect()}
    got = {(r["run"], r["config"]): (r["final"], r["rmse"], r["worst"], r["distance"]) for r in study(rows, BASELINES).collect()}
    assert len(want) == 15 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def test_devices_of_one_bucket_do_not_meet(spark):
    """Micro-batches in which devices differ in their number of rows, one comes late and one stays away: all in one bucket as each alone."""
    rng = np.random.default_rng(3)
    rows = [(1 + k // 9, d, 100 * d + k, float(k) - (5.0 if (d, k) == (2, 20) else 0.0), rng.normal(), rng.normal() / 10, 3.0, k * 0.3, k * 0.1 * d, k % 4 == 0) for d in range(1, 6) for k in range(27 - 4 * d) if (d, k // 9) != (3, 1)]
    df = spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], "part int, drive_id long, event_id long, t double, ax double, gz double, speed double, east double, north double, dark boolean")

    def run(buckets):
        folder = new_path(spark, "bucket")
        timed.in_files(df, F.col("part"), [1, 2, 3], f"{folder}/in")
        found = live.navigate(live.paced(spark, df.schema, f"{folder}/in", 1).drop("part"), buckets)
        live.run_available(found, f"{folder}/out", f"{folder}/state")
        return {r["event_id"]: (round(r["pe"], 9), round(r["pn"], 9), r["out_of_order"]) for r in spark.read.parquet(f"{folder}/out").collect()}

    one = run(1)
    assert len(one) == len(rows) and one == run(1000)


def test_a_large_part_is_several_files_of_one_micro_batch(spark):
    folder = new_path(spark, "files")
    df = spark.range(4001).select("id", F.when(F.col("id") == 4000, 3).otherwise(1 + F.floor(F.col("id") / 2000)).cast("int").alias("part"))
    assert timed.in_files(df, F.col("part"), [1, 2, 3], f"{folder}/in", 1000) == 2
    live.write_batches(live.paced(spark, df.schema, f"{folder}/in", 2), f"{folder}/out", f"{folder}/state").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").groupBy("part", "batch").count().collect()) == [(1, 0, 2000), (2, 1, 2000), (3, 2, 1)]


def test_a_tie_of_a_mean_does_not_hang_on_the_order_of_rows(spark, tmp_path):
    """A mean speed of 10.125 exactly, by values whose twentieths are no binary numbers: 10.13 whatever the order."""
    from tidewake.session import exact_mean

    for values in ((202.1, 202.9), (404.9, 0.1)):
        for order in (values, values[::-1]):
            df = spark.createDataFrame([(v / 20,) for v in order], "speed double")
            assert df.agg(F.round(exact_mean("speed"), 2).cast("double")).first()[0] == 10.13
    rows = [(i, datetime.datetime(2024, 1, 1), 1, "view", v, "") for i, v in enumerate((202.1, 202.9))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    from tidewake.queries.updates import pipe_15

    assert {r["speed"] for r in pipe_15(spark, str(tmp_path)).where("motion = 'straight/1'").collect()} == {10.13}


def test_a_filter_that_diverged_leaves_the_others_be():
    """one singular system ended the whole query."""
    f, alone = Planar.start(3), Planar.start(1)
    f.p[1, :3, :3] = -9 * np.eye(3)
    assert f.position(np.ones((3, 3))).tolist() == [True, False, True]
    alone.position(np.ones((1, 3)))
    assert (f.x[[0, 2]] == alone.x).all() and (f.x[1] == 0).all()


def test_phones_side_by_side_are_aligned_as_each_alone():
    """alignment stepped many recordings at once."""
    rng, n = np.random.default_rng(3), 40
    many, each = alignment.Stages(n), [alignment.Staged() for _ in range(n)]
    lean, push = rng.normal(0, 0.3, (n, 3)), rng.choice([0.0, 0.05, 0.3, 2.0], (n, 1)) * rng.normal(size=(n, 3))
    for k in range(220):
        on, still, speed = rng.random(n) < 0.9, rng.random(n) < (0.6 if k < 30 else 0.05), np.where(rng.random(n) < 0.7, rng.random(n) * k / 100, np.nan)
        acc = lean + [0, 0, 9.81] + (push * np.sin(k) + rng.normal(0, 0.02, (n, 3)) if k > 10 else 0)
        acc[rng.random(n) < 0.02] = np.nan
        many.update(acc, still, speed, on)
        for i in np.flatnonzero(on):
            each[i].update(acc[i], bool(still[i]), float(speed[i]))
        assert many.states() == [a.state for a in each]
    assert np.allclose(many.rotation, [a.rotation for a in each], atol=1e-9) and len(set(many.states())) > 1


def test_recordings_cut_over_many_steps_are_whole(spark, sf_dir, monkeypatch):
    """a task takes recordings until it has enough rows, whatever the batches of rows."""
    rows = stream(spark, sf_dir)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = key(recordings.fused(rows, ["drive_id"]))
    monkeypatch.setattr(recordings, "MOST", 100)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        assert key(recordings.fused(rows, ["drive_id"])) == whole and len(whole) == rows.count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_tracks_walked_together_are_walked_alone():
    """one call for many tracks, not one for each."""
    rng, lengths = np.random.default_rng(2), np.array([1, 4, 2, 1, 7])
    matrix = rng.integers(-4, 0, (lengths.sum(), 5, 5)) * 1000
    matrix[rng.random(matrix.shape) < 0.2] = mapmatch._NEVER
    order = rng.permuted(np.tile(np.arange(5), (lengths.sum(), 5, 1)), axis=2)
    entries, ends = mapmatch.walked(matrix, order, lengths)
    cut = np.split(np.arange(lengths.sum()), np.cumsum(lengths)[:-1])
    want = [pair for at in cut for pair in mapmatch.chained([(matrix[k], order[k]) for k in at])]
    assert list(zip(entries.tolist(), ends.tolist(), strict=True)) == want


def test_a_tie_of_a_mean_falls_as_in_the_sql(spark, tmp_path):
    """exact ties of the mean speed that doubles, added up in the stored order, round down in one drive and up in another."""
    import duckdb

    from tidewake.queries import QUERIES, SQL

    values = {1: (335.71, 422.49), 2: (463.53, 409.84, 487.13), **{3 + k: v for k, v in enumerate(itertools.permutations((277.04, 293.06, 429.2)))}, 9: (202.1, 202.9)}
    rows = [(d, k, v) for k in range(3) for d, vs in values.items() for v in vs[k : k + 1]]
    rows = [(len(rows) - i, datetime.datetime(2024, 1, 1), d, "view", v, "") for i, (d, _, v) in enumerate(rows)]
    made = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    made.coalesce(1).write.option("maxRecordsPerFile", 7).parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.sql("SET threads = 1")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.sql(SQL["pipe_15_motion_audit"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["pipe_15_motion_audit"](spark, str(tmp_path)).collect()) == want
    assert {r[3] for r in want if r[0] == "straight/1"} == {18.95}
