"""Viterbi in blocks, offset search, freshness, streamed machines and perturbations against brute force."""

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewake.operators import align, machines, mapmatch
from tidewake.operators.fold import scan
from tidewake.plans import scenarios


@pytest.fixture(scope="module")
def tracks(spark):
    """Two tracks over a street grid, one of them on a lattice of round coordinates, where many paths are equal."""
    _, edges = mapmatch.grid_graph(spark, 4, 50.0)
    rng = np.random.default_rng(1)
    rows = [("a", i, i, float(x), float(y)) for i, (x, y) in enumerate(np.cumsum(rng.normal(0, 6, (41, 2)), 0))]
    rows += [("b", 100 + i, i, float(10 * (i % 5) - 20), float(25 * (i % 3) - 25)) for i in range(37)]
    rows += [("c", 200, 0, 1.0, 1.0), ("d", 300, 0, 9e5, 9e5), ("d", 301, 1, 9e5, 9e5)]
    return spark.createDataFrame(rows, "drive_id string, event_id long, idx long, x double, y double"), edges.select("edge", "x1", "y1", "x2", "y2")


def best_path(steps, sigma, beta):
    """Over all paths: the best sum, of equal ones the one with the smallest candidates from its end on."""
    unit = mapmatch.UNIT
    emit = lambda c: round((-0.5 * (c["distance"] / sigma) ** 2 - math.log(math.sqrt(2 * math.pi) * sigma)) / unit)

    def move(a, b):
        same = a["edge"] == b["edge"]
        routed = abs(a["along"] - b["along"]) if same and b["edge"] != -1 else math.hypot(a["px"] - b["px"], a["py"] - b["py"])
        return round((-(abs(math.hypot(a["x"] - b["x"], a["y"] - b["y"]) - routed) + (0 if same else 2 * beta)) / beta - math.log(beta)) / unit)

    best = {(k,): emit(c) for k, c in enumerate(steps[0])}
    for a, b in itertools.pairwise(steps):
        new = {}
        for j, c in enumerate(b):
            score, path = min(((-(s + move(a[p[-1]], c)), p[::-1]) for p, s in best.items()))
            new[(*path[::-1], j)] = -score + emit(c)
        best = new  # one path for each last candidate
    return min((-s, p[::-1]) for p, s in best.items())[1][::-1]


def test_paths_do_not_depend_on_the_block_size(spark, tracks):
    points, edges = tracks
    want = {}
    found = mapmatch.candidates(points, edges, 12.0).toPandas()
    for _, own in found.groupby("drive_id"):
        steps = [g.sort_values("rank").to_dict("records") for _, g in own.sort_values("idx").groupby("idx")]
        want |= {c[k]["event_id"]: c[k]["edge"] for c, k in zip(steps, best_path(steps, 12.0, 15.0), strict=True)}
    for size, bucket in ((1, 10), (2, 50_000), (7, 30), (512, 50_000)):
        got = mapmatch.matched(points, edges, ["drive_id"], sigma=12.0, size=size, bucket=bucket).collect()
        assert {r["event_id"]: r["edge"] for r in got} == want and len(got) == len(want), size


def test_offsets_by_fft_equal_the_grid_search():
    rng = np.random.default_rng(3)
    for n in (60, 151, 400):
        x = rng.normal(size=n + 40)
        p, v = x[:n].copy(), x[11 : n + 11] * 2 + 5
        p[rng.integers(0, n, n // 10)] = np.nan
        v[rng.integers(0, n, n // 12)] = np.nan
        r, count, _ = align.lag_correlations(p, v, 30)
        for m in range(-30, 31):
            both = [(p[k], v[k - m]) for k in range(n) if 0 <= k - m < n and np.isfinite(p[k]) and np.isfinite(v[k - m])]
            assert count[m + 30] == len(both)
            assert r[m + 30] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-9)
        assert np.argmax(np.where(count > 20, r, -2)) - 30 == 11


def test_offset_ties_and_short_recordings(spark):
    wave = [math.sin(2 * math.pi * k / 20) for k in range(200)]  # repeats every two seconds: every second one fits
    rows = [("w", k * 0.1 + 5, wave[k]) for k in range(200)] + [("short", k * 0.1, wave[k]) for k in range(20)] + [("flat", k * 0.1, 1.0) for k in range(200)]
    table = spark.createDataFrame(rows, "drive_id string, t double, speed double")
    other = table.withColumn("t", F.when(F.col("drive_id") == "w", F.col("t") - 5).otherwise(F.col("t")))
    got = {r["drive_id"]: (round(r["tau"], 6), round(r["tau0"], 6)) for r in align.clock_offsets(table, other, 6.0).collect()}
    assert got == {"w": (5.0, 5.0), "short": (0.0, 0.0), "flat": (0.0, 0.0)}


def test_freshness_goes_by_the_last_accepted_fix(spark):
    a, b = (28.6139, 77.2090), (28.6140, 77.2090)
    frames = [(0, 1000.0, *a, False), (1, 1000.0, *a, False), (2, 1000.0, *b, True), (3, 1000.0, *b, False), (4, 1000.0, *a, False), (5, None, *a, False), (6, None, *b, False), (7, 1001.0, *b, False), (8, 1001.0, math.nan, 0.0, False), (9, 1001.0, None, None, False), (10, 1001.00005, *b, False), (11, 1001.0, *b, False)]
    df = spark.createDataFrame([(1, i, float(i), t, la, lo, d) for i, t, la, lo, d in frames], "drive_id int, event_id long, t double, fix_t double, lat double, lon double, denied boolean")
    got = [r["fresh"] for r in align.fresh(df, ["drive_id"]).orderBy("event_id").collect()]
    assert got == [True, False, False, True, True, False, True, False, False, False, False, False]


def test_a_scan_carries_its_state_over_batches_and_groups(spark):
    def machine():
        total = 0

        def step(k, x):
            nonlocal total
            total += x or 0
            return ((k, total),) * (k % 3)

        return step

    rows = [(g, k, None if k % 5 == 0 else k) for g in ("a", None, "b") for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, x long").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = scan(df, ["g"], ["k"], ["x"], machine, "k long, total long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(g, k, sum(i for i in range(k + 1) if i % 5)) for g in ("a", None, "b") for k in range(500) for _ in range(k % 3)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert scan(df.limit(0), ["g"], ["k"], ["x"], machine, "k long, total long").collect() == []


def test_a_long_recording_is_resampled_in_linear_time(spark):
    df = spark.range(300_000).select(F.lit(1).alias("drive_id"), F.col("id").alias("event_id"), (F.col("id") * 0.02).alias("t"), F.sin("id").alias("v"))
    began = time.time()
    assert machines.resampled(df, ["drive_id"], "v").count() == 60_000
    assert time.time() - began < 40


def test_perturbations_reach_the_target_and_follow_keys(spark):
    found = spark.createDataFrame([(d, f, f + 10, 1.0) for d in range(5) for f in range(0, 50, 5)], "drive_id long, first int, last int, dist double")
    key = lambda df: sorted(map(tuple, df.collect()))
    got = scenarios.perturbed(found, 128)
    assert key(got) == key(scenarios.perturbed(found.repartition(7), 128))
    rows = got.toPandas()
    assert len(rows) == 128 and rows["copy"].value_counts().to_dict() == {0: 50, 1: 50, 2: 28}
    assert (rows.loc[rows["copy"] == 0, ["acc_bias", "gyro_bias"]] == 0).all().all() and rows["acc_bias"].abs().max() <= 0.3
    assert rows.groupby("copy").get_group(2)[["drive_id", "first"]].max().tolist() == [2, 45]  # the first in order get one more
    assert scenarios.perturbed(found, 10).count() == 50 and scenarios.perturbed(found.limit(0), 10).count() == 0


def test_noise_is_normal_and_follows_keys(spark):
    zero = F.lit(0.0)
    rows = spark.range(40_000).select((F.col("id") % 7).alias("drive_id"), F.lit(0).alias("first"), F.when(F.col("id") < 10, 0).otherwise(1).alias("copy"), F.col("id").alias("idx"), zero.alias("acc_bias"), zero.alias("gyro_bias"), *[zero.alias(c) for c in ("ax", "ay", "az", "gx", "gy", "gz")])
    got = scenarios.disturbed(rows, acc_noise=1.0, gyro_noise=1.0).toPandas().sort_values("idx")
    again = scenarios.disturbed(rows.repartition(5), acc_noise=1.0, gyro_noise=1.0).toPandas().sort_values("idx")
    pd.testing.assert_frame_equal(got.reset_index(drop=True), again.reset_index(drop=True))
    assert (got.loc[got["copy"] == 0, ["ax", "gz"]] == 0).all().all()
    x = got.loc[got["copy"] == 1, ["ax", "ay", "az", "gx", "gy", "gz"]].to_numpy()
    assert np.abs(x.mean(0)).max() < 0.03 and np.abs(x.std(0) - 1).max() < 0.02 and np.abs((x**4).mean(0) - 3).max() < 0.2
    assert np.abs(np.corrcoef(x.T) - np.eye(6)).max() < 0.03


def test_a_drive_file_of_another_layout_is_refused(spark, tmp_path):
    from tidewake.sources import files

    header = "Time (s),Indicated Vehicle Speed (km/h),Yaw Rate"
    (tmp_path / "V-1.csv").write_text(header + "\n0,2,3\n")
    (tmp_path / "V-2.csv").write_text(header + "\n0,5,6\n")
    assert len(files.read_drives(spark, str(tmp_path)).collect()) == 2
    (tmp_path / "V-3.csv").write_text("Yaw Rate,Time (s),Indicated Vehicle Speed (km/h)\n9,0,5\n")
    with pytest.raises(Exception, match="(?i)header|conform"):
        files.read_drives(spark, str(tmp_path)).collect()
