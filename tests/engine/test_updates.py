"""Filter updates, levelling, projection, models, gates and stream control against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.operators import models, recordings, updates
from tidewake.operators.kernels import rotation
from tidewake.operators.kernels.inertial import Inertial
from tidewake.operators.simulate import CHANNELS, LEVELING, Config, run
from tidewake.plans import scenarios
from tidewake.session import stream as stream_of
from tidewake.streaming import live


def test_levelling_takes_the_motion_out():
    """A level filter in a turn reads the turn's own acceleration and must not tilt."""
    f = Inertial.start(2)
    f.v[:, 0], f.rate[:, 2] = 10.0, 0.2
    took = f.gravity(np.array([[1.5, 2.0, 9.80665], [1.5, 2.3, 9.80665]]), 0.3, np.array([1.5, 1.5]))
    angles = rotation.euler(f.body)
    assert took.all() and np.allclose(angles[0], 0, atol=1e-12)
    g2 = 9.80665**2 * 0.0025 + 0.0025 + 0.09
    assert angles[1, 0] == pytest.approx(9.80665 * 0.0025 * 0.3 / g2, rel=1e-6) and f.ba[1, 1] == pytest.approx(0.0025 * 0.3 / g2)


def test_levelling_is_gated():
    f = Inertial.start(1)
    assert not f.gravity(np.array([[6.0, 0.0, 9.8]]), 0.3).any() and np.allclose(f.q, [[1, 0, 0, 0]])


@pytest.mark.parametrize("name,acc,forward,taken", [
    ("fixed", 9.8, 1.9, True), ("fixed", 9.8, 2.1, False), ("steady", 11.1, 0.0, False), ("steady", 10.9, 0.0, True), ("adaptive", 15.0, 5.0, True), ("full", 11.7, 0.0, False),
])
def test_levelling_policies(name, acc, forward, taken):
    f = Inertial.start(1)
    assert LEVELING[name].apply(f, np.array([[forward, 0.0, math.sqrt(acc**2 - forward**2)]]), np.array([forward]))[0] == taken


def test_speed_that_contradicts_a_fast_filter_anchors_it():
    f = Inertial.start(3)
    f.v[:, 0] = [20.0, 20.0, 10.0]
    assert f.speed(np.array([2.0, 8.0, 2.0])).tolist() == [True, False, False]
    assert f.v[:, 0].tolist() == [2.0, 20.0, 10.0]


def test_each_row_is_its_own_filter(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(50)], "event_id long, east double").repartition(7)

    def step(x):
        f = Inertial.start(len(x["east"]))
        f.position(np.stack([x["east"]] + [np.zeros(len(x["east"]))] * 2, 1))
        return {"pe": f.p[:, 0]}

    found = {r["event_id"]: r["pe"] for r in updates.each(rows, "event_id", ("east",), "pe double", step).collect()}
    assert len(found) == 50 and all(found[k] == pytest.approx(k * 25 / 34) for k in found)
    assert updates.each(rows.where("event_id < 0"), "event_id", ("east",), "pe double", step).count() == 0


def test_jacobians_are_those_of_the_model(spark):
    row = spark.createDataFrame([(1, 14.5, 3.2, -0.8, 0.05, -0.08, 0.75)], "event_id long, ve double, vn double, vu double, rx double, ry double, rz double")
    assert updates.jacobian_errors(row, "event_id").first()["worst"] < 1e-7


def test_azimuthal_projection_of_a_published_geodesic(spark):
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    here, there = (dms(-37, 57, 3.7203), dms(144, 25, 29.5244)), (dms(-37, 39, 10.1561), dms(143, 55, 35.3839))
    points = spark.createDataFrame([(*there, *here), (*here, *here)], "lat double, lon double, lat0 double, lon0 double")
    far, same = geo.azimuthal(points, *[F.col(c) for c in ("lat", "lon", "lat0", "lon0")]).collect()
    bearing = math.radians(306 + 52 / 60 + 5.37 / 3600)
    assert math.hypot(far["east"], far["north"]) == pytest.approx(54972.271, abs=2e-3)
    assert far["east"] == pytest.approx(54972.271 * math.sin(bearing), abs=5e-3) and far["north"] == pytest.approx(54972.271 * math.cos(bearing), abs=5e-3)
    assert (same["east"], same["north"]) == (0.0, 0.0) and far.asDict().keys() == {"lat", "lon", "lat0", "lon0", "east", "north"}


def window_table(spark, n=400):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 6, 8))
    feats = models.Linear.features(x)
    noise = rng.normal(size=(n, 2)) * np.array([0.1, 2.0])
    y = feats[:, :2] * 3 + noise
    return x, y, spark.createDataFrame([(k, x[k].tolist(), y[k].tolist()) for k in range(n)], "k int, window array<array<double>>, moved array<double>")


def test_models_of_many_targets_match_least_squares(spark):
    x, y, df = window_table(spark)
    model = models.Linear.fit_all(df.repartition(5), "window", "moved", l2=1e-9, low=None)
    assert np.allclose(model.weights, np.linalg.lstsq(models.Linear.features(x), y, rcond=None)[0], atol=1e-6)


def test_displacement_model_knows_its_errors(spark):
    x, y, df = window_table(spark)
    found = models.Displacement.fit_all(df, "window", "moved").predict(x)
    spread = np.exp(found[:, 2:].mean(0) / 2)
    assert found.shape == (400, 4) and 0.06 < spread[0] < 0.16 and 1.2 < spread[1] < 3.2


def test_displacement_model_without_rows(spark):
    _, _, df = window_table(spark, 1)
    assert np.allclose(models.Displacement.fit_all(df.where("k < 0"), "window", "moved").predict(np.zeros((2, 6, 8)))[:, :1], 0)


def onnx_mean(channels, length):
    """The bytes of a model file that averages a window: one node, written field by field."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n % 128 + 128]), n // 128
        return out + bytes([n])

    number = lambda field, n: varint(field * 8) + varint(n)
    part = lambda field, data: varint(field * 8 + 2) + varint(len(data)) + data
    shape = lambda dims: b"".join(part(1, part(2, d.encode()) if isinstance(d, str) else number(1, d)) for d in dims)
    value = lambda name, dims: part(1, name) + part(2, part(1, number(1, 1) + part(2, shape(dims))))
    axes = part(1, b"axes") + number(8, 1) + number(8, 2) + number(20, 7)
    keep = part(1, b"keepdims") + number(3, 0) + number(20, 2)
    node = part(1, b"x") + part(2, b"y") + part(4, b"ReduceMean") + part(5, axes) + part(5, keep)
    graph = part(1, node) + part(2, b"g") + part(11, value(b"x", ("n", channels, length))) + part(12, value(b"y", ("n",)))
    return number(1, 8) + part(7, graph) + part(8, number(2, 13))


def test_onnx_model_runs_over_batches(spark):
    pytest.importorskip("onnxruntime")
    x, _, df = window_table(spark, 30)
    found = models.infer(df, "window", models.Onnx(onnx_mean(6, 8)), size=7).collect()
    assert all(r["prediction"] == pytest.approx([x[r["k"]].mean()], abs=1e-5) for r in found)


def test_gates(spark):
    kinds = spark.createDataFrame([("authentic",), ("synthetic",), ("field",)], "a string")
    assert [r[0] for r in kinds.select(models.trainable(F.col("a"))).collect()] == [True, False, True]
    for odd in ("other", None):
        with pytest.raises(Exception, match="unknown authenticity"):
            spark.createDataFrame([(odd,)], "a string").select(models.trainable(F.col("a"))).collect()


def test_picker_takes_the_next_free_regime(spark):
    rows = [(1, 5, k, mean, delta, yaw, 1.0) for k, (mean, delta, yaw) in enumerate([(20.0, 9.0, 6.0), (20.0, 9.0, 6.0), (20.0, 9.0, 1.0), (20.0, 0.0, 3.0), (20.0, 0.0, 1.0), (3.0, 0.0, 1.0)])]
    found = scenarios.picked(spark.createDataFrame(rows, "drive_id int, length int, first long, mean double, delta double, yaw double, dist double")).collect()
    assert [(r["first"], r["regime"]) for r in sorted(found)] == [(0, "turning"), (1, "accel_decel"), (2, "high_speed"), (4, "straight"), (5, "low_speed")]


def test_candidates_keep_rows_behind_them(spark):
    rows = spark.range(20).selectExpr("1 AS drive_id", "id AS event_id", "double(id) AS t", "double(id) AS speed", "0.1 AS gz")
    found = scenarios.candidates(rows, (4, 9), 2, 3, 1).collect()
    assert sorted((r["length"], r["first"]) for r in found) == [(4, 2), (4, 5), (4, 8), (4, 11), (4, 14), (9, 2), (9, 5), (9, 8)]
    one = next(r for r in found if (r["length"], r["first"]) == (4, 5))
    assert (one["mean"], one["delta"], one["dist"]) == (6.5, 3.0, pytest.approx(2.6))


def test_replay_is_kept_within_its_speeds(spark):
    rows = spark.range(10).selectExpr("1 AS drive_id", "id AS event_id", "double(id) AS t")
    due = lambda p, s: [round(r["due"], 4) for r in live.replay(rows, ["drive_id"], p, s).orderBy("t").collect()]
    assert due(0.8, 1.0) == [0.0, 0.1] and due(0.8, 99.0) == [0.0, 0.01] and due(0.8, 0.0) == [0.0, 1.0] and due(1.0, 1.0) == []


def test_commands_reach_over_micro_batches(spark, tmp_path):
    """One message a batch gives what one batch of all gives."""
    messages = [(1, k, float(k), cmd) for k, cmd in enumerate([None, "toggle_blackout", None, "other", None, "reset", None, "toggle_blackout", None])]
    schema = "drive_id long, event_id long, t double, cmd string"
    for k, m in enumerate(messages):
        spark.createDataFrame([m], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02}")
    answers = []
    for name, files in (("one", 1), ("all", 100)):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in/*")
        live.run_available(live.controlled(stream), f"{tmp_path}/out-{name}", f"{tmp_path}/{name}")
        answers.append(sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out-{name}").collect()))
    assert answers[0] == answers[1] == [(1, 0, 0, False), (1, 2, 0, True), (1, 4, 0, True), (1, 6, 1, False), (1, 8, 1, True)]


def test_latency_names_its_parts(spark, sf_dir):
    assert {r["part"] for r in recordings.latency(stream_of(spark, sf_dir)).where("ms > 0").collect()} == {"predict", "sideways", "fix", "inference"}


def test_oracle_interventions_remove_their_error():
    """A straight drive with a biased yaw rate, then one with a biased accelerometer, dark from the tenth step on."""
    steps, t = 60, np.arange(60) * 0.1
    batch = {c: np.zeros((1, steps)) for c in CHANNELS}
    batch["az"][:], batch["speed"][:], batch["ref_e"][0] = 9.80665, 10.0, 10 * t
    batch["inside"][0] = np.arange(steps) >= 10
    error = lambda rows, **flags: np.hypot(*(run(rows, Config("x", "inertial", model_speed=False, **flags))[0, -1] - [10 * t[-1], 0.0]))
    turning = {**batch, "gz": np.full((1, steps), 0.05)}
    assert error(turning, true_yaw=True) < 0.5 * error(turning)
    pushed = {**batch, "ax": np.where(np.arange(steps) >= 10, 1.0, 0.0)[None]}
    assert error(pushed, true_force=True) < 0.1 * error(pushed)
