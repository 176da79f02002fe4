"""Operators against hand-made cases: the expectations are closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import align, mapmatch, machines, metrics, models, quality, segments, splits
from tidewake.operators.kernels import alignment, rotation, unscented
from tidewake.operators.kernels.inertial import POLICIES, Inertial
from tidewake.operators.kernels.planar import Planar
from tidewake.operators.simulate import BASELINES, CHANNELS, Config, run
from tidewake.sources import files, schema, sinks


def rows(spark, times, drive=1):
    return spark.createDataFrame([(drive, i, float(t), float(i)) for i, t in enumerate(times)], "drive_id int, event_id long, t double, speed double")


def test_two_runs_with_a_gap(spark):
    times = [i * 0.1 for i in range(100)] + [15 + i * 0.1 for i in range(100)]
    found = segments.segments(rows(spark, times), 0.35, 1).orderBy("segment").collect()
    assert [(r["segment"], r["n"]) for r in found] == [(0, 100), (1, 100)]


def test_windows_do_not_cross_gaps_and_end_on_their_target(spark):
    times = [i * 0.1 for i in range(100)] + [20 + i * 0.1 for i in range(100)]
    found = segments.sliding_windows(rows(spark, times), 50, 10, 0.35, arrays=("speed",)).collect()
    assert len(found) == 12
    for r in found:
        assert r["window"][0][-1] == r["target"] and len(r["window"][0]) == 50
        assert r["window"][0] == [r["window"][0][0] + k for k in range(50)]


def test_short_runs_are_kept_by_length(spark):
    times = [0.0, 0.1, 0.2, 0.3, 0.4, 9, 9.1, 9.2, 9.3, 9.4, 20, 20.1]
    assert [r["n"] for r in segments.segments(rows(spark, times), 0.35, 4).orderBy("segment").collect()] == [5, 5]


def test_clock_offset_is_recovered(spark):
    t = [i * 0.1 for i in range(1000)]
    wave = lambda s: 10 + 5 * math.sin(2 * math.pi * 0.05 * s)
    phone = spark.createDataFrame([(1, s + 15, wave(s)) for s in t], "drive_id int, t double, speed double")
    vehicle = spark.createDataFrame([(1, s, wave(s)) for s in t], "drive_id int, t double, speed double")
    (r,) = align.clock_offsets(phone, vehicle, 8.0).collect()
    assert abs(r["tau"] - 15) <= 0.15 and r["r"] > 0.99


def test_interpolation_never_extrapolates(spark):
    left = spark.createDataFrame([(1, i, 10 + i * 0.5) for i in range(80)], "drive_id int, event_id long, t double")
    right = spark.createDataFrame([(1, 1000 + i, 20.0 + i, 5 + i * 0.5) for i in range(21)], "drive_id int, event_id long, t double, v double")
    found = align.interpolated(left, right, "v", "out").collect()
    assert len(found) == 41 and all(abs(r["out"] - (5 + (r["t"] - 20) * 0.5)) < 1e-9 for r in found)


def test_filling_is_by_position(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "k int, i int, v double")
    assert [r["v"] for r in align.filled(df, "v", "i", ["k"]).orderBy("i").collect()] == [2, 2, 4, 6, 8, 8]


def test_navigation_metrics(spark):
    df = spark.createDataFrame([(1, i, i * 0.2, 10.0 if i else 0.0) for i in range(101)], "run int, idx int, err double, step double")
    (r,) = metrics.navigation(df, ["run"], "err", "step", "idx").collect()
    assert (r["distance"], r["final"], r["drift"], r["mae"], r["worst"], r["cep50"]) == (1000, 20, 2, 10, 20, 10)


def test_viterbi_stays_where_nearest_jumps(spark):
    edges = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 0.0), (1, 0.0, 10.0, 100.0, 10.0)], "edge long, x1 double, y1 double, x2 double, y2 double")
    track = [(0, 0.0, 3.0)] + [(i, 20.0 * i, 10.0) for i in range(1, 6)]
    points = spark.createDataFrame([(1, i, i, x, y) for i, x, y in track], "drive_id int, event_id long, idx long, x double, y double")
    near = {r["event_id"]: r["py"] for r in mapmatch.nearest(points, edges, 45.0).collect()}
    assert near[0] == 0
    assert {r["py"] for r in mapmatch.matched(points, edges, ["drive_id"]).collect()} == {10.0}


def fix(i, t, east, **more):
    return {"drive_id": 1, "event_id": i, "t": t, "east": east, "north": 0.0, "accuracy": 3.0, "pred_e": east, "pred_n": 0.0, "var_e": 4.0, "var_n": 4.0, "cov_en": 0.0, "inertial": 1.0} | more


def test_trust_rejects_a_jump_and_forgives_after_many(spark):
    found = [fix(0, 0.0, 0.0), fix(1, 0.1, 50.0), fix(2, 0.2, 1.0, accuracy=60.0), fix(3, 60.0, 2.0, pred_e=40.0)]
    found += [fix(4 + i, 61.0 + i, 2.0, pred_e=40.0) for i in range(18)]
    got = [(r["status"], r["score"]) for r in machines.trust(spark.createDataFrame(found), ["drive_id"]).orderBy("event_id").collect()]
    assert [s for s, _ in got[:4]] == ["TRUSTED", "SUSPICIOUS_JUMP", "DEGRADED", "REJECTED_SPOOFED"]
    assert got[-1][0] == "DEGRADED" and got[0][1] == 1.0 and got[1][1] == 0.75


def test_crash_needs_impact_rotation_and_stillness(spark):
    calm = [(1, i, i * 0.1, 1.0, 5.0, 10.0) for i in range(10)]
    hit = [(1, 10, 1.0, 5.4, 300.0, 8.0), (1, 11, 2.5, 1.0, 1.0, 0.1), (1, 12, 3.1, 1.0, 1.0, 0.1)]
    df = spark.createDataFrame(calm + hit, "drive_id int, event_id long, t double, g double, rate double, speed double")
    states = [r["state"] for r in machines.crashes(df, ["drive_id"]).orderBy("event_id").collect()]
    assert states == ["NORMAL"] * 10 + ["CONFIRMING", "CONFIRMING", "CONFIRMED"]


def test_still_needs_ten_rows_and_two_in_a_row(spark):
    data = [(1, i, i * 0.1, 0.0, 0.0, 9.80665, 0.0, 0.0, 0.0, 5.0 if i == 14 else 0.1) for i in range(30)]
    df = spark.createDataFrame(data, "drive_id int, event_id long, t double, ax double, ay double, az double, gx double, gy double, gz double, speed double")
    still = [r["still"] for r in machines.stationary(df).orderBy("event_id").collect()]
    assert still == [False] * 10 + [True] * 4 + [False, False] + [True] * 14


def test_outage_sessions(spark):
    data = [(1, i, float(i), 0.0, 0.0, 5.0, 1.0) for i in range(20)]
    df = spark.createDataFrame(data, "drive_id int, event_id long, t double, lat double, lon double, step double, uncertainty double")
    (r,) = machines.outages(df, F.col("t").between(10, 15)).collect()
    assert (r["id"], r["seconds"], r["metres"], len(r["points"])) == ("BS-0001", 5.0, 30.0, 6)


def test_resampler_averages_and_fills(spark):
    times = [0.0, 0.03, 0.06, 0.10, 0.13, 0.40]
    df = spark.createDataFrame([(1, i, t, float(i)) for i, t in enumerate(times)], "drive_id int, event_id long, t double, v double")
    got = [(round(r["t"], 3), r["value"], r["filled"]) for r in machines.resampled(df, ["drive_id"], "v").orderBy("t").collect()]
    assert got == [(0.0, 0.0, False), (0.1, 2.0, False), (0.2, pytest.approx(2 + 2.5 / 3), True), (0.3, pytest.approx(2 + 5 / 3), True), (0.4, 4.5, False)]


def test_contract_names_every_fault(spark):
    names = ("ax", "ay", "az", "gx", "gy", "gz", "speed", "val")
    data = [(1, i, i * 0.1, *[0.0] * 8) for i in range(60)] + [(2, i, -i * 0.1 if i == 3 else i * 0.1, 150.0, *[0.0] * 5, 150.0, 0.0) for i in range(10)]
    df = spark.createDataFrame(data, "drive_id int, event_id long, t double, " + ", ".join(f"{n} double" for n in names))
    df = df.withColumn("t", F.when((F.col("drive_id") == 2) & (F.col("event_id") == 5), 0.4).otherwise(F.col("t")))
    got = {r["drive_id"]: r["errors"] for r in quality.contract(df).collect()}
    assert got[1] == "" and got[2] == "too few rows; time does not increase; acceleration out of range; speed out of range"


def test_schema_detection():
    found = schema.detect(["TIME", "ACCELEROMETER X (m/s²)", "ACCELEROMETER Y (m/s²)", "ACCELEROMETER Z (m/s²)", "GYROSCOPE ROLL (rad/s)", "GYROSCOPE PITCH (rad/s)", "GYROSCOPE YAW (rad/s)", "GPS SPEED (m/s)"])
    assert found.kind == "phone" and found.columns["acc_z"] == "ACCELEROMETER Z (m/s²)" and found.columns["speed"] == "GPS SPEED (m/s)" and not found.has_position
    with pytest.raises(ValueError):
        schema.detect(["time", "lat"], "phone")
    assert schema.detect(["Time", "Velocity km/hr"]).columns["wheel_speed"] == "Velocity km/hr"


def test_phone_dates(spark):
    df = spark.createDataFrame([("2019-08-30 18:12:45:703",), ("2019-08-30 18-12-45_703",)], "d string")
    assert [round(r[0], 3) for r in df.select(schema.phone_date_seconds(F.col("d"))).collect()] == [65565.703] * 2


def test_csv_drives_and_zip_members(spark, tmp_path):
    import zipfile

    text = "Time,Acc_x,Acc_y,Acc_z,Gyro_x,Gyro_y,Gyro_z\n0.0,1,2,3,4,5,6\n0.1,1,2,3,4,5,6\n"
    (tmp_path / "S-M.csv").write_text(text)
    (tmp_path / "V-M.csv").write_text("Time,WheelSpeed\n0.0,3\n")
    (tmp_path / "S-Y1.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/S-Q.csv", text)
    got = files.read_drives(spark, str(tmp_path / "S-*.csv"))
    assert {(r["drive_id"], r["acc_y"]) for r in got.collect()} == {("M", 2.0), ("Y1", 2.0)}
    listed = files.listing(spark, str(tmp_path), "*.csv")
    assert [r["drive_id"] for r in files.paired(listed).collect()] == ["M"] and [r[0] for r in files.incomplete(listed).collect()] == ["Y1"]
    assert files.read_zipped(spark, str(tmp_path / "a.zip"), "*.csv", ["Time", "Acc_x"]).count() == 2


def test_split_and_leakage(spark):
    parts = splits.split_drives([str(i) for i in range(10)])
    assert sorted(sum(parts.values(), [])) == sorted(str(i) for i in range(10)) and all(parts.values())
    bad = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "member string, split string")
    with pytest.raises(ValueError):
        splits.require_disjoint(bad)


def test_geojson_and_numbers(spark):
    df = spark.createDataFrame([(12345.678, 1.5, None, True)], "a double, b double, c double, d boolean")
    assert tuple(sinks.telemetry(df).first()) == ("1.2346e+04", "1.500000", "", "1")


# -- kernels --------------------------------------------------------------


def test_planar_jacobian_against_differences():
    rng = np.random.default_rng(0)
    f = Planar.start(4)
    x, acc, rate, pitch = rng.normal(0, 1, (4, 9)), rng.normal(0, 1, 4), rng.normal(0, 0.3, 4), rng.normal(0, 0.1, 4)
    want = np.stack([(f.move(x + d, acc, rate, pitch) - f.move(x - d, acc, rate, pitch)) / 2e-6 for d in np.eye(9) * 1e-6], 2)
    assert np.allclose(f.jacobian(x, acc, rate, pitch), want, atol=1e-5)


def perturbed(f, d):
    q = rotation.product(f.q, rotation.exponential(d[None, 6:9]))
    return Inertial(f.p + d[:3], f.v + d[3:6], q, f.ba + d[9:12], f.bg + d[12:15], f.cov.copy(), f.rate)


def test_inertial_transition_against_differences():
    rng = np.random.default_rng(1)
    f = Inertial.start(1)
    f.v, f.q = rng.normal(0, 5, (1, 3)), rotation.of_euler(*[rng.normal(0, 0.4, 1) for _ in range(3)])
    acc, gyro = rng.normal(0, 1, (1, 3)) + [0, 0, 9.8], rng.normal(0, 0.2, (1, 3))

    def after(d):
        g = perturbed(f, d)
        g.predict(acc, gyro, 0.1)
        return g

    base, columns = after(np.zeros(15)), []
    for d in np.eye(15) * 1e-6:
        a, b = after(d), after(-d)
        turn = [2 * rotation.product(base.q * [1, -1, -1, -1], x.q)[:, 1:] for x in (a, b)]
        columns.append(np.concatenate([a.p - b.p, a.v - b.v, turn[0] - turn[1], a.ba - b.ba, a.bg - b.bg], 1)[0] / 2e-6)
    g = perturbed(f, np.zeros(15))
    q = rotation.product(g.q, rotation.exponential(gyro * 0.1))
    g.q = q
    off = np.abs(g.transition(acc, gyro, np.array([0.1]))[0] - np.array(columns).T)
    off[:6, 12:] = 0  # the gyro bias reaches velocity over the attitude, one step later
    assert off.max() < 2e-2


def test_filters_keep_covariances_and_follow_fixes():
    f, g = Planar.start(3), Inertial.start(3)
    for t in range(100):
        truth = np.tile([t * 1.0, 0.0, 0.0], (3, 1))
        f.predict(np.zeros(3), np.zeros(3))
        g.predict(np.tile([0, 0, 9.80665], (3, 1)), np.zeros((3, 3)))
        f.position(truth)
        g.position(truth)
        g.sideways(policy=POLICIES[t % 3])
    assert np.allclose(f.x[:, 0], 99, atol=2) and np.allclose(g.p[:, 0], 99, atol=3)
    for cov in (f.p, g.cov):
        assert np.allclose(cov, cov.transpose(0, 2, 1)) and np.linalg.eigvalsh(cov).min() > -1e-9
    assert np.allclose(np.linalg.norm(g.q, axis=1), 1)


def test_gates_and_ranges():
    f = Planar.start(2)
    assert f.speed(np.array([np.nan, 70.0])).tolist() == [False, False]
    assert f.speed(np.array([50.0, 1.0])).tolist() == [False, True]
    g = Inertial.start(1)
    g.v[:] = [20.0, 0, 0]
    assert g.speed(np.array([1.0]))[0] and abs(g.v[0, 0] - 1) < 5


def test_levelling_and_standstill():
    g = Inertial.start(1)
    turn = rotation.matrix(rotation.of_euler(np.array([0.1]), np.array([-0.2]), np.array([0.0])))
    acc = (turn.transpose(0, 2, 1) @ np.array([0, 0, 9.80665])[:, None])[..., 0]
    g.level(acc, np.array([0.5]))
    assert np.allclose(rotation.euler(g.body)[0], [0.1, -0.2, 0.5], atol=1e-9)
    for _ in range(50):
        g.predict(acc, np.full((1, 3), 0.01))
        g.standstill(np.full((1, 3), 0.01))
    assert np.linalg.norm(g.v) < 0.05 and np.allclose(g.bg, 0.01, atol=2e-3)


def test_rotation_identities():
    rng = np.random.default_rng(2)
    theta = rng.normal(0, 1, (50, 3))
    r = rotation.matrix(rotation.exponential(theta))
    assert np.allclose(r @ r.transpose(0, 2, 1), np.eye(3)) and np.allclose(np.linalg.det(r), 1)
    assert np.allclose(rotation.matrix(rotation.of_euler(*rotation.euler(r).T)), r, atol=1e-6)
    assert np.allclose(rotation.right_jacobian(np.zeros((1, 3))), np.eye(3))


def test_unscented_equals_linear_filter():
    x, p = np.array([[1.0, 2.0]]), np.eye(2)[None]
    a = np.array([[1, 0.1], [0, 1]])
    m, c = unscented.predict(x, p, lambda s: s @ a.T, 0.1 * np.eye(2))
    assert np.allclose(m, x @ a.T) and np.allclose(c, a @ p @ a.T + 0.1 * np.eye(2), atol=1e-5)


def test_staged_alignment_finds_a_turned_phone():

    rng = np.random.default_rng(0)
    turn = rotation.matrix(rotation.of_euler(np.array([-0.4]), np.array([0.3]), np.array([0.7])))[0]  # vehicle to phone
    machine, states = alignment.Staged(), []
    for k in range(60):
        push = 0.0 if k < 20 else 1.5
        states.append(machine.update(turn @ (np.array([push, 0, 9.81]) + rng.normal(0, 0.01, 3)), k < 20, 0.0 if k < 20 else 0.15 * (k - 20)))
    assert states[0] == "CALIBRATING_GRAVITY" and states[14] == "CALIBRATING_FORWARD" and states[-1] == "CALIBRATED"
    assert np.allclose(machine.rotation @ turn, np.eye(3), atol=0.05)
    still, motion = np.array([turn @ [0, 0, 9.81]] * 20), np.array([turn @ [1.5, 0, 9.81]] * 20)
    found, state = alignment.whole(still, motion)
    assert state == "CALIBRATED" and np.allclose(found @ turn, np.eye(3), atol=1e-6)
    braking = alignment.whole(still, np.array([turn @ [-1.5, 0, 9.81]] * 20), np.array([turn @ [9, 0, 0], turn @ [1, 0, 0]]))[0]
    assert np.allclose(braking @ turn, np.diag([-1, -1, 1]), atol=1e-6)  # velocities say: backwards was the gain


def test_shaken_or_aimless_phones_do_not_calibrate():
    rng = np.random.default_rng(1)
    shaken = alignment.Staged()
    for _ in range(40):
        shaken.update(np.array([0, 0, 9.81]) + rng.normal(0, 2, 3), True)
    assert shaken.state == "CALIBRATING_GRAVITY"
    aimless = alignment.Staged()
    for k in range(80):
        aimless.update(np.array([np.cos(k), np.sin(k), 9.81]), k < 15, 5.0)
    assert aimless.state == "CALIBRATING_FORWARD"  # no direction dominates
    assert alignment.whole(np.array([[0, 0, 9.81]]), np.zeros((0, 3)))[1] == "CALIBRATING_FORWARD"


def frame_inputs(n, **given):
    from tidewake.operators.kernels.frames import INPUTS

    out = {c: np.full(n, np.nan) for c in INPUTS} | {c: np.zeros(n) for c in ("ax", "ay", "gx", "gy", "gz", "denied")} | {"az": np.full(n, 9.80665)}
    return out | {k: np.broadcast_to(np.asarray(v, float), n).copy() for k, v in given.items()}


@pytest.mark.parametrize("kind", ["planar", "inertial"])
def test_frame_step_through_an_outage(kind):
    """Standing, driving with fixes, six seconds without any, dead reckoning, and a smooth return."""
    from tidewake.operators.kernels.frames import Frames

    machine, seen = Frames(1, kind), []
    for k in range(400):
        t, moving = 0.1 * k, k >= 50
        push = min(max(t - 5, 0), 5)  # seconds of acceleration so far: 2 m/s2 towards the phone's top, up to 10 m/s
        x, v = push**2 + 10 * max(t - 10, 0), 2 * push
        fix = k % 10 == 0 and not 150 <= k < 290
        own = {"east": 100 + x, "north": 7, "fix_t": t, "accuracy": 4, "fix_speed": v} if fix else {}
        a = frame_inputs(1, t=t, fix_heading=90, model_speed=v if moving and k % 10 == 0 else np.nan, ay=2 if 0 < push < 5 else 0, az=9.80665 + 0.6 * moving * (-1) ** k, **own)
        seen.append({c: v[0] for c, v in machine.step(a, np.ones(1, bool)).items()} | {"k": k, "x": x})
    assert seen[30]["mode"] == "STATIONARY" and seen[30]["v"] == 0 and abs(seen[30]["pe"] - 100) < 1
    assert seen[140]["mode"] == "GNSS" and abs(seen[140]["pe"] - 100 - seen[140]["x"]) < 8
    first_dark = next(r["k"] for r in seen if r["blackout"])
    assert 195 <= first_dark <= 202 and seen[first_dark]["status"] == "BLACKOUT"  # six seconds after the last fix at 14.0 s
    assert seen[250]["mode"].startswith("DEAD_RECKONING") and seen[289]["dark_metres"] > 30
    back = next(r["k"] for r in seen if r["k"] >= 290 and not r["blackout"])
    assert all(r["mode"] == "REACQUISITION" for r in seen[back : back + 15]) and seen[back + 15]["mode"] != "REACQUISITION"
    assert abs(seen[399]["pe"] - 100 - seen[399]["x"]) < 12


def test_frame_step_trust_denial_and_order():
    from tidewake.operators.kernels.frames import Frames

    machine = Frames(3)
    for k in range(30):
        a = frame_inputs(3, t=0.1 * k, east=0, north=0, fix_t=0.1 * k, accuracy=3, fix_speed=0)
        machine.step(a, np.ones(3, bool))
    a = frame_inputs(3, t=[3.0, 3.0, 1.0], east=[500, 0, 0], north=0, fix_t=3.0, accuracy=[3, 60, 3], fix_speed=0, denied=[0, 0, 1])
    out = machine.step(a, np.ones(3, bool))
    assert out["status"].tolist() == ["SUSPICIOUS_JUMP", "DEGRADED", "BLACKOUT"] and out["blackout"].tolist() == [True, True, True]
    assert out["out_of_order"].tolist() == [False, False, True] and np.all(np.abs(out["pe"]) < 1)


def test_stream_of_frames_equals_batch(spark, sf_dir):
    from tidewake.queries import QUERIES

    rows = [{tuple(r) for r in QUERIES[q](spark, sf_dir).collect()} for q in ("est_16_frame_step", "str_07_frame_step")]
    assert rows[0] == rows[1] and len(rows[0]) > 100


def test_simulated_runs_are_independent():
    rng = np.random.default_rng(5)
    batch = {c: rng.normal(0, 0.1, (3, 30)) for c in CHANNELS}
    batch["inside"], batch["speed"] = np.tile((np.arange(30) > 15).astype(float), (3, 1)), np.full((3, 30), 5.0)
    for config in (Config("a"), Config("b", "inertial"), Config("c", "none")):
        whole = run(batch, config)
        assert np.allclose(whole[1:2], run({k: v[1:2] for k, v in batch.items()}, config))


def test_linear_model_and_loss(spark):
    rng = np.random.default_rng(6)
    windows = rng.normal(0, 1, (400, 6, 10))
    model = models.Linear.fit(windows, windows[:, 0].mean(1) * 3 + 5, low=None)
    assert np.allclose(model.predict(windows)[:, 0], windows[:, 0].mean(1) * 3 + 5, atol=1e-2)
    with pytest.raises(ValueError):
        models.require_training_data("synthetic")
    with pytest.raises(ValueError):
        models.require_known("m", b"x", {})


def test_stream_equals_batch(spark, sf_dir):
    from tidewake.queries import QUERIES
    from tidewake.queries.pipelines import live_rows
    from tidewake.streaming.live import navigate_batch

    batch = {r["event_id"]: round(r["pe"], 4) for r in navigate_batch(live_rows(spark, sf_dir)).collect()}
    live = {r["event_id"]: r["pe"] for r in QUERIES["str_07_stateful_navigation"](spark, sf_dir).collect()}
    assert batch.keys() == live.keys() and all(abs(batch[k] - live[k]) < 2e-4 for k in live)


def test_scenarios_come_from_every_drive(spark, sf_dir):
    from tidewake import queries
    from tidewake.session import table

    counts = {r["user_id"]: r["count"] for r in table(spark, sf_dir, "events").groupBy("user_id").count().collect()}
    grid = queries.QUERIES["join_13_scenario_grid"](spark, sf_dir).collect()
    assert sorted((r["drive_id"], r["first"], r["config"]) for r in grid) == sorted((d, 10, c) for d in counts for c in ("raw", "nhc", "full"))
    samples = queries.QUERIES["join_12_window_samples"](spark, sf_dir).collect()
    assert len(samples) == sum(len(range(5, min(n, 22))) for n in counts.values())
    assert sum(r["inside"] for r in samples) == sum(len(range(10, min(n, 20))) for n in counts.values())


def test_studies_hold_every_run_and_configuration(spark, sf_dir):
    from tidewake import queries
    from tidewake.queries.estimators import scenario_samples

    runs = {r["run"] for r in scenario_samples(spark, sf_dir).where("inside").select("run").distinct().collect()}
    names = {c.name for c in BASELINES}
    found = queries.QUERIES["pipe_04_scenario_configs"](spark, sf_dir).collect()
    assert sorted((r["run"], r["config"]) for r in found) == sorted((r, n) for r in runs for n in names)
    counts = {r["config"]: r["n"] for r in queries.QUERIES["pipe_05_monte_carlo"](spark, sf_dir).collect()}
    assert counts == {**dict.fromkeys(names, len(runs)), None: len(runs) * len(names)}


def test_speed_model_learns_from_every_window(spark):
    from tidewake.queries.estimators import speed_model

    rng = np.random.default_rng(8)
    windows = rng.normal(0, 1, (900, 6, 10))
    targets = np.r_[np.full(600, 3.0), windows[600:, 0].mean(1) * 3 + 5]  # a long first drive tells nothing of the others
    data = [(1 if i < 600 else 2, 0, i, w.tolist(), float(y)) for i, (w, y) in enumerate(zip(windows, targets, strict=True))]
    table = spark.createDataFrame(data, "drive_id int, segment int, start int, window array<array<double>>, target double")
    assert np.allclose(speed_model(table.repartition(5)).weights, models.Linear.fit(windows, targets).weights, atol=1e-9)
    assert not speed_model(table.limit(0)).weights.any()


def test_learned_gains_are_fitted_and_blended(spark, sf_dir):
    from tidewake import queries
    from tidewake.operators import recordings
    from tidewake.queries.estimators import gain_windows

    triples = gain_windows(spark, sf_dir).toPandas()
    x = np.column_stack([np.stack(triples["innovation"]), np.stack(triples["state"]), np.ones(len(triples))])
    gain = np.stack(triples["gain"])
    learned = x @ np.linalg.solve(x.T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ gain)
    got = {n: np.array(sorted(r["innovation"] + r["gain"] for r in queries.QUERIES[n](spark, sf_dir).collect())) for n in ("ml_07_gain_model", "est_17_learned_gain")}
    for name, want in (("ml_07_gain_model", learned), ("est_17_learned_gain", 0.8 * learned + 0.2 * gain)):
        assert np.allclose(got[name], np.array(sorted(np.column_stack([x[:, :3], want]).tolist())), atol=2e-6)
    one = np.ones((3, 9, 3))
    wild = np.stack([2 * one[0], 11 * one[0], np.full((9, 3), np.nan)])
    assert np.allclose(recordings.blended_gain(one, wild)[:, 0, 0], [1.8, 1, 1])


def test_grid_reaches_the_end_of_long_drives(spark, tmp_path):
    from tidewake import queries

    events = [(1, i, "view", f"2024-0{1 + i // 31}-{1 + i % 31:02d} 00:00:00", 1.0) for i in (0, 30, 31, 59)] + [(2, 99, "view", "2024-01-01 00:00:00", 1.0)]
    rows = spark.createDataFrame(events, "user_id long, event_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    found = sorted((r["drive_id"], r["t"], r["last_id"]) for r in queries.QUERIES["src_20_grid_sampling"](spark, str(tmp_path)).collect())
    first = found[0][1]
    assert found == [(1, first + d * 86400.0, 0 if d < 30 else 30 if d < 31 else 31 if d < 59 else 59) for d in range(60)] + [(2, first, 99)]


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_crash_clock_is_the_decimal_one_of_its_sql(spark, tmp_path):
    """An impact on row 4 at 0.8 s: row 14 is at the double next to 2.8, not yet two seconds after it; 14 * 0.2 was."""
    import datetime

    from tidewake.queries.machines import fsm_03

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), 1, "view", 600.0 if i == 4 else 20.0, "") for i in range(17)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    states = [r["state"] for r in fsm_03(spark, str(tmp_path)).orderBy("event_id").collect()]
    assert states == ["NORMAL"] * 4 + ["CONFIRMING"] * 11 + ["CONFIRMED"] * 2
