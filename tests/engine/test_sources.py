"""Sources: recorded channel files, headers, manifests, roads, generated recordings, gates."""

import datetime
import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake import shared
from tidewake.operators import mapmatch, recordings
from tidewake.plans import evaluation
from tidewake.queries import QUERIES
from tidewake.sources import files, sinks, synthetic


def _written(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / name.replace("__", ".").replace("_", "-")).write_bytes(text.encode("latin1"))
    return str(folder)


def test_channels_are_put_together_by_time(spark, tmp_path):
    for name, text in {
        "phone-acc.csv": "drive_id,Time (s),Accelerometer X (m/s²)\n1,0.1,2.5\n1,0.2,3.5\n2,0.1,9\n",
        "phone-gyro.csv": "drive_id,Time (s),Gyroscope Yaw\n1,0.1,0.25\n",
        "gps.csv": "Time (s),drive_id,GPS Latitude,GPS Longitude\n0.2,1,12.5,77.5\n0.3,1,12.6,77.6\n",
        "notes.csv": "drive_id,text\n1,hello\n",
    }.items():
        _written(tmp_path / name, **{"part__csv": text})
    found = files.read_channels(spark, str(tmp_path))
    rows = {(r["drive_id"], r["timestamp"]): (r["acc_x"], r["gyro_z"], r["lat"]) for r in found.collect()}
    assert rows == {(1, 0.1): (2.5, 0.25, None), (1, 0.2): (3.5, None, 12.5), (1, 0.3): (None, None, 12.6), (2, 0.1): (9.0, None, None)}


def test_no_channels_are_an_error(spark, tmp_path):
    _written(tmp_path / "notes.csv", part__csv="drive_id,text\n1,x\n")
    with pytest.raises(ValueError, match="no channel files"):
        files.read_channels(spark, str(tmp_path))


def test_headers_and_located_pairs(spark, tmp_path):
    phone, vehicle = "Time (s),Acc X,GPS Latitude,GPS Longitude", "Time (s),Speed (km/h),Latitude,Longitude"
    filled = lambda head: "\n".join([head, *(",".join(["zz"] * 4) for _ in range(500))])
    folder = _written(tmp_path / "d", S_1__csv=filled(phone), V_1__csv=filled(vehicle), S_2__csv=filled(phone), V_3__csv=filled(vehicle), S_4__csv=filled("Time (s),Acc X"), V_4__csv=filled(vehicle), S_5__csv=phone, V_5__csv=vehicle)
    found = files.headers(spark, f"{folder}/*.csv")
    assert {r["name"]: r["header"] for r in found.collect()} == {"S-1.csv": phone, "S-2.csv": phone, "V-1.csv": vehicle, "V-3.csv": vehicle, "S-4.csv": "Time (s),Acc X", "V-4.csv": vehicle, "S-5.csv": phone, "V-5.csv": vehicle}
    assert sorted(r[0] for r in files.located_pairs(found).collect()) == ["1", "5"]


def test_manifests_that_do_not_parse_are_left_out(spark, tmp_path):
    good = '{"dataset_name": " Mock ", "source": "x", "authenticity": "synthetic", "sensor_type": "imu", "sampling_rate_hz": 10, "drive_ids": ["M", 7]}'
    folder = _written(tmp_path / "m", a__json=good, b__json=good[:60], c__json=good.replace("synthetic", "rumour"), d__json=good.replace('"source": "x", ', ""), e__json="", f__json=good.replace(', "drive_ids": ["M", 7]', "\n").replace("Mock", "Two"))
    found = {r["name"]: (r["authenticity"], r["hz"], r["drives"]) for r in files.manifests(spark, folder).collect()}
    assert found == {"mock": ("synthetic", 10.0, ["M", "7"]), "two": ("synthetic", 10.0, [])}


def test_roads_are_stored_or_a_diagonal(spark):
    centres = spark.createDataFrame([(1, 10.0, -5.0), (9, 0.0, 0.0)], "drive_id int, x double, y double")
    nodes, edges = mapmatch.grids(centres, 3, 50.0)
    assert sorted((r["x"], r["y"]) for r in nodes.where("drive_id = 1").collect()) == [(x, y) for x in (-40.0, 10.0, 60.0) for y in (-55.0, -5.0, 45.0)]
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 8.0), (2, 3.0, 4.0), (2, 6.0, 0.0), (3, 1.0, 1.0)], "drive_id int, x double, y double")
    found = mapmatch.road_graph(edges, points)
    assert found.where("drive_id = 1 AND origin = 'stored'").count() == found.where("drive_id = 1").count() == 24
    assert sorted(tuple(r)[1:5] for r in found.where("drive_id = 2").collect()) == [(0.0, 0.0, 6.0, 8.0), (6.0, 8.0, 0.0, 0.0)]
    assert {r[0] for r in found.select("drive_id").collect()} == {1, 2, 3}  # roads of drives without points are not asked for
    assert mapmatch.road_graph(edges, points.limit(0)).count() == 0


def test_generated_recordings_follow_their_profiles(spark):
    profiles = spark.createDataFrame([(1, 10.0), (2, 20.0)], "drive_id long, cruise double")
    made = synthetic.drive(profiles, 400, (100, 200), noise=0.5)
    rows = made.orderBy("drive_id", "idx").toPandas()
    again = synthetic.drive(profiles.repartition(7), 400, (100, 200), noise=0.5).orderBy("drive_id", "idx").toPandas()
    assert np.array_equal(rows["az"], again["az"]) and np.array_equal(rows["gz"], again["gz"])
    clean = synthetic.drive(profiles, 400, (100, 200)).orderBy("drive_id", "idx").toPandas()
    one = clean[clean["drive_id"] == 1]
    assert one["speed"].max() == 10.0 and one["speed"].iloc[0] == 0.0 and one["dark"].sum() == 100
    heading = np.cumsum(one["gz"] * 0.1)
    assert np.allclose(one["east"], np.cumsum(one["speed"] * np.cos(heading) * 0.1)) and np.allclose(one["north"], np.cumsum(one["speed"] * np.sin(heading) * 0.1))
    two = synthetic.two_wheeler(profiles).where("drive_id = 2").orderBy("idx").toPandas()
    assert np.allclose(two["lean"], [math.atan2(20 * 0.3 * math.sin(0.05 * i), 9.80665) for i in range(600)])
    assert np.allclose(two["north"], np.cumsum(20 * np.sin(np.cumsum(two["gz"] * 0.1)) * 0.1))  # the track follows the curves
    assert synthetic.walk(profiles.limit(0)).count() == 0


def test_gain_triples_do_not_depend_on_partitions(spark):
    rows = [(d, 0, s, [0.1 * d] * 4, [0.01 * s] * 4) for d in range(5) for s in range(6)]
    windows = spark.createDataFrame(rows, "drive_id long, segment long, start long, acc array<double>, rate array<double>")
    found = [np.array(sorted(np.concatenate([r["innovation"], r["state"], r["gain"]]).round(9).tolist() for r in recordings.gain_triples(w).collect())) for w in (windows.repartition(1), windows.repartition(6))]
    assert found[0].shape == (30, 3 + 9 + 27) and np.allclose(found[0], found[1])
    assert recordings.gain_triples(windows.limit(0)).count() == 0


def test_every_gate_refuses_by_its_own_reason(spark):
    asked = [(0, "field", None, None, None, None), (1, "synthetic", None, None, None, "streets"), (2, "authentic", "m", True, "learned", "streets"), (3, "authentic", "m", False, "learned", "unsafe_waypoints"), (4, "field", "m", None, None, None), (5, "field", None, None, "learned", None)]
    requests = spark.createDataFrame(asked, "k int, authenticity string, model string, known boolean, gain string, map_source string")
    assert {r["k"]: r["refused"] for r in evaluation.refusals(requests).collect()} == {0: "", 1: "data", 2: "", 3: "model,map", 4: "model", 5: "gain"}
    with pytest.raises(Exception, match="unknown authenticity"):
        evaluation.refusals(requests.withColumn("authenticity", F.lit("rumour"))).collect()


def test_latency_calls_every_part_for_every_row(spark):
    rows = spark.range(50).select(*[F.col("id").cast("double").alias(c) for c in ("ax", "ay", "az", "gx", "gy", "gz")])
    found = {r["part"]: (r["calls"], r["ms"]) for r in recordings.latency(rows).collect()}
    assert {p: n for p, (n, _) in found.items()} == dict.fromkeys(("predict", "sideways", "fix", "inference"), 50) and all(ms > 0 for _, ms in found.values())
    assert recordings.latency(rows.limit(0)).count() == 0


@pytest.mark.parametrize("mounted", [True, False])
def test_a_folder_for_every_session_has_all_its_rows(spark, tmp_path, monkeypatch, mounted):
    """written and listed by tasks where the folder is mounted, by Spark's writer elsewhere; sessions go over several batches."""
    if not mounted:
        monkeypatch.setattr(shared, "mounted", lambda *_: None)
    rows = [(s, k, float(k * k) if k % 3 else None) for s in (-3, 0, 7, 12, None) for k in range(9, -1, -1)]
    df, folder = spark.createDataFrame(rows, "session long, k long, v double"), f"file://{tmp_path}/s"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        sinks.write_folders(df, folder, "rows.json", ("k",))
        sinks.write_folders(df.where("session > 0").groupBy("session").count(), folder, "summary.json")
        names = ["-3", "0", "12", "7", "__HIVE_DEFAULT_PARTITION__"]
        found = files.folders(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["file"], r["session"]) for r in found) == [*(("rows.json", n) for n in names), ("summary.json", "12"), ("summary.json", "7")]
    assert all(abs(r["modified"].timestamp() - datetime.datetime.now().timestamp()) < 600 for r in found)
    for s, name in zip((-3, 0, 12, 7, None), names, strict=True):
        (at,) = [p for p in Path(tmp_path).rglob(f"session={name}/*") if "summary" not in str(p) and not p.name.startswith(".")]
        want = [{"k": k} | ({} if v is None else {"v": v}) for x, k, v in rows[::-1] if x == s]
        assert [json.loads(x) for x in at.read_text().splitlines()] == want


def _events(spark, folder, n, user):
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.lit(datetime.datetime(2024, 1, 1)).alias("ts"), user.alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit("").alias("props"))
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_sessions_are_listed_without_a_process_for_each(spark, tmp_path):
    """a chmod process for every file and folder took most of the time."""
    made = _events(spark, tmp_path, 4000, F.col("id") % 2000)
    started = lambda: int(Path("/proc/stat").read_text().split("processes ")[1].split()[0])
    before = started()
    found = QUERIES["snk_06_session_listing"](spark, made).collect()
    assert started() - before < 2000
    assert len(found) == 2000 and {r["name"]: r["status"] for r in found} == {k: "DONE" if k % 3 else "INCOMPLETE" for k in range(2000)}


def test_sessions_without_a_number_or_below_zero_are_listed(spark, tmp_path):
    made = _events(spark, tmp_path, 12, F.when(F.col("id") > 1, F.col("id") % 6 - 4))
    assert {r["name"]: r["status"] for r in QUERIES["snk_06_session_listing"](spark, made).collect()} == {None: "INCOMPLETE", 1: "DONE"} | dict.fromkeys((-4, -3, -2, -1, 0), "INCOMPLETE")
