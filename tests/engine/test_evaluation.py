"""Audited evaluation: gates, no leaks, metrics; the blended return."""

import math

import pytest
from pyspark.sql import functions as F

from tidewake.operators import machines, models
from tidewake.plans import evaluation


@pytest.fixture(scope="module")
def rows(spark):
    data = [(d, d * 1000 + i, i * 0.1, i, 0.2, 0.0, 9.8, 0.0, 0.0, 0.05, 4.0 + d, 4.0 * math.sin(i / 20) + i * 0.4, i * 0.1 * d, 0.4) for d in (1, 2, 3) for i in range(60)]
    return spark.createDataFrame(data, "drive_id long, event_id long, t double, idx int, ax double, ay double, az double, gx double, gy double, gz double, speed double, east double, north double, step double")


@pytest.fixture(scope="module")
def provenance(spark):
    return spark.createDataFrame([(1, "authentic"), (2, "synthetic"), (3, "field")], "drive_id long, authenticity string")


def dark():
    return F.col("idx").between(20, 39)


def fast():
    class Fast:  # a local class travels to the workers by value
        def predict(self, windows):
            return windows[:, :1, -1] * 0 + 4.0

    return Fast()


def test_synthetic_drives_are_left_out_or_marked(rows, provenance):
    _, audit = evaluation.audited(rows, dark(), provenance, fast(), "fast")
    got = {r["drive_id"]: r for r in audit.collect()}
    assert set(got) == {1, 3} and all(r["valid"] and r["hidden_inside"] and r["shown_outside"] and r["finite"] for r in got.values())
    assert got[1]["points"] == 60 and got[1]["dark_points"] == 20 and got[1]["model"] == "fast" and got[1]["dark_metres"] == pytest.approx(8.0)
    _, audit = evaluation.audited(rows, dark(), provenance, allow_synthetic=True)
    assert {r["drive_id"]: r["valid"] for r in audit.collect()} == {1: True, 2: False, 3: True}


def test_an_unsafe_map_and_an_unknown_origin_are_refused(spark, rows, provenance):
    with pytest.raises(ValueError):
        evaluation.audited(rows, dark(), provenance, map_source="unsafe_waypoints")
    _, audit = evaluation.audited(rows, dark(), provenance, map_source="unsafe_waypoints", allow_synthetic=True)
    assert not any(r["valid"] or r["map_safe"] for r in audit.collect())
    odd = spark.createDataFrame([(1, "borrowed")], "drive_id long, authenticity string")
    with pytest.raises(Exception, match="borrowed"):
        evaluation.audited(rows, dark(), odd)[1].collect()


def test_the_truth_inside_an_outage_does_not_reach_the_estimates(rows, provenance):
    moved = rows.withColumn("east", F.when(dark(), F.col("east") + 1e4).otherwise(F.col("east"))).withColumn("speed", F.when(dark(), 99.0).otherwise(F.col("speed")))
    paths = [sorted((r["event_id"], r["pe"], r["pn"]) for r in evaluation.audited(x, dark(), provenance, fast())[0].collect()) for x in (rows, moved)]
    assert paths[0] == paths[1]


def test_errors_are_taken_inside_the_outage(rows, provenance):
    found, _ = evaluation.audited(rows, dark(), provenance, fast())
    (a, b) = evaluation.scored(found).orderBy("drive_id").collect()
    err = {r["idx"]: math.hypot(r["pe"] - r["east"], r["pn"] - r["north"]) for r in found.where("drive_id = 1").collect()}
    inside = [err[i] for i in range(20, 40)]
    assert a["final"] == pytest.approx(inside[-1], abs=2e-3) and a["worst"] == pytest.approx(max(inside), abs=2e-3)
    assert a["rmse"] == pytest.approx(math.sqrt(sum(e * e for e in inside) / 20), abs=2e-3)


def test_a_model_sees_padded_causal_windows(spark, rows):
    class Last:
        def predict(self, windows):
            assert windows.shape[1:] == (6, 10)
            return windows[:, :1, 0] + windows[:, 5:6, -1]

    got = evaluation.speeds(rows.withColumn("ax", F.col("idx").cast("double")), Last()).where("drive_id = 1").orderBy("idx").collect()
    assert [r["model_speed"] for r in got] == pytest.approx([max(0, i - 9) + 0.05 for i in range(60)])
    plain = evaluation.speeds(rows).where("drive_id = 1").orderBy("idx").collect()
    assert [r["model_speed"] for r in plain] == pytest.approx([0.02 * (i + 1) for i in range(60)])


def test_a_return_is_blended_without_a_step(spark):
    data = [(1, i, float(i), 10.0, 0.0, 0.0, 0.0, i == 3) for i in range(20)]
    df = spark.createDataFrame(data, "drive_id int, event_id long, t double, pe double, pn double, fe double, fn double, back boolean")
    got = machines.reacquired(df, F.col("back"), "pe", "pn", "fe", "fn").orderBy("event_id").collect()
    assert [r["out_e"] for r in got[:3]] == [None] * 3 and all(r["jump"] == 10 for r in got[3:])
    path = [r["out_e"] for r in got[3:]]
    assert path == sorted(path, reverse=True) and path[0] > 9.8 and path[-1] == 0 and max(a - b for a, b in zip(path, path[1:])) < 1.1


def test_rows_of_features_are_inferred_in_order(spark):
    class Twice:
        def predict(self, x):
            return x * 2

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "k int, x array<double>")
    assert all(list(r["p"]) == [2.0 * r["k"], 2.0] for r in models.infer_rows(df, "x", Twice(), "p", size=7).collect())
