"""Estimators, models and function kernels (EST, FN-08, ML, GOV)."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import estimators, mapmatch, models, recordings, segments
from ..operators.simulate import BASELINES
from ..session import STREAM_SQL, by_time, stream, table
from . import query
from .joins import _EDGES, street_grid, track_points
from .machines import recursive
from .windows import _SEG

_RUN = "OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"


@query("est_10_raw_integration", f", a AS (SELECT *, sum(gz * 0.1) {_RUN} AS h, sum(ax * 0.1) {_RUN} AS v FROM s) SELECT event_id, round(sum(v * cos(h) * 0.1) {_RUN}, 4) + 0 AS pe, round(sum(v * sin(h) * 0.1) {_RUN}, 4) + 0 AS pn FROM a")
def est_10(spark, sf_dir):
    return estimators.integrated(stream(spark, sf_dir)).select("event_id", F.round("pe", 4).alias("pe"), F.round("pn", 4).alias("pn"))


@query("est_11_constant_velocity", ", a AS (SELECT *, first_value(speed) OVER o AS v, first_value(gz) OVER o AS h FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)) SELECT event_id, round(v * cos(h) * 0.1 * idx, 4) + 0 AS pe, round(v * sin(h) * 0.1 * idx, 4) + 0 AS pn FROM a")
def est_11(spark, sf_dir):
    return estimators.constant_velocity(stream(spark, sf_dir)).select("event_id", F.round("pe", 4).alias("pe"), F.round("pn", 4).alias("pn"))


@query("est_12_speed_and_rate", f", a AS (SELECT *, sum(gz * 0.1) {_RUN} AS h FROM s) SELECT event_id, round(sum(speed * cos(h) * 0.1) {_RUN}, 4) + 0 AS pe, round(sum(speed * sin(h) * 0.1) {_RUN}, 4) + 0 AS pn FROM a")
def est_12(spark, sf_dir):
    return estimators.speed_and_rate(stream(spark, sf_dir)).select("event_id", F.round("pe", 4).alias("pe"), F.round("pn", 4).alias("pn"))


def _fused(spark, sf_dir, kind, dark=None):
    return recordings.fused(stream(spark, sf_dir), ["drive_id"], kind, dark).select("event_id", *[F.round(c, 4).alias(c) for c in ("pe", "pn", "v", "sd")])


@query("est_01_planar_filter")
def est_01(spark, sf_dir):
    return _fused(spark, sf_dir, "planar")


@query("est_04_inertial_filter")
def est_04(spark, sf_dir):
    return _fused(spark, sf_dir, "inertial")


@query("est_09_fusion_step")
def est_09(spark, sf_dir):
    return _fused(spark, sf_dir, "planar", "kind = 'error'")


_E = 5e-7  # what keeps the spread of the filter's points positive, as a variance
_UNSCENTED = recursive(
    "SELECT drive_id, event_id, idx AS k, speed AS z FROM s",
    f"r.event_id, 1.02 + 1.01::DOUBLE * {_E} AS a1, 0.1 + 0.1::DOUBLE * {_E} AS b1, 1.1::DOUBLE + {_E} AS c1, a1 + {_E} + 1 AS s1, (a1 + {_E}) / s1 AS k1, b1 / s1 AS k2, k1 * r.z AS v, k2 * r.z AS q, a1 - k1 * k1 * s1 AS a, b1 - k1 * k2 * s1 AS b, c1 - k2 * k2 * s1 AS c",
    f"r.event_id, f.a + 0.2 * f.b + 0.01 * f.c + 0.01 + 1.01 * {_E} AS a2, f.b + 0.1 * f.c + 0.1 * {_E} AS b2, f.c + 0.1 + {_E} AS c2, a2 + {_E} + 1 AS s2, (a2 + {_E}) / s2 AS g1, b2 / s2 AS g2, f.v + 0.1 * f.q + g1 * (r.z - f.v - 0.1 * f.q), f.q + g2 * (r.z - f.v - 0.1 * f.q), a2 - g1 * g1 * s2, b2 - g1 * g2 * s2, c2 - g2 * g2 * s2",
    "SELECT event_id, round(v, 3) AS v FROM f",
)


@query("est_08_unscented", _UNSCENTED, stream=False)
def est_08(spark, sf_dir):
    """For a linear motion and measurement the unscented filter is the Kalman filter, which the SQL is."""
    return recordings.unscented_speed(stream(spark, sf_dir), ["drive_id"]).select("event_id", F.round("v", 3).alias("v"))


def scenario_samples(spark, sf_dir):
    """Runs of 40 rows with the middle 20 dark."""
    o = by_time()
    rows = estimators.with_steps(stream(spark, sf_dir)).withColumn("idx", F.row_number().over(o) - 1)
    run, step = F.concat_ws("-", "drive_id", F.floor(F.col("idx") / 40)), (F.col("idx") % 40).cast("int")
    return rows.select(run.alias("run"), step.alias("step"), "ax", "ay", "az", "gx", "gy", "gz", F.col("east").alias("ref_e"), F.col("north").alias("ref_n"), "speed", (F.col("speed") + F.col("gx")).alias("model_speed"), step.between(10, 29).alias("inside"), F.col("step").alias("moved"))


@query("est_13_blackout_grid")
def est_13(spark, sf_dir):
    found = recordings.study(scenario_samples(spark, sf_dir), BASELINES)
    return found.select("run", "config", *[F.round(c, 3).alias(c) for c in ("distance", "final", "rmse", "drift")], "pass")


@query("est_14_ablations")
def est_14(spark, sf_dir):
    from ..operators.simulate import Config

    configs = (Config("decouple", "inertial"), Config("disable_lateral", "inertial", policy="disable_lateral"), Config("coupled", "inertial", policy="coupled"), Config("true_speed", "planar", true_speed=True), Config("zero_bias", "inertial", zero_bias=True), Config("leveling", "inertial", leveling="full"))
    found = recordings.study(scenario_samples(spark, sf_dir), configs)
    return found.groupBy("config").agg(F.count("*").alias("runs"), F.round(F.percentile("drift", F.lit(0.5)), 3).alias("median_drift"))


#: The decoding as two walks over the steps, forward for the scores and back along the pointers; scores are whole numbers of 2^-20.
_VITERBI = """, h AS (SELECT n.*, s.drive_id, s.idx, x1 + pos * (x2 - x1) AS px, y1 + pos * (y2 - y1) AS py, pos * sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS lat_ FROM n JOIN s USING (event_id)),
k AS (SELECT *, sqrt(pow(east - px, 2) + pow(north - py, 2)) AS d, row_number() OVER (PARTITION BY event_id ORDER BY sqrt(pow(east - px, 2) + pow(north - py, 2)), edge) AS r FROM h),
near AS (SELECT drive_id, idx, event_id, east, north, edge, px, py, lat_ AS along, d, r FROM k WHERE d <= 14 AND r <= 5),
cand AS (SELECT * FROM near UNION ALL SELECT drive_id, idx, event_id, east, north, -1, east, north, 0, 0, 1 FROM s WHERE event_id NOT IN (SELECT event_id FROM near)),
scored AS (SELECT *, round_even((-0.5 * pow(d / 4, 2) - ln(sqrt(2 * pi()) * 4)) * 1048576, 0)::BIGINT AS seen FROM cand),
moves AS (SELECT b.drive_id, b.idx, a.r AS origin, b.r, b.seen + round_even((-(abs(sqrt(pow(b.east - a.east, 2) + pow(b.north - a.north, 2)) - CASE WHEN a.edge = b.edge AND b.edge <> -1 THEN abs(a.along - b.along) ELSE sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) END)
    + CASE WHEN a.edge = b.edge THEN 0 ELSE 30 END) / 15 - ln(15)) * 1048576, 0)::BIGINT AS gain FROM scored a JOIN scored b ON a.drive_id = b.drive_id AND b.idx = a.idx + 1),
ahead AS (SELECT drive_id, idx, r, seen AS score, NULL::BIGINT AS origin FROM scored WHERE idx = 0
    UNION ALL SELECT m.drive_id, m.idx, m.r, max(f.score + m.gain), first(m.origin ORDER BY f.score + m.gain DESC, m.origin) FROM ahead f JOIN moves m ON m.drive_id = f.drive_id AND m.idx = f.idx + 1 AND m.origin = f.r GROUP BY m.drive_id, m.idx, m.r),
ends AS (SELECT drive_id, idx, r, origin FROM (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY idx DESC, score DESC, r) AS place FROM ahead) WHERE place = 1),
back AS (SELECT * FROM ends UNION ALL SELECT a.drive_id, a.idx, a.r, a.origin FROM back b JOIN ahead a ON a.drive_id = b.drive_id AND a.idx = b.idx - 1 AND a.r = b.origin)
SELECT event_id, edge, round(px, 4) AS px, round(py, 4) AS py FROM back JOIN scored USING (drive_id, idx, r)"""


@query("est_15_viterbi", f"WITH RECURSIVE {STREAM_SQL}{_EDGES}{_VITERBI}", stream=False)
def est_15(spark, sf_dir):
    """Each drive's points on the streets by the most likely path."""
    points = track_points(spark, sf_dir).withColumn("idx", F.row_number().over(by_time()) - 1)
    return mapmatch.matched(points, street_grid(spark), ["drive_id"], sigma=4.0).select("event_id", "edge", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"))


@query("est_17_learned_gain")
def est_17(spark, sf_dir):
    return learned_gains(spark, sf_dir, "blended")


def learned_gains(spark, sf_dir, column):
    """The gains of a model fitted on the triples, whole: three innovations, nine states by three."""
    triples = gain_windows(spark, sf_dir)
    found = recordings.with_learned_gain(triples, recordings.gain_model(triples))
    rounded = lambda c: F.transform(c, lambda v: F.round(v, 6))
    return found.select(rounded("innovation").alias("innovation"), rounded(column).alias("gain"))


def gain_windows(spark, sf_dir):
    """A triple for each window of the stream."""
    w = F.col("window")
    return recordings.gain_triples(window_rows(spark, sf_dir).select("drive_id", "segment", "start", w[0].alias("acc"), w[5].alias("rate")))


@query("src_24_gain_triples", _SEG + "SELECT 9 AS state, 27 AS gain FROM k WHERE rn >= 9 AND (rn - 9) % 5 = 0")
def src_24(spark, sf_dir):
    return gain_windows(spark, sf_dir).select(F.size("state").alias("state"), F.size("gain").alias("gain"))


@query("fn_08_rotations", """, n AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS n FROM s),
r AS (SELECT *, CASE WHEN n > 0 THEN sin(n) / n ELSE 1 END AS a, CASE WHEN n > 0 THEN (1 - cos(n)) / (n * n) ELSE 0.5 END AS b FROM n)
SELECT event_id, round(atan2(gx * a + b * gy * gz, 1 + b * (gz * gz - n * n)), 6) + 0 AS roll, round(asin(gy * a - b * gx * gz), 6) + 0 AS pitch, round(atan2(gz * a + b * gx * gy, 1 + b * (gx * gx - n * n)), 6) + 0 AS yaw FROM r""")
def fn_08(spark, sf_dir):
    """Rotation vectors to quaternions, matrices and angles; the SQL goes by Rodrigues' formula."""
    import pandas as pd

    @F.pandas_udf("array<double>")
    def turned(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        from ..operators.kernels import rotation

        return pd.Series(rotation.euler(rotation.matrix(rotation.exponential(np.stack([x, y, z], 1)))).tolist())

    found = stream(spark, sf_dir).select("event_id", turned("gx", "gy", "gz").alias("rpy"))
    return found.select("event_id", *[(F.round(F.col("rpy")[k], 6) + 0.0).alias(c) for k, c in enumerate(("roll", "pitch", "yaw"))])


IMU = ("ax", "ay", "az", "gx", "gy", "gz")


def window_rows(spark, sf_dir):
    return segments.sliding_windows(stream(spark, sf_dir), 10, 5, 43200.0, arrays=IMU)


def speed_model(rows) -> models.Linear:
    return models.Linear.fit_all(rows, "window", "target")


@query("ml_01_speed_model")
def ml_01(spark, sf_dir):
    rows = window_rows(spark, sf_dir)
    return models.infer(rows, "window", speed_model(rows)).select("drive_id", "segment", "start", F.round(F.col("prediction")[0], 4).alias("speed"), F.round("target", 4).alias("target"))


@query("ml_02_denoise_model")
def ml_02(spark, sf_dir):
    """What to add to a window's last sample to reach the mean of the five around it, learned from all windows, within 0.5."""
    around = by_time().rowsBetween(-2, 2)
    rows = stream(spark, sf_dir).withColumn("residual", F.array(*[F.avg(c).over(around) - F.col(c) for c in IMU]))
    windows = segments.sliding_windows(rows, 10, 5, 43200.0, arrays=IMU, statistics={"residual": F.last("residual")})
    model = models.Linear.fit_all(windows, "window", "residual", low=-0.5, high=0.5)
    return models.infer(windows, "window", model).select("drive_id", "segment", "start", F.transform("prediction", lambda v: F.round(v, 4)).alias("residual"))


@query("ml_03_displacement_model")
def ml_03(spark, sf_dir):
    """A window's displacement and the logarithms of its variances, learned from all windows; with the loss of each."""
    ends = {f"{c}{k}": at(c) for c in ("east", "north") for k, at in ((0, F.first), (1, F.last))}
    windows = segments.sliding_windows(stream(spark, sf_dir), 10, 5, 43200.0, arrays=IMU, statistics=ends)
    moved = F.array((F.col("east1") - F.col("east0")) / 100, (F.col("north1") - F.col("north0")) / 100)
    windows = windows.withColumn("moved", moved).select("drive_id", "segment", "start", "window", "moved")
    p, m = F.col("prediction"), F.col("moved")
    found = models.infer(windows, "window", models.Displacement.fit_all(windows, "window", "moved"))
    loss = models.gaussian_nll(m[0] - p[0], p[2]) + models.gaussian_nll(m[1] - p[1], p[3])
    return found.select("drive_id", "segment", "start", *[F.round(p[k], 4).alias(n) for k, n in enumerate(("dx", "dy", "log_var_x", "log_var_y"))], F.round(loss, 4).alias("loss"))


@query("ml_04_gaussian_nll", "SELECT event_id, round(0.5 * (greatest(-6, least(6, gz * 100)) + ay * ay * exp(-greatest(-6, least(6, gz * 100)))), 5) AS nll FROM s")
def ml_04(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", F.round(models.gaussian_nll(F.col("ay"), F.col("gz") * 100), 5).alias("nll"))


@query("ml_05_augmentation")
def ml_05(spark, sf_dir):
    rows = window_rows(spark, sf_dir).withColumn("key", F.abs(F.xxhash64("drive_id", "segment", "start")) % 2**31)
    return models.augmented(rows, "key", "window").select("key", F.round(F.col("window")[0][0], 6).alias("first"))


@query("ml_07_gain_model")
def ml_07(spark, sf_dir):
    return learned_gains(spark, sf_dir, "learned")


@query("gov_04_model_registry", "SELECT n_name AS name, n_nationkey % 5 NOT IN (1, 2) AS known FROM nation", stream=False)
def gov_04(spark, sf_dir):
    """Model contents against their registered digests; every fifth is altered and another one not registered."""
    nations = table(spark, sf_dir, "nation")
    content = F.encode(F.concat_ws("|", "n_name", "n_regionkey"), "utf-8")
    held = nations.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == 1, F.concat(content, F.lit(b"!"))).otherwise(content).alias("content"))
    registry = nations.where("n_nationkey % 5 <> 2").select(F.col("n_name").alias("name"), F.sha2(content, 256).alias("sha256"))
    return models.verified(held, registry)
