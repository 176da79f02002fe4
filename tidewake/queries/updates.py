"""Single filter updates with their closed forms in SQL, and the audits of the motion model (EST-02 to EST-07, PIPE-15, PIPE-16)."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import updates
from ..operators.kernels import rotation
from ..operators.kernels.inertial import Inertial
from ..operators.kernels.planar import Planar
from ..session import stored_mean, stream
from . import query

# Prior variances of a fresh planar filter, for the SQL: position 10, velocity 1, yaw (5 degrees)^2, rate bias 0.02^2.
_YAW = "pow(radians(5), 2)"


def _shown(found, *names):
    return found.select("event_id", *[c for c in found.columns if c.endswith("taken")], *[F.round(c, 6).alias(c) for c in names])


@query("est_02_planar_updates", f"""SELECT event_id, val BETWEEN 0 AND 60 AND val * val / 10 <= 9 AS taken, round(10 / 19.0 * east, 6) + 0 AS pe, round(10 / 19.0 * north, 6) + 0 AS pn, round(ax / 1.01, 6) + 0 AS ve,
    round({_YAW} / ({_YAW} + 0.0025) * gz * 10, 6) + 0 AS yaw, round(CASE WHEN val BETWEEN 0 AND 60 AND val * val / 10 <= 9 THEN val / 10 ELSE 0 END, 6) + 0 AS vm FROM s""")
def est_02(spark, sf_dir):
    """Position, velocity, heading and a model's speed, each on a fresh planar filter."""

    def step(x):
        n = len(x["val"])
        fixed, moving, turned, driven = (Planar.start(n) for _ in range(4))
        zero = np.zeros(n)
        fixed.position(np.stack([x["east"], x["north"], zero], 1))
        moving.velocity(np.stack([x["ax"], x["ay"], zero], 1))
        turned.heading(x["gz"] * 10)
        taken = driven.speed(x["val"], 3.0)
        return {"taken": taken, "pe": fixed.x[:, 0], "pn": fixed.x[:, 1], "ve": moving.x[:, 3], "yaw": turned.x[:, 6], "vm": driven.x[:, 3]}

    found = updates.each(stream(spark, sf_dir), "event_id", ("val", "east", "north", "ax", "ay", "gz"), "taken boolean, pe double, pn double, ve double, yaw double, vm double", step)
    return _shown(found, "pe", "pn", "ve", "yaw", "vm")


@query("est_03_planar_constraints", f"""SELECT event_id, round(ay - ay / q, 6) + 0 AS vn, round({_YAW} * speed * ay / q, 6) + 0 AS yaw, round(ax - ax / 1.0025, 6) + 0 AS vu, round(speed - speed / 1.0001, 6) + 0 AS ve_still,
    round(0.0004 / (0.0004 + 0.000001) * gz, 6) + 0 AS bias FROM (SELECT *, 1 + {_YAW} * speed * speed + 0.0025 AS q FROM s)""")
def est_03(spark, sf_dir):
    """No sideways velocity, and standstill with its rate bias, on planar filters that move."""

    def step(x):
        sliding, still = Planar.start(len(x["speed"])), Planar.start(len(x["speed"]))
        for f in (sliding, still):
            f.x[:, 3], f.x[:, 4], f.x[:, 5] = x["speed"], x["ay"], x["ax"]
        sliding.sideways()
        still.standstill(x["gz"])
        return {"vn": sliding.x[:, 4], "yaw": sliding.x[:, 6], "vu": sliding.x[:, 5], "ve_still": still.x[:, 3], "bias": still.x[:, 8]}

    found = updates.each(stream(spark, sf_dir), "event_id", ("speed", "ax", "ay", "gz"), "vn double, yaw double, vu double, ve_still double, bias double", step)
    return _shown(found, "vn", "yaw", "vu", "ve_still", "bias")


@query("est_05_gated_update", """SELECT event_id, p AS position_taken, v AS velocity_taken, round(CASE WHEN p THEN 25 / 34.0 * east / 5 ELSE 0 END, 6) + 0 AS pe, round(CASE WHEN p THEN sqrt(25 * 9 / 34.0) ELSE 5 END, 6) AS sd,
    round(CASE WHEN v THEN 0.25 / 0.29 * speed / 5 ELSE 0 END, 6) + 0 AS ve FROM (SELECT *, (pow(east / 5, 2) + pow(north / 5, 2)) / 34 + pow(ax, 2) / 61 <= 11.345 AS p, (pow(speed / 5, 2) + pow(ay / 5, 2)) / 0.29 <= 11.345 AS v FROM s)""")
def est_05(spark, sf_dir):
    """Fixes that are not trusted pass the gate of their normalised innovation or leave the filter as it was."""

    def step(x):
        f, g = Inertial.start(len(x["ax"])), Inertial.start(len(x["ax"]))
        p = f.position(np.stack([x["east"] / 5, x["north"] / 5, x["ax"]], 1), trusted=False)
        v = g.velocity(np.stack([x["speed"] / 5, x["ay"] / 5, np.zeros(len(p))], 1), trusted=False)
        return {"position_taken": p, "velocity_taken": v, "pe": f.p[:, 0], "sd": np.sqrt(f.cov[:, 0, 0]), "ve": g.v[:, 0]}

    found = updates.each(stream(spark, sf_dir), "event_id", ("ax", "ay", "east", "north", "speed"), "position_taken boolean, velocity_taken boolean, pe double, sd double, ve double", step)
    return _shown(found, "pe", "sd", "ve")


# at the identity attitude: levelling's innovation variance, the speed update's gate and new anchor
_LEVEL = "(pow(9.80665, 2) * 0.0025 + 0.0025 + 0.25)"


@query("est_06_inertial_updates", f"""SELECT event_id, m OR a AS speed_taken, l AS level_taken, round(25 / 34.0 * east, 6) + 0 AS pe, round(0.25 / 0.29 * speed, 6) + 0 AS ve, round(gz * 5, 6) + 0 AS yaw, round(gz * 8, 6) + 0 AS attitude,
    round(CASE WHEN m THEN v + 0.1 * (z - v) WHEN a THEN z ELSE v END, 6) + 0 AS vm, round(CASE WHEN l THEN 0.0025 * ax / 4 / {_LEVEL} ELSE 0 END, 6) + 0 AS bias
    FROM (SELECT *, NOT m AND abs(v) > 15 AND z < 5 AS a FROM (SELECT *, pow(z - v, 2) / 2.5 <= 9 AS m, (pow(ax / 4, 2) + pow(ay, 2)) / {_LEVEL} <= 9.21 AS l FROM (SELECT *, val / 4 AS v, speed AS z FROM s)))""")
def est_06(spark, sf_dir):
    """Trusted fixes, headings, attitude, a model's speed with its new anchor, and levelling, each on an inertial filter."""

    def step(x):
        n = len(x["val"])
        fixed, moving, turned, held, driven, level = (Inertial.start(n) for _ in range(6))
        zero, none = np.zeros(n), np.full(n, np.nan)
        fixed.position(np.stack([x["east"], x["north"], zero], 1))
        moving.velocity(np.stack([x["speed"], zero, zero], 1))
        turned.heading(x["gz"] * 10)
        held.attitude(np.stack([none, none, x["gz"] * 10], 1))
        driven.v[:, 0] = x["val"] / 4
        taken = driven.speed(x["speed"])
        levelled = level.gravity(np.stack([x["ax"] / 4, x["ay"], zero], 1))
        yaw = lambda f: rotation.euler(f.body)[:, 2]
        return {"speed_taken": taken, "level_taken": levelled, "pe": fixed.p[:, 0], "ve": moving.v[:, 0], "yaw": yaw(turned), "attitude": yaw(held), "vm": driven.v[:, 0], "bias": level.ba[:, 0]}

    outputs = "speed_taken boolean, level_taken boolean, pe double, ve double, yaw double, attitude double, vm double, bias double"
    found = updates.each(stream(spark, sf_dir), "event_id", ("val", "ax", "ay", "gz", "east", "north", "speed"), outputs, step)
    return _shown(found, "pe", "ve", "yaw", "attitude", "vm", "bias")


@query("est_07_level_start", "SELECT event_id, round(atan2(ay, az), 6) + 0 AS roll, round(asin(-ax / g), 6) + 0 AS pitch, round(gz * 10, 6) + 0 AS yaw, round((g - 9.80665) * ax / g, 6) + 0 AS bias FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS g FROM s)")
def est_07(spark, sf_dir):
    """Roll, pitch and accelerometer bias from one standing sample, yaw given."""

    def step(x):
        f = Inertial.start(len(x["ax"]))
        f.level(np.stack([x["ax"], x["ay"], x["az"]], 1), x["gz"] * 10)
        roll, pitch, yaw = rotation.euler(f.body).T
        return {"roll": roll, "pitch": pitch, "yaw": yaw, "bias": f.ba[:, 0]}

    found = updates.each(stream(spark, sf_dir), "event_id", ("ax", "ay", "az", "gz"), "roll double, pitch double, yaw double, bias double", step)
    return _shown(found, "roll", "pitch", "yaw", "bias")


# The motions audited (steps of 0.1 s, specific force less gravity, yaw rate, first speed).
MOTIONS = (
    ("standing", 100, 0.0, 0.0, 0.0, 0.0),
    ("straight", 100, 0.0, 0.0, 0.0, 10.0),
    ("accelerating", 100, 1.0, 0.0, 0.0, 0.0),
    ("braking", 100, -2.0, 0.0, 0.0, 20.0),
    ("turning_in_place", 100, 0.0, 0.0, 0.1, 0.0),
    ("quarter_circle", 157, 0.0, 1.0, 0.1, 10.0),
)
_MOTIONS = ", ".join(f"('{m}', {k}, {fx}::DOUBLE, {fy}::DOUBLE, {w}::DOUBLE, {v}::DOUBLE)" for m, k, fx, fy, w, v in MOTIONS)


@query("pipe_15_motion_audit", f""", c AS (SELECT drive_id, round(avg(speed), 2) / 10 AS size FROM s GROUP BY drive_id), m AS (SELECT motion || '/' || drive_id AS motion, steps, fx * size AS fx, fy * size AS fy, w, v0 * size AS v0 FROM (VALUES {_MOTIONS}) v(motion, steps, fx, fy, w, v0), c), k AS (SELECT *, unnest(range(1, steps + 1)) AS k FROM m),
    v AS (SELECT *, fx * cos(w * k * 0.1) - fy * sin(w * k * 0.1) AS ae, fx * sin(w * k * 0.1) + fy * cos(w * k * 0.1) AS an FROM k),
    d AS (SELECT *, v0 + 0.1 * sum(ae) OVER o AS ve, 0.1 * sum(an) OVER o AS vn FROM v WINDOW o AS (PARTITION BY motion ORDER BY k))
    SELECT motion, round(sum(ve * 0.1 - 0.005 * ae), 4) + 0 AS east, round(sum(vn * 0.1 - 0.005 * an), 4) + 0 AS north, round(max_by(sqrt(ve * ve + vn * vn), k), 4) + 0 AS speed, round(max(w * steps * 0.1), 4) + 0 AS yaw, true AS level FROM d GROUP BY motion""")
def pipe_15(spark, sf_dir):
    """Six motions with known ends, at the size of each drive's mean speed, through the inertial prediction: signs and frames agree, and nothing tilts or rises."""
    fields = ("motion", "steps", "force_x", "force_y", "rate", "speed")
    listed = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(fields, m, strict=True)]) for m in MOTIONS]))
    drives = stored_mean(stream(spark, sf_dir), "speed", 2, "mean").select("drive_id", (F.col("mean") / 10).alias("size"), listed.alias("m"))
    sized = [(F.col(f"m.{c}") * F.col("size")).alias(c) for c in ("force_x", "force_y", "speed")]
    given = drives.select(F.concat_ws("/", "m.motion", "drive_id").alias("motion"), "m.steps", "m.rate", *sized)
    level = (F.abs("roll") < 1e-6) & (F.abs("pitch") < 1e-6) & (F.abs("up") < 1e-6)
    return updates.motions(given).select("motion", *[(F.round(c, 4) + 0.0).alias(c) for c in ("east", "north", "speed", "yaw")], level.alias("level"))


@query("pipe_16_jacobian_audit", "SELECT event_id, true AS exact FROM s")
def pipe_16(spark, sf_dir):
    """The derivatives that the speed and sideways updates use, against differences, at every row's velocity and attitude."""
    rows = stream(spark, sf_dir).select("event_id", F.col("speed").alias("ve"), F.col("ay").alias("vn"), F.col("ax").alias("vu"), (F.col("gx") * 10).alias("rx"), (F.col("gy") * 10).alias("ry"), (F.col("gz") * 20).alias("rz"))
    return updates.jacobian_errors(rows, "event_id").select("event_id", (F.col("worst") < 1e-5).alias("exact"))
