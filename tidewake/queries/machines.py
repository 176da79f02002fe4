"""State machines and folds (FSM)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import machines
from ..operators.estimators import with_steps
from ..operators.kernels import alignment
from ..session import STREAM_SQL, by_time, stream
from . import query


def slow(spark, sf_dir):
    """Channels scaled so that a machine meets all of its branches."""
    rows = stream(spark, sf_dir)
    return rows.select("drive_id", "event_id", "t", "kind", "val", (F.col("ax") / 200).alias("ax"), (F.col("ay") / 200).alias("ay"), (9.80665 + (F.col("az") - 9.8) / 5).alias("az"), *[(F.col(c) / 3).alias(c) for c in ("gx", "gy", "gz")], (F.col("speed") / 20).alias("speed"))


_SLOW = ", z AS (SELECT drive_id, event_id, t, kind, val, ax / 200 AS ax, ay / 200 AS ay, 9.80665 + (az - 9.8) / 5 AS az, gx / 3 AS gx, gy / 3 AS gy, gz / 3 AS gz, speed / 20 AS speed FROM s)"


@query("fsm_01_stationary", _SLOW + """, v AS (SELECT *, speed > 0.8 AS veto, sqrt(ax * ax + ay * ay + az * az) AS an, sqrt(gx * gx + gy * gy + gz * gz) AS gn FROM z),
e AS (SELECT *, count(*) FILTER (veto) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM v),
o AS (SELECT *, NOT veto AND count(*) OVER f = 10 AND abs(sqrt(pow(avg(ax) OVER f, 2) + pow(avg(ay) OVER f, 2) + pow(avg(az) OVER f, 2)) - 9.80665) <= 1.2 AND var_pop(an) OVER f < 0.15 AND sqrt(pow(avg(gx) OVER f, 2) + pow(avg(gy) OVER f, 2) + pow(avg(gz) OVER f, 2)) < 0.05 AND max(gn) OVER f < 0.125 AS ok FROM e WINDOW f AS (PARTITION BY drive_id, veto ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY drive_id, veto ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT event_id, ok AND count(*) FILTER (ok) OVER (PARTITION BY drive_id, veto, epoch, run ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) >= 2 AS still FROM r""")
def fsm_01(spark, sf_dir):
    return machines.stationary(slow(spark, sf_dir)).select("event_id", "still")


@query("fsm_02_trust_score", ", f AS (SELECT drive_id, list(CASE WHEN kind = 'view' THEN 1.0 ELSE 0.2 END ORDER BY t, event_id) AS l FROM s GROUP BY drive_id) SELECT drive_id, round(list_reduce(list_prepend(1.0::DOUBLE, l::DOUBLE[]), lambda a, x: a * 0.75 + x * 0.25), 6) AS score FROM f")
def fsm_02(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("target", F.when(F.col("kind") == "view", 1.0).otherwise(0.2))
    return machines.ema(rows, ["drive_id"], "target", 0.25, 1.0).select("drive_id", F.round("out", 6).alias("score"))


def recursive(rows: str, first: str, step: str, out: str) -> str:
    """A fold in SQL: ``rows`` has drive_id and k from 0 on; ``first`` and ``step`` list the state after a row (f: before it)."""
    return f"""WITH RECURSIVE {STREAM_SQL}, r AS ({rows}), f AS (SELECT r.drive_id, r.k, {first} FROM r WHERE r.k = 0
UNION ALL SELECT r.drive_id, r.k, {step} FROM f JOIN r ON r.drive_id = f.drive_id AND r.k = f.k + 1) {out}"""


_TRUST = recursive(
    "SELECT drive_id, event_id, t, east, north, speed, CASE WHEN val > 450 THEN 60.0 WHEN val > 400 THEN NULL ELSE 5.0 END::DOUBLE AS accuracy, sqrt((ax * ax + ay * ay) / (4 + pow(CASE WHEN val > 450 THEN 60.0 WHEN val > 400 THEN 3.0 ELSE 5.0 END, 2))) AS away, row_number() OVER (PARTITION BY drive_id ORDER BY t, event_id) - 1 AS k FROM s WHERE kind = 'view'",
    "r.event_id, CASE WHEN r.accuracy > 50 THEN 'poor' WHEN r.away > 3.5 THEN 'outside' ELSE 'passed' END AS c, r.away, CASE WHEN c = 'poor' THEN 0.75 + 0.25 * 0.2 WHEN c = 'outside' THEN 0.75 + 0.25 * greatest(0, 1 - (r.away - 3.5) * 0.2) ELSE 1.0 END::DOUBLE AS score, CASE WHEN c = 'passed' THEN r.east END AS e, CASE WHEN c = 'passed' THEN r.north END AS n, CASE WHEN c = 'passed' THEN r.t END AS at, CASE WHEN c = 'passed' THEN 0 ELSE 1 END AS rejected",
    "r.event_id, CASE WHEN r.accuracy > 50 THEN 'poor' WHEN sqrt(pow(r.east - f.e, 2) + pow(r.north - f.n, 2)) > 25 AND sqrt(pow(r.east - f.e, 2) + pow(r.north - f.n, 2)) / greatest(r.t - f.at, 1e-3) > r.speed * 2.5 + 15 THEN 'jump' WHEN r.away > 3.5 THEN CASE WHEN f.rejected > 15 THEN 'forced' ELSE 'outside' END ELSE 'passed' END AS c2, r.away, f.score * 0.75 + 0.25 * CASE c2 WHEN 'poor' THEN 0.2 WHEN 'jump' THEN 0.0 WHEN 'forced' THEN 0.5 WHEN 'outside' THEN greatest(0, 1 - (r.away - 3.5) * 0.2) ELSE 1.0 END, CASE WHEN c2 = 'passed' THEN r.east ELSE f.e END, CASE WHEN c2 = 'passed' THEN r.north ELSE f.n END, CASE WHEN c2 = 'passed' THEN r.t ELSE f.at END, CASE c2 WHEN 'passed' THEN 0 WHEN 'forced' THEN f.rejected ELSE f.rejected + 1 END",
    "SELECT event_id, CASE WHEN c IN ('poor', 'forced') THEN 'DEGRADED' WHEN c = 'jump' OR (c = 'outside' AND away <= 6) THEN 'SUSPICIOUS_JUMP' WHEN c = 'outside' THEN 'REJECTED_SPOOFED' ELSE 'TRUSTED' END AS status, round(score, 6) AS score FROM f",
)


@query("fsm_02_trust_engine", _TRUST, stream=False)
def fsm_02_engine(spark, sf_dir):
    rows = stream(spark, sf_dir).where("kind = 'view'").withColumns({"accuracy": F.when(F.col("val") > 450, 60.0).when(F.col("val") > 400, F.lit(None).cast("double")).otherwise(5.0), "pred_e": F.col("east") + F.col("ax"), "pred_n": F.col("north") + F.col("ay"), "var_e": F.lit(4.0), "var_n": F.lit(4.0), "cov_en": F.lit(0.0), "inertial": F.col("speed")})
    return machines.trust(rows, ["drive_id"]).select("event_id", "status", F.round("score", 6).alias("score"))


_CRASH = recursive(
    "SELECT drive_id, event_id, idx AS k, idx * 0.2 AS t, val / 100 AS g, abs(gz) * 4000 AS rate, speed / 5 AS speed FROM s",
    "r.event_id, r.g >= 3.5 AS hit, CASE WHEN hit THEN r.t ELSE 0 END::DOUBLE AS at, CASE WHEN hit THEN r.g ELSE 0 END::DOUBLE AS g, CASE WHEN hit THEN r.rate ELSE 0 END::DOUBLE AS rate, CASE WHEN hit THEN CASE WHEN r.rate >= 250 OR r.g >= 5.25 THEN 'CONFIRMING' ELSE 'IMPACT' END ELSE 'NORMAL' END AS state",
    """r.event_id, f.state = 'NORMAL' AND r.g >= 3.5 AS hit2, CASE WHEN hit2 THEN r.t ELSE f.at END AS at2, CASE WHEN hit2 THEN r.g WHEN f.state = 'IMPACT' THEN greatest(f.g, r.g) ELSE f.g END AS g2, CASE WHEN hit2 THEN r.rate WHEN f.state = 'IMPACT' THEN greatest(f.rate, r.rate) ELSE f.rate END AS rate2,
CASE CASE WHEN hit2 OR f.state = 'IMPACT' THEN CASE WHEN rate2 >= 250 OR g2 >= 5.25 THEN 'CONFIRMING' WHEN hit2 OR r.t - at2 <= 0.5 THEN 'IMPACT' WHEN g2 < 6.3 THEN 'NORMAL' ELSE 'CONFIRMING' END ELSE f.state END
WHEN 'CONFIRMING' THEN CASE WHEN r.speed > 2 AND r.t - at2 > 1 THEN 'NORMAL' WHEN r.t - at2 >= 2 THEN CASE WHEN r.speed <= 1 THEN 'CONFIRMED' ELSE 'NORMAL' END ELSE 'CONFIRMING' END
WHEN 'IMPACT' THEN 'IMPACT' WHEN 'NORMAL' THEN 'NORMAL' ELSE 'CONFIRMED' END""",
    "SELECT event_id, state FROM f",
)


@query("fsm_03_crash", _CRASH, stream=False)
def fsm_03(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("t", (F.row_number().over(by_time()) - 1) / 5)  # as in SQL, the double next to the decimal: 3 * 0.2 is above 0.6
    rows = rows.select("drive_id", "event_id", "t", (F.col("val") / 100).alias("g"), (F.abs("gz") * 4000).alias("rate"), (F.col("speed") / 5).alias("speed"))
    return machines.crashes(rows, ["drive_id"]).select("event_id", "state")


@query("fsm_04_outage_sessions", """, d AS (SELECT *, kind IN ('error', 'click') AS inside, coalesce(sqrt(pow(east - lag(east) OVER o, 2) + pow(north - lag(north) OVER o, 2)), 0) AS step FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)),
b AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY drive_id ORDER BY t, event_id), false) THEN 1 ELSE 0 END AS start FROM d),
n AS (SELECT *, sum(start) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS number FROM b)
SELECT drive_id, printf('BS-%04d', number::BIGINT) AS id, round(max(t) - min(t), 3) AS seconds, round(sum(step), 4) AS metres, count(*) AS points FROM n WHERE inside GROUP BY drive_id, number HAVING max(t) - min(t) >= 7200 OR sum(step) >= 150""")
def fsm_04(spark, sf_dir):
    rows = with_steps(stream(spark, sf_dir)).withColumn("uncertainty", F.col("speed"))
    found = machines.outages(rows, F.col("kind").isin("error", "click"), 7200.0, 150.0)
    return found.select("drive_id", "id", F.round("seconds", 3).alias("seconds"), F.round("metres", 4).alias("metres"), F.size("points").cast("long").alias("points"))


@query("fsm_05_mode", "SELECT event_id, CASE WHEN kind = 'click' AND coalesce(lag(kind) OVER (PARTITION BY drive_id ORDER BY t, event_id), '') = 'error' THEN 'REACQUISITION' WHEN speed < 2 THEN 'STATIONARY' WHEN kind = 'error' OR val / 500 <= 0.7 THEN CASE WHEN speed > 10 THEN 'DEAD_RECKONING_MODEL' ELSE 'DEAD_RECKONING' END ELSE 'GNSS' END AS mode FROM s")
def fsm_05(spark, sf_dir):
    back = (F.col("kind") == "click") & (F.coalesce(F.lag("kind").over(by_time()), F.lit("")) == "error")
    return stream(spark, sf_dir).select("event_id", machines.mode(F.col("val") / 500, F.col("speed") / 100, F.col("speed") < 2, F.col("kind") == "error", back).alias("mode"))


@query("fsm_06_reacquisition", ", e AS (SELECT *, max(CASE WHEN kind = 'view' THEN idx END) OVER (PARTITION BY drive_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS lastv FROM s) SELECT event_id, idx - lastv AS since, round(CASE WHEN idx - lastv >= 15 THEN 1 ELSE 0.5 * (1 - cos(pi() * (idx - lastv + 1) / 15)) END, 6) AS w FROM e WHERE lastv IS NOT NULL")
def fsm_06(spark, sf_dir):
    from ..functions.motion import blend_weight

    rows = stream(spark, sf_dir).withColumn("since", machines.since_event(F.col("kind") == "view", by_time()).cast("long")).where("since IS NOT NULL")
    return rows.select("event_id", "since", F.round(blend_weight(F.col("since")), 6).alias("w"))


@query("fsm_07_magnetic_disturbance", ", m AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS n, t - lag(t) OVER (PARTITION BY drive_id ORDER BY t, event_id) AS dt FROM s), c AS (SELECT event_id, abs(n - 11) AS off, (abs(n - 11) > 1.5)::INT + (CASE WHEN count(*) OVER f >= 5 THEN var_pop(n) OVER f ELSE 0 END > 1.2)::INT + coalesce((CASE WHEN dt > 1e-4 AND dt < 1 THEN abs(n - lag(n) OVER (PARTITION BY drive_id ORDER BY t, event_id)) / dt END > 5)::INT, 0) AS fails FROM m WINDOW f AS (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT event_id, CASE WHEN fails = 0 THEN 'CLEAN' WHEN fails = 1 AND off < 2.25 THEN 'SUSPICIOUS' ELSE 'SEVERE' END AS disturbance FROM c")
def fsm_07(spark, sf_dir):
    return machines.disturbance(stream(spark, sf_dir), 11.0, 1.5, 1.2, 5.0).select("event_id", "disturbance")


def ticks(spark, sf_dir):
    """Rows on an irregular clock of some hundredths of a second, with a long gap before the 41st."""
    step = 0.023 + (F.col("event_id") % 9) * 0.031
    t = F.round(F.sum(step).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), 6) + F.when(F.row_number().over(by_time()) > 40, 1.5).otherwise(0.0)
    rows = stream(spark, sf_dir).withColumn("t", t)
    return rows.select("drive_id", "event_id", "t", "val", "east", "north")


_TICKS = "SELECT drive_id, event_id, val, idx AS k, round(sum(0.023 + (event_id % 9) * 0.031) OVER (PARTITION BY drive_id ORDER BY t, event_id), 6) + CASE WHEN idx >= 40 THEN 1.5 ELSE 0 END AS t FROM s"
_SAMPLES = """, e AS (SELECT *, lag(t) OVER o AS before, lag(last) OVER o AS v0 FROM f WHERE emits WINDOW o AS (PARTITION BY drive_id ORDER BY k)),
p AS (SELECT *, CASE WHEN t - before >= 0.18 AND t - before <= 1 THEN round_even((t - before) / 0.1, 0) ELSE 1 END::INT AS steps FROM e),
m AS (SELECT drive_id, CASE WHEN j = steps THEN t ELSE before + (t - before) * j / steps END AS t, CASE WHEN j = steps THEN last ELSE v0 + (last - v0) * j / steps END AS value, j < steps AS filled, coalesce(t - before > 1, false) AS restart FROM (SELECT *, unnest(range(1, steps + 1)) AS j FROM p))"""
_RESAMPLED = recursive(
    _TICKS,
    "r.t, r.val AS last, 0.0::DOUBLE AS total, 0 AS n, true AS emits, r.t AS at",
    "r.t, CASE WHEN r.t - f.at >= 0.09 THEN (f.total + r.val) / (f.n + 1) ELSE f.last END, CASE WHEN r.t - f.at >= 0.09 THEN 0 ELSE f.total + r.val END, CASE WHEN r.t - f.at >= 0.09 THEN 0 ELSE f.n + 1 END, r.t - f.at >= 0.09, CASE WHEN r.t - f.at >= 0.09 THEN r.t ELSE f.at END",
    _SAMPLES,
)


@query("fsm_08_resampler", _RESAMPLED + " SELECT drive_id, round(t, 6) AS t, round(value, 6) AS value, filled FROM m", stream=False)
def fsm_08(spark, sf_dir):
    found = machines.resampled(ticks(spark, sf_dir), ["drive_id"], "val")
    return found.select("drive_id", F.round("t", 6).alias("t"), F.round("value", 6).alias("value"), "filled")


_TRIGGER = """, w AS (SELECT *, count(*) FILTER (restart) OVER (PARTITION BY drive_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM m),
q AS (SELECT *, row_number() OVER (PARTITION BY drive_id, run ORDER BY t) AS count FROM w),
b AS (SELECT *, coalesce(max(CASE WHEN NOT filled THEN count // 10 END) OVER (PARTITION BY drive_id, run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT drive_id, round(t, 6) AS t, count FROM b WHERE NOT filled AND count // 10 > before AND count >= 20"""


@query("fsm_09_model_trigger", _RESAMPLED + _TRIGGER, stream=False)
def fsm_09(spark, sf_dir):
    return machines.triggered(machines.resampled(ticks(spark, sf_dir), ["drive_id"], "val"), ["drive_id"], 20, 10).select("drive_id", F.round("t", 6).alias("t"), "count")


@query("fsm_10_aligner")
def fsm_10(spark, sf_dir):
    from ..operators.recordings import aligned

    return aligned(stream(spark, sf_dir), ["drive_id"]).select("event_id", "state", F.transform("rotation", lambda x: F.round(x, 4)).alias("rotation"))


#: The level plane's own basis b, c (b as near to x as it goes) turns the axis of the largest moment into half an angle.
_ALIGNED = """, g AS (SELECT drive_id, avg(ax) AS x, avg(ay) AS y, avg(az) AS z FROM s WHERE idx < 30 GROUP BY drive_id),
u AS (SELECT drive_id, x / sqrt(x * x + y * y + z * z) AS ux, y / sqrt(x * x + y * y + z * z) AS uy, z / sqrt(x * x + y * y + z * z) AS uz FROM g),
b AS (SELECT *, sqrt(1 - ux * ux) AS bx, -ux * uy / sqrt(1 - ux * ux) AS by_, -ux * uz / sqrt(1 - ux * ux) AS bz FROM u),
c AS (SELECT *, 0 AS cx, uz * bx - ux * bz AS cy, ux * by_ - uy * bx AS cz FROM b),
f AS (SELECT c.*, ax * bx + ay * by_ + az * bz AS p, ax * cx + ay * cy + az * cz AS q FROM s JOIN c USING (drive_id) WHERE idx BETWEEN 30 AND 59),
m AS (SELECT drive_id, count(*) AS n, avg(p) AS mp, avg(q) AS mq, 0.5 * atan2(2 * avg(p * q), avg(p * p) - avg(q * q)) AS a FROM f GROUP BY drive_id),
v AS (SELECT c.*, n, mp, mq, a, cos(a) * bx + sin(a) * cx AS vx, cos(a) * by_ + sin(a) * cy AS vy, cos(a) * bz + sin(a) * cz AS vz FROM c LEFT JOIN m USING (drive_id)),
w AS (SELECT *, CASE WHEN sqrt(mp * mp + mq * mq) > 0.05 THEN CASE WHEN cos(a) * mp + sin(a) * mq < 0 THEN -1 ELSE 1 END
    WHEN CASE WHEN abs(vx) >= abs(vy) AND abs(vx) >= abs(vz) THEN vx WHEN abs(vy) >= abs(vz) THEN vy ELSE vz END < 0 THEN -1 ELSE 1 END AS way FROM v),
o AS (SELECT *, coalesce(n, 0) > 1 AS moved, sqrt(1 - uy * uy) AS r FROM w),
z AS (SELECT *, CASE WHEN moved THEN way * vx ELSE -uy * ux / r END AS fx, CASE WHEN moved THEN way * vy ELSE r END AS fy, CASE WHEN moved THEN way * vz ELSE -uy * uz / r END AS fz FROM o)
SELECT drive_id, CASE WHEN moved THEN '{calibrated}' ELSE '{forward}' END AS state, round(fx, 5) + 0 AS forward_x, round(fy, 5) + 0 AS forward_y, round(fz, 5) + 0 AS forward_z, round(uy * fz - uz * fy, 5) + 0 AS left_x, round(uz * fx - ux * fz, 5) + 0 AS left_y, round(ux * fy - uy * fx, 5) + 0 AS left_z, round(ux, 5) + 0 AS up_x, round(uy, 5) + 0 AS up_y, round(uz, 5) + 0 AS up_z FROM z"""


@query("fsm_11_batch_aligner", _ALIGNED.format(calibrated=alignment.CALIBRATED, forward=alignment.FORWARD_STAGE))
def fsm_11(spark, sf_dir):
    """Rotation of each drive's phone: gravity from its first 30 rows, the forward axis from the next 30. The SQL goes by angles in the level plane."""
    from ..operators.recordings import batch_aligned

    axes = [f"{a}_{c}" for a in ("forward", "left", "up") for c in "xyz"]
    found = batch_aligned(stream(spark, sf_dir), ["drive_id"], 30, 30)
    return found.select("drive_id", "state", *[(F.round(F.col("rotation")[k], 5) + 0.0).alias(name) for k, name in enumerate(axes)])


@query("fsm_12_absolute_latch", "SELECT event_id, bool_or(kind = 'click') OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS latched FROM s")
def fsm_12(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", F.bool_or(F.col("kind") == "click").over(by_time().rowsBetween(Window.unboundedPreceding, 0)).alias("latched"))


_THIN = """, r AS (SELECT drive_id, list({{'a': {a}, 'b': {b}, 'kept': [event_id::BIGINT]}} ORDER BY idx) AS rows FROM s GROUP BY drive_id),
k AS (SELECT drive_id, list_reduce(rows, lambda acc, x: CASE WHEN {away} >= {least} THEN {{'a': x.a, 'b': x.b, 'kept': list_concat(acc.kept, x.kept)}} ELSE acc END) AS f FROM r)
SELECT unnest(f.kept) AS event_id FROM k"""


@query("fsm_13_path_thinning", _THIN.format(a="east", b="north", away="sqrt(pow(x.a - acc.a, 2) + pow(x.b - acc.b, 2))", least=60.5))
def fsm_13(spark, sf_dir):
    return machines.thinned(stream(spark, sf_dir), ["drive_id"], 60.5).select("event_id")


@query("str_08_throttle", _THIN.format(a="t", b="0.0", away="x.a - acc.a", least=30000.5))
def str_08(spark, sf_dir):
    return machines.thinned(stream(spark, sf_dir), ["drive_id"], 30000.5, throttle=True).select("event_id")


@query("fsm_14_standstill_course", "SELECT event_id, round(CASE WHEN d / 0.1 >= 500 THEN atan2(dn, de) END, 6) AS course, round(CASE WHEN d > 40 THEN de / 0.1 END, 4) AS ve FROM (SELECT event_id, de, dn, sqrt(de * de + dn * dn) AS d FROM (SELECT event_id, east - lag(east) OVER o AS de, north - lag(north) OVER o AS dn FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)))")
def fsm_14(spark, sf_dir):
    from ..operators.estimators import finite_velocity

    return finite_velocity(stream(spark, sf_dir), 0.1, 500.0, 40.0).select("event_id", F.round("course", 6).alias("course"), F.round("ve", 4).alias("ve"))
