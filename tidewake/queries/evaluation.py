"""End-to-end runs: dead reckoning with an estimator, audited evaluation, mixed-rate streams through the frame step (PIPE-02, -07, -20, FSM-06)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, recordings
from ..operators.estimators import with_steps
from ..plans import evaluation
from ..session import STREAM_SQL, by_time, stream
from . import query
from .estimators import speed_model, window_rows


def _rows(spark, sf_dir):
    return with_steps(stream(spark, sf_dir)).withColumn("idx", F.row_number().over(by_time()) - 1)


def _dark():
    return F.col("idx").between(10, 29)


@query("pipe_02_estimated")
def pipe_02_estimated(spark, sf_dir):
    """Causal windows, the fitted speed model, the fusion filter and road matching over every drive."""
    from .joins import street_grid

    rows = evaluation.gated(_rows(spark, sf_dir), _dark())
    found = evaluation.navigated(rows, speed_model(window_rows(spark, sf_dir)), edges=street_grid(spark), sigma=4.0)
    return found.select("event_id", "is_outage", F.round("pe", 3).alias("pe"), F.round("pn", 3).alias("pn"))


def _provenance(spark, sf_dir):
    kind = F.when(F.col("drive_id") % 5 == 0, "synthetic").when(F.col("drive_id") % 5 == 1, "field").otherwise("authentic")
    return stream(spark, sf_dir).select("drive_id").distinct().withColumn("authenticity", kind)


def _audited(spark, sf_dir):
    return evaluation.audited(_rows(spark, sf_dir), _dark(), _provenance(spark, sf_dir), speed_model(window_rows(spark, sf_dir)), "ridge")


@query("pipe_07_audited_evaluation", """, d AS (SELECT drive_id, idx, coalesce(sqrt(pow(east - lag(east) OVER o, 2) + pow(north - lag(north) OVER o, 2)), 0) AS step FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id))
SELECT drive_id, CASE WHEN drive_id % 5 = 1 THEN 'field' ELSE 'authentic' END AS authenticity, true AS valid, count(*) AS points, count(*) FILTER (idx BETWEEN 10 AND 29) AS dark_points, 'ridge' AS model, true AS map_safe, true AS hidden_inside, true AS shown_outside, true AS finite,
    round(coalesce(sum(step) FILTER (idx BETWEEN 10 AND 29), 0), 3) AS dark_metres FROM d WHERE drive_id % 5 > 0 GROUP BY drive_id""")
def pipe_07(spark, sf_dir):
    """The audit of every drive that may be evaluated: synthetic ones are left out, the filter ran, nothing leaked."""
    return _audited(spark, sf_dir)[1].withColumn("dark_metres", F.round("dark_metres", 3))


@query("pipe_07_audited_metrics")
def pipe_07_metrics(spark, sf_dir):
    return evaluation.scored(_audited(spark, sf_dir)[0])


# -- mixed rates ----------------------------------------------------------

_EVERY, _PACE, _STALE = 41, 10, 6.0


def mixed(spark, sf_dir):
    """Two streams of every drive: inertial rows at 50 Hz (ten a recorded row) and fixes at 10 Hz at most that come and stay away."""
    rows = stream(spark, sf_dir).withColumn("idx", F.row_number().over(by_time()) - 1)
    frames = rows.select("drive_id", "idx", F.explode(F.sequence(F.lit(0), F.lit(_PACE - 1))).alias("k"), *[(F.col(c) / 40).alias(c) for c in ("ax", "ay")], F.col("az"), *[(F.col(c) / 5).alias(c) for c in ("gx", "gy", "gz")])
    frames = frames.select("drive_id", (F.col("idx") * _PACE + F.col("k")).alias("event_id"), ((F.col("idx") * _PACE + F.col("k")) * 0.02).alias("t"), "ax", "ay", "az", "gx", "gy", "gz")
    fixes = rows.where(F.col("idx") % _EVERY == 2).select("drive_id", (F.col("idx") * _PACE).alias("event_id"), (F.col("idx") * _PACE * 0.02 - 0.01).alias("t"), (F.col("east") / 400).alias("east"), (F.col("north") / 400).alias("north"))
    return frames, fixes


@query("pipe_20_stream_scenario", f"""WITH {STREAM_SQL}, f AS (SELECT drive_id, idx * {_PACE} + k AS frame, (idx * {_PACE} + k) * 0.02 AS t FROM s, (SELECT unnest(range({_PACE})) AS k)),
x AS (SELECT drive_id, idx * {_PACE} * 0.02 - 0.01 AS fix_t FROM s WHERE idx % {_EVERY} = 2),
j AS (SELECT f.*, x.fix_t FROM f ASOF LEFT JOIN x ON f.drive_id = x.drive_id AND f.t >= x.fix_t),
a AS (SELECT *, min(t) FILTER (fix_t IS NOT NULL) OVER (PARTITION BY drive_id, fix_t) AS arrived FROM j)
SELECT drive_id, count(*) AS frames, count(DISTINCT fix_t) AS fixes, count(*) FILTER (fix_t IS NULL) AS before_first, count(*) FILTER (round(t - arrived, 6) > {_STALE}) AS stale, count(*) FILTER (fix_t IS NULL) AS searching, count(*) FILTER (round(t - arrived, 6) > {_STALE}) AS blacked_out FROM a GROUP BY drive_id""", stream=False)
def pipe_20(spark, sf_dir):
    """Fixes that flap, joined to 50 Hz frames and run through the live frame step: what is stale and what the step says of it.

    A frame before the first fix is searching; a fix goes stale six seconds
    after it arrived, and from then on the step reports a blackout.
    """
    frames, fixes = mixed(spark, sf_dir)
    joined = align.latest(frames, fixes.withColumn("fix_t", F.col("t")), ["fix_t", "east", "north"])
    missing = F.lit(None).cast("double")
    inputs = joined.withColumns({"yaw": missing, "accuracy": F.when(F.col("fix_t").isNotNull(), 5.0), "fix_speed": F.when(F.col("fix_t").isNotNull(), 0.0), "fix_heading": missing, "denied": F.lit(0.0), "model_speed": missing})
    both = recordings.frames(inputs, ["drive_id"], "planar", ("status",), ("t", "fix_t"))
    arrived = F.min("t").over(Window.partitionBy("drive_id", "fix_t"))
    both = both.withColumn("late", F.coalesce(F.col("fix_t").isNotNull() & (F.round(F.col("t") - arrived, 6) > _STALE), F.lit(False)))
    return both.groupBy("drive_id").agg(
        F.count("*").alias("frames"), F.count_distinct("fix_t").alias("fixes"), F.count_if(F.col("fix_t").isNull()).alias("before_first"), F.count_if("late").alias("stale"),
        F.count_if(F.col("fix_t").isNull() & (F.col("status") == "DEGRADED")).alias("searching"), F.count_if(F.col("late") & (F.col("status") == "BLACKOUT")).alias("blacked_out"),
    )


@query("fsm_06_blended_position", """, e AS (SELECT *, max(CASE WHEN kind = 'view' THEN idx END) OVER (PARTITION BY drive_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS at FROM s),
d AS (SELECT e.*, v.east AS fe, v.north AS fn, v.ax AS oe, v.ay AS og, CASE WHEN e.idx - e.at >= 15 THEN 1 ELSE 0.5 * (1 - cos(pi() * (e.idx - e.at + 1) / 15)) END AS w FROM e JOIN s v ON v.drive_id = e.drive_id AND v.idx = e.at)
SELECT event_id, round(sqrt(oe * oe + og * og), 4) AS jump, round((1 - w) * (east + ax) + w * fe, 4) AS east, round((1 - w) * (north + ay) + w * fn, 4) AS north FROM d""")
def fsm_06_blend(spark, sf_dir):
    """From each returning fix on the output moves from the reckoned position to the fix's within 15 rows; the jump it hides."""
    from ..operators.machines import reacquired

    rows = stream(spark, sf_dir).withColumns({"pe": F.col("east") + F.col("ax"), "pn": F.col("north") + F.col("ay")})
    found = reacquired(rows, F.col("kind") == "view", "pe", "pn", "east", "north")
    return found.where("jump IS NOT NULL").select("event_id", F.round("jump", 4).alias("jump"), F.round("out_e", 4).alias("east"), F.round("out_n", 4).alias("north"))
