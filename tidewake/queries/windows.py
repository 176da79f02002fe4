"""Segmentation and analytic windows (WIN)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import segments
from ..session import by_time, stream
from . import query

HOURS = 3600.0
_SEG = """, d AS (SELECT *, CASE WHEN t - lag(t) OVER w > 43200 THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY drive_id ORDER BY t, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS raw FROM d),
n AS (SELECT *, count(*) OVER (PARTITION BY drive_id, raw) AS size FROM r),
k AS (SELECT *, dense_rank() OVER (PARTITION BY drive_id ORDER BY raw) - 1 AS segment, row_number() OVER (PARTITION BY drive_id, raw ORDER BY t, event_id) - 1 AS rn FROM n WHERE size >= 5)
"""


@query("win_01_gap_segments", _SEG + "SELECT drive_id, segment, count(*) AS n, round(min(t), 3) AS t_start, round(max(t), 3) AS t_end FROM k GROUP BY drive_id, segment")
def win_01(spark, sf_dir):
    found = segments.segments(stream(spark, sf_dir), 12 * HOURS, 5)
    return found.select("drive_id", "segment", "n", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"))


@query("win_02_sliding_windows", _SEG + """SELECT drive_id, segment, rn - 4 AS start, rn + 1 AS "end", round(m, 4) AS mean, round(sd, 4) AS std, round(speed, 6) AS target FROM (SELECT *, avg(val) OVER f AS m, stddev_pop(val) OVER f AS sd FROM k WINDOW f AS (PARTITION BY drive_id, segment ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE rn >= 4 AND (rn - 4) % 2 = 0""")
def win_02(spark, sf_dir):
    found = segments.sliding_windows(stream(spark, sf_dir), 5, 2, 12 * HOURS, {"mean": F.avg("val"), "std": F.stddev_pop("val")})
    return found.select("drive_id", "segment", "start", "end", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("target", 6).alias("target"))


@query("win_02_window_arrays", _SEG + """SELECT drive_id, segment, rn - 4 AS start, array_to_string(list_transform(wx, lambda x: round(x * 10)::BIGINT), ',') AS x, array_to_string(list_transform(wz, lambda x: round(x * 1000)::BIGINT), ',') AS z FROM (SELECT *, list(ax) OVER f AS wx, list(gz) OVER f AS wz FROM k WINDOW f AS (PARTITION BY drive_id, segment ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE rn >= 4 AND (rn - 4) % 2 = 0""")
def win_02_arrays(spark, sf_dir):
    found = segments.sliding_windows(stream(spark, sf_dir), 5, 2, 12 * HOURS, arrays=("ax", "gz"))
    text = lambda k, f: F.array_join(F.transform(F.col("window")[k], lambda x: F.round(x.cast("double") * f).cast("long")), ",")
    return found.select("drive_id", "segment", "start", text(0, 10).alias("x"), text(1, 1000).alias("z"))


@query("win_03_padded_windows", ", w AS (SELECT event_id, list(val) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM s) SELECT event_id, array_to_string(list_concat(list_transform(range(5 - len(l)), lambda i: l[1]), l), ',') AS w FROM (SELECT event_id, list_transform(l, lambda x: round(x * 100)::BIGINT) AS l FROM w)")
def win_03(spark, sf_dir):
    rows = segments.padded_windows(stream(spark, sf_dir), "val", 5, by_time())
    return rows.select("event_id", F.array_join(F.transform("window", lambda x: F.round(x * 100).cast("long")), ",").alias("w"))


@query("win_04_displacement_windows", """, w AS (SELECT *, lag(east, 5) OVER o AS e0, lag(north, 5) OVER o AS n0, lag(gz, 3) OVER o AS psi, count(*) OVER (PARTITION BY drive_id) AS n FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id))
SELECT event_id, round((east - e0) * cos(psi) + (north - n0) * sin(psi), 6) AS dx, round(-(east - e0) * sin(psi) + (north - n0) * cos(psi), 6) AS dy FROM w WHERE idx >= 5 AND idx < n - 1 AND idx % 5 = 0""")
def win_04(spark, sf_dir):
    o = by_time()
    rows = stream(spark, sf_dir).withColumn("idx", F.row_number().over(o) - 1).withColumn("n", F.count("*").over(Window.partitionBy("drive_id")))
    rows = rows.withColumn("de", F.col("east") - F.lag("east", 5).over(o)).withColumn("dn", F.col("north") - F.lag("north", 5).over(o)).withColumn("psi", F.lag("gz", 3).over(o))
    rows = rows.where("idx >= 5 AND idx < n - 1 AND idx % 5 = 0")
    c, s = F.cos("psi"), F.sin("psi")
    return rows.select("event_id", F.round(F.col("de") * c + F.col("dn") * s, 6).alias("dx"), F.round(-F.col("de") * s + F.col("dn") * c, 6).alias("dy"))


@query("win_05_course", """, d AS (SELECT event_id, idx, atan2(north - lag(north) OVER o, east - lag(east) OVER o) AS c, atan2(lead(north) OVER o - north, lead(east) OVER o - east) AS nx FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)) SELECT event_id, round(coalesce(c, nx), 6) AS course FROM d""")
def win_05(spark, sf_dir):
    o = by_time()
    step = F.atan2(F.col("north") - F.lag("north").over(o), F.col("east") - F.lag("east").over(o))
    after = F.atan2(F.lead("north").over(o) - F.col("north"), F.lead("east").over(o) - F.col("east"))
    return stream(spark, sf_dir).select("event_id", F.round(F.coalesce(step, after), 6).alias("course"))


@query("win_06_path_length", """, d AS (SELECT *, coalesce(sqrt(pow(east - lag(east) OVER o, 2) + pow(north - lag(north) OVER o, 2)), 0) AS step FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)) SELECT event_id, round(sum(step) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 4) AS length FROM d""")
def win_06(spark, sf_dir):
    from ..operators.estimators import with_steps

    rows = with_steps(stream(spark, sf_dir))
    return rows.select("event_id", F.round(F.sum("step").over(by_time().rowsBetween(Window.unboundedPreceding, 0)), 4).alias("length"))


@query("win_07_stationary_stats", """, a AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS an, sqrt(gx * gx + gy * gy + gz * gz) AS gn FROM s)
SELECT event_id, round(sqrt(pow(avg(ax) OVER f, 2) + pow(avg(ay) OVER f, 2) + pow(avg(az) OVER f, 2)), 5) AS mean_acc, round(var_pop(an) OVER f, 5) AS var_acc, round(max(gn) OVER f, 6) AS max_gyro FROM a WINDOW f AS (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER f = 10""")
def win_07(spark, sf_dir):
    from ..operators.machines import stationary_statistics

    rows = stationary_statistics(stream(spark, sf_dir), by_time()).where("full")
    return rows.select("event_id", F.round("mean_acc", 5).alias("mean_acc"), F.round("var_acc", 5).alias("var_acc"), F.round("max_gyro", 6).alias("max_gyro"))


@query("win_08_rolling_noise", """, a AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS an FROM s) SELECT event_id, round(CASE WHEN count(*) OVER f > 5 THEN stddev_pop(an) OVER f ELSE 0.05 END, 5) AS noise FROM a WINDOW f AS (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def win_08(spark, sf_dir):
    from ..functions.motion import norm

    f = by_time().rowsBetween(-49, 0)
    rows = stream(spark, sf_dir).withColumn("an", norm(F.col("ax"), F.col("ay"), F.col("az")))
    return rows.select("event_id", F.round(F.when(F.count("*").over(f) > 5, F.stddev_pop("an").over(f)).otherwise(0.05), 5).alias("noise"))


@query("win_09_magnetic_variance", """, a AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS an FROM s) SELECT event_id, round(CASE WHEN count(*) OVER f >= 5 THEN var_pop(an) OVER f ELSE 0 END, 5) AS v FROM a WINDOW f AS (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def win_09(spark, sf_dir):
    from ..functions.motion import norm

    f = by_time().rowsBetween(-9, 0)
    rows = stream(spark, sf_dir).withColumn("an", norm(F.col("ax"), F.col("ay"), F.col("az")))
    return rows.select("event_id", F.round(F.when(F.count("*").over(f) >= 5, F.var_pop("an").over(f)).otherwise(0.0), 5).alias("v"))


@query("win_10_unwrap", """, a AS (SELECT *, ay % pi() AS psi FROM s), d AS (SELECT *, psi - lag(psi) OVER (PARTITION BY drive_id ORDER BY t, event_id) AS step FROM a), c AS (SELECT *, CASE WHEN abs(step) > pi() THEN -2 * pi() * floor((step + pi()) / (2 * pi())) ELSE 0 END AS fix FROM d)
SELECT event_id, round(psi + sum(fix) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 5) AS psi FROM c""")
def win_10(spark, sf_dir):
    import math

    rows = stream(spark, sf_dir).withColumn("psi", F.col("ay") % math.pi)
    rows = rows.withColumn("fix", segments.unwrapped(F.col("psi"), by_time()))
    return rows.select("event_id", F.round(F.col("psi") + F.sum("fix").over(by_time().rowsBetween(Window.unboundedPreceding, 0)), 5).alias("psi"))


@query("win_11_gradient", """SELECT event_id, round(CASE WHEN lag(val) OVER o IS NULL THEN (lead(val) OVER o - val) / 0.1 WHEN lead(val) OVER o IS NULL THEN (val - lag(val) OVER o) / 0.1 ELSE (lead(val) OVER o - lag(val) OVER o) / 0.2 END, 4) AS g FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)""")
def win_11(spark, sf_dir):
    o = by_time()
    before, after = F.lag("val").over(o), F.lead("val").over(o)
    g = F.when(before.isNull(), (after - F.col("val")) / 0.1).when(after.isNull(), (F.col("val") - before) / 0.1).otherwise((after - before) / 0.2)
    return stream(spark, sf_dir).select("event_id", F.round(g, 4).alias("g"))


@query("win_12_lagged_deltas", "SELECT event_id, " + ", ".join(f"round(coalesce(val - lag(val, {k}) OVER o, 0), 6) AS d{k}" for k in (5, 10, 20)) + " FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)")
def win_12(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", *[F.round(F.coalesce(F.col("val") - F.lag("val", k).over(by_time()), F.lit(0.0)), 6).alias(f"d{k}") for k in (5, 10, 20)])


@query("win_13_trailing_integral", "SELECT event_id, round(coalesce(sum(gz) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) * 0.1, 6) + 0 AS yaw FROM s")
def win_13(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", F.round(F.coalesce(F.sum("gz").over(by_time().rowsBetween(-10, -1)), F.lit(0.0)) * 0.1, 6).alias("yaw"))


@query("win_14_transitions", ", d AS (SELECT drive_id, kind = 'error' AS x, coalesce(lag(kind = 'error') OVER (PARTITION BY drive_id ORDER BY t, event_id), false) AS b FROM s) SELECT drive_id, count(*) FILTER (x AND NOT b) AS rises FROM d GROUP BY drive_id")
def win_14(spark, sf_dir):
    x = F.col("kind") == "error"
    rise = x & ~F.coalesce(F.lag(x).over(by_time()), F.lit(False))
    return stream(spark, sf_dir).select("drive_id", rise.alias("rise")).groupBy("drive_id").agg(F.count_if("rise").alias("rises"))


_PATH = """, d AS (SELECT *, coalesce(sqrt(pow(east - lag(east) OVER o, 2) + pow(north - lag(north) OVER o, 2)), 0) AS step FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)),
c AS (SELECT *, sum(step) OVER (PARTITION BY drive_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cum, avg(abs(gz)) OVER w AS yaw, stddev_pop(speed) OVER w AS sd FROM d WINDOW w AS (PARTITION BY drive_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
o AS (SELECT a.drive_id, a.idx AS first, b.cum - a.cum AS dist, a.yaw, a.sd FROM c a JOIN c b ON a.drive_id = b.drive_id AND b.idx = a.idx + 9 WHERE a.idx >= 5 AND a.idx % 5 = 0)
"""


@query("win_15_outage_scenarios", _PATH + "SELECT drive_id, first, round(dist, 4) AS dist FROM o WHERE dist >= 30")
def win_15(spark, sf_dir):
    from ..plans.scenarios import outages

    return outages(stream(spark, sf_dir), 10, 5, 5, 30.0).select("drive_id", "first", F.round("dist", 4).alias("dist"))


@query("win_16_scenario_class", _PATH + "SELECT drive_id, first, CASE WHEN yaw > 0.05 THEN 'curve' WHEN sd > 6 THEN 'variation' ELSE 'straight' END AS class FROM o WHERE dist >= 30")
def win_16(spark, sf_dir):
    from ..plans.scenarios import classified, outages

    return classified(outages(stream(spark, sf_dir), 10, 5, 5, 30.0), 0.05, 6.0).select("drive_id", "first", "class")


# every length is scanned from row 4 in steps of 3; two rows stay behind a window
_SCANNED = " UNION ALL ".join(
    f"SELECT drive_id, {n} AS length, idx AS first, avg(val / 4) OVER w AS mean, max(val / 4) OVER w - min(val / 4) OVER w AS delta, degrees(avg(abs(gz)) OVER w) AS yaw, 0.1 * sum(val / 4) OVER w AS dist, count(*) OVER (PARTITION BY drive_id) AS total "
    f"FROM s WINDOW w AS (PARTITION BY drive_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    for n in (5, 10, 20)
)


@query("win_17_window_picker", f""", o AS (SELECT * FROM ({_SCANNED}) WHERE first >= 4 AND (first - 4) % 3 = 0 AND first < total - length - 2),
f AS (SELECT *, list_filter([CASE WHEN yaw > 5 THEN 'turning' END, CASE WHEN delta > 6 THEN 'accel_decel' END, CASE WHEN mean > 15 AND yaw < 2.5 THEN 'high_speed' END, CASE WHEN mean < 4 THEN 'low_speed' END, CASE WHEN yaw < 2 AND mean >= 4 THEN 'straight' END], lambda x: x IS NOT NULL) AS fits FROM o),
l AS (SELECT drive_id, length, list_reduce(list_prepend([]::STRUCT(first BIGINT, regime VARCHAR)[], list([{{'first': first, 'regime': array_to_string(fits, ',')}}] ORDER BY first)), lambda acc, x: CASE WHEN x[1].regime <> '' AND len(list_filter(str_split(x[1].regime, ','), lambda r: NOT list_contains(list_transform(acc, lambda a: a.regime), r))) > 0
    THEN list_append(acc, {{'first': x[1].first, 'regime': list_filter(str_split(x[1].regime, ','), lambda r: NOT list_contains(list_transform(acc, lambda a: a.regime), r))[1]}}) ELSE acc END) AS picks FROM f GROUP BY drive_id, length)
SELECT p.drive_id, p.length, p.pick.first AS first, p.pick.regime AS regime, round(o.mean, 6) AS mean, round(o.dist, 6) AS dist FROM (SELECT drive_id, length, unnest(picks) AS pick FROM l) p JOIN o ON o.drive_id = p.drive_id AND o.length = p.length AND o.first = p.pick.first""")
def win_17(spark, sf_dir):
    """Outage windows of three lengths for each motion regime of each drive."""
    from ..plans.scenarios import candidates, picked

    rows = stream(spark, sf_dir).withColumn("speed", F.col("val") / 4)
    return picked(candidates(rows, (5, 10, 20), 4, 3, 2)).select("drive_id", "length", "first", "regime", F.round("mean", 6).alias("mean"), F.round("dist", 6).alias("dist"))


@query("win_18_checkpoints", ", m AS (SELECT drive_id, max(idx) AS last FROM s GROUP BY drive_id) SELECT drive_id, " + ", ".join(f"round(max(val) FILTER (idx = least({k}, last)), 6) AS at_{k}" for k in (10, 30, 60)) + " FROM s JOIN m USING (drive_id) GROUP BY drive_id")
def win_18(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("idx", F.row_number().over(by_time()) - 1)
    at = lambda k: F.max_by("val", F.when(F.col("idx") <= k, F.col("idx")))
    return rows.groupBy("drive_id").agg(*[F.round(at(k), 6).alias(f"at_{k}") for k in (10, 30, 60)])


@query("win_19_remaining_distance", """, d AS (SELECT *, coalesce(sqrt(pow(lead(east) OVER o - east, 2) + pow(lead(north) OVER o - north, 2)), 0) AS step FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)) SELECT event_id, round(sum(step) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS rest FROM d""")
def win_19(spark, sf_dir):
    o = by_time()
    step = F.coalesce(F.hypot(F.lead("east").over(o) - F.col("east"), F.lead("north").over(o) - F.col("north")), F.lit(0.0))
    rows = stream(spark, sf_dir).withColumn("step", step)
    return rows.select("event_id", F.round(F.sum("step").over(o.rowsBetween(0, Window.unboundedFollowing)), 4).alias("rest"))
