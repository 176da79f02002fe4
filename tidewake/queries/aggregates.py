"""Aggregations, ordering and set operations (AGG, SRT, SET)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.motion import norm
from ..operators import quality, splits
from ..operators.estimators import with_steps
from ..plans.scenarios import grouped
from ..session import by_time, stream, table
from . import query

R4 = lambda c, n: F.round(c, 4).alias(n)
_ERR = ", e AS (SELECT *, abs(ax) + speed AS err, coalesce(sqrt(pow(east - lag(east) OVER o, 2) + pow(north - lag(north) OVER o, 2)), 0) AS step FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id))"


def errors(spark, sf_dir):
    return with_steps(stream(spark, sf_dir)).withColumn("err", F.abs("ax") + F.col("speed")).withColumn("idx", F.row_number().over(by_time()) - 1)


@query("agg_01_scaler_fit", "SELECT channel, round(avg(x), 5) AS mean, round(CASE WHEN stddev_pop(x) <= 1e-6 THEN 1 ELSE stddev_pop(x) END, 5) AS std, count(*) AS n FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS channel FROM embeddings) GROUP BY channel", stream=False)
def agg_01(spark, sf_dir):
    from ..operators.scaler import fit

    return fit(table(spark, sf_dir, "embeddings"), "embedding").select(F.col("channel").cast("long").alias("channel"), F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n")


@query("agg_02_scaler_apply", ", x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS channel FROM embeddings), p AS (SELECT channel, avg(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY channel) SELECT vec_id, round(sum((x - m) / sd), 3) AS total, round(max((x - m) / sd), 4) AS most FROM x JOIN p USING (channel) GROUP BY vec_id")
def agg_02(spark, sf_dir):
    from ..operators.scaler import apply, fit

    rows = table(spark, sf_dir, "embeddings")
    scaled = apply(rows, "embedding", fit(rows, "embedding"))
    return scaled.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.round(F.array_max("embedding"), 4).alias("most"))


@query("agg_03_nav_metrics", _ERR + " SELECT drive_id, round(sum(step), 7) AS distance, round(arg_max(err, idx), 7) AS final, round(100 * arg_max(err, idx) / greatest(sum(step), 1), 7) AS drift, round(sqrt(avg(err * err)), 7) AS rmse, round(avg(err), 7) AS mae, round(max(err), 7) AS worst, round(quantile_cont(err, 0.5), 7) AS cep50, round(quantile_cont(err, 0.95), 7) AS p95 FROM e GROUP BY drive_id")
def agg_03(spark, sf_dir):
    from ..operators.metrics import navigation

    return navigation(errors(spark, sf_dir), ["drive_id"], "err", "step", "idx", digits=7)


@query("agg_04_blackout_metrics", _ERR + " SELECT drive_id, round(sqrt(avg(pow(speed - 12, 2))), 4) AS speed_rmse, round(avg(abs(speed - 12)), 4) AS speed_mae, round(sqrt(avg(pow(least(abs(gz), 2 * pi() - abs(gz)), 2))), 6) AS heading_rmse, 100 * arg_max(err, idx) / greatest(sum(step), 1) < 10 AS pass FROM e GROUP BY drive_id")
def agg_04(spark, sf_dir):
    from ..functions.geo import angle_between

    off = angle_between(F.col("gz"), F.lit(0.0))
    drift = 100 * F.max_by("err", "idx") / F.greatest(F.sum("step"), F.lit(1.0))
    return errors(spark, sf_dir).groupBy("drive_id").agg(R4(F.sqrt(F.avg(F.pow(F.col("speed") - 12, 2))), "speed_rmse"), R4(F.avg(F.abs(F.col("speed") - 12)), "speed_mae"), F.round(F.sqrt(F.avg(off * off)), 6).alias("heading_rmse"), (drift < 10).alias("pass"))


@query("agg_05_baseline_rollup", "SELECT event_type AS baseline, count(*) AS n, count(*) FILTER (value < 100) AS passed, round(100.0 * count(*) FILTER (value < 100) / count(*), 4) AS pass_pct, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS worst FROM events GROUP BY event_type", stream=False)
def agg_05(spark, sf_dir):
    from ..operators.metrics import summary

    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("baseline")).agg(*summary(F.col("value"), F.col("value") < 100))


@query("agg_06_duration_rollup", "SELECT l_returnflag AS baseline, l_linestatus AS duration, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem WHERE l_quantity < 25 GROUP BY 1, 2", stream=False)
def agg_06(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity < 25")
    return rows.groupBy(F.col("l_returnflag").alias("baseline"), F.col("l_linestatus").alias("duration")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"))


_SETS = "SELECT cfg, split, regime, count(*) AS n, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median FROM (SELECT l_returnflag AS cfg, l_linestatus AS split, l_linenumber AS regime, l_quantity AS x FROM lineitem) GROUP BY GROUPING SETS ({})"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cfg"), F.col("l_linestatus").alias("split"), F.col("l_linenumber").alias("regime"), F.col("l_quantity").alias("x"))


def study(spark, sf_dir, sets):
    return grouped(lines(spark, sf_dir), sets, F.count("*").alias("n"), R4(F.avg("x"), "mean"), R4(F.percentile("x", F.lit(0.5)), "median")).select("cfg", "split", "regime", "n", "mean", "median")


@query("agg_07_grouping_sets", _SETS.format("(cfg), (cfg, split), (cfg, regime)"), stream=False)
def agg_07(spark, sf_dir):
    return study(spark, sf_dir, [["cfg"], ["cfg", "split"], ["cfg", "regime"]])


@query("agg_08_config_duration", _SETS.format("(cfg, split, regime), (cfg, split), (cfg), ()"), stream=False)
def agg_08(spark, sf_dir):
    return study(spark, sf_dir, [["cfg", "split", "regime"], ["cfg", "split"], ["cfg"], []])


@query("agg_09_monte_carlo", _SETS.format("(split), ()").replace("cfg, split, regime,", "split,"), stream=False)
def agg_09(spark, sf_dir):
    return grouped(lines(spark, sf_dir), [["split"], []], F.count("*").alias("n"), R4(F.avg("x"), "mean"), R4(F.percentile("x", F.lit(0.5)), "median")).select("split", "n", "mean", "median")


@query("agg_10_verdict", "SELECT event_type AS baseline, CASE WHEN p >= 90 THEN 'PASS' WHEN p >= 20 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM (SELECT event_type, 100.0 * count(*) FILTER (value < 100) / count(*) AS p FROM events GROUP BY event_type)", stream=False)
def agg_10(spark, sf_dir):
    p = 100 * F.count_if(F.col("value") < 100) / F.count("*")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("baseline")).agg(F.when(p >= 90, "PASS").when(p >= 20, "PARTIAL").otherwise("FAIL").alias("verdict"))


@query("agg_11_timing", ", d AS (SELECT *, t - lag(t) OVER (PARTITION BY drive_id ORDER BY t, event_id) AS dt FROM s) SELECT drive_id, round(avg(dt), 3) AS mean, round(quantile_cont(dt, 0.5), 3) AS median, round(stddev_pop(dt), 3) AS std, round(min(dt), 3) AS least, round(max(dt), 3) AS most, round(sum(dt) FILTER (speed < 5), 3) AS standing FROM d GROUP BY drive_id HAVING count(*) > 1")
def agg_11(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("dt", F.col("t") - F.lag("t").over(by_time()))
    r = lambda c, n: F.round(c, 3).alias(n)
    return rows.groupBy("drive_id").agg(r(F.avg("dt"), "mean"), r(F.percentile("dt", F.lit(0.5)), "median"), r(F.stddev_pop("dt"), "std"), r(F.min("dt"), "least"), r(F.max("dt"), "most"), r(F.sum(F.when(F.col("speed") < 5, F.col("dt"))), "standing"), F.count("*").alias("n")).where("n > 1").drop("n")


_BANDS = {"all": "true", "slow": "speed < 1", "mid": "speed BETWEEN 1 AND 10", "fast": "speed > 10"}


@query("agg_12_speed_accuracy", "SELECT " + ", ".join(f"round(avg(abs(ay)) FILTER ({w}), 5) AS mae_{n}, round(sqrt(avg(ay * ay) FILTER ({w})), 5) AS rmse_{n}, round(avg(ay) FILTER ({w}), 5) + 0 AS bias_{n}" for n, w in _BANDS.items()) + " FROM s")
def agg_12(spark, sf_dir):
    from ..operators.metrics import banded

    return stream(spark, sf_dir).agg(*banded(F.col("ay"), {n: F.expr(w) for n, w in _BANDS.items()}))


@query("agg_13_model_comparison", "SELECT kind AS checkpoint, " + ", ".join(f"round(avg(abs(ay)) FILTER ({w}), 5) AS mae_{n}, round(sqrt(avg(ay * ay) FILTER ({w})), 5) AS rmse_{n}, round(avg(ay) FILTER ({w}), 5) + 0 AS bias_{n}" for n, w in _BANDS.items()) + " FROM s GROUP BY kind")
def agg_13(spark, sf_dir):
    from ..operators.metrics import banded

    return stream(spark, sf_dir).groupBy(F.col("kind").alias("checkpoint")).agg(*banded(F.col("ay"), {n: F.expr(w) for n, w in _BANDS.items()}))


@query("agg_14_regime_correlation", ", f AS (SELECT *, unnest(list_filter([CASE WHEN speed > 10 THEN 'fast' END, CASE WHEN abs(gz) > 0.05 THEN 'turning' END, 'all'], lambda x: x IS NOT NULL)) AS regime FROM s) SELECT regime, count(*) AS n, round(CASE WHEN stddev_pop(ay) > 1e-6 AND stddev_pop(val) > 1e-6 THEN corr(ay, val) END, 5) AS r, round(var_pop(val), 3) AS v FROM f GROUP BY regime")
def agg_14(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("speed") > 10, "fast"), F.when(F.abs("gz") > 0.05, "turning"), F.lit("all")))
    rows = stream(spark, sf_dir).select("ay", "val", F.explode(flags).alias("regime"))
    guarded = F.when((F.stddev_pop("ay") > 1e-6) & (F.stddev_pop("val") > 1e-6), F.corr("ay", "val"))
    return rows.groupBy("regime").agg(F.count("*").alias("n"), F.round(guarded, 5).alias("r"), F.round(F.var_pop("val"), 3).alias("v"))


@query("agg_15_lag_correlation", ", c AS (SELECT drive_id, idx, ay, ay - avg(ay) OVER (PARTITION BY drive_id) AS a, val - avg(val) OVER (PARTITION BY drive_id) AS b FROM s), l AS (SELECT x.drive_id, k AS lag, sum(x.a * y.b) AS p FROM c x, range(-5, 6) r(k), c y WHERE x.drive_id = y.drive_id AND y.idx = x.idx + k GROUP BY 1, 2) SELECT drive_id, arg_max(lag, p) AS lag, round(max(p), 3) AS p FROM l GROUP BY drive_id")
def agg_15(spark, sf_dir):
    from ..operators.metrics import best_lag

    rows = stream(spark, sf_dir).withColumn("idx", F.row_number().over(by_time()) - 1)
    return best_lag(rows, "ay", "val", 5).select("drive_id", F.col("lag").cast("long").alias("lag"), F.round("p", 3).alias("p"))


@query("agg_16_acceptance", "SELECT drive_id, round(count(*) FILTER (kind = 'view') / greatest(1, count(*) FILTER (kind IN ('view', 'error'))), 6) AS rate FROM s GROUP BY drive_id")
def agg_16(spark, sf_dir):
    taken, refused = F.count_if(F.col("kind") == "view"), F.count_if(F.col("kind") == "error")
    return stream(spark, sf_dir).groupBy("drive_id").agg(F.round(taken / F.greatest(F.lit(1), taken + refused), 6).alias("rate"))


#: The roots of a symmetric 3 x 3 matrix's characteristic cubic: q + 2 p cos(phi + 2 k pi / 3).
_CUBIC = """, m AS (SELECT drive_id, avg(ax * ax) AS a, avg(ay * ay) AS b, avg(az * az) AS c, avg(ax * ay) AS d, avg(ax * az) AS e, avg(ay * az) AS f FROM s GROUP BY drive_id),
    q AS (SELECT *, (a + b + c) / 3 AS q FROM m), p AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
    r AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p)))) / 3 AS phi FROM p)
"""


@query("agg_17_second_moments", _CUBIC + """SELECT drive_id, round(a, 4) AS xx, round(b, 4) AS yy, round(c, 4) AS zz, round(d, 4) + 0 AS xy, round(e, 4) + 0 AS xz, round(f, 4) + 0 AS yz,
    round(q + 2 * p * cos(phi), 4) AS largest, round(q + 2 * p * cos(phi + 2 * pi() / 3), 4) AS smallest FROM r""")
def agg_17(spark, sf_dir):
    from ..operators.metrics import principal_axes

    found = principal_axes(stream(spark, sf_dir), ("ax", "ay", "az"), ["drive_id"])
    named = {"xx": "m00", "yy": "m11", "zz": "m22", "xy": "m01", "xz": "m02", "yz": "m12"}
    return found.select("drive_id", *[(F.round(m, 4) + 0.0).alias(c) for c, m in named.items()], F.round(F.col("eigenvalues")[0], 4).alias("largest"), F.round(F.col("eigenvalues")[2], 4).alias("smallest"))


@query("agg_18_iron_fit", ", g AS (SELECT drive_id, (max(ax) + min(ax)) / 2 AS bx, (max(ay) + min(ay)) / 2 AS by_, greatest((max(ax) - min(ax)) / 2, 1) AS sx, greatest((max(ay) - min(ay)) / 2, 1) AS sy, greatest((max(az) - min(az)) / 2, 1) AS sz, count(*) AS n FROM s GROUP BY drive_id) SELECT drive_id, round(bx, 6) AS bias_ax, round(by_, 6) AS bias_ay, round((sx + sy + sz) / 3 / sx, 6) AS scale_ax, round((sx + sy + sz) / 3 / sz, 6) AS scale_az FROM g WHERE n >= 50")
def agg_18(spark, sf_dir):
    found = quality.iron_fit(stream(spark, sf_dir), ("ax", "ay", "az"), ["drive_id"])
    return found.select("drive_id", *[F.round(c, 6).alias(c) for c in ("bias_ax", "bias_ay", "scale_ax", "scale_az")])


@query("agg_19_gyro_bias", ", g AS (SELECT *, count(*) FILTER (speed < 10) OVER (PARTITION BY drive_id) AS slow FROM s), k AS (SELECT * FROM g WHERE CASE WHEN slow >= 20 THEN speed < 10 ELSE idx < 10 END) SELECT drive_id, round(avg(gz), 6) + 0 AS bias, round(stddev_pop(gz), 6) AS noise, round(degrees(stddev_pop(gz)) * sqrt(0.1) * 60, 5) AS arw FROM k GROUP BY drive_id")
def agg_19(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("idx", F.row_number().over(by_time()) - 1)
    slow = F.count_if(F.col("speed") < 10).over(Window.partitionBy("drive_id"))
    kept = rows.withColumn("slow", slow).where(F.when(F.col("slow") >= 20, F.col("speed") < 10).otherwise(F.col("idx") < 10))
    return kept.groupBy("drive_id").agg(F.round(F.avg("gz"), 6).alias("bias"), F.round(F.stddev_pop("gz"), 6).alias("noise"), F.round(F.degrees(F.stddev_pop("gz")) * 0.1**0.5 * 60, 5).alias("arw"))


@query("agg_20_magnetometer_audit", ", n AS (SELECT drive_id, sqrt(ax * ax + ay * ay + az * az) AS m FROM s) SELECT drive_id, round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS std, round(min(m), 4) AS least, round(max(m), 4) AS most, stddev_pop(m) > 1.5 OR max(m) > 100 AS anomaly FROM n GROUP BY drive_id")
def agg_20(spark, sf_dir):
    m = F.col("m")
    rows = stream(spark, sf_dir).select("drive_id", norm(F.col("ax"), F.col("ay"), F.col("az")).alias("m"))
    return rows.groupBy("drive_id").agg(R4(F.avg(m), "mean"), R4(F.stddev_pop(m), "std"), R4(F.min(m), "least"), R4(F.max(m), "most"), ((F.stddev_pop(m) > 1.5) | (F.max(m) > 100)).alias("anomaly"))


@query("agg_21_error_decomposition", "SELECT drive_id, round(sum(abs(speed - 12) * 0.1), 5) AS magnitude, round(sum(2 * 12 * abs(sin(gz / 2)) * 0.1), 5) AS direction FROM s GROUP BY drive_id")
def agg_21(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("drive_id").agg(F.round(F.sum(F.abs(F.col("speed") - 12) * 0.1), 5).alias("magnitude"), F.round(F.sum(2 * 12 * F.abs(F.sin(F.col("gz") / 2)) * 0.1), 5).alias("direction"))


@query("agg_22_sensitivity", "SELECT kind AS oracle, round((1 - avg(val) / greatest(1e-3, max(base))) * 100, 4) AS pct FROM s, (SELECT avg(val) AS base FROM s WHERE kind = 'view') WHERE kind <> 'view' GROUP BY kind")
def agg_22(spark, sf_dir):
    means = stream(spark, sf_dir).groupBy("kind").agg(F.avg("val").alias("m"))
    base = means.where("kind = 'view'").select(F.col("m").alias("base"))
    return means.where("kind <> 'view'").join(F.broadcast(base)).select(F.col("kind").alias("oracle"), R4((1 - F.col("m") / F.greatest(F.lit(1e-3), F.col("base"))) * 100, "pct"))


@query("agg_23_yaw_budget", "SELECT kind AS regime, count(*) AS n, round(quantile_cont(abs(gz), 0.5), 6) AS median, round(quantile_cont(abs(gz), 0.9), 6) AS p90, round(avg(gz), 6) + 0 AS mean FROM s GROUP BY kind")
def agg_23(spark, sf_dir):
    a = F.abs("gz")
    return stream(spark, sf_dir).groupBy(F.col("kind").alias("regime")).agg(F.count("*").alias("n"), F.round(F.percentile(a, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(a, F.lit(0.9)), 6).alias("p90"), F.round(F.avg("gz"), 6).alias("mean"))


@query("agg_24_session_summary", "SELECT drive_id, round(max(speed), 4) AS top, round(avg(speed), 4) AS mean, round(max(abs(gz)), 6) AS lean, count(*) FILTER (kind = 'view') AS fixes FROM s GROUP BY drive_id")
def agg_24(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("drive_id").agg(R4(F.max("speed"), "top"), R4(F.avg("speed"), "mean"), F.round(F.max(F.abs("gz")), 6).alias("lean"), F.count_if(F.col("kind") == "view").alias("fixes"))


@query("agg_25_trip_summary", "SELECT drive_id, round(sqrt(pow(arg_max(east, idx) - arg_min(east, idx), 2) + pow(arg_max(north, idx) - arg_min(north, idx), 2)), 4) AS displacement, count(*) AS frames FROM s GROUP BY drive_id")
def agg_25(spark, sf_dir):
    key = F.struct("t", "event_id")
    ends = lambda c: F.max_by(c, key) - F.min_by(c, key)
    return stream(spark, sf_dir).groupBy("drive_id").agg(R4(F.hypot(ends("east"), ends("north")), "displacement"), F.count("*").alias("frames"))


@query("agg_26_split_counts", "SELECT CASE WHEN drive_id % 10 < 7 THEN 'train' WHEN drive_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, count(*) AS windows, count(DISTINCT drive_id) AS drives FROM s GROUP BY 1")
def agg_26(spark, sf_dir):
    part = F.col("drive_id") % 10
    per = stream(spark, sf_dir).groupBy(F.when(part < 7, "train").when(part < 9, "val").otherwise("test").alias("split"), "drive_id").agg(F.count("*").alias("n"))
    return per.groupBy("split").agg(F.sum("n").alias("windows"), F.count("*").alias("drives"))


@query("agg_27_signals", "SELECT 'V-' || n_nationkey || '.csv' AS name, true AS yaw, false AS heading, true AS speed, false AS steering FROM nation WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation)", stream=False)
def agg_27(spark, sf_dir):
    """Which reference signals each vehicle file's header offers."""
    from ..operators.quality import signals
    from .sources import _drives

    lines = spark.read.text(f"{_drives(spark, sf_dir)}/V-*.csv").select(F.col("_metadata.file_name").alias("name"), "value")
    return signals(lines.where(F.col("value").startswith("Time")), "name", F.col("value"))


@query("agg_28_fix_intervals", ", d AS (SELECT drive_id, t - lag(t) OVER (PARTITION BY drive_id ORDER BY t, event_id) AS dt FROM s WHERE kind = 'view') SELECT drive_id, round(min(dt), 3) AS least, round(max(dt), 3) AS most, round(avg(dt), 3) AS mean FROM d GROUP BY drive_id HAVING count(dt) > 0")
def agg_28(spark, sf_dir):
    rows = stream(spark, sf_dir).where("kind = 'view'").select("drive_id", (F.col("t") - F.lag("t").over(by_time())).alias("dt"))
    return rows.groupBy("drive_id").agg(F.round(F.min("dt"), 3).alias("least"), F.round(F.max("dt"), 3).alias("most"), F.round(F.avg("dt"), 3).alias("mean")).where("least IS NOT NULL")


@query("agg_29_transition_log", "SELECT event_id, kind, fast FROM (SELECT event_id, kind, speed > 12 AS fast, lag(kind) OVER o AS k0, lag(speed > 12) OVER o AS f0 FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)) WHERE k0 IS NULL OR kind <> k0 OR fast <> f0")
def agg_29(spark, sf_dir):
    state = F.struct("kind", (F.col("speed") > 12).alias("fast"))
    rows = stream(spark, sf_dir).select("event_id", state.alias("now"), F.lag(state).over(by_time()).alias("before"))
    return rows.where("before IS NULL OR now <> before").select("event_id", "now.kind", "now.fast")


@query("srt_01_stable_top_k", "SELECT drive_id, event_id, rank FROM (SELECT drive_id, event_id, row_number() OVER (PARTITION BY drive_id ORDER BY val, event_id) AS rank FROM s) WHERE rank <= 5")
def srt_01(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("drive_id").orderBy("val", "event_id"))
    return stream(spark, sf_dir).select("drive_id", "event_id", rank.alias("rank")).where("rank <= 5")


@query("srt_03_sorted_unique", "SELECT DISTINCT p_brand AS dir FROM part ORDER BY 1", stream=False)
def srt_03(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("dir")).distinct().orderBy("dir")


@query("srt_04_newest_first", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey", stream=False)
def srt_04(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey")


@query("srt_02_eigenvalues", _CUBIC + """SELECT drive_id, round(q + 2 * p * cos(phi), 4) AS first, round(3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)), 4) AS second, round(q + 2 * p * cos(phi + 2 * pi() / 3), 4) AS third FROM r""")
def srt_02(spark, sf_dir):
    """Principal moments of the specific force, largest first; the SQL takes the cubic's roots."""
    from ..operators.metrics import principal_axes

    e = F.col("eigenvalues")
    return principal_axes(stream(spark, sf_dir), ("ax", "ay", "az"), ["drive_id"]).select("drive_id", *[F.round(e[k], 4).alias(n) for k, n in enumerate(("first", "second", "third"))])


@query("set_04_except", "SELECT drive_id FROM s EXCEPT SELECT drive_id FROM s WHERE kind = 'error' AND val > 100")
def set_04(spark, sf_dir):
    """Drives without a large error."""
    rows = stream(spark, sf_dir)
    return rows.select("drive_id").subtract(rows.where("kind = 'error' AND val > 100").select("drive_id"))


@query("srt_05_no_cap", ", n AS (SELECT *, count(*) OVER (PARTITION BY drive_id) AS total FROM s) SELECT drive_id, idx AS first FROM n WHERE idx >= 5 AND idx % 5 = 0 AND idx + 10 <= total")
def srt_05(spark, sf_dir):
    """All scenarios, however many were asked for: a target below their number does not cut the list."""
    from ..plans.scenarios import outages

    return outages(stream(spark, sf_dir), 10, 5, 5, 0.0).select("drive_id", F.col("first").cast("long").alias("first"))


@query("srt_06_every_kth", "SELECT event_id FROM s WHERE idx % 3 = 0")
def srt_06(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", (F.row_number().over(by_time()) - 1).alias("idx")).where("idx % 3 = 0").select("event_id")


@query("srt_07_first_fix_anchor", "SELECT drive_id, round(arg_min(lat, idx), 6) AS lat0, round(arg_min(lon, idx), 6) AS lon0 FROM s WHERE kind = 'view' GROUP BY drive_id")
def srt_07(spark, sf_dir):
    key = F.struct("t", "event_id")
    return stream(spark, sf_dir).where("kind = 'view'").groupBy("drive_id").agg(F.round(F.min_by("lat", key), 6).alias("lat0"), F.round(F.min_by("lon", key), 6).alias("lon0"))


@query("set_01_concat", "SELECT event_id, 'a' AS part FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'b' FROM events WHERE event_type = 'click'", stream=False)
def set_01(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    a, b = (rows.where(F.col("event_type") == k).select("event_id", F.lit(n).alias("part")) for k, n in (("view", "a"), ("click", "b")))
    return a.unionByName(b)


@query("set_02_split_leakage", "SELECT member, list_sort(list(DISTINCT split))[1] AS one, list_sort(list(DISTINCT split))[2] AS other FROM (SELECT source AS member, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY member HAVING count(DISTINCT split) > 1", stream=False)
def set_02(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("member"), F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"))
    return splits.shared_members(rows).select("member", F.col("splits")[0].alias("one"), F.col("splits")[1].alias("other"))


@query("set_03_union_windows", """, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY drive_id ORDER BY t, event_id) > 43200 THEN 1 ELSE 0 END AS new FROM s),
k AS (SELECT *, sum(new) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY drive_id, segment ORDER BY t, event_id) - 1 AS rn FROM k)
SELECT CASE WHEN drive_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, drive_id, rn - 4 AS start, round(speed, 4) AS target FROM r WHERE drive_id % 10 >= 7 AND rn >= 4 AND (rn - 4) % 2 = 0""")
def set_03(spark, sf_dir):
    """The windows of the validation and the test drives, each made by itself and put together."""
    from ..operators import segments

    rows = stream(spark, sf_dir)
    parts = {"val": "drive_id % 10 IN (7, 8)", "test": "drive_id % 10 = 9"}
    found = [segments.sliding_windows(rows.where(cond), 5, 2, 43200.0).withColumn("split", F.lit(name)) for name, cond in parts.items()]
    return found[0].unionByName(found[1]).select("split", "drive_id", F.col("start").cast("long").alias("start"), F.round("target", 4).alias("target"))


@query("set_05_seeded_split", ", d AS (SELECT drive_id, row_number() OVER (ORDER BY md5('42:' || drive_id)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT drive_id FROM s)), c AS (SELECT *, greatest(1, round_even(n * 0.15, 0)) AS m FROM d) SELECT drive_id, CASE WHEN n < 3 OR k <= n - 2 * m THEN 'train' WHEN k <= n - m THEN 'val' ELSE 'test' END AS split FROM c")
def set_05(spark, sf_dir):
    return splits.split_table(stream(spark, sf_dir), "drive_id")
