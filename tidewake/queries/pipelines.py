"""Composite pipelines and streams (PIPE, STR)."""


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import estimators, recordings
from ..operators.simulate import BASELINES, Config
from ..plans import prepare, scenarios
from ..session import by_time, stream, table
from ..shared import new_path
from ..sources import synthetic
from ..streaming import live
from . import query
from .estimators import _RUN, gov_04, scenario_samples
from .sources import profiles
from .windows import _PATH, _SEG


def split_column():
    part = F.col("drive_id") % 10
    return F.when(part < 7, "train").when(part < 9, "val").otherwise("test")


@query("pipe_01_prepare", _SEG + ", w AS (SELECT drive_id FROM k WHERE rn >= 4 AND (rn - 4) % 2 = 0) SELECT CASE WHEN drive_id % 10 < 7 THEN 'train' WHEN drive_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, count(*) AS windows, count(DISTINCT drive_id) AS drives FROM w GROUP BY 1")
def pipe_01(spark, sf_dir):
    return prepare.counts(prepare.windows(stream(spark, sf_dir), split_column(), 5, 2, 43200.0))


@query("pipe_01_channel_scaler", _SEG + """, w AS (SELECT drive_id, segment, rn FROM k WHERE rn >= 4 AND (rn - 4) % 2 = 0 AND drive_id % 10 < 7),
x AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS channel, unnest([ax, ay, az, gx, gy, gz]) AS x FROM w JOIN k ON w.drive_id = k.drive_id AND w.segment = k.segment AND k.rn BETWEEN w.rn - 4 AND w.rn)
SELECT channel, round(avg(x), 4) AS mean, round(CASE WHEN stddev_pop(x) <= 1e-6 THEN 1 ELSE stddev_pop(x) END, 4) AS std, count(*) AS n FROM x GROUP BY channel""")
def pipe_01_scaler(spark, sf_dir):
    rows = prepare.windows(stream(spark, sf_dir), split_column(), 5, 2, 43200.0)
    return prepare.channel_scaler(rows).select("channel", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query("pipe_02_dead_reckoning", f", a AS (SELECT *, greatest(0, least(30, sum(ax * 0.1) {_RUN})) AS v, sum(gz * 0.1) {_RUN} AS h FROM s) SELECT event_id, round(v, 4) AS v, round(sum(v * cos(h) * 0.1) {_RUN}, 4) + 0 AS pe FROM a")
def pipe_02(spark, sf_dir):
    o = estimators.order()
    rows = stream(spark, sf_dir).withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(30.0), estimators.running(F.col("ax") * 0.1, o)))).withColumn("h", estimators.running(F.col("gz") * 0.1, o))
    return rows.withColumn("s", F.col("v") * F.cos("h") * 0.1).select("event_id", F.round("v", 4).alias("v"), F.round(estimators.running(F.col("s"), o), 4).alias("pe"))


def _synthetic_samples(df):
    return df.select(F.col("drive_id").cast("string").alias("run"), F.col("idx").alias("step"), "ax", "ay", "az", "gx", "gy", "gz", F.col("east").alias("ref_e"), F.col("north").alias("ref_n"), "speed", F.col("speed").alias("model_speed"), F.col("dark").alias("inside"), (F.col("speed") * 0.1).alias("moved"))


@query("pipe_03_outage_kilometre")
def pipe_03(spark, sf_dir):
    """An outage of 65 s in a recording generated for each drive, through every configuration."""
    found = recordings.study(_synthetic_samples(synthetic.outage_kilometre(profiles(spark, sf_dir))), BASELINES)
    return found.select("run", "config", F.round("distance", 3).alias("distance"), F.round("drift", 3).alias("drift"), "pass")


@query("pipe_04_scenario_configs")
def pipe_04(spark, sf_dir):
    return recordings.study(scenario_samples(spark, sf_dir), BASELINES).select("run", "config", F.round("drift", 3).alias("drift"))


@query("pipe_05_monte_carlo")
def pipe_05(spark, sf_dir):
    found = recordings.study(scenario_samples(spark, sf_dir), BASELINES)
    return scenarios.grouped(found, [["config"], []], F.count("*").alias("n"), F.round(F.percentile("drift", F.lit(0.5)), 3).alias("median"))


_PERTURBED = """, b AS (SELECT drive_id, idx, east, north, count(*) OVER (PARTITION BY drive_id) AS n, sqrt(pow(east - lag(east) OVER o, 2) + pow(north - lag(north) OVER o, 2)) AS step FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id)),
d AS (SELECT *, sum(step) OVER (PARTITION BY drive_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS dist FROM b),
p AS (SELECT drive_id, idx AS first, row_number() OVER (ORDER BY drive_id, idx) - 1 AS place, count(*) OVER () AS n FROM d WHERE idx >= 5 AND idx % 5 = 0 AND idx + 10 <= n AND dist >= 30)
SELECT drive_id, first, copy, copy = 0 AS plain FROM (SELECT *, unnest(range(greatest(1, (3000 - place - 1) // n + 1))) AS copy FROM p WHERE place < 3000 OR n >= 3000)"""


@query("pipe_06_perturbation", _PERTURBED)
def pipe_06(spark, sf_dir):
    """Every scenario, copied with biases until there are 3,000."""
    found = scenarios.perturbed(scenarios.outages(stream(spark, sf_dir), 10, 5, 5, 30.0), 3000)
    return found.select("drive_id", F.col("first").cast("long").alias("first"), F.col("copy").cast("long").alias("copy"), ((F.col("acc_bias") == 0) & (F.col("gyro_bias") == 0)).alias("plain"))


@query("pipe_06_white_noise")
def pipe_06_noise(spark, sf_dir):
    """What the perturbation adds to each channel of the copies' samples: mean and deviation."""
    rows = stream(spark, sf_dir).withColumn("idx", F.row_number().over(by_time()) - 1)
    copies = scenarios.perturbed(scenarios.outages(stream(spark, sf_dir), 10, 5, 5, 30.0), 3000)
    names = ("ax", "ay", "az", "gx", "gy", "gz")
    met = scenarios.samples_of(copies, rows.select("drive_id", "idx", *names))
    both = scenarios.disturbed(met.withColumns({f"{c}0": F.col(c) for c in names})).where("copy > 0")
    return both.agg(F.count("*").alias("n"), *[F.round(f(F.col(c) - F.col(f"{c}0") - F.col("acc_bias" if c[0] == "a" else "gyro_bias")), 5).alias(f"{c}_{k}") for c in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))])


@query("pipe_08_two_wheeler")
def pipe_08(spark, sf_dir):
    """S-curves at each drive's speed, with the sideways constraint of a car and without it."""
    found = recordings.study(_synthetic_samples(synthetic.two_wheeler(profiles(spark, sf_dir))), (Config("car"), Config("two_wheeler", sideways=False)))
    return found.select("run", "config", F.round("drift", 3).alias("drift"))


@query("pipe_09_field_session", ", d AS (SELECT *, t - lag(t) OVER (PARTITION BY drive_id ORDER BY t, event_id) AS dt, kind = 'error' AND NOT coalesce(lag(kind = 'error') OVER (PARTITION BY drive_id ORDER BY t, event_id), false) AS rise FROM s) SELECT drive_id, count(*) AS n, round(avg(dt), 3) AS dt, count(*) FILTER (rise) AS outages, round(avg(ay * ay), 5) AS nis FROM d GROUP BY drive_id")
def pipe_09(spark, sf_dir):
    o = by_time()
    x = F.col("kind") == "error"
    rows = stream(spark, sf_dir).withColumn("dt", F.col("t") - F.lag("t").over(o)).withColumn("rise", x & ~F.coalesce(F.lag(x).over(o), F.lit(False)))
    return rows.groupBy("drive_id").agg(F.count("*").alias("n"), F.round(F.avg("dt"), 3).alias("dt"), F.count_if("rise").alias("outages"), F.round(F.avg(F.col("ay") * F.col("ay")), 5).alias("nis"))


@query("pipe_12_interval_labels", """, w AS (SELECT drive_id, idx AS last, count(*) OVER o AS n, avg(val) OVER o AS v FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
    k AS (SELECT *, CASE WHEN last < 20 THEN 'before' WHEN last < 50 THEN 'outage' ELSE 'after' END AS interval FROM w WHERE n = 10 AND (last - 9) % 5 = 0)
    SELECT drive_id, interval, count(*) AS windows, round(avg(v), 6) AS mean, round(max(v), 6) AS peak, round(max_by(v, last), 6) AS last FROM k GROUP BY drive_id, interval""")
def pipe_12(spark, sf_dir):
    """Windows of ten rows, five apart, labelled by the row they end on: mean, peak and last value of each interval."""
    o = by_time()
    rows = stream(spark, sf_dir).select("drive_id", (F.row_number().over(o) - 1).alias("end"), F.count("*").over(o.rowsBetween(-9, 0)).alias("n"), F.avg("val").over(o.rowsBetween(-9, 0)).alias("v"))
    label = F.when(F.col("end") < 20, "before").when(F.col("end") < 50, "outage").otherwise("after")
    windows = rows.where((F.col("n") == 10) & ((F.col("end") - 9) % 5 == 0))
    return windows.groupBy("drive_id", label.alias("interval")).agg(F.count("*").alias("windows"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("peak"), F.round(F.max_by("v", "end"), 6).alias("last"))


@query("pipe_13_outage_suite")
def pipe_13(spark, sf_dir):
    found = recordings.study(scenario_samples(spark, sf_dir), BASELINES)
    return found.groupBy("config").agg(F.count("*").alias("runs"), F.count_if("pass").alias("passed"), F.round(F.percentile("drift", F.lit(0.5)), 3).alias("median"))


@query("pipe_14_integrity", ", d AS (SELECT *, t - lag(t) OVER (PARTITION BY drive_id ORDER BY t, event_id) AS dt FROM s) SELECT drive_id, round(quantile_cont(dt, 0.5), 3) AS dt, round(min(speed), 4) AS least, round(max(speed), 4) AS most, round(stddev_pop(speed), 4) AS std FROM d GROUP BY drive_id")
def pipe_14(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("dt", F.col("t") - F.lag("t").over(by_time()))
    return rows.groupBy("drive_id").agg(F.round(F.percentile("dt", F.lit(0.5)), 3).alias("dt"), F.round(F.min("speed"), 4).alias("least"), F.round(F.max("speed"), 4).alias("most"), F.round(F.stddev_pop("speed"), 4).alias("std"))


@query("pipe_17_oracle_interventions")
def pipe_17(spark, sf_dir):
    oracles = ("zero_bias", "true_yaw", "true_force", "true_speed")
    configs = (Config("base", "inertial"), *[Config(name, "inertial", **{name: True}) for name in oracles])
    found = recordings.study(scenario_samples(spark, sf_dir), configs).groupBy("config").agg(F.avg("final").alias("m"))
    base = found.where("config = 'base'").select(F.col("m").alias("base"))
    return found.join(F.broadcast(base)).select("config", F.round((1 - F.col("m") / F.greatest(F.lit(1e-3), F.col("base"))) * 100, 3).alias("pct"))


@query("pipe_18_partial_error_removal", "SELECT event_id, f, round(CASE WHEN idx BETWEEN 10 AND 19 THEN gz + f * (0.01 - gz) ELSE gz END, 6) AS w FROM s, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) v(f)")
def pipe_18(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("idx", F.row_number().over(by_time()) - 1)
    rows = rows.withColumn("f", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))))
    w = F.when(F.col("idx").between(10, 19), F.col("gz") + F.col("f") * (0.01 - F.col("gz"))).otherwise(F.col("gz"))
    return rows.select("event_id", "f", F.round(w, 6).alias("w"))


@query("pipe_19_leveling_policies")
def pipe_19(spark, sf_dir):
    from ..operators.simulate import LEVELING

    found = recordings.study(scenario_samples(spark, sf_dir), (Config("off", "inertial"), *[Config(name, "inertial", leveling=name) for name in LEVELING]))
    return found.groupBy("config").agg(F.count("*").alias("runs"), F.round(F.percentile("drift", F.lit(0.5)), 3).alias("median"), F.round(F.percentile("rmse", F.lit(0.5)), 3).alias("rmse"))


@query("pipe_21_invariants", """, d AS (SELECT *, coalesce(sqrt(pow(east - lag(east) OVER o, 2) + pow(north - lag(north) OVER o, 2)), 0) AS step FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id))
SELECT drive_id, max(speed) <= 24.9 AS speed_ok, max(abs(gz)) <= 0.099 AS rate_ok, max(abs(degrees(atan(ax / az)))) <= 45.5 AS lean_ok, max(step) <= 270 AS step_ok, round(max(step), 3) AS worst_step FROM d GROUP BY drive_id""")
def pipe_21(spark, sf_dir):
    """Physical bounds of every run: speed, rotation, lean and the step between rows."""
    rows = estimators.with_steps(stream(spark, sf_dir))
    worst = lambda c: F.max(F.abs(c))
    return rows.groupBy("drive_id").agg(
        (F.max("speed") <= 24.9).alias("speed_ok"), (worst("gz") <= 0.099).alias("rate_ok"), (worst(F.degrees(F.atan(F.col("ax") / F.col("az")))) <= 45.5).alias("lean_ok"),
        (F.max("step") <= 270).alias("step_ok"), F.round(F.max("step"), 3).alias("worst_step"),
    )


@query("pipe_24_finite_velocity", "SELECT event_id, round(de / 0.1, 4) AS ve FROM (SELECT event_id, de, sqrt(de * de + dn * dn) AS d FROM (SELECT event_id, east - lag(east) OVER o AS de, north - lag(north) OVER o AS dn FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id))) WHERE d > 0.1")
def pipe_24(spark, sf_dir):
    return estimators.finite_velocity(stream(spark, sf_dir)).where("ve IS NOT NULL").select("event_id", F.round("ve", 4).alias("ve"))


def live_rows(spark, sf_dir):
    return stream(spark, sf_dir).select("drive_id", "event_id", "t", "ax", "gz", "speed", "east", "north", (F.col("kind") == "error").alias("dark"))


def _streamed(spark, sf_dir, table_name):
    """The events table as a file stream."""
    kinds = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(kinds).parquet(f"{sf_dir}/events.parquet*")
    return raw


def _events_stream(spark, sf_dir):
    raw = _streamed(spark, sf_dir, "events")
    return raw.select(F.col("user_id").alias("drive_id"), "event_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("val"), (F.col("value") / 20).alias("speed"))


def _answer(spark, query_df, name, mode):
    """The stream's answer as files, read back."""
    folder = new_path(spark, name)
    live.run_available(query_df, f"{folder}/out", f"{folder}/state", mode)
    return spark.read.schema(query_df.schema).parquet(f"{folder}/out")


@query("str_04_tumbling", "SELECT user_id AS drive_id, epoch_us(date_trunc('day', ts)) // 1000000 AS day, count(*) AS n FROM events GROUP BY 1, 2", stream=False)
def str_04(spark, sf_dir):
    days = _events_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "drive_id").agg(F.count("*").alias("n"))
    out = _answer(spark, days, "str_04", "complete")
    return out.select("drive_id", F.unix_seconds("window.start").alias("day"), "n")


@query("str_05_sliding", "SELECT user_id AS drive_id, start, count(*) AS n FROM (SELECT user_id, unnest([epoch_us(date_trunc('day', ts)) // 1000000, epoch_us(date_trunc('day', ts)) // 1000000 - 86400]) AS start FROM events) GROUP BY 1, 2", stream=False)
def str_05(spark, sf_dir):
    out = _answer(spark, live.sliding(_events_stream(spark, sf_dir), size="2 days", step="1 day"), "str_05", "complete")
    return out.select("drive_id", F.unix_seconds("window.start").alias("start"), "n")


@query("str_06_sessions", ", d AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY drive_id ORDER BY t, event_id) >= 43200 THEN 1 ELSE 0 END AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM d) SELECT drive_id, (run + 1)::BIGINT AS number, count(*) AS n FROM r GROUP BY 1, 2")
def str_06(spark, sf_dir):
    out = _answer(spark, live.fix_sessions(_events_stream(spark, sf_dir), gap="12 hours"), "str_06", "complete")
    number = F.row_number().over(Window.partitionBy("drive_id").orderBy("session_window.start")).cast("long")
    return out.select("drive_id", number.alias("number"), "n")


@query("str_07_stateful_navigation")
def str_07(spark, sf_dir):
    from ..session import CHANNELS

    raw = _streamed(spark, sf_dir, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t")
    channels = [F.expr(CHANNELS[c]).alias(c) for c in ("ax", "gz", "speed", "east", "north")]
    rows = raw.select(F.col("user_id").alias("drive_id"), "event_id", t, *channels, (F.col("event_type") == "error").alias("dark"))
    out = _answer(spark, live.navigate(rows), "str_07", "append")
    return out.select("event_id", F.round("pe", 4).alias("pe"), "out_of_order")


@query("str_09_rates", "SELECT user_id AS drive_id, epoch_us(ts) // 1000000 AS sec, count(*) AS n FROM events GROUP BY 1, 2", stream=False)
def str_09(spark, sf_dir):
    out = _answer(spark, live.rates(_events_stream(spark, sf_dir)), "str_09", "complete")
    return out.select("drive_id", F.unix_seconds("window.start").alias("sec"), "n")


@query("str_10_backpressure", "SELECT 3 AS batches, count(*) AS n, count(DISTINCT event_id) AS distinct_n FROM events", stream=False)
def str_10(spark, sf_dir):
    """Five files, two a batch: three batches, every row in one of them."""
    from .sources import _folder

    folder, events = _folder(spark), table(spark, sf_dir, "events")
    events.repartition(5, "event_id").write.parquet(f"{folder}/in")
    live.write_batches(live.paced(spark, events.schema, f"{folder}/in", 2), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").agg(F.count_distinct("batch").cast("int").alias("batches"), F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_n"))


@query("str_11_replay", ", r AS (SELECT *, idx - floor(0.25 * count(*) OVER (PARTITION BY drive_id)) AS k FROM s) SELECT event_id, round(k * 0.025, 4) AS due FROM r WHERE k >= 0")
def str_11(spark, sf_dir):
    """The last three quarters of each recording at four times its speed."""
    return live.replay(stream(spark, sf_dir), ["drive_id"], 0.25, 4.0).select("event_id", F.round("due", 4).alias("due"))


@query("str_12_commands", """, r AS (SELECT *, sum(CASE WHEN kind = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY drive_id ORDER BY idx) AS run FROM s),
    d AS (SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY drive_id, run ORDER BY idx) % 2 = 1 AS denied FROM r) SELECT event_id, run::BIGINT AS run, denied FROM d WHERE kind NOT IN ('click', 'error')""")
def str_12(spark, sf_dir):
    """Frames and commands in one stream by device: clicks reset a device, errors hide and show its fixes."""
    raw = _streamed(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = raw.select(F.col("user_id").alias("drive_id"), "event_id", t.alias("t"), F.col("event_type").alias("kind"))
    frames = rows.where("kind NOT IN ('click', 'error')").select("drive_id", "event_id", "t", F.lit(None).cast("string").alias("cmd"))
    commands = rows.where("kind IN ('click', 'error')").select("drive_id", "event_id", "t", F.when(F.col("kind") == "click", "reset").otherwise("toggle_blackout").alias("cmd"))
    return _answer(spark, live.controlled(frames.unionByName(commands)), "str_12", "append").select("event_id", "run", "denied")


@query("str_13_delivery", "SELECT user_id AS drive_id, count(*) AS n FROM events GROUP BY 1", stream=False)
def str_13(spark, sf_dir):
    """A stream written twice from one checkpoint: the second run adds nothing."""
    from .sources import _folder

    folder = _folder(spark)
    for _ in range(2):
        live.write_stream(_events_stream(spark, sf_dir), f"{folder}/out", f"{folder}/state", None).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("drive_id").agg(F.count("*").alias("n"))


@query("pipe_22_latency", "SELECT part, count(*) AS calls, true AS within_budget FROM s, (VALUES ('inference'), ('predict'), ('sideways'), ('fix')) v(part) GROUP BY part")
def pipe_22(spark, sf_dir):
    """Mean wait of every row for each part of a step, and whether 200 predictions and 10 of the part fit into a second."""
    found = recordings.latency(stream(spark, sf_dir))
    load = 200 * F.max(F.when(F.col("part") == "predict", F.col("ms"))).over(Window.partitionBy(F.lit(1))) + 10 * F.col("ms")  # four rows
    return found.select("part", "calls", (load < 1000).alias("within_budget"))


@query("pipe_25_summary", ", d AS (SELECT drive_id, count(*) AS n, count(*) FILTER (kind = 'error') AS dark, max(speed) AS top FROM s GROUP BY drive_id) SELECT drive_id, printf('drive %d: %d rows, %d without a fix, top speed %.4f m/s', drive_id, n, dark, top) AS line FROM d")
def pipe_25(spark, sf_dir):
    """One line of text a drive."""
    found = stream(spark, sf_dir).groupBy("drive_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("dark"), F.max("speed").alias("top"))
    return found.select("drive_id", F.format_string("drive %d: %d rows, %d without a fix, top speed %.4f m/s", "drive_id", "n", "dark", "top").alias("line"))


@query("pipe_23_state_export")
def pipe_23(spark, sf_dir):
    found = recordings.exported(stream(spark, sf_dir), ["drive_id"])
    return found.select("drive_id", *[F.round(c, 6).alias(c) for c in ("position", "velocity", "attitude", "acc_bias", "gyro_bias")])


@query("str_03_out_of_order", "SELECT event_id, coalesce(t < max(t) OVER (PARTITION BY drive_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM s")
def str_03(spark, sf_dir):
    before = F.max("t").over(Window.partitionBy("drive_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return stream(spark, sf_dir).select("event_id", F.coalesce(F.col("t") < before, F.lit(False)).alias("late"))


@query("src_06_window_files", _SEG + "SELECT CASE WHEN drive_id % 10 < 7 THEN 'train' WHEN drive_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, drive_id, segment, rn - 4 AS start, round(speed, 4) AS target, round(az, 5) AS last_az FROM k WHERE rn >= 4 AND (rn - 4) % 2 = 0")
def src_06(spark, sf_dir):
    """Windows written by split and read back: where each begins, its target and the last value of a channel."""
    path = new_path(spark, "windows")
    prepare.windows(stream(spark, sf_dir), split_column(), 5, 2, 43200.0).write.partitionBy("split").parquet(path)
    found = spark.read.parquet(path)
    return found.select("split", "drive_id", F.col("segment").cast("long").alias("segment"), F.col("start").cast("long").alias("start"), F.round("target", 4).alias("target"), F.round(F.element_at(F.col("window")[2], -1).cast("double"), 5).alias("last_az"))


@query("gov_01_training_gate", "SELECT o_orderkey AS dataset, CASE o_orderstatus WHEN 'F' THEN 'authentic' WHEN 'O' THEN 'synthetic' ELSE 'field' END AS authenticity, o_orderstatus <> 'O' AS allowed FROM orders", stream=False)
def gov_01(spark, sf_dir):
    """A table of dataset manifests through the gate; synthetic data may not train a released model."""
    from ..operators.models import trainable

    kind = F.when(F.col("o_orderstatus") == "F", "authentic").when(F.col("o_orderstatus") == "O", "synthetic").otherwise("field")
    manifests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dataset"), kind.alias("authenticity"))
    return manifests.withColumn("allowed", trainable(F.col("authenticity")))


@query("gov_02_map_source_gate", """, r AS (SELECT drive_id, drive_id % 3 = 0 AS synthetic, CASE WHEN drive_id % 7 > 0 THEN drive_id % 25 END AS model, drive_id % 4 = 0 AS learned, drive_id % 5 = 0 AS truth FROM s GROUP BY drive_id)
SELECT drive_id, concat_ws(',', CASE WHEN synthetic THEN 'data' END, CASE WHEN model % 5 IN (1, 2) THEN 'model' END, CASE WHEN learned AND model IS NULL THEN 'gain' END, CASE WHEN truth THEN 'map' END) AS refused FROM r""")
def gov_02(spark, sf_dir):
    """An evaluation asked for each drive, by its data's origin, its model in the registry, its gain and its map: which gates refuse it."""
    from ..plans.evaluation import refusals

    d = F.col("drive_id")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("model")).join(gov_04(spark, sf_dir).withColumnRenamed("name", "model"), "model")
    asked = stream(spark, sf_dir).select("drive_id").distinct().select(
        "drive_id", F.when(d % 3 == 0, "synthetic").otherwise("field").alias("authenticity"), F.when(d % 7 > 0, d % 25).alias("_key"),
        F.when(d % 4 == 0, "learned").alias("gain"), F.when(d % 5 == 0, "unsafe_waypoints").otherwise("streets").alias("map_source"),
    )
    return refusals(asked.join(names, "_key", "left")).select("drive_id", "refused")


def live_frames(rows):
    """Rows of the stream view as live frames at 10 Hz: a fix every tenth frame, none in a stretch, one simulated denial."""
    index = F.col("event_id") % 60
    t = F.unix_micros("ts") / F.lit(1e6) if "ts" in rows.columns else F.col("t")
    fix = F.when((index % 10 < 5) & ~index.between(30, 44), 1)
    at = lambda c: F.when(fix.isNotNull(), c)
    return rows.select(
        "drive_id", "event_id", t.alias("t"), (F.col("ax") / 20).alias("ax"), (F.col("ay") / 20).alias("ay"), "az", (F.col("gx") / 5).alias("gx"), (F.col("gy") / 5).alias("gy"), (F.col("gz") / 5).alias("gz"),
        F.when(index % 3 == 0, F.col("val") % 360).alias("yaw"), at(F.col("east") / 20).alias("east"), at(F.col("north") / 20).alias("north"), at(t).alias("fix_t"), at(F.when(index == 2, 60.0).otherwise(5.0)).alias("accuracy"),
        at(F.col("speed") / 20).alias("fix_speed"), at(F.col("val") % 360).alias("fix_heading"), (index == 50).cast("double").alias("denied"), F.when(index % 7 == 0, F.col("speed") / 20).alias("model_speed"),
    )


_SHOWN = ("mode", "status", "still", "blackout", "aligned", "out_of_order")
_ALL = (*_SHOWN, "pe", "pn", "v", "score")


def _rounded(found):
    return found.select("event_id", *_SHOWN, *[F.round(c, 3).alias(c) for c in ("pe", "pn", "v", "score")])


@query("est_16_frame_step")
def est_16(spark, sf_dir):
    return _rounded(recordings.frames(live_frames(stream(spark, sf_dir)), ["drive_id"], shown=_ALL))


@query("est_16_frame_step_planar")
def est_16_planar(spark, sf_dir):
    return _rounded(recordings.frames(live_frames(stream(spark, sf_dir)), ["drive_id"], "planar", _ALL))


@query("str_07_frame_step")
def str_07_frames(spark, sf_dir):
    from ..session import CHANNELS

    raw = _streamed(spark, sf_dir, "events")
    channels = [F.expr(e).alias(c) for c, e in CHANNELS.items()]
    rows = raw.select(F.col("user_id").alias("drive_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("val"), *channels)
    return _rounded(_answer(spark, live.drive(live_frames(rows)), "str_07_frames", "append"))
