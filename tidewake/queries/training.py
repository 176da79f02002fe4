"""Trained networks: rounds of gradients over all windows, drift corrections, stored versions, held-out scores (ML, SNK-15, PIPE-10, PIPE-11)."""

import dataclasses

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, models, segments, training
from ..operators.kernels.network import Perceptron, SpeedNet
from ..plans import scenarios
from ..session import STREAM_SQL, by_time, stream, table
from ..shared import new_path, saved
from ..sources.store import Store
from . import query
from .windows import _SEG
from .estimators import IMU, speed_model, window_rows
from .pipelines import split_column

SCHEDULE = training.Schedule(epochs=6)


def _moments(df, columns: list) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each column over all rows; a deviation near zero is 1."""
    row = df.agg(*[F.coalesce(f(c), F.lit(0.0)) for f in (F.avg, F.stddev_pop) for c in columns]).first()
    mean, std = np.array(row[: len(columns)]), np.array(row[len(columns) :])
    return mean, np.where(std > 1e-6, std, 1.0)


def speed_windows(spark, sf_dir):
    return window_rows(spark, sf_dir).withColumn("split", split_column())


def trained_speed(spark, sf_dir, schedule=SCHEDULE, hidden: int = 32, after=None) -> training.Trained:
    """The speed network, trained on the training drives' windows, chosen on the validation drives'."""
    rows = speed_windows(spark, sf_dir)
    mean, std = _moments(stream(spark, sf_dir).where(split_column() == "train"), list(IMU))
    level = rows.where("split = 'train'").agg(F.avg("target")).first()[0] or 1.0
    keys = ["drive_id", "segment", "start"]
    parts = [training.blocks(rows.where(F.col("split") == s), keys, "window", "target", batch=schedule.batch) for s in ("train", "val")]
    return training.train(SpeedNet(len(IMU), hidden, mean, std, level), *parts, schedule, after)


@query("ml_08_training")
def ml_08(spark, sf_dir):
    """The epochs of a run: rate, losses, which weights were best so far."""
    found = trained_speed(spark, sf_dir)
    rows = [(h["epoch"], round(h["rate"], 8), round(h["train_loss"], 5), round(h["val_loss"], 5), h["best"]) for h in found.history]
    return spark.createDataFrame(rows, "epoch int, rate double, train_loss double, val_loss double, best boolean")


@query("ml_01_speed_network")
def ml_01_network(spark, sf_dir):
    """Speeds of the held-out drives' windows by the trained network."""
    rows = speed_windows(spark, sf_dir).where("split = 'test'")
    return models.infer(rows, "window", trained_speed(spark, sf_dir)).select("drive_id", "segment", "start", F.round(F.col("prediction")[0], 4).alias("speed"), F.round("target", 4).alias("target"))


@query("pipe_10_speed_evaluation")
def pipe_10(spark, sf_dir):
    """Speed errors on drives that neither trained nor chose the network."""
    rows = speed_windows(spark, sf_dir).where("split = 'test'")
    scored = models.infer(rows, "window", trained_speed(spark, sf_dir))
    return scored.agg(F.count("*").alias("windows"), *metrics.banded(F.col("prediction")[0] - F.col("target"), {"all": F.lit(True), "fast": F.col("target") > 10}))


@query("pipe_11_checkpoints")
def pipe_11(spark, sf_dir):
    """Stored checkpoints read back and compared on the held-out drives: the first epoch's, the best, and the ridge."""
    store, rows = Store(spark, new_path(spark, "models")), speed_windows(spark, sf_dir)
    best = trained_speed(spark, sf_dir, after=lambda epoch, theta: store.save("speed", {"theta": theta}, {"epoch": epoch}))
    chosen = max(h["epoch"] for h in best.history if h["best"]) if best.history else None
    held = rows.where("split = 'test'")
    found = [("ridge", speed_model(rows.where("split = 'train'")))]
    found += [(name, training.Trained(best.net, store.load("speed", v)[0]["theta"])) for name, v in (("first", 1), ("best", chosen)) if v]
    out = None
    for name, model in found:
        part = models.infer(held, "window", model).groupBy(F.lit(name).alias("checkpoint")).agg(F.count("*").alias("windows"), *metrics.banded(F.col("prediction")[0] - F.col("target"), {"all": F.lit(True)}))
        out = part if out is None else out.unionByName(part)
    return out


@query("snk_15_model_store", _SEG + "SELECT version, 'ridge' AS name, true AS intact, count(*) AS windows, 0.0::DOUBLE AS off FROM k, (VALUES (1), (2)) v(version) WHERE rn >= 9 AND (rn - 9) % 5 = 0 GROUP BY version")
def snk_15(spark, sf_dir):
    """Two versions of the fitted ridge: written, listed against their digests, read back, and how far predictions after reading are off."""
    store, rows = Store(spark, new_path(spark, "models")), speed_windows(spark, sf_dir)
    fitted = [speed_model(rows.where("split = 'train'")), speed_model(rows)]
    for model in fitted:
        store.save("ridge", {"weights": model.weights}, {"channels": list(IMU)})
    out = None
    for k, model in enumerate(fitted, 1):
        back = models.Linear(store.load("ridge", k)[0]["weights"])
        both = models.infer(models.infer(rows, "window", model, "was"), "window", back, "now")
        part = both.agg(F.lit(k).alias("version"), F.count("*").alias("windows"), F.max(F.abs(F.col("was")[0] - F.col("now")[0])).alias("off"))
        out = part if out is None else out.unionByName(part)
    return out.join(store.registry().select("version", "name", "intact"), "version")


# -- denoising and displacement -------------------------------------------


def _flat(windows, value: str):
    """Windows as rows of features, by split."""
    rows = windows.withColumn("split", split_column())
    return rows.select("drive_id", "segment", "start", "split", F.flatten("window").alias("features"), F.col(value).alias("value"))


def _fitted(rows, widths: tuple, schedule, bound: float | None = None):
    """A perceptron on all training windows, chosen on the validation windows; inputs standardised, outputs scaled or bounded."""
    fit = rows.where("split = 'train'")
    mean, std = _moments(fit, [F.col("features")[k] for k in range(widths[0])])
    parts = [training.blocks(rows.where(F.col("split") == s), ["drive_id", "segment", "start"], "features", "value", batch=schedule.batch) for s in ("train", "val")]
    return training.train(Perceptron(widths, mean, std, 1.0 if bound is None else bound), *parts, schedule)


@query("ml_02_denoise_network")
def ml_02_network(spark, sf_dir):
    """What to add to a window's last sample to reach the mean of the five around it: held-out errors without, with the ridge and with the network."""
    around = by_time().rowsBetween(-2, 2)
    rows = stream(spark, sf_dir).withColumn("residual", F.array(*[F.avg(c).over(around) - F.col(c) for c in IMU]))
    windows = segments.sliding_windows(rows, 10, 5, 43200.0, arrays=IMU, statistics={"residual": F.last("residual")})
    flat = _flat(windows, "residual")
    net = _fitted(flat, (60, 64, 6), SCHEDULE, 0.5)
    ridge = models.Linear.fit_all(windows.where(split_column() == "train"), "window", "residual", low=-0.5, high=0.5)
    held = models.infer_rows(flat.where("split = 'test'"), "features", net).select("value", F.transform("prediction", lambda v: F.greatest(F.lit(-0.5), F.least(F.lit(0.5), v))).alias("p"))
    plain = models.infer(windows.where(split_column() == "test"), "window", ridge).select(F.col("residual").alias("value"), F.col("prediction").alias("p"))
    error = lambda v, p: F.sqrt(F.avg(F.aggregate(F.zip_with(v, p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)))
    out = None
    for name, df, p in (("none", held, F.array_repeat(F.lit(0.0), 6)), ("ridge", plain, F.col("p")), ("network", held, F.col("p"))):
        part = df.agg(F.lit(name).alias("model"), F.count("*").alias("windows"), F.round(error(F.col("value"), p), 5).alias("rms"))
        out = part if out is None else out.unionByName(part)
    return out


def _displacements(spark, sf_dir):
    ends = {f"{c}{k}": f(c) for c in ("east", "north") for k, f in ((0, F.first), (1, F.last))}
    windows = segments.sliding_windows(stream(spark, sf_dir), 10, 5, 43200.0, arrays=IMU, statistics=ends)
    return _flat(windows.withColumn("moved", F.array((F.col("east1") - F.col("east0")) / 100, (F.col("north1") - F.col("north0")) / 100)), "moved")


@query("ml_09_odometry_training")
def ml_09(spark, sf_dir):
    """A displacement network trained by likelihood: the epochs' losses and which was the best."""
    found = _fitted(_displacements(spark, sf_dir), (60, 64, 4), dataclasses.replace(SCHEDULE, loss="nll"))
    rows = [(h["epoch"], round(h["rate"], 8), round(h["train_loss"], 5), round(h["val_loss"], 5), h["best"]) for h in found.history]
    return spark.createDataFrame(rows, "epoch int, rate double, train_loss double, val_loss double, best boolean")


@query("ml_03_displacement_network")
def ml_03_network(spark, sf_dir):
    """Displacements of the held-out drives' windows with the logarithms of their variances, and the loss of each."""
    rows = _displacements(spark, sf_dir)
    net = _fitted(rows, (60, 64, 4), dataclasses.replace(SCHEDULE, loss="nll"))
    p, m = F.col("prediction"), F.col("value")
    s = [F.greatest(F.lit(-6.0), F.least(F.lit(6.0), p[k])) for k in (2, 3)]
    loss = models.gaussian_nll(m[0] - p[0], s[0]) + models.gaussian_nll(m[1] - p[1], s[1])
    found = models.infer_rows(rows.where("split = 'test'"), "features", net)
    return found.select("drive_id", "segment", "start", *[F.round(c, 4).alias(n) for c, n in zip((p[0], p[1], *s), ("dx", "dy", "log_var_x", "log_var_y"), strict=True)], F.round(loss, 4).alias("loss"))


# -- drift corrections ----------------------------------------------------

_BEFORE = 5
_LENGTH = 10
FEATURES = ("speed0", "gz0", "ax0", "ay0", "seconds", "mean_gz", "mean_ax", "mean_ay", "sd_speed", "metres", "turned", "swung")
_TARGETS = ("dx", "dy", "dyaw")


def drift_targets(spark, sf_dir):
    """Every outage with its entry state and the error that dead reckoning (entry speed, integrated rate) ends with, in the entry's frame."""
    o, rows = by_time(), stream(spark, sf_dir)
    behind = o.rowsBetween(-_BEFORE, -1)
    entry = rows.select(
        "drive_id", (F.row_number().over(o) - 1).alias("first"), *[F.lag(c).over(o).alias(n) for c, n in (("speed", "speed0"), ("gz", "gz0"), ("ax", "ax0"), ("ay", "ay0"), ("east", "e0"), ("north", "n0"))],
        F.atan2(F.lag("north").over(o) - F.lag("north", 2).over(o), F.lag("east").over(o) - F.lag("east", 2).over(o)).alias("yaw0"),
        *[F.avg(c).over(behind).alias(f"mean_{c}") for c in ("gz", "ax", "ay")], F.stddev_pop("speed").over(behind).alias("sd_speed"),
    )
    found = scenarios.outages(rows, _LENGTH, _BEFORE, 5, 0.0).select("drive_id", "first", "last").join(entry, ["drive_id", "first"])
    samples = rows.select("drive_id", (F.row_number().over(o) - 1).alias("idx"), "gz", "east", "north", (F.col("east") - F.lag("east").over(o)).alias("de"), (F.col("north") - F.lag("north").over(o)).alias("dn"))
    met = scenarios.samples_of(found, samples)
    turned = F.sum(F.col("gz") * 0.1).over(Window.partitionBy("drive_id", "first").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("turned", turned)
    step = lambda f: F.sum(F.col("speed0") * f(F.col("yaw0") + F.col("turned")) * 0.1)
    state = ["speed0", "gz0", "ax0", "ay0", "e0", "n0", "yaw0", "mean_gz", "mean_ax", "mean_ay", "sd_speed"]
    ends = met.groupBy("drive_id", "first", *state).agg(
        step(F.cos).alias("re"), step(F.sin).alias("rn"), F.max_by("turned", "idx").alias("turned"), F.sum(F.abs("gz")).alias("swung"),
        *[F.max_by(c, "idx").alias(c) for c in ("east", "north", "de", "dn")],
    )
    err_e, err_n = F.col("east") - F.col("e0") - F.col("re"), F.col("north") - F.col("n0") - F.col("rn")
    off = F.atan2("dn", "de") - F.col("yaw0") - F.col("turned")
    seconds = F.lit(_LENGTH * 0.1)
    return ends.select(
        "drive_id", "first", "speed0", "gz0", "ax0", "ay0", seconds.alias("seconds"), "mean_gz", "mean_ax", "mean_ay", "sd_speed", (F.col("speed0") * seconds).alias("metres"), "turned", "swung",
        (err_e * F.cos("yaw0") + err_n * F.sin("yaw0")).alias("dx"), (err_n * F.cos("yaw0") - err_e * F.sin("yaw0")).alias("dy"), F.atan2(F.sin(off), F.cos(off)).alias("dyaw"),
    )


_DRIFT_SQL = f"""WITH {STREAM_SQL},
b AS (SELECT *, lag(speed) OVER o AS speed0, lag(gz) OVER o AS gz0, lag(east) OVER o AS e0, lag(north) OVER o AS n0, atan2(lag(north) OVER o - lag(north, 2) OVER o, lag(east) OVER o - lag(east, 2) OVER o) AS yaw0,
    avg(gz) OVER p AS mean_gz, stddev_pop(speed) OVER p AS sd_speed, count(*) OVER (PARTITION BY drive_id) AS n, east - lag(east) OVER o AS de, north - lag(north) OVER o AS dn
    FROM s WINDOW o AS (PARTITION BY drive_id ORDER BY t, event_id), p AS (PARTITION BY drive_id ORDER BY t, event_id ROWS BETWEEN {_BEFORE} PRECEDING AND 1 PRECEDING)),
e AS (SELECT * FROM b WHERE idx >= {_BEFORE} AND idx % 5 = 0 AND idx + {_LENGTH} <= n),
m AS (SELECT e.drive_id, e.idx AS first, e.speed0, e.e0, e.n0, e.yaw0, e.mean_gz, e.sd_speed, b.idx, b.east, b.north, b.de, b.dn, sum(b.gz * 0.1) OVER (PARTITION BY e.drive_id, e.idx ORDER BY b.idx) AS turned
    FROM e JOIN b ON e.drive_id = b.drive_id AND b.idx BETWEEN e.idx AND e.idx + {_LENGTH - 1}),
g AS (SELECT drive_id, first, any_value(speed0) AS speed0, any_value(yaw0) AS yaw0, any_value(mean_gz) AS mean_gz, any_value(sd_speed) AS sd_speed, max_by(turned, idx) AS turned, max_by(dn, idx) AS dn, max_by(de, idx) AS de,
    max_by(east, idx) - any_value(e0) - sum(speed0 * cos(yaw0 + turned) * 0.1) AS ee, max_by(north, idx) - any_value(n0) - sum(speed0 * sin(yaw0 + turned) * 0.1) AS en FROM m GROUP BY drive_id, first)
SELECT drive_id, first, round(speed0, 4) AS speed0, round(mean_gz, 4) AS mean_gz, round(sd_speed, 4) AS sd_speed, round(turned, 4) AS turned, round(ee * cos(yaw0) + en * sin(yaw0), 4) AS dx, round(en * cos(yaw0) - ee * sin(yaw0), 4) AS dy,
    round(cos(atan2(dn, de) - yaw0 - turned), 4) AS cos_dyaw FROM g"""


@query("ml_06_drift_targets", _DRIFT_SQL, stream=False)
def ml_06_targets(spark, sf_dir):
    found = drift_targets(spark, sf_dir)
    return found.select("drive_id", F.col("first").cast("long").alias("first"), *[F.round(c, 4).alias(c) for c in ("speed0", "mean_gz", "sd_speed", "turned", "dx", "dy")], F.round(F.cos("dyaw"), 4).alias("cos_dyaw"))


@query("ml_06_residual_net")
def ml_06(spark, sf_dir):
    """Mean drift of every split before and after the learned correction; trained on one split's outages, chosen on the second's."""
    rows = drift_targets(spark, sf_dir).withColumn("split", split_column())
    rows = saved(rows.select("drive_id", "first", "split", F.array(*FEATURES).alias("state"), F.array(*_TARGETS).alias("error")), "drift")
    fit = rows.where("split = 'train'")
    mean, std = _moments(fit, [F.col("state")[k] for k in range(len(FEATURES))])
    _, scale = _moments(fit, [F.col("error")[k] for k in range(len(_TARGETS))])
    net = Perceptron((len(FEATURES), 64, 64, len(_TARGETS)), mean, std, scale)
    parts = [training.blocks(rows.where(F.col("split") == s), ["drive_id", "first"], "state", "error", batch=SCHEDULE.batch) for s in ("train", "val")]
    model = training.train(net, *parts, SCHEDULE)
    e, p = F.col("error"), F.col("prediction")
    scored = models.infer_rows(rows, "state", model)
    return scored.groupBy("split").agg(F.count("*").alias("outages"), F.round(F.avg(F.hypot(e[0], e[1])), 3).alias("drift_before"), F.round(F.avg(F.hypot(e[0] - p[0], e[1] - p[1])), 3).alias("drift_after"))


@query("ml_10_batched_inference", "SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 4) AS y FROM embeddings", stream=False)
def ml_10(spark, sf_dir):
    """A linear model fitted on all vectors to their mean, run over batches of 256: the mean comes back."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("window"))
    rows = rows.withColumn("target", F.aggregate(F.col("window")[0], F.lit(0.0), lambda a, x: a + x) / F.size(F.col("window")[0]))
    model = models.Linear.fit_all(rows, "window", "target", l2=1e-9, low=None)
    return models.infer(rows, "window", model).select("vec_id", F.round(F.col("prediction")[0], 4).alias("y"))
