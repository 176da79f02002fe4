"""Audited evaluation: provenance, blackout gate, estimator, map, metrics and leak checks as one plan.

What the estimator sees inside an outage holds no reference value: the gate
replaces positions by nulls before anything is joined to them, and the errors
are taken afterwards against the rows' own reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import estimators, mapmatch, metrics, models, recordings
from ..operators.models import trainable
from ..operators.segments import padded_windows

CHANNELS = ("ax", "ay", "az", "gx", "gy", "gz")


def refusals(requests: DataFrame) -> DataFrame:
    """``requests`` with ``refused``: the gates that an evaluation does not pass, comma-joined, empty where it may run.

    data: not of authentic or field origin. model: one is named that is not
    registered with its content (``known``, null: no). gain: a learned gain
    without a model. map: waypoints of the truth. A null map or gain is none.
    """
    gates = (
        ("data", ~trainable(F.col("authenticity"))), ("model", F.col("model").isNotNull() & ~F.coalesce("known", F.lit(False))),
        ("gain", F.coalesce(F.col("gain") == "learned", F.lit(False)) & F.col("model").isNull()), ("map", F.coalesce(F.col("map_source") == "unsafe_waypoints", F.lit(False))),
    )
    return requests.withColumn("refused", F.concat_ws(",", *[F.when(bad, name) for name, bad in gates]))


def gated(rows: DataFrame, inside: Column) -> DataFrame:
    """``rows`` (with idx) with ``is_outage`` and the positions that navigation may see, ``nav_east`` and ``nav_north``."""
    shown = lambda c: F.when(~F.col("is_outage"), F.col(c))
    return rows.withColumn("is_outage", F.coalesce(inside, F.lit(False))).withColumns({"nav_east": shown("east"), "nav_north": shown("north")})


def speeds(rows: DataFrame, model=None, size: int = 10) -> DataFrame:
    """``rows`` with ``model_speed``: the model's on the causal window up to each row (short ones padded), without
    a model the running sum of the forward acceleration within 0 and 30 m/s."""
    o = estimators.order()
    if model is None:
        return rows.withColumn("model_speed", F.greatest(F.lit(0.0), F.least(F.lit(30.0), estimators.running(F.col("ax") * 0.1, o))))
    seen = rows
    for c in CHANNELS:
        seen = padded_windows(seen, c, size, o).withColumnRenamed("window", f"_{c}")
    seen = seen.withColumn("_window", F.array(*[f"_{c}" for c in CHANNELS])).drop(*[f"_{c}" for c in CHANNELS])
    found = models.infer(seen, "_window", model, "_speed")
    return found.withColumn("model_speed", F.greatest(F.col("_speed")[0], F.lit(0.0))).drop("_window", "_speed")


def navigated(rows: DataFrame, model=None, kind: str = "planar", edges: DataFrame | None = None, sigma: float = 10.0) -> DataFrame:
    """Gated rows through the estimator: (drive_id, event_id, idx, is_outage, pe, pn, v).

    Outside an outage fixes are fused, inside it the model's speed and the
    sideways constraint; with ``edges`` the path is matched to the roads.
    """
    seen = speeds(rows, model).select("drive_id", "event_id", "t", "idx", "is_outage", *CHANNELS, F.coalesce("nav_east", F.lit(0.0)).alias("east"), F.coalesce("nav_north", F.lit(0.0)).alias("north"), F.when(F.col("is_outage"), F.col("model_speed")).otherwise(F.col("speed")).alias("speed"))
    found = recordings.fused(seen, ["drive_id"], kind, "is_outage").select("drive_id", "event_id", "pe", "pn", "v")
    found = rows.select("drive_id", "event_id", "idx", "is_outage").join(found, ["drive_id", "event_id"])
    if edges is None:
        return found
    points = found.select("drive_id", "event_id", "idx", F.col("pe").alias("x"), F.col("pn").alias("y"))
    snapped = mapmatch.matched(points, edges, ["drive_id"], sigma=sigma).select("drive_id", "event_id", "px", "py")
    return found.join(snapped, ["drive_id", "event_id"]).withColumns({"pe": F.col("px"), "pn": F.col("py")}).drop("px", "py")


def audited(rows: DataFrame, inside: Column, provenance: DataFrame, model=None, model_name: str | None = None, map_source: str = "none", edges: DataFrame | None = None, allow_synthetic: bool = False) -> tuple[DataFrame, DataFrame]:
    """(estimates with ``err``, audit): every drive through the gates, the estimator and the checks.

    ``provenance`` has drive_id and authenticity. Drives of synthetic origin
    are left out unless allowed, and never count as valid research; unknown
    authenticity is an error. A map of the truth's waypoints is refused unless
    synthetic data are allowed. The audit has a row for each evaluated drive.
    """
    if map_source == "unsafe_waypoints" and not allow_synthetic:
        raise ValueError("waypoints of the truth cannot be a map")
    known = rows.join(provenance.select("drive_id", "authenticity"), "drive_id").withColumn("_valid", trainable(F.col("authenticity")))
    gate = gated(known if allow_synthetic else known.where("_valid"), inside)
    found = navigated(gate, model, edges=edges)
    truth = gate.select("drive_id", "event_id", "east", "north", "nav_east", "nav_north", "authenticity", "_valid", "step")
    both = found.join(truth, ["drive_id", "event_id"]).withColumn("err", F.hypot(F.col("pe") - F.col("east"), F.col("pn") - F.col("north")))
    safe = F.lit(map_source != "unsafe_waypoints")
    audit = both.groupBy("drive_id", "authenticity").agg(
        (F.bool_and("_valid") & safe).alias("valid"), F.count("*").alias("points"), F.count_if("is_outage").alias("dark_points"), F.lit(model_name).alias("model"), safe.alias("map_safe"),
        F.bool_and(~F.col("is_outage") | (F.col("nav_east").isNull() & F.col("nav_north").isNull())).alias("hidden_inside"),
        F.bool_and(F.col("is_outage") | ((F.col("nav_east") == F.col("east")) & (F.col("nav_north") == F.col("north")))).alias("shown_outside"),
        F.bool_and(F.col("pe").isNotNull() & ~F.isnan("pe") & ~F.isnan("pn")).alias("finite"), F.sum(F.when(F.col("is_outage"), F.col("step")).otherwise(0.0)).alias("dark_metres"),
    )
    return both.drop("_valid"), audit


def scored(estimates: DataFrame) -> DataFrame:
    """Errors inside the outage per drive."""
    return metrics.navigation(estimates.where("is_outage"), ["drive_id"], "err", "step", "idx", 3)
