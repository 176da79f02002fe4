"""State machines over ordered rows.

Machines whose state resets at row-local conditions are gaps and islands
(window functions); those whose next state depends on the last one are scans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.motion import GRAVITY, blend_weight, norm
from .fold import fold, scan


def stationary_statistics(df: DataFrame, order: WindowSpec, rows: int = 10) -> DataFrame:
    """Adds mean acceleration norm, variance of norms, mean and largest rotation norm over the last rows, and ``full``."""
    f = order.rowsBetween(1 - rows, 0)
    df = df.withColumn("_an", norm(F.col("ax"), F.col("ay"), F.col("az"))).withColumn("_gn", norm(F.col("gx"), F.col("gy"), F.col("gz")))
    mean = lambda *c: norm(*[F.avg(x).over(f) for x in c])
    out = df.withColumn("mean_acc", mean("ax", "ay", "az")).withColumn("var_acc", F.var_pop("_an").over(f)).withColumn("mean_gyro", mean("gx", "gy", "gz"))
    return out.withColumn("max_gyro", F.max("_gn").over(f)).withColumn("full", F.count("*").over(f) == rows).drop("_an", "_gn")


def stationary(df: DataFrame, variance: float = 0.15, norm_slack: float = 1.2, most_speed: float = 0.8, mean_rate: float = 0.05, most_rate: float = 0.125, latch: int = 2) -> DataFrame:
    """Adds ``still``. Rows above ``most_speed`` are vetoed: never still, outside the rolling rows, and they break a run.

    The other rows' statistics cover the last ten of them; ``latch`` of them
    in a row that fulfil all conditions, with no veto between, latch.
    """
    order = Window.partitionBy("drive_id").orderBy("t", "event_id")
    veto = F.col("speed") > most_speed
    df = df.withColumn("_veto", veto).withColumn("_epoch", F.count_if(veto).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = Window.partitionBy("drive_id", "_veto").orderBy("t", "event_id")
    df = stationary_statistics(df, kept)
    ok = ~F.col("_veto") & F.col("full") & (F.abs(F.col("mean_acc") - GRAVITY) <= norm_slack) & (F.col("var_acc") < variance) & (F.col("mean_gyro") < mean_rate) & (F.col("max_gyro") < most_rate)
    df = df.withColumn("_ok", ok)
    df = df.withColumn("_run", F.count_if(~F.col("_ok")).over(kept.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("drive_id", "_veto", "_epoch", "_run").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    still = F.col("_ok") & (F.count_if("_ok").over(run) >= latch)
    return df.withColumn("still", still).drop("_veto", "_epoch", "_ok", "_run", "mean_acc", "var_acc", "mean_gyro", "max_gyro", "full")


TRUSTED, DEGRADED, JUMP, SPOOFED = "TRUSTED", "DEGRADED", "SUSPICIOUS_JUMP", "REJECTED_SPOOFED"


def trust(fixes: DataFrame, keys: list[str], alpha: float = 0.25, most_accuracy: float = 50.0, most_jump: float = 25.0, gate: float = 3.5, forced: int = 15, unknown: float = 3.0) -> DataFrame:
    """Fold fixes (t, event_id, east, north, accuracy, pred_e, pred_n, var_e, var_n, cov_en, inertial) into status and score.

    A poor accuracy degrades; a jump that inertial speed cannot explain and a
    Mahalanobis distance over the gate reject; all three count as rejections.
    After more than ``forced`` of them in a row fixes outside the gate are
    taken with half trust until one passes. Only a trusted fix becomes the next
    comparison. A null or zero accuracy is ``unknown`` metres.
    """
    values = ["east", "north", "accuracy", "pred_e", "pred_n", "var_e", "var_n", "cov_en", "inertial"]

    def machine():
        score, good, rejected = 1.0, None, 0

        def step(t, event, east, north, accuracy, pred_e, pred_n, var_e, var_n, cov, inertial):
            nonlocal score, good, rejected
            own = accuracy or unknown
            a, b, c = var_e + own * own, cov, var_n + own * own
            de, dn = east - pred_e, north - pred_n
            far = math.sqrt(max(0.0, (c * de * de - 2 * b * de * dn + a * dn * dn) / (a * c - b * b)))
            moved = math.hypot(east - good[0], north - good[1]) if good else 0.0
            if accuracy is not None and accuracy > most_accuracy:
                status, goal, rejected = DEGRADED, 0.2, rejected + 1
            elif good and moved > most_jump and moved / max(t - good[2], 1e-3) > inertial * 2.5 + 15.0:
                status, goal, rejected = JUMP, 0.0, rejected + 1
            elif far > gate and rejected > forced:
                status, goal = DEGRADED, 0.5
            elif far > gate:
                status, goal, rejected = SPOOFED if far > 6.0 else JUMP, max(0.0, 1.0 - (far - gate) * 0.2), rejected + 1
            else:
                status, goal, rejected, good = TRUSTED, 1.0, 0, (east, north, t)
            score = max(0.0, min(1.0, score * (1 - alpha) + alpha * goal))
            return ((event, status, score),)

        return step

    return scan(fixes, keys, ["t", "event_id"], values, machine, "event_id long, status string, score double")


def ema(df: DataFrame, keys: list[str], value: str, alpha: float, initial: float) -> DataFrame:
    """The last exponential moving average per group."""
    return fold(df, keys, ["t", "event_id"], [value], F.lit(initial), lambda s, x: s * (1 - alpha) + x[value] * alpha, lambda s: s)


def crashes(df: DataFrame, keys: list[str], impact_g: float = 3.5, surge: float = 250.0, still_speed: float = 1.0, still_seconds: float = 2.0) -> DataFrame:
    """Crash state per row (t, event_id, g, rate, speed): NORMAL, IMPACT, CONFIRMING or CONFIRMED."""

    def machine():
        state, at, peak, spin = "NORMAL", 0.0, 0.0, 0.0

        def step(t, event, g, rate, speed):
            nonlocal state, at, peak, spin
            hit = state == "NORMAL" and g >= impact_g
            if hit:
                at, peak, spin = t, g, rate
            elif state == "IMPACT":
                peak, spin = max(peak, g), max(spin, rate)
            if hit or state == "IMPACT":
                if spin >= surge or peak >= impact_g * 1.5:
                    state = "CONFIRMING"
                elif t - at <= 0.5:
                    state = "IMPACT"
                else:
                    state = "NORMAL" if peak < impact_g * 1.8 else "CONFIRMING"
            if state == "CONFIRMING":
                if speed > still_speed * 2 and t - at > 1.0:
                    state = "NORMAL"
                elif t - at >= still_seconds:
                    state = "CONFIRMED" if speed <= still_speed else "NORMAL"
            return ((event, state),)

        return step

    return scan(df, keys, ["t", "event_id"], ["g", "rate", "speed"], machine, "event_id long, state string")


def outages(df: DataFrame, inside: Column, least_seconds: float = 2.0, least_metres: float = 10.0) -> DataFrame:
    """Runs of rows inside an outage, by gaps and islands: id (all starts counted), times, distance, largest uncertainty, points; short ones are dropped."""
    order = Window.partitionBy("drive_id").orderBy("t", "event_id")
    df = df.withColumn("_in", inside)
    start = F.col("_in") & ~F.coalesce(F.lag("_in").over(order), F.lit(False))
    df = df.withColumn("_start", start.cast("int"))
    df = df.withColumn("number", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_in")
    points = F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    found = df.groupBy("drive_id", "number").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.sum("step").alias("metres"), F.max("uncertainty").alias("uncertainty"), points.alias("points"))
    found = found.withColumn("seconds", F.col("t_end") - F.col("t_start")).where((F.col("seconds") >= least_seconds) | (F.col("metres") >= least_metres))
    return found.withColumn("id", F.format_string("BS-%04d", "number"))


def mode(trust_score: Column, speed: Column, still: Column, in_outage: Column, returning: Column) -> Column:
    """Navigation mode by priority: coming back, standing, dead reckoning with or without a speed, satellites."""
    return F.when(returning, "REACQUISITION").when(still, "STATIONARY").when(in_outage | (trust_score <= 0.7), F.when(speed > 0.1, "DEAD_RECKONING_MODEL").otherwise("DEAD_RECKONING")).otherwise("GNSS")


def since_event(event: Column, order: WindowSpec) -> Column:
    """Rows since the last row where ``event`` holds (0 there); null before the first."""
    number = F.row_number().over(order)
    return number - F.last(F.when(event, number), True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def reacquired(df: DataFrame, returns: Column, pe: str, pn: str, fix_e: str, fix_n: str, rows: int = 15) -> DataFrame:
    """Adds ``jump``, ``out_e`` and ``out_n``: the offset at the last returning fix and the position blended towards it.

    The weight of the fix grows along a cosine bell over ``rows`` rows, so the
    output leaves the reckoned position (``pe``, ``pn``) without a step; before
    the first return all three are null.
    """
    order = Window.partitionBy("drive_id").orderBy("t", "event_id")
    held = lambda c: F.last(F.when(F.col("_returns"), c), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_returns", returns).withColumn("_since", since_event(F.col("_returns"), order))
    offset = F.hypot(F.col(pe) - F.col(fix_e), F.col(pn) - F.col(fix_n))
    df = df.withColumns({"jump": held(offset), "_fe": held(F.col(fix_e)), "_fn": held(F.col(fix_n)), "_w": blend_weight(F.col("_since"), rows)})
    mixed = lambda a, b: (1 - F.col("_w")) * F.col(a) + F.col("_w") * F.col(b)
    return df.withColumns({"out_e": mixed(pe, "_fe"), "out_n": mixed(pn, "_fn")}).drop("_returns", "_since", "_fe", "_fn", "_w")


def disturbance(df: DataFrame, expected: float, tolerance: float, most_variance: float, most_rate: float) -> DataFrame:
    """Adds ``disturbance``: CLEAN, SUSPICIOUS or SEVERE, from the field's norm, its recent variance and its rate of change."""
    order = Window.partitionBy("drive_id").orderBy("t", "event_id")
    f = order.rowsBetween(-9, 0)
    size = norm(F.col("ax"), F.col("ay"), F.col("az"))
    df = df.withColumn("_n", size)
    variance = F.when(F.count("*").over(f) >= 5, F.var_pop("_n").over(f)).otherwise(0.0)
    dt = F.col("t") - F.lag("t").over(order)
    rate = F.when((dt > 1e-4) & (dt < 1), F.abs(F.col("_n") - F.lag("_n").over(order)) / dt)
    off = F.abs(F.col("_n") - expected)
    fails = (off > tolerance).cast("int") + (variance > most_variance).cast("int") + F.coalesce((rate > most_rate).cast("int"), F.lit(0))
    df = df.withColumn("_fails", fails).withColumn("_off", off)
    return df.withColumn("disturbance", F.when(F.col("_fails") == 0, "CLEAN").when((F.col("_fails") == 1) & (F.col("_off") < 1.5 * tolerance), "SUSPICIOUS").otherwise("SEVERE")).drop("_n", "_fails", "_off")


def resampled(df: DataFrame, keys: list[str], value: str, period: float = 0.1, slack: float = 0.1, most_gap: float = 1.0) -> DataFrame:
    """Anti-aliased samples: the mean of what came since the last emission, once ``period`` (less the slack) has passed since it.

    The first row is emitted; rows that do not advance the clock accumulate; a
    gap of 1.8 periods up to ``most_gap`` seconds is filled with interpolants
    before the mean; a longer one marks its row ``restart``. Boundaries follow
    the last emission, so this is a fold.
    """

    def machine():
        at, last, total, n = None, None, 0.0, 0

        def step(t, event, x):
            nonlocal at, last, total, n
            total, n = total + x, n + 1
            if at is None:
                at, last, total, n = t, x, 0.0, 0
                return ((t, x, False, False),)
            dt = t - at
            if dt < period * (1 - slack):
                return ()
            before, mean = last, total / n
            steps = round(dt / period) if 1.8 * period <= dt <= most_gap else 1
            out = [(at + dt * k / steps, before + (mean - before) * k / steps, True, False) for k in range(1, steps)]
            at, last, total, n = t, mean, 0.0, 0
            return (*out, (t, mean, False, dt > most_gap))

        return step

    return scan(df, keys, ["t", "event_id"], [value], machine, "t double, value double, filled boolean, restart boolean")


def triggered(samples: DataFrame, keys: list[str], ring: int = 50, every: int = 10) -> DataFrame:
    """Emissions (not interpolants) at which the model runs: the ring is full and the count has crossed a multiple of ``every``.

    A ``restart`` empties the ring and begins the count anew.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    samples = samples.withColumn("run", F.count_if("restart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy(*keys, "run").orderBy("t")
    count = F.row_number().over(order)
    before = F.coalesce(F.last(F.when(~F.col("filled"), F.floor(count / every)), True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    samples = samples.withColumn("count", count)
    return samples.withColumn("_crossed", F.floor(F.col("count") / every) > before).where("NOT filled AND _crossed").where(F.col("count") >= ring).drop("_crossed")


def thinned(df: DataFrame, keys: list[str], least: float, throttle: bool = False) -> DataFrame:
    """Rows kept greedily: the first, then each that is ``least`` away from the last kept one (metres, or seconds with ``throttle``)."""

    def machine():
        last = None

        def step(t, event, east=0.0, north=0.0):
            nonlocal last
            if last is not None and (t - last[0] if throttle else math.hypot(east - last[1], north - last[2])) < least:
                return ()
            last = t, east, north
            return ((event,),)

        return step

    return scan(df, keys, ["t", "event_id"], [] if throttle else ["east", "north"], machine, "event_id long")
