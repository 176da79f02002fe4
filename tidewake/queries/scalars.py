"""Projections, cleaning, filters and scalar functions (PRJ, FN)."""

from pyspark.sql import functions as F

from ..functions import geo, motion
from ..session import by_time, stream, table
from ..sources import schema
from . import query

R6 = lambda c: F.round(c, 6)


_PHONE_FIELDS = "('timestamp', 'Time (s)'), ('acc_x', 'Accelerometer X (m/s²)'), ('acc_y', 'Accelerometer Y (m/s²)'), ('acc_z', 'Accelerometer Z (m/s²)'), ('gyro_x', 'Gyroscope Roll'), ('gyro_y', 'Gyroscope Pitch'), ('gyro_z', 'Gyroscope Yaw'), ('lat', 'GPS Latitude'), ('lon', 'GPS Longitude')"
_VEHICLE_FIELDS = "('timestamp', 'Time (s)'), ('wheel_speed', 'Indicated Vehicle Speed (km/h)'), ('yaw_rate', 'Yaw Rate')"


@query("prj_01_detect_schema", f"""SELECT 'S-' || n_nationkey || '.csv' AS name, canonical, source FROM nation, (VALUES {_PHONE_FIELDS}) v(canonical, source)
UNION ALL SELECT 'V-' || n_nationkey || '.csv', canonical, source FROM nation, (VALUES {_VEHICLE_FIELDS}) v(canonical, source) WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation)""", stream=False)
def prj_01(spark, sf_dir):
    """The canonical columns of every recorded file, by its header."""
    from ..sources import files
    from .sources import _drives

    return files.detected(files.headers(spark, f"{_drives(spark, sf_dir)}/*.csv")).select("name", "canonical", "source")


@query("prj_02_normalize_names", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || ' (' || p_type || ')')), '[\s\[\](){}<>/\\.,:;-]+', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM part""", stream=False)
def prj_02(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", F.trim(F.regexp_replace(schema.normalized(raw), "_", " ")).alias("name"))


@query("prj_03_rename_canonical", "SELECT event_id AS idx, value AS wheel_speed, user_id AS drive_id FROM events", stream=False)
def prj_03(spark, sf_dir):
    return schema.renamed(table(spark, sf_dir, "events"), {"idx": "event_id", "wheel_speed": "value", "drive_id": "user_id"})


@query("prj_04_timestamp_derivation", "SELECT event_id, CASE WHEN val > 400 THEN NULL ELSE val END AS raw, round(CASE WHEN val > 400 THEN idx * 0.1 ELSE val / 1000 END, 6) AS t FROM s")
def prj_04(spark, sf_dir):
    raw = F.when(F.col("val") <= 400, F.col("val"))
    number = F.row_number().over(by_time()) - 1
    return stream(spark, sf_dir).select("event_id", raw.alias("raw"), R6(schema.seconds("time (ms)", raw, number)).alias("t"))


@query("prj_05_phone_date", "SELECT event_id, round(extract(hour FROM ts) * 3600.0 + extract(minute FROM ts) * 60 + extract(second FROM ts) + 0.703, 6) AS sec FROM events", stream=False)
def prj_05(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH-mm-ss"), F.lit("_703"))
    return table(spark, sf_dir, "events").select("event_id", R6(schema.phone_date_seconds(text)).alias("sec"))


@query("prj_06_speed_unit", "SELECT event_id, round(value / 3.6, 6) AS mps, value AS unchanged FROM events", stream=False)
def prj_06(spark, sf_dir):
    kmh, mps = schema.speed_mps("Velocity km/h", F.col("value")), schema.speed_mps("wheel_speed", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", R6(kmh).alias("mps"), mps.alias("unchanged"))


@query("prj_07_interpolate_fill", """, g AS (SELECT drive_id, event_id, idx, CASE WHEN kind = 'view' THEN val END AS v FROM s),
w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER p AS i0, last_value(v IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER n AS i1, first_value(v IGNORE NULLS) OVER n AS v1
    FROM g WINDOW p AS (PARTITION BY drive_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY drive_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (idx - i0) * 1.0 / (i1 - i0) END, 8) AS filled FROM w""")
def prj_07(spark, sf_dir):
    from ..operators.align import filled

    rows = stream(spark, sf_dir).withColumn("idx", F.row_number().over(by_time()) - 1)
    rows = rows.withColumn("v", F.when(F.col("kind") == "view", F.col("val")))
    return filled(rows, "v", "idx", ["drive_id"]).select("event_id", F.round("v", 8).alias("filled"))


@query("prj_08_zero_base", "SELECT event_id, round(t - min(t) OVER (PARTITION BY drive_id), 4) AS rel FROM s")
def prj_08(spark, sf_dir):
    from ..operators.align import zero_based

    return zero_based(stream(spark, sf_dir).select("drive_id", "event_id", "t"), "t", ["drive_id"]).select("event_id", F.round("t", 4).alias("rel"))


_ODD_SQL = "CASE event_id % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN '-Infinity'::DOUBLE ELSE ax END"


@query("prj_09_sanitise_engine", f""", o AS (SELECT event_id, {_ODD_SQL} AS x, gz AS g FROM s),
c AS (SELECT event_id, CASE WHEN isnan(x) THEN 0 WHEN x = 'Infinity'::DOUBLE THEN 9.81 WHEN x = '-Infinity'::DOUBLE THEN -9.81 ELSE x END AS x FROM o)
SELECT event_id, round(x, 6) AS x, CASE WHEN abs(x) < 1e-3 THEN 9.81 ELSE 0 END::DOUBLE AS z FROM c""")
def prj_09(spark, sf_dir):
    odd = F.expr("CASE event_id % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE ax END")
    rows = stream(spark, sf_dir).select("event_id", motion.finite(odd, 0.0, 9.81, -9.81).alias("x"))
    return rows.select("event_id", R6("x").alias("x"), F.when(F.abs("x") < 1e-3, 9.81).otherwise(0.0).alias("z"))


@query("prj_10_sanitise_filter", f"SELECT event_id, CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE round(x, 6) END AS x FROM (SELECT event_id, {_ODD_SQL} AS x FROM s)")
def prj_10(spark, sf_dir):
    odd = F.expr("CASE event_id % 7 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE ax END")
    return stream(spark, sf_dir).select("event_id", R6(motion.finite(odd)).alias("x"))


@query("prj_11_dt_source", """, d AS (SELECT event_id, (t - lag(t) OVER (PARTITION BY drive_id ORDER BY event_id)) / 100000 AS d FROM s)
SELECT event_id, CASE WHEN d IS NULL THEN 'first' WHEN d <= 0 THEN 'out_of_order' WHEN d BETWEEN 0.001 AND 0.5 THEN 'event' ELSE 'clamped' END AS source, round(CASE WHEN d BETWEEN 0.001 AND 0.5 THEN d ELSE 0.1 END, 6) AS dt FROM d""")
def prj_11(spark, sf_dir):
    from pyspark.sql import Window

    from ..operators.align import dt_source

    gap = (F.col("t") - F.lag("t").over(Window.partitionBy("drive_id").orderBy("event_id"))) / 100000
    source, dt = dt_source(gap)
    return stream(spark, sf_dir).select("event_id", source.alias("source"), R6(dt).alias("dt"))


@query("prj_12_gravity_vector", "SELECT event_id, round(-9.80665 * sin(gx) * cos(gy), 6) + 0 AS x, round(9.80665 * sin(gy), 6) + 0 AS y, round(9.80665 * cos(gy) * cos(gx), 6) AS z FROM s")
def prj_12(spark, sf_dir):
    x, y, z = motion.gravity_in_body(F.col("gy"), F.col("gx"))
    return stream(spark, sf_dir).select("event_id", R6(x).alias("x"), R6(y).alias("y"), R6(z).alias("z"))


@query("prj_13_dynamic_veto", "SELECT event_id, sqrt(ax * ax + ay * ay + (az - 9.80665) * (az - 9.80665)) <= 0.40 AS still FROM s")
def prj_13(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", (motion.norm(F.col("ax"), F.col("ay"), F.col("az") - motion.GRAVITY) <= 0.40).alias("still"))


@query("prj_14_valid_overlap", """, b AS (SELECT drive_id, min(t) AS lo, max(t) AS hi FROM s WHERE kind = 'view' GROUP BY drive_id)
SELECT event_id FROM s JOIN b USING (drive_id) WHERE kind <> 'view' AND t - 3600 BETWEEN lo AND hi""")
def prj_14(spark, sf_dir):
    from ..operators.align import inside_overlap

    rows = stream(spark, sf_dir).select("drive_id", "event_id", "t", "kind")
    return inside_overlap(rows.where("kind <> 'view'"), rows.where("kind = 'view'"), 3600.0).select("event_id")


@query("prj_15_group_mapping", "SELECT event_id, CASE WHEN drive_id % 10 < 4 THEN 'driver_a' WHEN drive_id % 10 < 7 THEN 'driver_b' ELSE 'driver_c' END AS driver FROM s")
def prj_15(spark, sf_dir):
    from ..operators.splits import mapped

    groups = {k: "driver_a" if k < 4 else "driver_b" if k < 7 else "driver_c" for k in range(10)}
    return mapped(stream(spark, sf_dir).select("event_id", (F.col("drive_id") % 10).alias("prefix")), "prefix", groups, "driver").select("event_id", "driver")


@query("prj_16_split_assignment", "SELECT event_id, CASE WHEN drive_id % 10 < 7 THEN 'train' WHEN drive_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM s")
def prj_16(spark, sf_dir):
    part = F.col("drive_id") % 10
    return stream(spark, sf_dir).select("event_id", F.when(part < 7, "train").when(part < 9, "val").otherwise("test").alias("split"))


@query("prj_17_flatten_frame", "SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events", stream=False)
def prj_17(spark, sf_dir):
    frame = F.from_json("props", "k bigint, missing string")
    return table(spark, sf_dir, "events").select("event_id", frame.alias("f")).select("event_id", F.coalesce("f.k", F.lit(0)).alias("k"), F.coalesce("f.missing", F.lit("none")).alias("missing"))


@query("prj_18_device_allow_list", "SELECT s_suppkey, '{\"model\":\"' || s_name || '\"}' AS kept FROM supplier", stream=False)
def prj_18(spark, sf_dir):
    from ..operators.quality import allowed

    info = F.create_map(F.lit("model"), "s_name", F.lit("phone_number"), F.lit("555"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(allowed(info)).alias("kept"))


@query("prj_19_contract_checks", """, d AS (SELECT *, t - lag(t) OVER (PARTITION BY drive_id ORDER BY t, event_id) AS dt FROM s)
SELECT drive_id, count(*) AS n, array_to_string(list_filter([CASE WHEN count(*) < 50 THEN 'too few rows' END, CASE WHEN coalesce(min(dt), 1) <= 0 THEN 'time does not increase' END, CASE WHEN bool_or(isnan(val) OR isinf(val)) THEN 'not finite' END,
    CASE WHEN max(greatest(abs(ax), abs(ay), abs(az))) > 9.9 THEN 'acceleration out of range' END, CASE WHEN max(greatest(abs(gx), abs(gy), abs(gz))) > 25 THEN 'rotation out of range' END, CASE WHEN min(speed) < -1 OR max(speed) > 24 THEN 'speed out of range' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM d GROUP BY drive_id""")
def prj_19(spark, sf_dir):
    from ..operators.quality import contract

    return contract(stream(spark, sf_dir), most_acc=9.9, most_speed=24.0)


@query("prj_20_rate_duration", "SELECT drive_id, round(max(t) - min(t), 4) AS duration, round((count(*) - 1) / (max(t) - min(t)), 9) AS hz FROM s GROUP BY drive_id HAVING count(*) > 1")
def prj_20(spark, sf_dir):
    span = F.max("t") - F.min("t")
    return stream(spark, sf_dir).groupBy("drive_id").agg(F.round(span, 4).alias("duration"), F.round((F.count("*") - 1) / span, 9).alias("hz"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("prj_21_authentic_gate", "SELECT n_nationkey, n_nationkey % 3 = 0 AS allowed FROM nation", stream=False)
def prj_21(spark, sf_dir):
    """Recordings' paths through the gate: only those that say that they are authentic pass."""
    from ..operators.quality import authentic

    folder = F.when(F.col("n_nationkey") % 3 == 0, "/data/Authentic_drives/").otherwise("/data/mock/")
    return table(spark, sf_dir, "nation").select("n_nationkey", authentic(F.concat(folder, "n_name")).alias("allowed"))


@query("prj_22_heading_source", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN event_id % 2 = 0 ELSE val > 250 END AS absolute FROM s")
def prj_22(spark, sf_dir):
    from ..operators.quality import heading_is_absolute

    part = F.col("event_id") % 3
    flag = F.when(part == 0, F.lit(True)).when(part == 1, F.lit(False))
    webkit = (part == 1) & (F.col("event_id") % 2 == 0)
    yaw = F.when((part == 2) & (F.col("val") > 250), F.col("val"))
    return stream(spark, sf_dir).select("event_id", heading_is_absolute(flag, webkit, yaw).alias("absolute"))


@query("prj_23_event_arbitration", "SELECT event_id FROM (SELECT event_id, kind = 'click' AS is_abs, bool_or(kind = 'click') OVER (PARTITION BY drive_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM s) WHERE is_abs OR NOT seen")
def prj_23(spark, sf_dir):
    absolute = F.col("kind") == "click"
    seen = F.max(absolute).over(by_time().rowsBetween(-(2**63), 0))
    return stream(spark, sf_dir).select("event_id", absolute.alias("is_abs"), seen.alias("seen")).where("is_abs OR NOT seen").select("event_id")


@query("prj_24_alpha_to_compass", "SELECT event_id, CASE WHEN kind = 'view' THEN val ELSE round((360 - val % 360) % 360, 6) END AS compass FROM s")
def prj_24(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", F.when(F.col("kind") == "view", F.col("val")).otherwise(R6(F.pmod(360 - F.col("val"), F.lit(360.0)))).alias("compass"))


@query("prj_25_display", "SELECT event_id, ['N','NE','E','SE','S','SW','W','NW'][(floor((val % 360) / 45 + 0.5)::BIGINT % 8 + 1)::INT] AS cardinal, round(speed * 3.6, 4) AS kmh, CASE WHEN gz > 0.02 THEN 'L' WHEN gz < -0.02 THEN 'R' ELSE '-' END AS lean FROM s")
def prj_25(spark, sf_dir):
    lean = F.when(F.col("gz") > 0.02, "L").when(F.col("gz") < -0.02, "R").otherwise("-")
    return stream(spark, sf_dir).select("event_id", motion.cardinal(F.col("val") % 360).alias("cardinal"), F.round(F.col("speed") * 3.6, 4).alias("kmh"), lean.alias("lean"))


@query("fn_01_enu", "SELECT event_id, round(radians(lon - 77.5) * 6378137 * cos(radians(12.9)), 4) AS east, round(radians(lat - 12.9) * 6378137, 4) AS north, round(lat, 6) AS lat_back FROM s")
def fn_01(spark, sf_dir):
    lat0, lon0 = F.lit(12.9), F.lit(77.5)
    e, n = geo.to_enu(F.col("lat"), F.col("lon"), lat0, lon0)
    return stream(spark, sf_dir).select("event_id", F.round(e, 4).alias("east"), F.round(n, 4).alias("north"), R6(geo.from_enu(e, n, lat0, lon0)[0]).alias("lat_back"))


def _geodesic_sql() -> str:
    """Vincenty's inverse from (12.9, 77.5), one nested SELECT a round."""
    f = "(1 / 298.257223563)"
    arc = """SELECT *, cos2 - 2 * su * sw / k AS m FROM (SELECT *, 1 - tilt * tilt AS k FROM (SELECT *, atan2(sin2, cos2) AS sigma, CASE WHEN sin2 = 0 THEN 0 ELSE cu * p / sin2 END AS tilt
        FROM (SELECT *, sqrt(p * p + q * q) AS sin2 FROM (SELECT *, cw * sin(x) AS p, cu * sw - su * cw * cos(x) AS q, su * sw + cu * cw * cos(x) AS cos2 FROM ({})))))"""
    rows = f"SELECT event_id, radians(lon - 77.5) AS l, sin(u) AS su, cos(u) AS cu, sin(w) AS sw, cos(w) AS cw, radians(lon - 77.5) AS x FROM (SELECT *, atan((1 - {f}) * tan(radians(12.9))) AS u, atan((1 - {f}) * tan(radians(lat))) AS w FROM s)"
    for _ in range(6):
        solved = f"SELECT *, {f} / 16 * k * (4 + {f} * (4 - 3 * k)) AS c FROM ({arc.format(rows)})"
        rows = f"SELECT event_id, l, su, cu, sw, cw, l + (1 - c) * {f} * tilt * (sigma + c * sin2 * (m + c * cos2 * (2 * m * m - 1))) AS x FROM ({solved})"
    series = f"SELECT *, 1 + h / 16384 * (4096 + h * (-768 + h * (320 - 175 * h))) AS a, h / 1024 * (256 + h * (-128 + h * (74 - 47 * h))) AS b FROM (SELECT *, k * (1 / pow(1 - {f}, 2) - 1) AS h FROM ({arc.format(rows)}))"
    long = f"SELECT *, 6378137 * (1 - {f}) * a * (sigma - b * sin2 * (m + b / 4 * (cos2 * (2 * m * m - 1) - b / 6 * m * (4 * sin2 * sin2 - 3) * (4 * m * m - 3)))) AS d FROM ({series})"
    return f"SELECT event_id, CASE WHEN sin2 = 0 THEN 0 ELSE round(d * p / sin2, 4) + 0 END AS east, CASE WHEN sin2 = 0 THEN 0 ELSE round(d * q / sin2, 4) + 0 END AS north FROM ({long})"


@query("fn_02_azimuthal", _geodesic_sql())
def fn_02(spark, sf_dir):
    """Metres from a point on the ellipsoid, azimuthal equidistant."""
    rows = stream(spark, sf_dir).select("event_id", "lat", "lon")
    found = geo.azimuthal(rows, F.col("lat"), F.col("lon"), F.lit(12.9), F.lit(77.5))
    return found.select("event_id", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"))


@query("fn_03_haversine", "SELECT event_id, round(2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), 4) AS m FROM (SELECT event_id, pow(sin(radians(12.91 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(12.91)) * pow(sin(radians(77.51 - lon) / 2), 2) AS a FROM s)")
def fn_03(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(12.91), F.lit(77.51)), 4).alias("m"))


@query("fn_04_wrap", "SELECT event_id, round(((ax + pi()) - floor((ax + pi()) / (2 * pi())) * 2 * pi()) - pi(), 6) AS a FROM s")
def fn_04(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", R6(geo.wrap(F.col("ax"))).alias("a"))


@query("fn_05_angle_between", "SELECT event_id, round(least(abs(ay - gz), 2 * pi() - abs(ay - gz)), 6) AS d FROM s")
def fn_05(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", R6(geo.angle_between(F.col("ay"), F.col("gz"))).alias("d"))


@query("fn_06_compass_yaw", "SELECT event_id, round(radians(90 - val % 360), 6) AS yaw, round(val % 360, 5) AS back FROM s")
def fn_06(spark, sf_dir):
    yaw = geo.yaw_of_compass(F.col("val") % 360)
    return stream(spark, sf_dir).select("event_id", R6(yaw).alias("yaw"), F.round(geo.compass_of_yaw(yaw), 5).alias("back"))


@query("fn_07_euler_rotation", "SELECT event_id, round(cos(ay) * cos(gy), 6) AS r11, round(cos(ay) * sin(gy) * sin(gx) - sin(ay) * cos(gx), 6) + 0 AS r12, round(sin(ay) * cos(gy), 6) + 0 AS r21, round(-sin(gy), 6) + 0 AS r31, round(cos(gy) * cos(gx), 6) AS r33 FROM s")
def fn_07(spark, sf_dir):
    r = geo.euler_rotation(F.col("gx"), F.col("gy"), F.col("ay"))
    return stream(spark, sf_dir).select("event_id", *[R6(r[k]).alias(n) for k, n in ((0, "r11"), (1, "r12"), (3, "r21"), (6, "r31"), (8, "r33"))])


@query("fn_09_tilt_heading", "SELECT event_id, round(CASE WHEN h < 0 THEN h + 2 * pi() ELSE h END, 6) AS h FROM (SELECT event_id, atan2(-(ay * cos(gx) - az * sin(gx)), ax * cos(gy) + ay * sin(gx) * sin(gy) + az * cos(gx) * sin(gy)) AS h FROM s)")
def fn_09(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", R6(motion.tilt_heading(F.col("ax"), F.col("ay"), F.col("az"), F.col("gx"), F.col("gy"))).alias("h"))


@query("fn_10_mag_calibrate", "SELECT event_id, round((ax - 0.5) * 1.1, 6) AS x, round((ay + 0.2) * 0.9, 6) AS y, round(az - 0.1, 6) AS z FROM s")
def fn_10(spark, sf_dir):
    from ..operators.quality import calibrated

    x, y, z = calibrated([F.col("ax"), F.col("ay"), F.col("az")], (0.5, -0.2, 0.1), (1.1, 0.9, 1.0))
    return stream(spark, sf_dir).select("event_id", R6(x).alias("x"), R6(y).alias("y"), R6(z).alias("z"))


@query("fn_11_lean_angle", "SELECT event_id, round(greatest(-radians(45), least(radians(45), atan2(speed * gz, 9.80665))), 6) AS lean FROM s")
def fn_11(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", R6(motion.lean_angle(F.col("speed"), F.col("gz"))).alias("lean"))


@query("fn_12_nhc_sigma", "SELECT event_id, round(0.05 * (1 + 2 * sin(abs(gz))), 6) AS two_wheeler, 0.05::DOUBLE AS car FROM s")
def fn_12(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", R6(motion.lateral_sigma(0.05, F.col("gz"))).alias("two_wheeler"), motion.lateral_sigma(0.05, F.col("gz"), False).alias("car"))


@query("fn_13_model_sigma", "SELECT event_id, CASE WHEN speed < 2 THEN 0.6 WHEN speed < 10 THEN 1.0 ELSE 1.8 END::DOUBLE AS sigma FROM s")
def fn_13(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", motion.model_sigma(F.col("speed")).alias("sigma"))


@query("fn_14_blend_weight", "SELECT event_id, round(CASE WHEN idx >= 15 THEN 1 ELSE 0.5 * (1 - cos(pi() * (idx + 1) / 15)) END, 6) AS w FROM s")
def fn_14(spark, sf_dir):
    return stream(spark, sf_dir).withColumn("idx", F.row_number().over(by_time()) - 1).select("event_id", R6(motion.blend_weight(F.col("idx"))).alias("w"))


@query("fn_15_severity", "SELECT event_id, CASE WHEN speed > 30 OR val > 300 THEN 'SEVERE' WHEN speed > 10 OR val > 80 THEN 'MODERATE' ELSE 'MILD' END AS severity FROM s")
def fn_15(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", motion.severity(F.col("speed"), F.col("val")).alias("severity"))


@query("fn_16_hmm_logs", "SELECT event_id, round(-0.5 * pow(speed / 10, 2) - ln(sqrt(2 * pi()) * 10), 6) AS emission, round(-(abs(speed - 3) + CASE WHEN kind = 'view' THEN 0 ELSE 30 END) / 15 - ln(15), 6) AS transition FROM s")
def fn_16(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", R6(motion.emission_log(F.col("speed"), 10.0)).alias("emission"), R6(motion.transition_log(F.col("speed"), F.lit(3.0), F.col("kind") == "view", 15.0)).alias("transition"))


@query("fn_17_point_segment", "SELECT event_id, round(pos, 6) AS pos, round(sqrt(pow(east - 100 * pos, 2) + pow(north - 50 * pos, 2)), 6) AS d FROM (SELECT *, greatest(0, least(1, (east * 100 + north * 50) / 12500)) AS pos FROM s)")
def fn_17(spark, sf_dir):
    ends = [F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(50.0)]
    return stream(spark, sf_dir).select("event_id", R6(geo.along(F.col("east"), F.col("north"), *ends)).alias("pos"), R6(geo.segment_distance(F.col("east"), F.col("north"), *ends)).alias("d"))


@query("fn_18_leveling_sigma", "SELECT event_id, round(greatest(0.02, least(0.5, sqrt(0.0016 + pow(0.1 * ay, 2)))), 6) AS sigma FROM s")
def fn_18(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", R6(motion.leveling_sigma(0.04, 0.1, F.col("ay"), 0.02, 0.5)).alias("sigma"))


@query("fn_19_kinematic_yaw", "SELECT event_id, round(CASE WHEN speed > 2 THEN ay / greatest(speed, 1) ELSE 0 END, 6) AS w FROM s")
def fn_19(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", R6(motion.kinematic_yaw_rate(F.col("ay"), F.col("speed"))).alias("w"))


@query("fn_20_distance_text", "SELECT event_id, CASE WHEN m < 1000 THEN floor(m + 0.5)::BIGINT || ' m' ELSE printf('%.1f km', floor(m / 100 + 0.5) / 10) END AS distance, CASE WHEN mi < 60 THEN mi || ' min' ELSE (mi // 60) || ' hr ' || (mi % 60) || ' min' END AS duration FROM (SELECT event_id, (event_id % 5000 * 7 + 3)::DOUBLE AS m, floor((event_id % 9000) / 60.0 + 0.5)::BIGINT AS mi FROM events)", stream=False)
def fn_20(spark, sf_dir):
    m, sec = (F.col("event_id") % 5000 * 7 + 3).cast("double"), F.col("event_id") % 9000
    return table(spark, sf_dir, "events").select("event_id", geo.distance_text(m).alias("distance"), geo.duration_text(sec).alias("duration"))


@query("fn_21_json", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{\"k\":' || (json_extract(props, '$.k')::BIGINT) || '}' AS back FROM events", stream=False)
def fn_21(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("f")).select("event_id", "f.k", F.to_json("f").alias("back"))


@query("fn_22_sha256", "SELECT p_partkey, sha256(p_name) AS digest FROM part", stream=False)
def fn_22(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2("p_name", 256).alias("digest"))


@query("fn_23_remaining_time", "SELECT event_id, round(600 * greatest(0, least(1, val / 400)), 4) AS eta FROM s")
def fn_23(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", F.round(geo.remaining_time(F.lit(600.0), F.col("val"), F.lit(400.0)), 4).alias("eta"))
