"""Joins and correlation of streams (JOIN)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import align, mapmatch, quality
from ..plans import scenarios
from ..session import STREAM_SQL, by_time, stream, table
from . import query

R4 = lambda c: F.round(c, 4)


def imu_and_fixes(spark, sf_dir):
    rows = stream(spark, sf_dir)
    return rows.where("kind <> 'view'"), rows.where("kind = 'view'")


def numbered(spark, sf_dir):
    return stream(spark, sf_dir).withColumn("idx", F.row_number().over(by_time()) - 1)


@query("join_01_pair_drives", ", v AS (SELECT drive_id, count(*) AS fixes, avg(val) AS mean FROM s WHERE kind = 'error' AND val > 450 GROUP BY drive_id), p AS (SELECT drive_id, count(*) AS n FROM s GROUP BY drive_id) SELECT drive_id, n, coalesce(fixes, 0) AS fixes, round(coalesce(mean, 0), 4) AS speed, CASE WHEN fixes IS NULL THEN 1.0 END::DOUBLE AS corr FROM p LEFT JOIN v USING (drive_id)")
def join_01(spark, sf_dir):
    rows = stream(spark, sf_dir)
    vehicle = rows.where("kind = 'error' AND val > 450").groupBy("drive_id").agg(F.count("*").alias("fixes"), F.avg("val").alias("mean"))
    phone = rows.groupBy("drive_id").agg(F.count("*").alias("n"))
    return phone.join(vehicle, "drive_id", "left").select("drive_id", "n", F.coalesce("fixes", F.lit(0)).alias("fixes"), R4(F.coalesce("mean", F.lit(0.0))).alias("speed"), F.when(F.col("fixes").isNull(), 1.0).alias("corr"))


@query("join_02_interp_time_join", """, i AS (SELECT * FROM s WHERE kind <> 'view'), v AS (SELECT drive_id, t, val FROM s WHERE kind = 'view'),
a AS (SELECT i.drive_id, i.event_id, i.t, lo.t AS t0, lo.val AS v0 FROM i ASOF JOIN v lo ON i.drive_id = lo.drive_id AND i.t >= lo.t),
b AS (SELECT a.*, hi.t AS t1, hi.val AS v1 FROM a ASOF JOIN v hi ON a.drive_id = hi.drive_id AND a.t <= hi.t)
SELECT event_id, round(CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE v0 END, 4) AS v FROM b""")
def join_02(spark, sf_dir):
    imu, fixes = imu_and_fixes(spark, sf_dir)
    return align.interpolated(imu.select("drive_id", "event_id", "t"), fixes, "val", "v").select("event_id", R4("v").alias("v"))


_OFFSETS = """, n AS (SELECT drive_id, idx, val, lead(val, 7) OVER (PARTITION BY drive_id ORDER BY idx) AS shifted FROM s),
lags AS (SELECT unnest(range(-600, 601)) AS m),
v AS (SELECT drive_id, idx, shifted AS v FROM n WHERE shifted IS NOT NULL),
c AS (SELECT p.drive_id, m, corr(p.val, v.v) AS r FROM n p JOIN v USING (drive_id) JOIN lags ON p.idx - v.idx = m GROUP BY p.drive_id, m HAVING count(*) > 50),
k AS (SELECT drive_id, count(*) AS n, count(shifted) AS known FROM n GROUP BY drive_id),
b AS (SELECT drive_id, m, r, row_number() OVER (PARTITION BY drive_id ORDER BY round(r, 7) DESC, m <> 0, m) AS place FROM c)
SELECT drive_id, round(CASE WHEN known < 50 THEN 15 ELSE 15 + coalesce(m, 0) * 0.1 END, 3) AS tau, round(CASE WHEN known < 50 THEN 1.0 ELSE coalesce(r, -1) END, 4) AS r FROM k LEFT JOIN b USING (drive_id) WHERE k.n > 0 AND (place = 1 OR place IS NULL)"""


@query("join_03_clock_offset", _OFFSETS)
def join_03(spark, sf_dir):
    """Recorded values against the same values seven rows earlier on a clock 15 seconds behind: the offset is found again within a minute."""
    rows = numbered(spark, sf_dir)
    phone = rows.select("drive_id", (F.col("idx") * 0.1 + 15.0).alias("t"), F.col("val").alias("speed"))
    vehicle = rows.select("drive_id", (F.col("idx") * 0.1).alias("t"), F.lead("val", 7).over(by_time()).alias("speed"))
    return align.clock_offsets(phone, vehicle).select("drive_id", F.round("tau", 3).alias("tau"), R4("r").alias("r"))


@query("join_04_asof_last_value", ", i AS (SELECT * FROM s WHERE kind <> 'view'), v AS (SELECT * FROM s WHERE kind = 'view') SELECT i.event_id, v.event_id AS fix_id, round(v.lat, 6) AS lat, round(i.t - v.t, 3) AS age FROM i ASOF LEFT JOIN v ON i.drive_id = v.drive_id AND i.t >= v.t")
def join_04(spark, sf_dir):
    imu, fixes = imu_and_fixes(spark, sf_dir)
    found = align.latest(imu.select("drive_id", "event_id", "t"), fixes.withColumn("fix_id", F.col("event_id")), ["fix_id", "lat"])
    return found.select("event_id", "fix_id", F.round("lat", 6).alias("lat"), F.round("age", 3).alias("age"))


_FRESH = f"""WITH RECURSIVE {STREAM_SQL}, r AS (SELECT drive_id, event_id, idx AS k, kind = 'error' AS denied, CASE WHEN event_id % 11 > 0 THEN floor(t / 86400) * 86400 END AS ft, CASE WHEN kind <> 'click' THEN floor(val / 100) END AS la, CASE WHEN event_id % 13 > 0 THEN 77.5 ELSE 77.6 END::DOUBLE AS lo FROM s),
x AS (SELECT *, NOT denied AND la IS NOT NULL AS usable FROM r),
f AS (SELECT drive_id, k, event_id, usable AS fresh, usable AS some, CASE WHEN usable THEN ft END AS ft, CASE WHEN usable THEN la END AS la, CASE WHEN usable THEN lo END AS lo FROM x WHERE k = 0
UNION ALL SELECT x.drive_id, x.k, x.event_id, x.usable AND (NOT f.some OR coalesce(abs(x.ft - f.ft) > 1e-4, false) OR x.la <> f.la OR x.lo <> f.lo) AS fr, f.some OR fr, CASE WHEN fr THEN x.ft ELSE f.ft END, CASE WHEN fr THEN x.la ELSE f.la END, CASE WHEN fr THEN x.lo ELSE f.lo END FROM f JOIN x ON x.drive_id = f.drive_id AND x.k = f.k + 1)
SELECT event_id, fresh FROM f"""


@query("join_05_freshness", _FRESH, stream=False)
def join_05(spark, sf_dir):
    """Frames with repeated fixes, some without a time, some denied: which bring a new one."""
    rows = stream(spark, sf_dir)
    fix_t = F.when(F.col("event_id") % 11 > 0, F.floor(F.col("t") / 86_400) * 86_400.0)
    lat = F.when(F.col("kind") != "click", F.floor(F.col("val") / 100).cast("double"))
    frames = rows.select("drive_id", "event_id", "t", fix_t.alias("fix_t"), lat.alias("lat"), F.when(F.col("event_id") % 13 > 0, 77.5).otherwise(77.6).alias("lon"), (F.col("kind") == "error").alias("denied"))
    return align.fresh(frames, ["drive_id"]).select("event_id", "fresh")


@query("join_06_staleness", ", i AS (SELECT * FROM s WHERE kind <> 'view'), v AS (SELECT * FROM s WHERE kind = 'view') SELECT i.event_id, coalesce(i.t - v.t <= 21600, false) AS valid FROM i ASOF LEFT JOIN v ON i.drive_id = v.drive_id AND i.t >= v.t")
def join_06(spark, sf_dir):
    imu, fixes = imu_and_fixes(spark, sf_dir)
    found = align.latest(imu.select("drive_id", "event_id", "t"), fixes.withColumn("fix_id", F.col("event_id")), ["fix_id"], most_age=21600.0)
    return found.select("event_id", F.col("fix_id").isNotNull().alias("valid"))


_EDGES = """, e0 AS (SELECT i, j, (i - 2) * 50.0 + 100 AS x, (j - 2) * 50.0 + 100 AS y FROM range(5) a(i), range(5) b(j)),
e AS (SELECT (a.i * 5 + a.j) * 25 + b.i * 5 + b.j AS edge, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM e0 a JOIN e0 b ON abs(a.i - b.i) + abs(a.j - b.j) = 1),
n AS (SELECT event_id, edge, east, north, x1, y1, x2, y2, greatest(0, least(1, ((east - x1) * (x2 - x1) + (north - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS pos FROM s, e),
c AS (SELECT event_id, edge, sqrt(pow(east - (x1 + pos * (x2 - x1)), 2) + pow(north - (y1 + pos * (y2 - y1)), 2)) AS d FROM n)
"""


def street_grid(spark):
    _, edges = mapmatch.grid_graph(spark, 5, 50.0)
    return edges.select("edge", *[(F.col(c) + 100).alias(c) for c in ("x1", "y1", "x2", "y2")])


def track_points(spark, sf_dir):
    return stream(spark, sf_dir).select("drive_id", "event_id", "t", F.col("east").alias("x"), F.col("north").alias("y"))


@query("join_07_nearest_segment", _EDGES + "SELECT s.event_id, b.d AS distance FROM s LEFT JOIN (SELECT event_id, round(min(d), 6) AS d FROM c WHERE d < 12 GROUP BY event_id) b USING (event_id)")
def join_07(spark, sf_dir):
    points = track_points(spark, sf_dir).select("event_id", "x", "y")
    return mapmatch.nearest(points, street_grid(spark), 12.0).select("event_id", F.round("distance", 6).alias("distance"))


@query("join_08_candidates", _EDGES + ", k AS (SELECT event_id, d, row_number() OVER (PARTITION BY event_id ORDER BY d, edge) AS rank FROM c WHERE d <= 14) SELECT event_id, rank, round(d, 6) AS distance FROM k WHERE rank <= 5 UNION ALL SELECT event_id, 1, 0 FROM s WHERE event_id NOT IN (SELECT event_id FROM k)")
def join_08(spark, sf_dir):
    points = track_points(spark, sf_dir).select("event_id", "x", "y")
    return mapmatch.candidates(points, street_grid(spark), 4.0).select("event_id", "rank", F.round("distance", 6).alias("distance"))


@query("join_09_route_projection", """, r AS (SELECT k, k * 40.0 AS x1, (k % 2) * 60.0 AS y1, (k + 1) * 40.0 AS x2, ((k + 1) % 2) * 60.0 AS y2 FROM range(5) t(k)),
n AS (SELECT event_id, k, east, north, x1, y1, x2, y2, greatest(0, least(1, ((east - x1) * (x2 - x1) + (north - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS pos FROM s, r)
SELECT event_id, round(min(sqrt(pow(east - (x1 + pos * (x2 - x1)), 2) + pow(north - (y1 + pos * (y2 - y1)), 2))), 6) AS off FROM n GROUP BY event_id""")
def join_09(spark, sf_dir):
    route = [(40.0 * k, 60.0 * (k % 2)) for k in range(6)]
    legs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*a, *b), strict=True)]) for a, b in zip(route[:-1], route[1:], strict=True)])
    off = F.array_min(F.transform(legs, lambda s: geo.segment_distance(F.col("east"), F.col("north"), s["x1"], s["y1"], s["x2"], s["y2"])))
    return stream(spark, sf_dir).select("event_id", F.round(off, 6).alias("off"))


@query("join_10_proximity", """, h AS (SELECT * FROM (VALUES (1, 12.902, 77.503), (2, 12.905, 77.505), (3, 12.908, 77.502)) v(id, la, lo)),
d AS (SELECT event_id, id, 2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)) AS m FROM (SELECT event_id, id, pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2) AS a FROM s, h))
SELECT event_id, arg_min(id, m)::BIGINT AS spot, round(min(m), 3) AS m FROM d WHERE m < 250 GROUP BY event_id""")
def join_10(spark, sf_dir):
    spots = ((1, 12.902, 77.503), (2, 12.905, 77.505), (3, 12.908, 77.502))
    away = F.array(*[F.struct(geo.haversine(F.col("lat"), F.col("lon"), F.lit(a), F.lit(o)).alias("m"), F.lit(i).cast("long").alias("spot")) for i, a, o in spots])
    return stream(spark, sf_dir).select("event_id", F.array_min(away).alias("b")).where("b.m < 250").select("event_id", "b.spot", F.round("b.m", 3).alias("m"))


@query("join_11_blackout_gate", "SELECT event_id, idx BETWEEN 10 AND 19 AS is_outage, round(east, 4) AS ref_east, CASE WHEN idx NOT BETWEEN 10 AND 19 THEN round(east, 4) END AS nav_east FROM s")
def join_11(spark, sf_dir):
    return gated(spark, sf_dir).select("event_id", "is_outage", R4("ref_east").alias("ref_east"), R4("nav_east").alias("nav_east"))


def gated(spark, sf_dir):
    rows = numbered(spark, sf_dir).withColumn("is_outage", (F.col("idx") >= 10) & (F.col("idx") < 20))
    return rows.select("drive_id", "event_id", "idx", "is_outage", F.col("east").alias("ref_east"), F.when(~F.col("is_outage"), F.col("east")).alias("nav_east"))


_SPECS = ", sp AS (SELECT drive_id, min(idx) + 10 AS first, min(idx) + 20 AS last FROM s GROUP BY drive_id)"


def specs(spark, sf_dir):
    return stream(spark, sf_dir).select("drive_id").distinct().withColumns({"first": F.lit(10), "last": F.lit(20)})


@query("join_12_window_samples", _SPECS + " SELECT sp.drive_id, s.event_id, s.idx >= sp.first AND s.idx < sp.last AS inside FROM sp JOIN s ON sp.drive_id = s.drive_id AND s.idx BETWEEN sp.first - 5 AND sp.last + 1")
def join_12(spark, sf_dir):
    found = scenarios.samples_of(specs(spark, sf_dir), numbered(spark, sf_dir).select("drive_id", "event_id", "idx"), 5, 2)
    return found.select("drive_id", "event_id", "inside")


@query("join_13_scenario_grid", _SPECS + " SELECT drive_id, first, config FROM sp, (VALUES ('raw'), ('nhc'), ('full')) c(config)")
def join_13(spark, sf_dir):
    return scenarios.grid(specs(spark, sf_dir), ("raw", "nhc", "full")).select("drive_id", F.col("first").cast("long").alias("first"), "config")


@query("join_14_rate_pairing", ", a AS (SELECT drive_id, val, row_number() OVER (PARTITION BY drive_id ORDER BY t, event_id) AS n FROM s WHERE kind = 'view'), b AS (SELECT drive_id, val, row_number() OVER (PARTITION BY drive_id ORDER BY t, event_id) AS n FROM s WHERE kind = 'click') SELECT drive_id, count(*) AS n, round(corr(a.val, b.val), 5) AS r FROM a JOIN b USING (drive_id, n) GROUP BY drive_id HAVING count(*) > 2")
def join_14(spark, sf_dir):
    part = lambda k, name: stream(spark, sf_dir).where(f"kind = '{k}'").select("drive_id", F.col("val").alias(name), F.row_number().over(by_time()).alias("n"))
    both = part("view", "a").join(part("click", "b"), ["drive_id", "n"])
    return both.groupBy("drive_id").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 5).alias("r")).where("n > 2")


@query("join_15_reference_residual", ", a AS (SELECT drive_id, event_id, val, row_number() OVER (PARTITION BY drive_id ORDER BY t, event_id) AS n FROM s WHERE kind <> 'click'), b AS (SELECT drive_id, val AS ref, row_number() OVER (PARTITION BY drive_id ORDER BY t, event_id) AS n FROM s WHERE kind = 'click'), j AS (SELECT a.*, b.ref FROM a LEFT JOIN b USING (drive_id, n)) SELECT event_id, round(val - last_value(ref IGNORE NULLS) OVER (PARTITION BY drive_id ORDER BY n ROWS UNBOUNDED PRECEDING), 6) AS residual FROM j")
def join_15(spark, sf_dir):
    rows = stream(spark, sf_dir)
    a = rows.where("kind <> 'click'").select("drive_id", "event_id", "val", F.row_number().over(by_time()).alias("n"))
    b = rows.where("kind = 'click'").select("drive_id", F.col("val").alias("ref"), F.row_number().over(by_time()).alias("n"))
    padded = F.last("ref", True).over(Window.partitionBy("drive_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return a.join(b, ["drive_id", "n"], "left").select("event_id", F.round(F.col("val") - padded, 6).alias("residual"))


@query("join_16_provenance_lookup", "SELECT n_nationkey, trim(lower(n_name)) AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", stream=False)
def join_16(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.trim(F.lower("n_name")).alias("name"), F.col("r_name").alias("region"))


@query("gov_03_leakage_checks", "SELECT drive_id, NOT bool_or(idx BETWEEN 10 AND 19 AND event_id % 400 = 0) AS hidden_inside, NOT bool_or(idx NOT BETWEEN 10 AND 19 AND event_id % 300 = 0) AS shown_outside, true AS reference_whole FROM s GROUP BY drive_id")
def gov_03(spark, sf_dir):
    """The checks on every drive's gated rows, of which some are broken: a fix shown inside an outage, one missing outside."""
    rows = gated(spark, sf_dir)
    broken = F.when(F.col("is_outage") & (F.col("event_id") % 400 == 0), F.col("ref_east")).when(~F.col("is_outage") & (F.col("event_id") % 300 == 0), F.col("nav_east") + 1).otherwise(F.col("nav_east"))
    return quality.leakage(rows.withColumn("nav_east", broken), "drive_id")
