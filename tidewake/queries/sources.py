"""Sources and sinks as queries over the test tables or over recordings generated for their drives (SRC, SNK)."""


from pyspark.sql import functions as F

from ..operators import mapmatch
from ..sources import files, schema, sinks, synthetic
from .. import shared
from ..session import by_time, stream, table
from ..shared import new_path, saved
from . import query


_PHONE = "Time (s),Accelerometer X (m/s²),Accelerometer Y (m/s²),Accelerometer Z (m/s²),Gyroscope Roll,Gyroscope Pitch,Gyroscope Yaw,GPS Latitude,GPS Longitude"
_VEHICLE = "Time (s),Indicated Vehicle Speed (km/h),Yaw Rate"


def _drives(spark, sf_dir, located=False):
    """A folder of drive files as recorders leave them, one drive a nation (25 drives of 20 rows): phone and vehicle CSVs, the last drive
    without its vehicle file, and every phone file again in one archive. ``located``: vehicle files have positions too, every fifth drive's none."""
    import io
    import zipfile

    folder, sc = _folder(spark) + "/drives", spark.sparkContext
    nations = sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())  # a fixed list of 25

    def put(name: str, data: bytes) -> None:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        out.write(data)
        out.close()

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for n in nations:
            head = f"{_VEHICLE},GPS Latitude,GPS Longitude" if located and n % 5 else _VEHICLE
            place = lambda k: f",12.{n},77.{k}" if located and n % 5 else ""  # noqa: B023, E731
            phone = "\n".join([_PHONE, *(f"{k / 10},{n + k},{k},9.8,0.1,0.2,{n / 100},12.{n},77.{k}" for k in range(20))]).encode("latin1")
            archive.writestr(f"phones/S-{n}.csv", phone)
            put(f"S-{n}.csv", phone)
            if n != nations[-1]:
                put(f"V-{n}.csv", "\n".join([head, *(f"{k / 10},{n + 2 * k},{n / 50}{place(k)}" for k in range(20))]).encode("latin1"))
    put("phones.zip", packed.getvalue())
    return folder


_ROWS = "(SELECT n_nationkey AS n, k FROM nation, range(20) r(k))"


@query("src_01_drive_table", f"SELECT n::VARCHAR AS drive_id, count(*) AS n, sum(n + k)::DOUBLE AS acc_x, round(sum((n + 2 * k)::DOUBLE), 3) AS wheel_speed FROM {_ROWS} WHERE n < (SELECT max(n_nationkey) FROM nation) GROUP BY n", stream=False)
def src_01(spark, sf_dir):
    """Phone and vehicle files of one drive, read apart and joined on the drive and the clock."""
    folder = _drives(spark, sf_dir)
    phone, vehicle = files.read_drives(spark, f"{folder}/S-*.csv"), files.read_drives(spark, f"{folder}/V-*.csv")
    both = phone.join(vehicle.select("drive_id", "timestamp", "wheel_speed"), ["drive_id", "timestamp"])
    return both.groupBy("drive_id").agg(F.count("*").alias("n"), F.sum("acc_x").alias("acc_x"), F.round(F.sum("wheel_speed"), 3).alias("wheel_speed"))


@query("src_02_header_sniff", "SELECT 'S-' || n_nationkey || '.csv' AS name, 9 AS columns, 'phone' AS kind FROM nation UNION ALL SELECT 'V-' || n_nationkey || '.csv', 3, 'vehicle' FROM nation WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation)", stream=False)
def src_02(spark, sf_dir):
    """What every file is, by its header's columns: a vehicle has a wheel speed and no accelerometer."""
    found = files.headers(spark, f"{_drives(spark, sf_dir)}/*.csv")
    kinds = files.detected(found).select("name", "kind").distinct()
    return found.join(kinds, "name").select("name", F.size(F.split("header", ",")).alias("columns"), "kind")


@query("src_03_discovery", "SELECT n_nationkey::VARCHAR AS drive_id, n_nationkey < (SELECT max(n_nationkey) FROM nation) AS complete FROM nation", stream=False)
def src_03(spark, sf_dir):
    listed = files.listing(spark, _drives(spark, sf_dir), "*.csv")
    return files.paired(listed).select("drive_id", F.lit(True).alias("complete")).unionByName(files.incomplete(listed).select("drive_id", F.lit(False).alias("complete")))


@query("src_05_zipped_drives", f"SELECT n::VARCHAR AS drive_id, count(*) AS n, sum(n + k)::DOUBLE AS acc_x FROM {_ROWS} GROUP BY n", stream=False)
def src_05(spark, sf_dir):
    found = files.read_zipped(spark, f"{_drives(spark, sf_dir)}/phones.zip", "*S-*.csv", ["Time (s)", "Accelerometer X (m/s²)"])
    named = found.withColumn("drive_id", files.drive_id(F.element_at(F.split("member", "/"), -1)))
    return named.groupBy("drive_id").agg(F.count("*").alias("n"), F.sum(F.col("`Accelerometer X (m/s²)`").cast("double")).alias("acc_x"))


@query("src_04_channel_files", "SELECT drive_id, t AS t, max(ax) AS acc_x, max(gz) AS gyro_z, max(lat) FILTER (kind = 'view') AS lat FROM s GROUP BY drive_id, t")
def src_04(spark, sf_dir):
    """A dataset of CSV files a channel, fixes only where there are some, found by their names, read apart and put together; notes are left out."""
    folder, rows, clock = f"{_folder(spark)}/channels", stream(spark, sf_dir), F.col("t").alias("Time (s)")
    axes = lambda a, b, c, name: [F.col(x).alias(f"{name} {k}") for x, k in ((a, "X"), (b, "Y"), (c, "Z"))]
    write = lambda df, name: df.write.option("header", "true").csv(f"{folder}/{name}")
    write(rows.select("drive_id", clock, *axes("ax", "ay", "az", "Accelerometer")), "S-acc.csv")
    write(rows.select("drive_id", clock, *axes("gx", "gy", "gz", "Gyroscope")), "S-gyro.csv")
    write(rows.where("kind = 'view'").select("drive_id", clock, F.col("lat").alias("GPS Latitude"), F.col("lon").alias("GPS Longitude")), "S-gps.csv")
    write(rows.select("drive_id", "kind").distinct(), "notes.csv")
    return files.read_channels(spark, folder).select("drive_id", F.col("timestamp").alias("t"), "acc_x", "gyro_z", "lat")


@query("src_07_session_replay", "SELECT event_id, kind = 'view' AND lat > 12.902 AS has_fix FROM s")
def src_07(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("has_new_gnss", (F.col("kind") == "view").cast("int")).withColumn("lat", F.when(F.col("lat") > 12.902, F.col("lat")))
    return files.replay(rows).select("event_id", F.col("gnss").isNotNull().alias("has_fix"))


@query("src_08_drive_replay", "SELECT event_id, round(lat, 6) AS lat, 3.0::DOUBLE AS accuracy FROM s")
def src_08(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("has_new_gnss", F.lit(1))
    return files.replay(rows).select("event_id", F.round("gnss.lat", 6).alias("lat"), "gnss.accuracy")


def profiles(spark, sf_dir):
    """A profile for each drive of the stream, which cruises at the drive's own mean speed."""
    return stream(spark, sf_dir).groupBy("drive_id").agg(F.round(F.avg("speed"), 3).alias("cruise"))


_PROFILES = ", p AS (SELECT drive_id, round(avg(speed), 3) AS cruise FROM s GROUP BY drive_id)"
_DRIVE = _PROFILES + ", g AS (SELECT drive_id, i AS idx, CASE WHEN i / 1200.0 < 0.1 THEN i / 1200.0 * 10 * cruise WHEN i / 1200.0 < 0.8 THEN cruise ELSE greatest(0, (1 - i / 1200.0) * 5 * cruise) END AS speed FROM p, range(1200) r(i))"


@query("src_09_synthetic_drive", _DRIVE + "SELECT drive_id, idx::INT AS idx, round(speed, 7) AS speed, idx >= 450 AND idx < 750 AS dark FROM g")
def src_09(spark, sf_dir):
    return synthetic.drive(profiles(spark, sf_dir)).select("drive_id", "idx", F.round("speed", 7).alias("speed"), "dark")


@query("src_10_synthetic_walk", _PROFILES + "SELECT drive_id, i::INT AS idx, round(cruise / 10, 6) AS speed, round(i * cruise * 0.01 + cruise * 0.01, 5) AS east, i >= 500 AND i < 700 AS dark FROM p, range(900) r(i)")
def src_10(spark, sf_dir):
    return synthetic.walk(profiles(spark, sf_dir)).select("drive_id", "idx", F.round("speed", 6).alias("speed"), F.round("east", 5).alias("east"), "dark")


@query("src_11_mock_dataset", _DRIVE.replace("1200", "1000") + "SELECT drive_id, count(*) AS n, round(max(speed), 4) AS top, round(sum(speed) * 0.1, 2) AS metres, true AS noisy FROM g GROUP BY drive_id")
def src_11(spark, sf_dir):
    """A thousand noisy rows for each drive; the noise has its mean at zero and its size as asked, within five standard errors."""
    made = synthetic.drive(profiles(spark, sf_dir), 1000, noise=0.5).groupBy("drive_id").agg(F.count("*").alias("n"), F.round(F.max("speed"), 4).alias("top"), F.round(F.sum("speed") * 0.1, 2).alias("metres"), F.avg("az").alias("m"), F.stddev("az").alias("sd"))
    noisy = (F.abs(F.col("m") - synthetic.GRAVITY) < 0.08) & (F.abs(F.col("sd") - 0.5) < 0.06)
    return made.select("drive_id", "n", "top", "metres", noisy.alias("noisy"))


@query("src_12_two_wheeler", _PROFILES + "SELECT drive_id, i::INT AS idx, round(atan2(cruise * 0.3 * sin(i * 0.1 * 0.5), 9.80665), 6) + 0 AS lean FROM p, range(600) r(i)")
def src_12(spark, sf_dir):
    return synthetic.two_wheeler(profiles(spark, sf_dir)).select("drive_id", "idx", (F.round("lean", 6) + 0.0).alias("lean"))


@query("src_13_outage_kilometre", _DRIVE + "SELECT drive_id, round(sum(speed) FILTER (idx >= 300 AND idx < 950) * 0.1, 3) AS dark_metres, count(*) FILTER (idx >= 300 AND idx < 950) AS dark_rows FROM g GROUP BY drive_id")
def src_13(spark, sf_dir):
    made = synthetic.outage_kilometre(profiles(spark, sf_dir)).where("dark")
    return made.groupBy("drive_id").agg(F.round(F.sum("speed") * 0.1, 3).alias("dark_metres"), F.count("*").alias("dark_rows"))


@query("src_15_paired_drives", "SELECT n_nationkey::VARCHAR AS drive_id FROM nation WHERE n_nationkey % 5 > 0 AND n_nationkey < (SELECT max(n_nationkey) FROM nation)", stream=False)
def src_15(spark, sf_dir):
    """Drives with both files and positions in both, by the files' headers."""
    return files.located_pairs(files.headers(spark, f"{_drives(spark, sf_dir, located=True)}/*.csv"))


@query("src_16_manifests", "SELECT lower(s_name) AS name, CASE s_suppkey % 3 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'authentic' ELSE 'field' END AS authenticity, (10 + s_nationkey)::DOUBLE AS hz, 2 AS drives FROM supplier WHERE s_suppkey % 7 > 1", stream=False)
def src_16(spark, sf_dir):
    """One manifest file a supplier; every seventh is cut off, another one names no known origin, and both are left out."""
    key, path = F.col("s_suppkey"), f"{_folder(spark)}/manifests"
    origin = F.when(key % 7 == 1, "hearsay").when(key % 3 == 0, "synthetic").when(key % 3 == 1, "authentic").otherwise("field")
    text = F.to_json(F.struct(F.concat(F.lit(" "), "s_name").alias("dataset_name"), F.lit("recorded").alias("source"), origin.alias("authenticity"), F.lit("imu").alias("sensor_type"), (10 + F.col("s_nationkey")).alias("sampling_rate_hz"), F.array(F.lit("M"), key.cast("string")).alias("drive_ids")))
    made = table(spark, sf_dir, "supplier").withColumn("text", text).select(key.alias("key"), F.when(key % 7 == 0, F.left("text", F.lit(40))).otherwise(F.col("text")).alias("value"))
    shared.dealt(made, "key").write.partitionBy("key").text(path)
    return files.manifests(spark, path).select("name", "authenticity", "hz", F.size("drives").alias("drives"))


def frame_lines(spark, sf_dir):
    imu = F.struct(F.col("t").alias("timestamp"), F.col("ax").alias("acc_x"), F.col("ay").alias("acc_y"), F.col("az").alias("acc_z"))
    gnss = F.when(F.col("kind") == "view", F.struct(F.col("t").alias("timestamp"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")))
    return stream(spark, sf_dir).select("event_id", F.to_json(F.struct(F.lit("sensor_frame").alias("type"), imu.alias("imu"), gnss.alias("gnss"))).alias("value"))


@query("src_17_nested_frames", "SELECT round(t, 3) AS t, round(ax, 6) AS acc_x, CASE WHEN kind = 'view' THEN round(lat, 6) END AS lat FROM s")
def src_17(spark, sf_dir):
    found = files.frames(frame_lines(spark, sf_dir))
    return found.select(F.round("imu.timestamp", 3).alias("t"), F.round("imu.acc_x", 6).alias("acc_x"), F.round("gnss.latitude", 6).alias("lat"))


@query("src_18_flat_frames", "SELECT round(t, 3) AS t, round(az, 6) AS acc_z, 3.0::DOUBLE AS accuracy FROM s")
def src_18(spark, sf_dir):
    found = files.flat_frames(frame_lines(spark, sf_dir))
    return found.select(F.round("timestamp", 3).alias("t"), F.round("acc_z", 6).alias("acc_z"), "accuracy")


@query("src_19_client_units", "SELECT event_id, round(radians(val), 6) AS rad FROM s")
def src_19(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", F.round(F.radians("val"), 6).alias("rad"))


@query("src_20_grid_sampling", ", g AS (SELECT drive_id, min(t) AS t0, max(t) AS t1 FROM s GROUP BY drive_id), k AS (SELECT drive_id, t0 + i * 86400.0 AS t FROM g, (SELECT unnest(range(0, (SELECT (max(t1 - t0) / 86400)::BIGINT + 2 FROM g)))) r(i) WHERE t0 + i * 86400.0 <= t1) SELECT k.drive_id, round(k.t, 3) AS t, s.event_id AS last_id FROM k ASOF JOIN s ON k.drive_id = s.drive_id AND k.t >= s.t")
def src_20(spark, sf_dir):
    from ..operators.align import latest

    rows = stream(spark, sf_dir)
    spans = rows.groupBy("drive_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    grid = spans.select("drive_id", "t0", "t1", F.explode(F.sequence(F.lit(0), F.floor((F.col("t1") - F.col("t0")) / 86400.0) + 1)).alias("i")).select("drive_id", (F.col("t0") + F.col("i") * 86400.0).alias("t"), "t1").where("t <= t1").select("drive_id", "t", F.lit(2**62).alias("event_id"))
    found = latest(grid, rows.withColumn("last_id", F.col("event_id")), ["last_id"])
    return found.select("drive_id", F.round("t", 3).alias("t"), "last_id")


def _centres(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("drive_id").agg(F.round(F.avg("east"), 2).alias("x"), F.round(F.avg("north"), 2).alias("y"))


@query("src_21_road_graph", "SELECT drive_id, CASE WHEN drive_id % 2 = 0 THEN 'stored' ELSE 'diagonal' END AS origin, CASE WHEN drive_id % 2 = 0 THEN 80 ELSE 2 END AS edges, round(CASE WHEN drive_id % 2 = 0 THEN 4000 ELSE 2 * sqrt(pow(max(east) - min(east), 2) + pow(max(north) - min(north), 2)) END, 4) AS metres FROM s GROUP BY drive_id")
def src_21(spark, sf_dir):
    """Streets around every other drive are stored and read back; the others get the diagonal of their bounding box."""
    _, edges = mapmatch.grids(_centres(spark, sf_dir).where("drive_id % 2 = 0"), 5, 50.0)
    points = stream(spark, sf_dir).select("drive_id", F.col("east").alias("x"), F.col("north").alias("y"))
    found = mapmatch.road_graph(saved(edges, "roads"), points)
    return found.groupBy("drive_id", "origin").agg(F.count("*").alias("edges"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 4).alias("metres"))


@query("src_22_street_grid", ", c AS (SELECT drive_id, round(avg(east), 2) AS x, round(avg(north), 2) AS y FROM s GROUP BY drive_id) SELECT drive_id, (i * 5 + j) AS node, round(c.x + (i - 2) * 50.0, 3) AS x, round(c.y + (j - 2) * 50.0, 3) AS y FROM c, range(5) a(i), range(5) b(j)")
def src_22(spark, sf_dir):
    """A grid of streets around the middle of each drive."""
    nodes, _ = mapmatch.grids(_centres(spark, sf_dir), 5, 50.0)
    return nodes.select("drive_id", "node", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("src_23_waypoint_graph", "SELECT drive_id, idx, x1, x2 FROM (SELECT drive_id, idx, round(east, 4) AS x1, round(lead(east) OVER (PARTITION BY drive_id ORDER BY idx), 4) AS x2 FROM s) WHERE x2 IS NOT NULL")
def src_23(spark, sf_dir):
    points = stream(spark, sf_dir).select("drive_id", (F.row_number().over(by_time()) - 1).cast("long").alias("idx"), F.col("east").alias("x"), F.col("north").alias("y"))
    return mapmatch.waypoint_graph(points, allow_truth=True).select("drive_id", "idx", F.round("x1", 4).alias("x1"), F.round("x2", 4).alias("x2"))


def _folder(spark) -> str:
    return new_path(spark, "sinks")


def _through(spark, df):
    """Written as JSON lines to the shared folder and read back."""
    path = f"{_folder(spark)}/reports"
    df.write.json(path)
    return spark.read.schema(df.schema).json(path)


@query("snk_01_split_writer", "SELECT CASE WHEN drive_id % 10 < 7 THEN 'train' WHEN drive_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM s GROUP BY 1")
def snk_01(spark, sf_dir):
    part = F.col("drive_id") % 10
    path = f"{_folder(spark)}/splits"
    sinks.write_splits(stream(spark, sf_dir).withColumn("split", F.when(part < 7, "train").when(part < 9, "val").otherwise("test")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("snk_02_scaler_json", "SELECT channel, round(avg(x), 5) AS mean, round(CASE WHEN stddev_pop(x) <= 1e-6 THEN 1 ELSE stddev_pop(x) END, 5) AS std, count(*) AS n FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS channel FROM embeddings) GROUP BY channel", stream=False)
def snk_02(spark, sf_dir):
    """The scaler as JSON lines, written and read back."""
    from ..operators.scaler import fit

    found = _through(spark, fit(table(spark, sf_dir, "embeddings"), "embedding"))
    return found.select(F.col("channel").cast("long").alias("channel"), F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n")


@query("snk_03_manifest_json", "SELECT '{\"windows\":' || count(*) || ',\"drives\":' || count(DISTINCT drive_id) || '}' AS manifest FROM s")
def snk_03(spark, sf_dir):
    return stream(spark, sf_dir).groupBy("drive_id").agg(F.count("*").alias("n")).agg(F.to_json(F.struct(F.sum("n").alias("windows"), F.count("*").alias("drives"))).alias("manifest"))


@query("snk_04_telemetry_csv", "SELECT event_id::VARCHAR AS event_id, CASE WHEN kind = 'error' THEN '' ELSE printf('%.6f', val) END AS val, CASE WHEN kind = 'view' THEN '1' ELSE '0' END AS fix FROM s")
def snk_04(spark, sf_dir):
    rows = stream(spark, sf_dir).select("event_id", F.when(F.col("kind") != "error", F.col("val")).alias("val"), (F.col("kind") == "view").alias("fix"))
    return sinks.telemetry(rows)


@query("snk_05_session_summary", "SELECT round(max(speed), 4) AS top, round(avg(speed), 4) AS mean, count(*) FILTER (kind = 'view') AS fixes FROM s")
def snk_05(spark, sf_dir):
    return _through(spark, stream(spark, sf_dir).agg(F.round(F.max("speed"), 4).alias("top"), F.round(F.avg("speed"), 4).alias("mean"), F.count_if(F.col("kind") == "view").alias("fixes")))


@query("snk_06_session_listing", "SELECT drive_id AS name, CASE WHEN drive_id % 3 > 0 THEN 'DONE' ELSE 'INCOMPLETE' END AS status FROM s GROUP BY drive_id")
def snk_06(spark, sf_dir):
    """One folder a session with its rows, and with a summary where the session was ended: listed from the files, newest first."""
    folder, rows = f"{_folder(spark)}/sessions", stream(spark, sf_dir).withColumn("session", F.col("drive_id"))
    sinks.write_folders(rows.select("session", "event_id", "t", "val"), folder, "rows.json", ("t", "event_id"))
    sinks.write_folders(rows.where("drive_id % 3 > 0").groupBy("session").agg(F.count("*").alias("frames"), F.max("speed").alias("top")), folder, "summary.json")
    found = files.folders(spark, folder).withColumn("name", F.expr("try_cast(session AS bigint)"))
    listed = found.where("file = 'rows.json'").groupBy("name").agg(F.max("modified").alias("modified"))
    return sinks.sessions(listed, found.where("file = 'summary.json'").select("name", F.lit("DONE").alias("status")).distinct()).select("name", "status")


@query("snk_07_geojson", "SELECT drive_id, 'FeatureCollection' AS type, count(*) AS points, round(first(lon ORDER BY idx), 5) AS lon, round(last(lat ORDER BY idx), 5) AS lat FROM s GROUP BY drive_id")
def snk_07(spark, sf_dir):
    """One collection a drive, written and parsed again: its points, where it begins and where it ends."""
    tracks = stream(spark, sf_dir).groupBy("drive_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
    out = _through(spark, sinks.collection(tracks.select("drive_id", sinks.feature(F.col("points"), F.struct("drive_id")).alias("feature")), ["drive_id"]))
    parsed = F.from_json("geojson", "type string, features array<struct<type:string, geometry:struct<coordinates:array<array<double>>>>>")
    line = F.col("g.features")[0]["geometry"]["coordinates"]
    return out.select("drive_id", parsed.alias("g")).select("drive_id", "g.type", F.size(line).cast("long").alias("points"), F.round(line[0][0], 5).alias("lon"), F.round(F.element_at(line, -1)[1], 5).alias("lat"))


@query("snk_08_run_report", "SELECT event_type AS name, '{\"n\":' || count(*) || '}' AS report FROM events GROUP BY event_type", stream=False)
def snk_08(spark, sf_dir):
    return _through(spark, table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.to_json(F.struct(F.count("*").alias("n"))).alias("report")))


@query("snk_09_evaluation_report", "SELECT '{\"rows\":' || count(*) || ',\"passed\":' || count(*) FILTER (value < 100) || '}' AS report FROM events", stream=False)
def snk_09(spark, sf_dir):
    return _through(spark, table(spark, sf_dir, "events").agg(F.to_json(F.struct(F.count("*").alias("rows"), F.count_if(F.col("value") < 100).alias("passed"))).alias("report")))


@query("snk_10_trace_csv", "SELECT user_id % 4 AS window_id, count(*) AS n FROM events GROUP BY 1", stream=False)
def snk_10(spark, sf_dir):
    path = f"{_folder(spark)}/traces"
    table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("window_id"), "event_id", "value").write.mode("overwrite").partitionBy("window_id").option("header", "true").csv(path)
    return spark.read.option("header", "true").csv(path).groupBy(F.col("window_id").cast("long").alias("window_id")).agg(F.count("*").alias("n"))


@query("snk_11_trajectories", "SELECT event_id, 'east' AS axis, round(east, 4) AS v FROM s UNION ALL SELECT event_id, 'north', round(north, 4) FROM s")
def snk_11(spark, sf_dir):
    return stream(spark, sf_dir).select("event_id", "east", "north").unpivot("event_id", ["east", "north"], "axis", "v").withColumn("v", F.round("v", 4))


@query("snk_12_manifests", "SELECT n_name AS name, '{\"region\":' || n_regionkey || '}' AS json FROM nation", stream=False)
def snk_12(spark, sf_dir):
    return _through(spark, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.to_json(F.struct(F.col("n_regionkey").alias("region"))).alias("json")))


@query("snk_13_json_safe", "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 0 ELSE round(val, 6) END AS v FROM s")
def snk_13(spark, sf_dir):
    odd = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("inf")).otherwise(F.col("val"))
    return stream(spark, sf_dir).select("event_id", F.round(sinks.json_safe(odd), 6).alias("v"))
