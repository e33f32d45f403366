"""Streams of scans, descriptor tables and text outputs."""

import datetime as dt

from pyspark.sql import functions as F

from scenelake.sources import descriptors
from scenelake.streaming import maps


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_publish_writes_every_batch_once(spark, tmp_path):
    rows = [(at(k / 100), float(k % 7), float(k % 3), 0.5) for k in range(60)]
    points = spark.createDataFrame(rows, "ts timestamp, x double, y double, z double")
    points.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    views = {"cloud": lambda b: b.select("x", "y", "z"), "path": lambda b: b.agg(F.max("ts").alias("last"))}
    for _ in range(2):
        maps.publish(stream(), views, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/cloud")).count() == 60
    assert spark.read.parquet(str(tmp_path / "out/path")).agg(F.max("last")).first()[0] == at(0.59)


def test_merged_sources_and_scan_cells(spark, tmp_path):
    a = spark.createDataFrame([(at(0), 0.2, 0.2, 0.2), (at(0.05), 0.4, 0.4, 0.4), (at(0.15), 0.3, 0.3, 0.3)], "ts timestamp, x double, y double, z double")
    b = spark.createDataFrame([(at(0), 1.0)], "ts timestamp, acc double")
    one = maps.merged_sources({"lidar": a, "imu": b}, ["x", "acc"])
    assert sorted((r.sensor, r.x, r.acc) for r in one.collect() if r.sensor == "imu") == [("imu", None, 1.0)] and one.count() == 4
    got = sorted((r.n, round(r.x, 9)) for r in maps.scan_cells(a, 0.5).collect())
    assert got == [(1, 0.3), (2, 0.3)]
    planes = spark.createDataFrame([(0, 0, 0, 25, 0.0, 0.0, 1.0, True), (1, 0, 0, 99, 0.0, 0.0, 1.0, False)], "vx int, vy int, vz int, n int, nx double, ny double, nz double, planar boolean")
    assert [(r.r, r.g) for r in maps.plane_markers(planes).collect()] == [(0.5, 0.5)]


def test_bucketed_descriptors_join_without_shuffle(spark):
    rows = spark.range(200).select((F.col("id") % 17).alias("k1"), (F.col("id") % 5).alias("k2"), "id")
    try:
        for name in ("_desc_a", "_desc_b"):
            descriptors.save_descriptors(rows, name, ["k1", "k2"], 4)
        a, b = (descriptors.load_descriptors(spark, n) for n in ("_desc_a", "_desc_b"))
        met = a.hint("merge").join(b.withColumnRenamed("id", "other"), ["k1", "k2"])
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        assert met.count() == rows.join(rows.withColumnRenamed("id", "other"), ["k1", "k2"]).count()
    finally:
        for name in ("_desc_a", "_desc_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_slices_and_text(spark):
    files = spark.createDataFrame([(f"{k}.pcd",) for k in "dbca"], "path string")
    name = lambda df: [r.path[0] for r in df.collect()]
    assert name(descriptors.sliced(files, 1, 2)) == ["b", "c"] and name(descriptors.sliced(files, 2)) == ["c", "d"]
    s = spark.createDataFrame([(1, 0.0, 1.0, 2.5, -3.0)], "seg_id int, x1 double, y1 double, x2 double, y2 double")
    assert descriptors.segment_text(s).first().value == "0.000000 1.000000 2.500000 -3.000000"
    p = spark.createDataFrame([(1, [float(k) for k in range(16)]), (2, [1.0]), (3, None)], "k int, pose array<double>")
    got = {r.k: r.value for r in descriptors.pose_text(p, "k").collect()}
    assert got[1].split("\n")[1] == "4.000000 5.000000 6.000000 7.000000" and got[2] is None and got[3] is None
    m = spark.createDataFrame([(1, 2, 10, 20, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5)], "src int, ref int, src_instance int, ref_instance int, src_x double, src_y double, src_z double, ref_x double, ref_y double, ref_z double")
    assert descriptors.match_text(m).first().value == "10 20 0.0000 0.5000 1.0000 1.5000 2.0000 2.5000"
    c = spark.createDataFrame([(0.0,), (0.2,), (None,)], "r double")
    assert descriptors.not_black(c).count() == 1
