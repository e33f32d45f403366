"""Invariants and small fixtures with the awkward cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.operators import association, cells, detect, graph, ordering, raster, segments, temporal
from scenelake.sources import detections, pcd, sinks


def cloud(spark, n, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.gauss(0, 2), rng.gauss(0, 2), rng.gauss(0, 1)) for i in range(n)], "point_idx bigint, x double, y double, z double")


def test_voxel_keys_at_boundaries(spark):
    df = spark.createDataFrame([(-1.0,), (-0.5,), (0.0,), (0.5,), (1.0,)], "x double")
    got = df.select(cells.cell("x", 0.5).alias("f"), cells.truncated_cell("x", 0.5).alias("t")).collect()
    assert [tuple(r) for r in got] == [(-2, -3), (-1, -2), (0, 0), (1, 1), (2, 2)]


def test_knn_is_exact_where_points_are_sparse(spark):
    pts = [(0, 0.0, 0.0, 0.0), (1, 0.1, 0.0, 0.0), (2, 50.0, 0.0, 0.0), (3, 49.0, 0.0, 0.0), (4, 1e4, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "point_idx bigint, x double, y double, z double")
    got = {}
    for r in cells.knn_exact(df, 2, 0.5).collect():
        got.setdefault(r.point_idx, []).append((r["rank"], r.neighbour))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {0: [1, 3], 1: [0, 3], 2: [3, 1], 3: [2, 1], 4: [2, 3]}


def test_iou_is_symmetric_and_matching_is_one_to_one(spark):
    rng = random.Random(3)
    d = spark.createDataFrame([(f, k, rng.randrange(30)) for f in "ab" for k in range(6) for _ in range(12)], "frame string, det int, point int").distinct()
    i = spark.createDataFrame([(k, rng.randrange(30)) for k in range(6) for _ in range(12)], "inst int, point int").distinct()
    m = association.iou_matrix(d, i)
    assert all(0 < r.iou <= 1 for r in m.collect())
    best = association.mutual_best(m, 0.0).collect()
    assert len({(r.frame, r.det) for r in best}) == len({(r.frame, r.inst) for r in best}) == len(best) > 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (7, 8), (9, 9), *[(i, i + 1) for i in range(100, 140)]]
    nodes = spark.createDataFrame([(i,) for i in {x for p in links for x in p} | {50}], "node bigint")
    got = {r.node: r.root for r in graph.components(nodes, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got[3] == 1 and got[8] == 7 and got[9] == 9 and got[50] == 50 and all(got[i] == 100 for i in range(100, 141))


def test_rigid_fit(spark):
    """A turn by 180 degrees is found, a mirrored triple is null."""
    names = [f"{p}{a}{i}" for p in "st" for i in (1, 2, 3) for a in "xy"]
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0, 0.0, 0.0, -1.0), (0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0)], names)
    x, y, yaw = geo.fit_triple([F.col(n) for n in names[:6]], [F.col(n) for n in names[6:]])
    a, b = df.select(x.alias("x"), y.alias("y"), yaw.alias("yaw")).collect()
    assert abs(a.x) < 1e-9 and abs(a.y) < 1e-9 and abs(abs(a.yaw) - math.pi) < 1e-9 and tuple(b) == (None, None, None)


def test_erode_and_dilate(spark):
    g = spark.createDataFrame([(i, j, 3) for i in range(3) for j in range(3)], "gx int, gy int, n int")
    assert [tuple(r) for r in raster.erode(g, 1).collect()] == [(1, 1)]
    assert raster.dilate(g, 1).count() == 25 and raster.dilate(g, 1).agg(F.max("v")).first()[0] == 3.0


def test_bilinear_weights_sum_to_the_points(spark):
    assert abs(raster.bilinear_splat(cloud(spark, 50), 0.7).agg(F.sum("w")).first()[0] - 50) < 1e-9


def test_height_band_falls_back(spark):
    flat = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 1.0)], "point_idx bigint, x double, y double, z double")
    r = raster.height_band(flat).first()
    assert r.floor_z is None and r.low == r.high == 1.0
    assert raster.height_band(flat.limit(0)).count() == 0


def test_nms_ties_and_threshold(spark):
    rows = [(0, 1, 0.9, 0.0, 0.0, 2.0, 2.0), (0, 2, 0.9, 0.0, 0.0, 2.0, 2.0), (0, 3, 0.5, 1.0, 0.0, 3.0, 2.0), (1, 4, 0.1, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "frame int, box_id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.box_id for r in detect.nms(df, 0.5).collect()) == [1, 3, 4]


def test_run_lengths_cover_all(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, None, None, 0, 1])], "k string, p int, v int")
    got = [(r.v, r.start, r.n) for r in detect.run_lengths(df, ["k"], "p", "v").orderBy("start").collect()]
    assert got == [(1, 0, 2), (None, 2, 2), (0, 4, 1), (1, 5, 1)]


def test_asof_edges(spark):
    s = spark.createDataFrame([(1, 100, 1.0), (1, 200, 3.0), (1, 900, 9.0)], "k int, us bigint, x double")
    q = spark.createDataFrame([(1, i, t) for i, t in enumerate([50, 100, 150, 500, 950])] + [(2, 9, 100)], "k int, qid int, us bigint")
    got = {r.qid: r.x for r in temporal.asof_interpolate(q, s, "k", 150).collect()}
    assert got == {0: None, 1: 1.0, 2: 2.0, 3: None, 4: None, 9: None}


def test_segments(spark):
    square = [(1, 100.0, 100.0, 400.0, 100.0), (2, 400.0, 100.0, 400.0, 400.0), (3, 400.0, 400.0, 100.0, 400.0), (4, 100.0, 400.0, 100.0, 100.0), (5, 100.0, 100.0, 400.0, 400.0), (6, 7.0, 7.0, 7.0, 7.0)]
    df = spark.createDataFrame(square, "seg_id bigint, x1 double, y1 double, x2 double, y2 double")
    got = {(round(r.x), round(r.y)) for r in segments.intersections(df, 100.0).collect()}
    assert got == {(100, 100), (400, 100), (400, 400), (100, 400)}
    assert segments.samples(df.filter("seg_id = 6"), 1.0).count() == 2


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int")
    assert [(r.v, r.k) for r in ordering.global_rank(df, ["v"], "k").orderBy("v").collect()] == [(i, i + 1) for i in range(101)]


def test_upsert_and_text_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 4), (3, "d", 1), (1, "e", 2)], old.schema)
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["id"], "version").collect()) == [(1, "e", 2), (2, "b", 5), (3, "d", 1)]
    pts = cloud(spark, 20)
    sinks.write_pcd(pts, f"{tmp_path}/c")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/c").collect())
    with open(f"{tmp_path}/one.pcd", "w") as f:
        f.write(text + "\n")
    spark.dataSource.register(pcd.PcdSource)
    back = spark.read.format("pcd").load(f"{tmp_path}/one.pcd")
    assert back.count() == 20 and abs(back.agg(F.sum("x")).first()[0] - pts.agg(F.sum("x")).first()[0]) < 1e-4
    sinks.write_dxf(spark.createDataFrame([(1, 0.0, 0.0, 1.0, 2.0)], "seg_id bigint, x1 double, y1 double, x2 double, y2 double"), f"{tmp_path}/d")
    dxf = [r.value for r in spark.read.text(f"{tmp_path}/d").collect()]
    assert dxf[0] == "0" and dxf[-1] == "EOF" and "LINE" in dxf and "-2.0000" in dxf


def test_pcd_binary_and_errors():
    import numpy as np

    head = b"VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 4\nHEIGHT 1\nPOINTS 4\nDATA binary\n"
    body = np.array([[1, 2, 3], [np.nan, 0, 0], [4, 5, 6], [7, 8, np.inf]], "<f4").tobytes()
    assert [r[1] for r in pcd.parse_pcd("f", head + body)] == [0, 2]
    with pytest.raises(ValueError):
        list(pcd.parse_pcd("f", head.replace(b"POINTS 4", b"POINTS 2") + body))


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n1,2,3,255,0,128\n\n4 5 6 0 0 0\nnan 1 2 0 0 0\nx y z\n")
    got = pcd.read_xyz(spark, str(tmp_path / "a.txt")).orderBy("x").collect()
    assert [(r.x, r.r) for r in got] == [(1.0, 1.0), (4.0, 0.0)]
    (tmp_path / "d.json").write_text('{"raw_tags": "a", "tags": "chair. table.", "mask": [{"value": 0, "label": "background"}, {"value": 1, "label": "c", "labels": {"chair": 0.5, "seat": 0.25}, "box": [1, 2, 3, 4]}]}')
    assert sorted((r.label, r.det_id, r.u1) for r in detections.read_detections(spark, str(tmp_path / "d.json")).collect()) == [("chair", 1, 3.0), ("seat", 1, 3.0)]
    (tmp_path / "p.json").write_text('{"f1": [' + ",".join(["1"] * 16) + '], "bad": [1]}')
    assert [r.name for r in detections.read_pose_graph(spark, str(tmp_path / "p.json")).collect()] == ["f1"]
    (tmp_path / "l.txt").write_text("header\na b\nx y z\n0.1 0.2 0.7\n0.3 0.3 0.4\n")
    got = {(r.measured, r.predicted): round(r.p, 3) for r in detections.read_likelihood(spark, str(tmp_path / "l.txt")).collect()}
    assert len(got) == 6 and got["b", "z"] == 0.4


def test_stream_of_planes(spark, tmp_path):
    from scenelake.streaming import sync

    src = tmp_path / "in"
    for k in range(3):
        rows = [(0.1 * i, 0.1 * j, 0.5) for i in range(4) for j in range(k + 1)]
        spark.createDataFrame(rows, "x double, y double, z double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("x double, y double, z double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = sync.voxel_planes(stream, 1.0, least=5, most=20).writeStream.format("memory").queryName("planes").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("planes").orderBy(F.desc("n")).first()
    assert last.planar and abs(last.nz) > 0.999 and abs(last.d + 0.5 * last.nz) < 1e-6 and last.n >= 20 and last.frozen


def test_stream_resets(spark, tmp_path):
    from scenelake.streaming import sync

    src = tmp_path / "in"
    spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 0.5), (1, 0.7)], "k int, ts double").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("k int, ts double").parquet(str(src))
    q = sync.with_resets(stream, "k").writeStream.format("memory").queryName("resets").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.run for r in spark.table("resets").collect()] == [0, 0, 1, 1]


def test_scan_samples_batch_semantics(spark):
    from scenelake.streaming import sync

    t = "timestamp '2024-01-01 00:00:0{}'"
    scans = spark.sql(f"select 1 scan_id, 'a' sensor, {t.format(1)} beg, {t.format(2)} end, 5 n union all select 2, 'a', {t.format(3)}, {t.format(4)}, 1")
    samples = spark.sql(" union all ".join(f"select 'a' sensor, {t.format(i)} ts, {i} value" for i in range(6)))
    assert sorted((r.scan_id, r.value) for r in sync.scan_samples(scans, samples).collect()) == [(1, 1), (1, 2)]
