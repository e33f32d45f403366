"""Operators without SQL, against brute force on small fixtures."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from scenelake.operators import cells, detect, frames, image, masks, ordering, segments, shapes, temporal, walls


def cloud(spark, n, seed=1, scale=(3.0, 2.0, 0.4)):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3)) * scale
    return p, spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "point_idx bigint, x double, y double, z double")


def test_plane_fit_equals_eigenvectors(spark):
    p, df = cloud(spark, 600)
    got = shapes.plane_fit(df.withColumn("k", F.col("point_idx") % 4), ["k"], 5, 1.0).collect()
    for r in got:
        q = p[np.arange(len(p)) % 4 == r.k]
        value, vector = np.linalg.eigh(np.cov(q.T, bias=True))
        assert np.allclose([r.l0, r.l1, r.radius**2], value, atol=1e-8)
        assert abs(abs(np.dot(vector[:, 0], [r.nx, r.ny, r.nz])) - 1) < 1e-6 and max((r.nx, r.ny, r.nz), key=abs) > 0
    flat = spark.createDataFrame([(i, float(i % 7), float(i % 5), 1.0) for i in range(35)], df.schema).withColumn("k", F.lit(0))
    r = shapes.plane_fit(flat, ["k"]).first()
    assert r.planar and abs(r.nz - 1) < 1e-6 and abs(r.d + 1) < 1e-6


def test_planarity_uses_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([np.c_[rng.uniform(0, 4, (60, 2)), np.zeros(60)], rng.uniform(6, 9, (40, 3))])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "point_idx bigint, x double, y double, z double")
    got = {r.point_idx for r in shapes.planarity(df, 0.5, 8).collect()}
    want = set()
    for i, a in enumerate(p):
        near = p[np.argsort(((p - a) ** 2).sum(1), kind="stable")[:9]]
        v = np.linalg.eigvalsh(np.cov(near.T, bias=True))
        if v[1] > 1e-12 and v[0] < 0.35 * v[1]:
            want.add(i)
    assert got == want and set(range(60)) <= got


def test_nearest_exact(spark):
    p, df = cloud(spark, 80, 5)
    p = np.concatenate([p, [[500.0, 0, 0], [-900.0, 3, 1]]])
    df = df.union(spark.createDataFrame([(80, 500.0, 0.0, 0.0), (81, -900.0, 3.0, 1.0)], df.schema))
    got = {(r.point_idx, r["rank"]): r.neighbour for r in cells.knn_exact(df, 3, 0.5).collect()}
    for i, a in enumerate(p):
        near = [j for j in np.argsort(((p - a) ** 2).sum(1), kind="stable") if j != i][:3]
        assert [got[i, k] for k in (1, 2, 3)] == near
    assert cells.knn_exact(df.limit(1), 3, 0.5).count() == cells.knn_exact(df.limit(0), 3, 0.5).count() == 0
    assert cells.knn_exact(df.limit(2), 3, 0.5).count() == 2


def test_plans_hold_no_product_and_no_single_window(spark):
    _, df = cloud(spark, 50)
    boxes = spark.createDataFrame([(1, 5, -1.0, 1.0, -1.0, 1.0, -1.0, 1.0)], "instance_id bigint, n bigint, lx double, hx double, ly double, hy double, lz double, hz double")
    from scenelake.operators import association

    labels = df.select(F.col("point_idx").alias("instance_id"), F.lit("a").alias("label"))
    places = df.select(F.col("point_idx").alias("instance_id"), "x", "y", "z", F.lit(9).alias("n"))
    ranked = df.select(F.lit("k").alias("k"), F.col("point_idx").alias("id"), F.col("x").alias("score"), (F.col("point_idx") % 2).alias("positive"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (association.greedy_fill(boxes, df), association.share_label_pairs(labels, places, 5, 1.0), detect.average_precision(ranked, "k"), walls.near_middles(segs(spark, 20), 0.5)):
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
            assert "positive" not in text or "windowspecdefinition(_range" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def segs(spark, n, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, a, d = rng.uniform(0, 6), rng.uniform(0, 6), rng.choice([0, 0.02, math.pi / 2]), rng.uniform(0.3, 2)
        rows.append((i, x, y, x + d * math.cos(a), y + d * math.sin(a)))
    return spark.createDataFrame(rows, "seg_id bigint, x1 double, y1 double, x2 double, y2 double")


def test_first_fit_fits_the_line_anew(spark):
    """Each next segment lies too far off the first one's line, but on the line
    of all before it."""
    rows = [(0, 0.0, 0.0, 10.0, 0.0), (1, 11.0, 0.15, 20.0, 0.15), (2, 21.0, 0.24, 29.0, 0.24), (3, 0.0, 5.0, 4.0, 5.0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "seg_id bigint, x1 double, y1 double, x2 double, y2 double, k int")
    got = {r.seg_id: r.cluster for r in segments.first_fit(df, "k", 5.0, 0.2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
    far = segments.first_fit(df.filter("seg_id <> 1"), "k", 5.0, 0.2)
    assert {r.seg_id: r.cluster for r in far.collect()} == {0: 0, 2: 2, 3: 3}


def test_ransac_finds_a_tilted_plane(spark):
    rng = np.random.default_rng(8)
    flat = np.c_[rng.uniform(-5, 5, (300, 2)), np.zeros(300)]
    flat[:, 2] = 0.2 * flat[:, 0] + 1 + rng.normal(0, 0.01, 300)
    p = np.concatenate([flat, rng.uniform(-5, 5, (100, 3))])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "point_idx bigint, x double, y double, z double")
    r = shapes.ransac_plane(df, 64, 0.1).first()
    n = np.array([-0.2, 0, 1]) / math.sqrt(1.04)
    assert r.inliers >= 290 and np.dot(n, [r.nx, r.ny, r.nz]) > 0.999


def test_thinning_of_thick_walls(spark):
    """A wall over a hundred cells thick is thinned all the way."""
    rows = [(x, y, 1) for x in range(260) for y in range(120)]
    got = {(r.gx, r.gy) for r in shapes.thin(spark.createDataFrame(rows, "gx int, gy int, n int")).collect()}
    assert 0 < len(got) < 400 and all(sum((x + a, y + b) in got for a in (0, 1) for b in (0, 1)) < 4 for x, y in got)


def test_modes_registration_and_samples(spark):
    a = spark.createDataFrame([(float(x),) for x in [10] * 40 + [12] * 20 + [95] * 30], "ang double")
    modes = {r.bin: r["mode"] for r in shapes.mean_shift(a, 5.0, 30).collect()}
    assert abs(modes[10] - modes[12]) < 0.5 and abs(modes[95] - 95.5) < 0.1
    p, df = cloud(spark, 300, 9, (4.0, 4.0, 1.0))
    moved = df.withColumns({"x": F.col("x") * math.cos(0.02) - F.col("y") * math.sin(0.02) + 0.03, "y": F.col("x") * math.sin(0.02) + F.col("y") * math.cos(0.02) - 0.02})
    x, y, yaw = shapes.icp(df.select("point_idx", "x", "y"), moved.select("point_idx", "x", "y"), 0.5, 15)
    assert max(abs(x - 0.03), abs(y + 0.02), abs(yaw - 0.02)) < 0.01


def test_travelled_with_equal_times(spark):
    rows = [(1, 5, 2, 0.0), (1, 5, 1, 10.0), (1, 5, 3, 20.0), (1, 9, 4, 21.0), (1, 10, 5, 40.0)]
    df = spark.createDataFrame(rows, "traj bigint, us bigint, event_id bigint, x double")
    walked = temporal.travelled(df, "traj", ["us", "event_id"], 5.0)
    assert {r.event_id: r.d for r in walked.collect()} == {1: 0.0, 2: 10.0, 3: 30.0, 4: 30.0, 5: 50.0}
    assert {r.event_id: r.end_id for r in temporal.end_frames(walked, "traj", ["us", "event_id"], 30.0).collect()} == {1: 3, 2: 5, 3: -1, 4: -1, 5: -1}


def test_empty_masks_and_quantiles(spark):
    px = spark.createDataFrame([(1, 3, 4), (1, 5, 6)], "m int, u int, v int")
    got = {r.m: (r.u0, r.v1, r.area) for r in detect.mask_box(px, ["m"], spark.createDataFrame([(1,), (2,)], "m int")).collect()}
    assert got == {1: (3, 6, 2), 2: (0, 0, 0)}
    rows = spark.createDataFrame([("a", float(i), i) for i in range(10)] + [("b", 1.0, 77)], "k string, v double, id int")
    assert {(r.k, r.n, r.value) for r in ordering.discrete_quantile(rows, "k", ["v", "id"], 0.9).collect()} == {("a", 10, 8.0), ("b", 1, 1.0)}


def test_frames_and_names(spark):
    names = spark.createDataFrame([("im10.png",), ("im9.png",), ("im009_2.png",), ("a",)], "name string")
    got = [r.name for r in names.orderBy(frames.natural_key("name"), "name").collect()]
    assert got == ["a", "im9.png", "im009_2.png", "im10.png"]
    assert [r[0] for r in spark.createDataFrame([("x/y.z/im1.tar.gz",), ("im",), ("/a/.b",)], "n string").select(frames.stem("n")).collect()] == ["im1.tar", "im", ""]
    a = spark.createDataFrame([("000123456789012345678901234567",), ("5",)], "ts string")
    c = spark.createDataFrame([("123456789012345678901234567", "x"), ("05", "y")], "ts string, v string")
    assert {r.v for r in frames.by_big_integer(a, c, "ts").collect()} == {"x", "y"}
    t = spark.createDataFrame([("a(0.50),b,c(x),d(2)",), ("",)], "t string").select(frames.parse_labels("t").alias("m"))
    assert [r.m for r in t.collect()] == [{"a": 0.5, "d": 2.0}, {}]


def test_merging_follows_chains(spark):
    m = spark.createDataFrame([(i, p) for i, ps in ((1, range(10)), (2, range(5, 15)), (3, range(11, 16)), (9, range(90, 99))) for p in ps], "instance_id bigint, point bigint")
    labels = spark.createDataFrame([(1, "a", 1.0, 1), (3, "a", 2.0, 4), (2, "b", 5.0, 1), (9, "a", 1.0, 1)], "instance_id bigint, label string, score double, n bigint")
    sets, sums = frames.overlap_merge(m, labels, 0.4)
    assert {r.instance_id: r.n for r in sets.groupBy("instance_id").agg(F.count("*").alias("n")).collect()} == {1: 16, 9: 9}
    assert {(r.instance_id, r.label): (r.score, r.n) for r in sums.collect()} == {(1, "a"): (3.0, 5), (1, "b"): (5.0, 1), (9, "a"): (1.0, 1)}


def test_images_against_dense_arrays(spark):
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((20, 20)) < 0.4, rng.integers(1, 9, (20, 20)), 0).astype(float)
    grid = spark.createDataFrame([(int(x), int(y), float(dense[x, y])) for x, y in zip(*np.nonzero(dense))], "gx int, gy int, value double")
    pad = np.pad(dense, 2)
    shifts = lambda p: np.stack([p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)])
    as_dict = lambda df: {(r.gx + 1, r.gy + 1): r.value for r in df.collect() if r.value}
    full = lambda a: {(int(x), int(y)): float(a[x, y]) for x, y in zip(*np.nonzero(a))}
    s = shifts(pad)
    assert as_dict(image.dilate(grid, 1)) == full(s.max(0)) and as_dict(image.erode(grid, 1)) == full(s.min(0))
    assert as_dict(image.median(grid)) == full(np.median(s, axis=0))
    assert as_dict(image.gaussian(grid)) == full(sum(s[i] * w for i, w in enumerate(np.outer([1, 2, 1], [1, 2, 1]).ravel())) / 16)


def test_run_lengths_and_prompts(spark):
    m = spark.createDataFrame([(1, [2, 3, 1, 2]), (2, [0, 4]), (3, [5])], "mask int, counts array<int>")
    assert {r.mask: r.a for r in m.select("mask", masks.rle_area("counts").alias("a")).collect()} == {1: 5, 2: 4, 3: 0}
    assert sorted(tuple(r) for r in masks.rle_decode(m, "mask", "counts").collect()) == [(1, 2), (1, 3), (1, 4), (1, 6), (1, 7), (2, 0), (2, 1), (2, 2), (2, 3)]
    w = spark.createDataFrame([("dining table(0.45)",), ("cup",)], "p string").select(masks.word_scores("p").alias("w")).collect()
    assert [[tuple(x) for x in r.w] for r in w] == [[("dining", 0.45), ("table", 0.45)], [("cup", None)]]
