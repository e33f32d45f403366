"""Voxel maps and LAS files, against brute force on small fixtures."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenelake.operators import voxelmap as op
from scenelake.sources import las

PLANE = "vx int, vy int, vz int, nx double, ny double, nz double, d double, cx double, cy double, cz double, radius double, pvar double, tvar double"


def test_match_prefers_own_cell_then_the_neighbour_leant_to(spark):
    planes = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 1.0, -0.5, 0.5, 0.5, 0.5, 1.0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0, 1.0, -0.3, 1.5, 0.5, 0.3, 1.0, 0.0, 0.0)], PLANE)
    pts = [(1, 0.9, 0.5, 0.5), (2, 0.9, 0.5, 0.3), (3, 0.5, 0.5, 0.3), (4, 9.0, 9.0, 9.0), (5, None, 0.5, 0.5)]
    df = spark.createDataFrame(pts, "point_idx int, x double, y double, z double")
    got = {r.point_idx: (r.vx, round(r.dist, 9)) for r in op.match_planes(df, planes, 1.0, 0.0025).collect()}
    assert got == {1: (0, 0.0), 2: (1, 0.0)}
    far = planes.withColumn("radius", F.lit(0.01))
    assert op.match_planes(df, far, 1.0, 0.0025).count() == 0 == op.match_planes(df, planes.limit(0), 1.0, 0.0025).count()


def test_merged_planes_are_components_across_faces(spark):
    rng = np.random.default_rng(2)
    cells = {tuple(map(int, c)) for c in rng.integers(-2, 3, (60, 3))}
    rows = [(*c, int(rng.integers(2)), *map(float, rng.choice([0.0, 0.05, 0.5], 2)), 0.0, 0.01, 0.01, 0.01) for c in sorted(cells)]
    df = spark.createDataFrame(rows, "vx int, vy int, vz int, main int, a double, b double, d double, va double, vb double, vd double")
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(rows):
        for j, q in enumerate(rows[:i]):
            apart = math.sqrt(sum((p[k] - q[k]) ** 2 / 0.02 for k in (4, 5, 6)))
            if sum(abs(p[k] - q[k]) for k in range(3)) == 1 and p[3] == q[3] and (abs(p[4] - q[4]) < 0.1 and abs(p[5] - q[5]) < 0.1 or apart < 0.004):
                root[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    want = sorted((g[0][3], len(g), round(sum(r[4] for r in g) / len(g), 9)) for g in groups.values())
    got = sorted((r.main, r.n_cells, round(r.a, 9)) for r in op.merge_planes(df).collect())
    assert got == want


def test_ingest_takes_newer_messages_whole(spark):
    at = lambda ts, *n: spark.createDataFrame([(ts, k) for k in n], "ts double, node int")
    nodes = lambda df: sorted(r.node for r in df.collect())
    assert nodes(op.ingest(at(1.0, 1, 2), at(1.02, 3))) == [3]
    assert nodes(op.ingest(at(1.0, 1, 2), at(1.005, 3))) == [1, 2] == nodes(op.ingest(at(1.0, 1, 2), at(2.0)))
    assert nodes(op.ingest(at(1.0), at(0.5, 3))) == [3]


def test_register_lines_finds_a_known_move(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(8):
        t, (x, y), along = rng.uniform(0, math.pi), rng.normal(size=2), rng.normal()
        d, c, s = (math.cos(t), math.sin(t)), math.cos(0.4), math.sin(0.4)
        td = (c * d[0] - s * d[1], s * d[0] + c * d[1])
        rows.append((0, x, y, *d, c * x - s * y + 1.5 + along * td[0], s * x + c * y - 0.7 + along * td[1], *td))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{c} double" for c in "k sx sy sdx sdy tx ty tdx tdy".split()))
    r = op.register_lines(df, "k").first()
    assert np.allclose([r.x, r.y, r.yaw], [1.5, -0.7, 0.4])
    one = op.register_lines(df.limit(1), "k").first()
    assert one.x is None and abs(one.yaw - 0.4) < 1e-9


def test_periodic_and_keys(spark):
    f = spark.createDataFrame([(k, t) for k, ts in ((1, [0, 5, 19, 20, 39, 41, 41]), (2, [7])) for t in ts] + [(1, None)], "inst int, frame int")
    assert sorted((r.inst, r.frame) for r in op.periodic(f, "inst", "frame", 20).collect()) == [(1, 0), (1, 20), (1, 41), (2, 7)]
    m = spark.createDataFrame([(1.0, 2.0), (1.0 + 1e-9, 2.0), (1.0, 2.1)], "a double, b double")
    assert sorted(tuple(r) for r in op.distinct_matches(m, ["a", "b"]).collect()) == [(1.0, 2.0), (1.0, 2.1)]


def test_union_area_counts_overlap_once(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0), (1, 0.0, 0.0, 0.0, 4.0, 4.0, 0.0), (2, 0.0, 0.0, 1.0, 0.0, None, 1.0)], "k int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    got = {r.k: r.area for r in op.union_area(t, "k", 0.05).collect()}
    assert set(got) == {1} and abs(got[1] - 8) < 0.2


def las_file(points, form=2, minor=2, colours=True):
    width = 26 if form == 2 else 20
    head = bytearray(227)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, minor, form
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<HI", head, 105, width, len(points))
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.01, 10.0, 20.0, 30.0)
    body = b"".join(struct.pack("<3i", *p[:3]) + bytes(8) + (struct.pack("<3H", *p[3:]) if form == 2 else b"") for p in points)
    return bytes(head) + body


def test_las(spark, tmp_path):
    pts = [(1000, 2000, 300, 10, 20, 65280), (-1000, 0, 0, 0, 32640, 5)]
    (tmp_path / "a.las").write_bytes(las_file(pts))
    (tmp_path / "b.las").write_bytes(las_file(pts, 0))
    df = las.read_las(spark, str(tmp_path / "*.las"))
    rows = {(r.path[-5:], r.point_idx): r for r in las.unit_colours(df).collect()}
    assert len(rows) == 4
    a = rows["a.las", 0]
    assert np.allclose([a.x, a.y, a.z, a.red, a.blue], [11, 22, 33, 10 / 65280, 1.0]) and abs(rows["a.las", 1].green - 0.5) < 1e-9
    assert rows["b.las", 1].red is None and abs(rows["b.las", 1].x - 9) < 1e-9
    for bad in (b"PK", las_file(pts)[:-1], las_file(pts, 0x82 - 0x80).replace(bytes([2]) + struct.pack("<H", 26), bytes([0x82]) + struct.pack("<H", 26))):
        with pytest.raises(ValueError):
            list(las.las_batches("x", bad))
    assert list(las.las_batches("x", las_file([]))) == []
