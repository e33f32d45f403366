"""Crossing segments, met block by block."""

import random

import pytest
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.operators import segments

from test_registration import plan


def crosses(a, b):
    ax, ay, bx, by, dx, dy = a[3] - a[1], a[4] - a[2], b[3] - b[1], b[4] - b[2], b[1] - a[1], b[2] - a[2]
    k = ax * by - ay * bx
    if abs(k) > 1e-9 and all(-0.001 <= v / k <= 1.001 for v in (dx * by - dy * bx, dx * ay - dy * ax)):
        t = (dx * by - dy * bx) / k
        return a[1] + t * ax, a[2] + t * ay


@pytest.mark.parametrize("chunk", [7, 512])
@pytest.mark.parametrize("name", [int, "s{:03d}".format])
def test_crossings_are_whole_whatever_the_blocks(spark, monkeypatch, chunk, name):
    monkeypatch.setattr(segments, "CHUNK", chunk)
    monkeypatch.setattr(segments, "TOGETHER", 5)
    rnd = random.Random(5)
    rows = [(name(i), *[rnd.uniform(-2.5, 2.5) for _ in range(4)]) for i in range(120)]
    rows += [rows[7], (name(120), *rows[8][1:]), (name(121), 1.0, 1.0, 1.0, 1.0)]  # a row twice, a copy by another name, a point
    rnd.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 0.0, 0.0, 1.0, 1.0), (name(122), None, 0.0, 1.0, 1.0)], f"seg_id {'int' if name is int else 'string'}, x1 double, y1 double, x2 double, y2 double")
    want = sorted((a[0], b[0], *at) for a in rows for b in rows if a[0] < b[0] and (at := crosses(a, b)))
    assert sorted(map(tuple, segments.intersections(df.repartition(3), 1.0).collect())) == want and len(want) > 1000


def test_no_pair_is_a_row_of_the_join(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 1.0, 1.0, 0.0)], "seg_id int, x1 double, y1 double, x2 double, y2 double")
    text = plan(segments.intersections(df))
    assert text.startswith("MapInArrow") and "seg_id" not in text
    assert segments.intersections(df.filter("seg_id = 3")).collect() == []


def test_rounded(spark):
    rows = [(0.00005, 0.0001), (-0.00005, -0.0001), (1.23456, 1.2346), (-2.0, -2.0), (1e15 + 0.25, 1e15 + 0.25), (None, None)]
    out = spark.createDataFrame(rows, "v double, w double").select(geo.rounded("v", 4).eqNullSafe(F.col("w")).alias("same"))
    assert all(r.same for r in out.collect())
