"""Voxel maps of planes, look-ups by oriented box and frustum, graph tables."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.geometry import in_obb

from .cells import cell, voxel_index
from .graph import components

KEYS = ("vx", "vy", "vz")
FLOORS = ("floor", "carpet", "ceiling")


def packed(keys: Sequence[Column | str] = KEYS) -> Column:
    """One number for a cell within 2^20 cells of the origin on each axis."""
    k = [F.col(c) if isinstance(c, str) else c for c in keys]
    return sum(((k[i].cast("bigint") + (1 << 20)) * (1 << (42 - 21 * i)) for i in range(3)), F.lit(0).cast("bigint"))


def voxels_in_obb(points: DataFrame, size: float, centre: Sequence[float], axes: Sequence[Sequence[float]], extent: Sequence[float]) -> DataFrame:
    """(vx, vy, vz, n) of the cells that have a corner in the oriented box. The
    box's own bounds, widened by a cell, go to the scan as ranges."""
    half = [sum(abs(a[k]) * e / 2 for a, e in zip(axes, extent)) for k in range(3)]
    near = points
    for k, a in enumerate("xyz"):
        near = near.filter(F.col(a).between(centre[k] - half[k] - size, centre[k] + half[k] + size))
    hit = F.lit(False)
    for o in itertools.product((0, 1), repeat=3):
        hit = hit | in_obb([(F.col(k) + i) * F.lit(size) for k, i in zip(KEYS, o)], centre, axes, extent)
    return voxel_index(near, size).filter(hit).select(*KEYS, "n")


def frustum_cells(points: DataFrame, size: float, pose: Sequence[float], fx: float, fy: float, width: int, height: int, near: float, far: float) -> DataFrame:
    """(vx, vy, vz, n) of the cells that a sample of the view meets. Samples
    stand half a cell apart in depth and across; their number follows from the
    view alone, whatever the cloud."""
    step, depths = size / 2, int(np.ceil((far - near) / (size / 2)))
    g = points.sparkSession.range(depths).select((F.lit(near) + F.col("id") * F.lit(step)).alias("z")).filter(F.col("z") < far)
    for a, f, n in (("x", fx, width), ("y", fy, height)):
        span = F.col("z") / F.lit(float(f)) * F.lit(n)
        last = 2 * ((span / F.lit(size)).cast("int") + 1) - 1
        g = g.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_i")).withColumn(a, -span / 2 + F.col("_i") * F.lit(step)).drop("_i")
    world = [sum((F.col(a) * F.lit(float(pose[4 * k + i])) for i, a in enumerate("xyz")), F.lit(0.0)) + F.lit(float(pose[4 * k + 3])) for k in range(3)]
    seen = g.select(*[cell(w, size).alias(k) for w, k in zip(world, KEYS)]).distinct()
    return voxel_index(points, size).join(seen, list(KEYS), "left_semi").select(*KEYS, "n")


def match_planes(points: DataFrame, planes: DataFrame, size: float, variance: float, sigma: float = 3.0, reach: float = 3.0, id_col: str = "point_idx") -> DataFrame:
    """(id, vx, vy, vz, dist, prob): the plane that explains a point best, of
    its own cell or, if none there does, of the one neighbour that it leans to
    by over a quarter on each axis. planes(vx, vy, vz, nx, ny, nz, d, cx, cy,
    cz, radius, pvar, tvar): pvar is the variance of the centre along the
    normal and tvar that of the tilt. A match lies within ``sigma`` deviations
    of the plane and ``reach`` radii of its centre."""
    p = points.select(id_col, "x", "y", "z", *[cell(a, size).alias(k) for a, k in zip("xyz", KEYS)])
    off = [F.col(a) / F.lit(size) - (F.col(k) + F.lit(0.5)) for a, k in zip("xyz", KEYS)]
    lean = [F.when(o > 0.25, 1).when(o < -0.25, -1).otherwise(0) for o in off]
    at = lambda step, keys: F.struct(F.lit(step).alias("step"), *[k.alias(n) for n, k in zip(KEYS, keys)])
    both = F.array(at(0, [F.col(k) for k in KEYS]), at(1, [F.col(k) + o for k, o in zip(KEYS, lean)]))
    tried = p.select(id_col, "x", "y", "z", F.explode(F.array_distinct(both)).alias("_c")).select(id_col, "x", "y", "z", "_c.*")
    met = tried.join(planes, list(KEYS))
    dist = F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d"))
    met = met.withColumn("dist", dist).withColumn("_r2", F.greatest(F.lit(0.0), sum(((F.col(a) - F.col(f"c{a}")) ** 2 for a in "xyz"), F.lit(0.0)) - F.col("dist") ** 2))
    met = met.withColumn("_s", F.lit(variance) + F.col("pvar") + F.col("tvar") * F.col("_r2"))
    good = met.filter((F.sqrt("_r2") <= reach * F.col("radius")) & (F.col("dist") < sigma * F.sqrt("_s")))
    good = good.withColumn("prob", F.exp(-0.5 * F.col("dist") ** 2 / F.col("_s")) / F.sqrt("_s"))
    best = F.min_by(F.struct(*KEYS, "dist", "prob"), F.struct("step", -F.col("prob")))
    return good.groupBy(id_col).agg(best.alias("b")).select(id_col, "b.*")


def merge_planes(planes: DataFrame, slope: float = 0.1, apart: float = 0.004) -> DataFrame:
    """(root, main, n_cells, a, b, d) of planes(vx, vy, vz, main, a, b, d, va,
    vb, vd) joined across cell faces: same main axis and either both slopes
    within ``slope`` or a Mahalanobis distance under ``apart``. A component's
    plane weighs its cells by the inverse size of their variance, so the order
    of the merges doesn't matter."""
    p = planes.withColumn("node", packed())
    faces = F.explode(F.array(*[F.struct(*[F.lit(int(i == k)).alias(n) for i, n in enumerate(KEYS)]) for k in range(3)])).alias("_o")
    values = ("main", "a", "b", "d", "va", "vb", "vd")
    left = p.select("node", *[F.col(c).alias(f"_{c}") for c in values], *KEYS, faces).select("node", *[f"_{c}" for c in values], *[(F.col(k) + F.col("_o")[k]).alias(k) for k in KEYS])
    met = left.join(p.withColumnRenamed("node", "other"), list(KEYS)).filter("_main = main")
    far = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 / (F.col(f"v{c}") + F.col(f"_v{c}")) for c in "abd"), F.lit(0.0)))
    flat = (F.abs(F.col("a") - F.col("_a")) < slope) & (F.abs(F.col("b") - F.col("_b")) < slope)
    root = components(p.select("node"), met.filter(flat | (far < apart)).select(F.col("node").alias("a"), F.col("other").alias("b")))
    w = 1 / F.sqrt(F.col("va") ** 2 + F.col("vb") ** 2 + F.col("vd") ** 2)
    all_ = p.join(root, "node").withColumn("_w", w)
    return all_.groupBy("root", "main").agg(F.count("*").alias("n_cells"), *[(F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in "abd"])


def large_clusters(clusters: DataFrame, least: int, key: str = "cluster") -> DataFrame:
    """Rows of the clusters of at least ``least`` rows."""
    big = clusters.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(key)
    return clusters.join(big, key, "left_semi")


def confident(boxes: DataFrame, tokens: str, score: float, token: float) -> DataFrame:
    """Boxes over the score, with the places of their tokens over theirs."""
    over = F.filter(F.transform(F.col(tokens), lambda v, i: F.when(v > token, i)), lambda i: i.isNotNull())
    return boxes.filter(F.col("score") > score).withColumn(tokens, over)


def node_matches(matches: DataFrame, src: DataFrame, ref: DataFrame) -> DataFrame:
    """matches(src, ref) with instance and centroid of both nodes(node,
    instance, x, y, z); a match of a node that isn't there is skipped."""
    side = lambda n, t: t.select(F.col("node").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("instance", "x", "y", "z")])
    return matches.join(side("src", src), "src").join(side("ref", ref), "ref")


def union_area(triangles: DataFrame, key: str, size: float) -> DataFrame:
    """(key, area): cells whose centre some triangle(key, x1, y1, .. y3) covers,
    counted once. The work follows the triangles' bounds, not their pairs."""
    lo, hi = {a: F.least(*[f"{a}{k}" for k in (1, 2, 3)]) for a in "xy"}, {a: F.greatest(*[f"{a}{k}" for k in (1, 2, 3)]) for a in "xy"}
    t = triangles.filter(" and ".join(f"{a}{k} is not null" for a in "xy" for k in (1, 2, 3)))
    t = t.select(key, *[f"{a}{k}" for k in (1, 2, 3) for a in "xy"], F.explode(F.sequence(cell(lo["x"], size), cell(hi["x"], size))).alias("gx"), cell(lo["y"], size).alias("_a"), cell(hi["y"], size).alias("_b"))
    t = t.select("*", F.explode(F.sequence("_a", "_b")).alias("gy"))
    x, y = (F.col("gx") + F.lit(0.5)) * F.lit(size), (F.col("gy") + F.lit(0.5)) * F.lit(size)
    side = lambda i, j: (F.col(f"x{j}") - F.col(f"x{i}")) * (y - F.col(f"y{i}")) - (F.col(f"y{j}") - F.col(f"y{i}")) * (x - F.col(f"x{i}"))
    s = [side(1, 2), side(2, 3), side(3, 1)]
    inside = ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))
    return t.filter(inside).select(key, "gx", "gy").distinct().groupBy(key).agg((F.count("*") * F.lit(size * size)).alias("area"))


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def distinct_matches(rows: DataFrame, columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """One row, the least, of those alike in all columns on the tolerance's grid."""
    grid = [F.floor(F.col(c) / tolerance + 0.5).alias(f"_g{k}") for k, c in enumerate(columns)]
    return rows.groupBy(*grid).agg(F.min(F.struct(*columns)).alias("_r")).select("_r.*")


def periodic(frames: DataFrame, key: str, frame: str, gap: int) -> DataFrame:
    """(key, frame) of updates: the first frame, then the first at least ``gap``
    after the last update. A group is one instance's distinct frame numbers."""
    kind = frames.schema[key].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        t, at, kept = np.sort(f[frame].to_numpy()), 0, []
        while at < len(t):
            kept.append(int(t[at]))
            at = int(np.searchsorted(t, t[at] + gap))
        return pd.DataFrame({key: [f[key].iloc[0]] * len(kept), frame: kept})

    clean = frames.select(key, F.col(frame).cast("bigint").alias(frame)).dropna().distinct()
    return clean.groupBy(key).applyInPandas(run, f"{key} {kind}, {frame} bigint")


def floor_instances(instances: DataFrame) -> DataFrame:
    """(label, instance_id) of floors, carpets and ceilings: the dictionary that
    queries by label filter."""
    return instances.filter(F.col("label").isin(*FLOORS)).select("label", "instance_id")


def ingest(current: DataFrame, update: DataFrame, newer: float = 0.01) -> DataFrame:
    """The update's nodes(ts, ..) if its time is over ``newer`` past the current
    one's, all replaced; else the current nodes. Times are one-row aggregates."""
    now, new = current.agg(F.max("ts").alias("_now")), update.agg(F.max("ts").alias("_new"))
    take = F.col("_new").isNotNull() & (F.col("_now").isNull() | (F.col("_new") - F.col("_now") > newer))
    choice = now.crossJoin(new).select(F.coalesce(take, F.lit(False)).alias("_take"))
    both = update.withColumn("_of", F.lit(True)).unionByName(current.withColumn("_of", F.lit(False)))
    return both.join(F.broadcast(choice), F.col("_of") == F.col("_take")).drop("_of", "_take")


def dense_points(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """points(node, x, y, z) of known nodes, with the node's instance."""
    return points.join(nodes.select("node", "instance"), "node").select("node", "instance", "x", "y", "z")


def register_lines(pairs: DataFrame, key: str) -> DataFrame:
    """(key, x, y, yaw) that takes lines s onto lines t: pairs(key, sx, sy, sdx,
    sdy, tx, ty, tdx, tdy) of a point and unit direction each. The turn comes
    from the directions, the shift from least squares across the target lines;
    both are sums. Null shift where all lines are parallel."""
    turn = pairs.groupBy(key).agg(F.atan2(F.sum(F.expr("sdx*tdy - sdy*tdx")), F.sum(F.expr("sdx*tdx + sdy*tdy"))).alias("yaw"))
    p = pairs.join(turn, key).withColumns({"_x": F.expr("cos(yaw)*sx - sin(yaw)*sy - tx"), "_y": F.expr("sin(yaw)*sx + cos(yaw)*sy - ty")})
    xx, xy, yy = "1 - tdx*tdx", "-tdx*tdy", "1 - tdy*tdy"
    m = p.groupBy(key, "yaw").agg(*[F.sum(F.expr(e)).alias(n) for e, n in ((xx, "_a"), (xy, "_b"), (yy, "_c"), (f"-(({xx})*_x + ({xy})*_y)", "_p"), (f"-(({xy})*_x + ({yy})*_y)", "_q"))])
    det = "(_a*_c - _b*_b)"
    return m.select(key, F.expr(f"case when abs{det} > 1e-12 then (_p*_c - _q*_b)/{det} end").alias("x"), F.expr(f"case when abs{det} > 1e-12 then (_q*_a - _p*_b)/{det} end").alias("y"), "yaw")


def free_cells(points: DataFrame, size: float = 0.3, top: float = 0.01) -> DataFrame:
    """Mean of each cell of the ground, below ``top``."""
    g = points.groupBy(*[cell(a, size).alias(k) for a, k in zip("xyz", KEYS)]).agg(*[F.avg(a).alias(a) for a in "xyz"])
    return g.filter(F.col("z") < top)


def rest_state(samples: DataFrame, key: str, gravity: float = 9.81) -> DataFrame:
    """Gravity and gyro bias of each sensor at rest from samples(key, ax, ay,
    az, wx, wy, wz): means, the mean acceleration scaled and turned about."""
    m = samples.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("ax", "ay", "az", "wx", "wy", "wz")])
    n = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)
    return m.select(key, "n", *[F.when(n > 0, -F.col(f"a{a}") / n * gravity).alias(f"g{a}") for a in "xyz"], "wx", "wy", "wz")


def propagated(samples: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """samples(keys, t, acc, rate) with speed, way and heading since the first
    of their scan: each sample holds until the next. One window a scan."""
    w = Window.partitionBy(*keys).orderBy(*order)
    dt = F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0.0))
    s = samples.withColumns({"_dt": dt, "_a": F.coalesce(F.lag("acc").over(w), F.lit(0.0)), "_w": F.coalesce(F.lag("rate").over(w), F.lit(0.0))})
    s = s.withColumns({"speed": F.sum(F.col("_a") * F.col("_dt")).over(w), "heading": F.sum(F.col("_w") * F.col("_dt")).over(w)})
    before = F.coalesce(F.lag("speed").over(w), F.lit(0.0))
    s = s.withColumn("_s", before * F.col("_dt") + 0.5 * F.col("_a") * F.col("_dt") ** 2)
    return s.withColumn("way", F.sum("_s").over(w)).drop("_dt", "_a", "_w", "_s")
