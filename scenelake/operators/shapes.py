"""Planes, boxes, rays, skeletons and iterative fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import cell, knn_exact, radius_pairs


def moments(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, centre and covariance of each key: sums alone, combined map-side."""
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], *[F.covar_pop(p[0], p[1]).alias(p) for p in pairs])


def eigen(xx: str, xy: str, xz: str, yy: str, yz: str, zz: str) -> Column:
    """Struct (nx, ny, nz, l0, l1, l2) of a symmetric 3 x 3: eigenvalues in
    ascending order by the angle of its characteristic cubic, and the least
    one's direction, with its greatest component positive."""
    a, b, c, d, e, f = (F.col(k) for k in (xx, xy, xz, yy, yz, zz))
    mean = (a + d + f) / 3
    p = F.sqrt(((a - mean) ** 2 + (d - mean) ** 2 + (f - mean) ** 2 + 2 * (b * b + c * c + e * e)) / 6)
    u, v, w = a - mean, d - mean, f - mean
    det = u * (v * w - e * e) - b * (b * w - e * c) + c * (b * e - v * c)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(p > 0, det / (2 * p * p * p)).otherwise(0.0)))
    phi = F.acos(r) / 3
    top, low = mean + 2 * p * F.cos(phi), mean + 2 * p * F.cos(phi + 2 * math.pi / 3)
    zero = F.lit(0.0)
    values = F.greatest(zero, low), F.greatest(zero, 3 * mean - top - low), F.greatest(zero, top)
    rows = ((a - low, b, c), (b, d - low, e), (c, e, f - low))
    crosses = [[x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]] for x, y in ((rows[0], rows[1]), (rows[0], rows[2]), (rows[1], rows[2]))]
    best = F.array_max(F.array(*[F.struct((k[0] * k[0] + k[1] * k[1] + k[2] * k[2]).alias("n"), *[x.alias(s) for x, s in zip(k, "xyz")]) for k in crosses]))
    return F.transform(F.array(best), lambda k: _signed(k, values))[0]


def _signed(k: Column, values: tuple[Column, ...]) -> Column:
    n = F.sqrt(k["n"])
    x = [F.when(n > 0, k[s] / n).otherwise(1.0 if s == "z" else 0.0) for s in "xyz"]
    most = F.greatest(*[F.abs(v) for v in x])
    sign = F.when(F.abs(x[2]) >= most - 1e-12, F.signum(x[2])).when(F.abs(x[1]) >= most - 1e-12, F.signum(x[1])).otherwise(F.signum(x[0]))
    return F.struct(*[(v * sign).alias(f"n{s}") for v, s in zip(x, "xyz")], *[v.alias(f"l{i}") for i, v in enumerate(values)])


def plane_fit(points: DataFrame, keys: Sequence[str], least: int = 5, flat: float = 0.01) -> DataFrame:
    """Plane of each key: normal, offset, radius and whether it is flat."""
    m = moments(points, keys).filter(F.col("n") >= least).withColumn("e", eigen("xx", "xy", "xz", "yy", "yz", "zz"))
    d = -(F.col("e.nx") * F.col("cx") + F.col("e.ny") * F.col("cy") + F.col("e.nz") * F.col("cz"))
    return m.select(*keys, "n", "cx", "cy", "cz", "e.nx", "e.ny", "e.nz", d.alias("d"), F.sqrt("e.l2").alias("radius"), F.col("e.l0").alias("l0"), F.col("e.l1").alias("l1"), (F.col("e.l0") < flat).alias("planar"))


def planarity(points: DataFrame, radius: float, least: int, ratio: float = 0.35, id_col: str = "point_idx") -> DataFrame:
    """Points whose least eigenvalue over their ``least`` nearest others and
    themselves is under ``ratio`` of the next; radius: where the search begins."""
    near = knn_exact(points, least, radius, id_col).select(F.col(id_col), F.col("neighbour").alias("_j")).union(points.select(id_col, F.col(id_col).alias("_j")))
    around = near.join(points.select(F.col(id_col).alias("_j"), "x", "y", "z"), "_j")
    p = plane_fit(around, [id_col], least, math.inf)
    return p.filter((F.col("l1") > 0) & (F.col("l0") < ratio * F.col("l1"))).select(id_col)


def ransac_plane(points: DataFrame, hypotheses: int, distance: float, seed: int = 7, tilt: float = 20.0) -> DataFrame:
    """One row: the best of a fixed number of seeded planes near the
    horizontal. Triples come from the least hashes, so a run repeats; their
    number is bounded, and inliers are counted by one pass of the points."""
    pool = points.orderBy(F.xxhash64("point_idx", F.lit(seed)), "point_idx").limit(3 * hypotheses).collect()
    rows = []
    for k in range(len(pool) // 3):
        a, b, c = (np.array([r.x, r.y, r.z]) for r in pool[3 * k : 3 * k + 3])
        n = np.cross(b - a, c - a)
        if np.linalg.norm(n) > 1e-9:
            n = n / np.linalg.norm(n)
            n = n if n[2] > 0 else -n
            if n[2] >= math.cos(math.radians(tilt)):
                rows.append((k, *map(float, n), float(-n @ a)))
    spark = points.sparkSession
    h = spark.createDataFrame(rows, "k int, nx double, ny double, nz double, d double")
    off = F.abs(F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz") + F.col("d"))
    n = points.join(F.broadcast(h)).filter(off <= distance).groupBy("k", "nx", "ny", "nz", "d").agg(F.count("*").alias("inliers"))
    return n.orderBy(F.desc("inliers"), "k").limit(1)


def yaw_box(points: DataFrame, key: str, steps: int = 90) -> DataFrame:
    """(key, yaw, cx, cy, ex, ey, ez): the turn about z, in whole steps of a
    quarter, with the least area; extents are aggregates for each turn."""
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.cos(math.pi / 2 * k / steps)).alias("c"), F.lit(math.sin(math.pi / 2 * k / steps)).alias("s")) for k in range(steps)])).alias("t")
    p = points.select(key, "x", "y", "z", turns)
    u, v = F.col("x") * F.col("t.c") + F.col("y") * F.col("t.s"), -F.col("x") * F.col("t.s") + F.col("y") * F.col("t.c")
    e = p.groupBy(key, F.col("t.k").alias("k")).agg(*[f(w).alias(f"{n}{a}") for a, w in (("u", u), ("v", v), ("z", F.col("z"))) for n, f in (("lo", F.min), ("hi", F.max))])
    area = (F.col("hiu") - F.col("lou")) * (F.col("hiv") - F.col("lov"))
    best = e.groupBy(key).agg(F.min_by(F.struct("k", "lou", "hiu", "lov", "hiv", "loz", "hiz"), F.struct(F.round(area, 9), F.col("k"))).alias("b"))
    yaw = F.col("b.k") * (math.pi / 2 / steps)
    mu, mv = (F.col("b.lou") + F.col("b.hiu")) / 2, (F.col("b.lov") + F.col("b.hiv")) / 2
    return best.select(key, yaw.alias("yaw"), (mu * F.cos(yaw) - mv * F.sin(yaw)).alias("cx"), (mu * F.sin(yaw) + mv * F.cos(yaw)).alias("cy"), (F.col("b.hiu") - F.col("b.lou")).alias("ex"), (F.col("b.hiv") - F.col("b.lov")).alias("ey"), (F.col("b.hiz") - F.col("b.loz")).alias("ez"))


def ray_cells(rays: DataFrame, size: float, steps: int, dense: DataFrame | None = None) -> DataFrame:
    """(ray_id, step, vx, vy, vz) of the cells that rays(ray_id, ox, oy, oz,
    dx, dy, dz) sample each half cell, up to the first dense cell."""
    k = rays.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    at = [cell(F.col(f"o{a}") + F.col(f"d{a}") * (F.col("step") * (size / 2)), size).alias(f"v{a}") for a in "xyz"]
    met = k.select("ray_id", "step", *at).groupBy("ray_id", "vx", "vy", "vz").agg(F.min("step").alias("step"))
    if dense is None:
        return met
    stop = met.join(dense.select("vx", "vy", "vz"), ["vx", "vy", "vz"], "left_semi").groupBy("ray_id").agg(F.min("step").alias("_stop"))
    return met.join(stop, "ray_id", "left").filter(F.col("_stop").isNull() | (F.col("step") <= F.col("_stop"))).drop("_stop")


def line_cells(segments: DataFrame, size: float) -> DataFrame:
    """(seg_id, gx, gy): cells along each segment, one step of the longer axis
    at a time."""
    g = [F.floor(F.col(c) / size + 0.5).cast("int").alias(n) for c, n in (("x1", "a"), ("y1", "b"), ("x2", "c"), ("y2", "d"))]
    s = segments.select("seg_id", *g).withColumn("n", F.greatest(F.abs(F.col("c") - F.col("a")), F.abs(F.col("d") - F.col("b"))))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    along = lambda p, q: F.when(F.col("n") > 0, F.floor(F.col(p) + (F.col(q) - F.col(p)) * F.col("k") / F.col("n") + 0.5)).otherwise(F.col(p)).cast("int")
    return s.select("seg_id", along("a", "c").alias("gx"), along("b", "d").alias("gy")).distinct()


def grid_components(grid: DataFrame) -> DataFrame:
    """(gx, gy, root) of 8-connected cells; a cell's node packs its place."""
    from .graph import components

    node = lambda x, y: x.cast("bigint") * 2**32 + y.cast("bigint") + 2**31
    c = grid.select("gx", "gy").distinct()
    ahead = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("o")
    there = c.select(node(F.col("gx"), F.col("gy")).alias("a"), (F.col("gx") + F.lit(0)).alias("gx"), F.col("gy"), ahead)
    there = there.select("a", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"))
    links = there.join(c, ["gx", "gy"], "left_semi").select("a", node(F.col("gx"), F.col("gy")).alias("b"))
    named = c.withColumn("node", node(F.col("gx"), F.col("gy")))
    return named.join(components(named.select("node"), links), "node").select("gx", "gy", "root")


def component_filter(grid: DataFrame, area: int, aspect: float) -> DataFrame:
    """Cells of components that are large or elongated enough."""
    c = grid_components(grid)
    w, h = F.max("gx") - F.min("gx") + 1, F.max("gy") - F.min("gy") + 1
    keep = c.groupBy("root").agg(F.count("*").alias("n"), (F.greatest(w, h) / F.least(w, h)).alias("aspect")).filter((F.col("n") >= area) | (F.col("aspect") >= aspect))
    return c.join(keep.select("root"), "root", "left_semi").select("gx", "gy", "root")


def sobel(grid: DataFrame, value: str) -> DataFrame:
    """(gx, gy, mag, horizontal): gradient of a sparse image, absent cells 0."""
    w = {(a, b): (a * (2 if b == 0 else 1), b * (2 if a == 0 else 1)) for a in (-1, 0, 1) for b in (-1, 0, 1)}
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(x).alias("wx"), F.lit(y).alias("wy")) for (a, b), (x, y) in w.items()])).alias("o")
    s = grid.select("gx", "gy", F.col(value).alias("_v"), o).select((F.col("gx") - F.col("o.a")).alias("gx"), (F.col("gy") - F.col("o.b")).alias("gy"), (F.col("_v") * F.col("o.wx")).alias("x"), (F.col("_v") * F.col("o.wy")).alias("y"))
    g = s.groupBy("gx", "gy").agg(F.abs(F.sum("x")).alias("x"), F.abs(F.sum("y")).alias("y"))
    return g.select("gx", "gy", (F.col("x") + F.col("y")).cast("bigint").alias("mag"), (F.col("y") >= F.col("x")).alias("horizontal")).filter("mag > 0")


def mean_shift(angles: DataFrame, bandwidth: float, rounds: int, bins: int = 180) -> DataFrame:
    """(bin, mode): directions in bins of the half turn move to the weighted
    mean of their surroundings. Bins bound the work, whatever the rows."""
    w = angles.select(F.pmod(F.floor(F.col("ang") * (bins / 180.0)).cast("int"), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    hist = {r.bin: r.n for r in w.collect()}  # at most ``bins`` rows
    at = {b: (b + 0.5) * 180 / bins for b in hist}
    where = np.array([(b + 0.5) * 180 / bins for b in hist])
    mass = np.array([float(hist[b]) for b in hist])
    for _ in range(rounds):
        for b in at:
            d = (where - at[b] + 90) % 180 - 90
            k = mass * np.exp(-d * d / (2 * bandwidth * bandwidth))
            at[b] = float((at[b] + (k @ d) / k.sum()) % 180)
    return angles.sparkSession.createDataFrame([(int(b), round(m, 4)) for b, m in sorted(at.items())], "bin int, mode double")


def icp_step(source: DataFrame, target: DataFrame, radius: float) -> DataFrame:
    """One row (x, y, yaw, n, error): the plane motion that best lays source
    points on their nearest targets within the radius."""
    pairs = radius_pairs(source, target.withColumnRenamed("point_idx", "t_idx"), radius, "point_idx", "t_idx", "xy")
    near = pairs.groupBy("point_idx").agg(F.min_by("t_idx", F.struct("d2", "t_idx")).alias("t_idx"), F.min("d2").alias("d2"))
    m = near.join(source.select("point_idx", F.col("x").alias("sx"), F.col("y").alias("sy")), "point_idx").join(target.select(F.col("point_idx").alias("t_idx"), F.col("x").alias("tx"), F.col("y").alias("ty")), "t_idx")
    n = F.count("*")
    a = {c: F.avg(c) for c in ("sx", "sy", "tx", "ty")}
    dot = F.sum(F.col("sx") * F.col("tx") + F.col("sy") * F.col("ty")) - n * (a["sx"] * a["tx"] + a["sy"] * a["ty"])
    cross = F.sum(F.col("sx") * F.col("ty") - F.col("sy") * F.col("tx")) - n * (a["sx"] * a["ty"] - a["sy"] * a["tx"])
    s = m.agg(dot.alias("d"), cross.alias("c"), *[v.alias(k) for k, v in a.items()], n.alias("n"), F.sqrt(F.avg("d2")).alias("error"))
    yaw = F.atan2("c", "d")
    return s.select((F.col("tx") - (F.cos(yaw) * F.col("sx") - F.sin(yaw) * F.col("sy"))).alias("x"), (F.col("ty") - (F.sin(yaw) * F.col("sx") + F.cos(yaw) * F.col("sy"))).alias("y"), yaw.alias("yaw"), "n", "error")


def icp(source: DataFrame, target: DataFrame, radius: float, rounds: int = 10, least: float = 1e-6) -> tuple[float, float, float]:
    """(x, y, yaw) by repeated steps. A step is one distributed join; only
    three numbers come back."""
    x = y = yaw = 0.0
    for _ in range(rounds):
        c, s = math.cos(yaw), math.sin(yaw)
        moved = source.withColumns({"x": F.col("x") * c - F.col("y") * s + x, "y": F.col("x") * s + F.col("y") * c + y})
        r = icp_step(moved, target, radius).first()
        if not r.n:
            break
        c, s = math.cos(r.yaw), math.sin(r.yaw)
        x, y, yaw = c * x - s * y + r.x, s * x + c * y + r.y, yaw + r.yaw
        if abs(r.x) + abs(r.y) + abs(r.yaw) < least:
            break
    return x, y, yaw


def entropy(points: DataFrame, radius: float, epsilon: float = 1e-6) -> DataFrame:
    """One row: mean differential entropy of the points' neighbourhoods."""
    near = radius_pairs(points, points, radius, "point_idx", "point_idx").select("point_idx", F.col("point_idx_2").alias("_j"))
    m = moments(near.join(points.select(F.col("point_idx").alias("_j"), "x", "y", "z"), "_j"), ["point_idx"])
    det = F.col("xx") * (F.col("yy") * F.col("zz") - F.col("yz") * F.col("yz")) - F.col("xy") * (F.col("xy") * F.col("zz") - F.col("yz") * F.col("xz")) + F.col("xz") * (F.col("xy") * F.col("yz") - F.col("yy") * F.col("xz"))
    return m.agg(F.avg(0.5 * F.log(F.lit(2 * math.pi * math.e) * F.greatest(det, F.lit(0.0)) + epsilon)).alias("entropy"))


def thin(grid: DataFrame) -> DataFrame:
    """Skeleton of each 8-connected component by alternating deletion passes,
    until one changes nothing.
    A component is thinned in one task; pages of plans are split into
    components first, which bounds a task by the largest wall network."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        on = set(zip(g.gx, g.gy))
        ring = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
        changed = True
        while changed:
            changed = False
            for odd in (0, 1):
                gone = []
                for x, y in on:
                    p = [(x + a, y + b) in on for a, b in ring]
                    if 2 <= sum(p) <= 6 and sum(not p[k] and p[(k + 1) % 8] for k in range(8)) == 1:
                        n, e, s, w = p[0], p[2], p[4], p[6]
                        if not (n and e and s if not odd else n and e and w) and not (e and s and w if not odd else n and s and w):
                            gone.append((x, y))
                on -= set(gone)
                changed |= bool(gone)
        return pd.DataFrame(sorted(on), columns=["gx", "gy"])

    return grid_components(grid).groupBy("root").applyInPandas(run, "gx int, gy int")


def pack_blocks(counts: DataFrame, most: int) -> DataFrame:
    """(vx, vy, vz, block): voxels in spatial order dealt into blocks of about
    ``most`` points by the running count."""
    from .ordering import running_sum

    r = running_sum(counts, ["vx", "vy", "vz"], "n", "_before")
    return r.select("vx", "vy", "vz", "n", F.floor(F.col("_before") / most).cast("int").alias("block"))


def accepted(expr: Column, rows: DataFrame) -> DataFrame:
    """rows where expr is true, or all of them where it is true of none."""
    hit = rows.filter(expr)
    any_ = hit.limit(1).agg(F.count("*").alias("_any"))
    return rows.join(F.broadcast(any_)).filter(expr | (F.col("_any") == 0)).drop("_any")


def ground_steps(points: DataFrame, degrees: float) -> DataFrame:
    """Points whose slope from the ring below in their column is at most the
    limit: points(col, ring, x, y, z, point_idx)."""
    w = Window.partitionBy("col").orderBy("ring", "point_idx")
    flat = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    slope = F.degrees(F.atan2(F.abs(F.col("z") - F.lag("z").over(w)), flat))
    return points.withColumn("_s", slope).filter(F.col("_s") <= degrees).drop("_s")
