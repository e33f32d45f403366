"""Column expressions: transforms, cameras, angles, segments, boxes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int) -> Column:
    """Half away from zero, as SQL's round does on doubles; by arithmetic, as
    ``F.round`` writes each double out as a decimal first."""
    v, unit = col(c), F.lit(10.0**digits)
    whole = F.signum(v) * F.floor(F.abs(v) * unit + 0.5) / unit
    return F.when(F.abs(v) * unit < F.lit(2.0**52), whole).otherwise(v)  # beyond, a double has no such digits


def id_color(i: Column | str) -> list[Column]:
    """Red, green, blue of an id's low 24 bits."""
    return [F.shiftright(col(i), s).bitwiseAND(F.lit(255)).cast("int") for s in (16, 8, 0)]


def camera(pose: Sequence[float], p: Sequence[Column | str] = ("x", "y", "z")) -> list[Column]:
    """World to camera by the inverse of a rigid 4x4 row-major pose, with y and
    z flipped: x, y, depth."""
    d = [col(a) - F.lit(float(pose[4 * i + 3])) for i, a in enumerate(p)]
    local = [sum((d[i] * F.lit(float(pose[4 * i + k])) for i in range(3)), F.lit(0.0)) for k in range(3)]
    return [local[0], -local[1], -local[2]]


def pinhole(x: Column, y: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a camera point, rounded to the nearest."""
    return tuple((v * f / depth + c + 0.5).cast("int") for v, f, c in ((x, fx, cx), (y, fy, cy)))


def in_view(u: Column, v: Column, depth: Column, width: int, height: int, far: float) -> Column:
    return (depth > 0.1) & (depth < far) & (u >= 1) & (u < width - 1) & (v >= 1) & (v < height - 1)


def spherical_flip(points: DataFrame, factor: float = 100.0) -> DataFrame:
    """p + 2 (R - |p|) p / |p| with R = factor * max |p|; the origin stays."""
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    top = points.agg((F.max(n) * factor).alias("_R"))
    k = F.when(n > 0, 1 + 2 * (F.col("_R") - n) / n).otherwise(1.0)
    return points.join(F.broadcast(top)).select("point_idx", *[(F.col(a) * k).alias(a) for a in "xyz"])


def in_obb(p: Sequence[Column | str], centre: Sequence[float], axes: Sequence[Sequence[float]], extent: Sequence[float]) -> Column:
    """Whether a point lies in an oriented box, its faces included."""
    out = F.lit(True)
    for axis, e in zip(axes, extent):
        dot = sum(((col(c) - F.lit(float(o))) * F.lit(float(a)) for c, o, a in zip(p, centre, axis)), F.lit(0.0))
        out = out & (F.abs(dot) <= F.lit(e / 2))
    return out


def length(x1, y1, x2, y2) -> Column:
    return F.sqrt((col(x2) - col(x1)) ** 2 + (col(y2) - col(y1)) ** 2)


def angle180(x1, y1, x2, y2) -> Column:
    """Direction of a segment in degrees, 0 to 180."""
    return F.pmod(F.degrees(F.atan2(col(y2) - col(y1), col(x2) - col(x1))), F.lit(180.0))


def angle_gap(a, b) -> Column:
    """Difference of two directions, 0 to 90."""
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(180.0))
    return F.least(d, 180.0 - d)


def snap(angle, tolerance: float = 15.0) -> Column:
    """H, V or N: a direction within the tolerance of an axis."""
    a = col(angle)
    return F.when((a <= tolerance) | (a >= 180 - tolerance), "H").when(F.abs(a - 90) <= tolerance, "V").otherwise("N")


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    n = dx * dx + dy * dy
    t = F.when(n > 0, ((col(px) - col(x1)) * dx + (col(py) - col(y1)) * dy) / n).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt((col(px) - col(x1) - t * dx) ** 2 + (col(py) - col(y1) - t * dy) ** 2)


def extend(d: float, x1="x1", y1="y1", x2="x2", y2="y2") -> list[Column]:
    """Both ends moved outward by d (inward if negative); a point stays."""
    n = length(x1, y1, x2, y2)
    ux, uy = F.when(n > 0, (col(x2) - col(x1)) / n).otherwise(0.0), F.when(n > 0, (col(y2) - col(y1)) / n).otherwise(0.0)
    return [col(x1) - d * ux, col(y1) - d * uy, col(x2) + d * ux, col(y2) + d * uy]


def rigid2d(x: Column | str, y: Column | str, tx: float, ty: float, yaw: float) -> tuple[Column, Column]:
    c, s = math.cos(yaw), math.sin(yaw)
    return col(x) * c - col(y) * s + tx, col(x) * s + col(y) * c + ty


def fit_triple(s: Sequence[Column], t: Sequence[Column]) -> tuple[Column, Column, Column]:
    """(tx, ty, yaw) that takes three source points to three targets in the
    least-squares sense; nulls where the triple is mirrored. s and t: x1, y1,
    x2, y2, x3, y3."""
    third = F.lit(3.0)
    mean = lambda v, k: (v[k] + v[k + 2] + v[k + 4]) / third
    sx, sy, tx, ty = mean(s, 0), mean(s, 1), mean(t, 0), mean(t, 1)
    dot = sum(((s[k] - sx) * (t[k] - tx) + (s[k + 1] - sy) * (t[k + 1] - ty) for k in (0, 2, 4)), F.lit(0.0))
    cross = sum(((s[k] - sx) * (t[k + 1] - ty) - (s[k + 1] - sy) * (t[k] - tx) for k in (0, 2, 4)), F.lit(0.0))
    turn = lambda v: (v[2] - v[0]) * (v[5] - v[1]) - (v[3] - v[1]) * (v[4] - v[0])
    ok = turn(s) * turn(t) > 0
    yaw = F.atan2(cross, dot)
    x = tx - (F.cos(yaw) * sx - F.sin(yaw) * sy)
    y = ty - (F.sin(yaw) * sx + F.cos(yaw) * sy)
    return F.when(ok, x), F.when(ok, y), F.when(ok, yaw)


def fit_many(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same over any number of pairs (sx, sy, tx, ty) of each key, from
    sums alone; mirrored sets get the nearest rotation."""
    a = {c: F.avg(c) for c in ("sx", "sy", "tx", "ty")}
    n = F.count("*")
    dot = F.sum(F.col("sx") * F.col("tx") + F.col("sy") * F.col("ty")) - n * (a["sx"] * a["tx"] + a["sy"] * a["ty"])
    cross = F.sum(F.col("sx") * F.col("ty") - F.col("sy") * F.col("tx")) - n * (a["sx"] * a["ty"] - a["sy"] * a["tx"])
    m = points.groupBy(*keys).agg(dot.alias("_d"), cross.alias("_c"), *[v.alias(f"_{k}") for k, v in a.items()])
    yaw = F.atan2("_c", "_d")
    return m.select(*keys, (F.col("_tx") - (F.cos(yaw) * F.col("_sx") - F.sin(yaw) * F.col("_sy"))).alias("x"), (F.col("_ty") - (F.sin(yaw) * F.col("_sx") + F.cos(yaw) * F.col("_sy"))).alias("y"), yaw.alias("yaw"))


def circular_mean(angle) -> Column:
    """Aggregate: mean of angles in radians."""
    return F.atan2(F.sum(F.sin(col(angle))), F.sum(F.cos(col(angle))))


def wrap(angle) -> Column:
    """Radians into (-pi, pi]."""
    return F.atan2(F.sin(col(angle)), F.cos(col(angle)))


def to_corners(cx="cx", cy="cy", w="w", h="h") -> list[Column]:
    return [col(cx) - col(w) / 2, col(cy) - col(h) / 2, col(cx) + col(w) / 2, col(cy) + col(h) / 2]


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column]:
    """IoU and generalised IoU of corner boxes."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    union = area(a) + area(b) - inter
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    iou = F.when(union > 0, inter / union).otherwise(0.0)
    return iou, iou - F.when(hull > 0, (hull - union) / hull).otherwise(0.0)


def cosine(a: str, b: str) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def slerp(q0: Sequence[Column], q1: Sequence[Column], t: Column) -> list[Column]:
    """Quaternion interpolation along the shorter arc."""
    dot = sum((a * b for a, b in zip(q0, q1)), F.lit(0.0))
    sign, d = F.when(dot < 0, -1.0).otherwise(1.0), F.least(F.abs(dot), F.lit(1.0))
    a = F.acos(d)
    wa = F.when(d > 0.9995, 1 - t).otherwise(F.sin((1 - t) * a) / F.sin(a))
    wb = F.when(d > 0.9995, t).otherwise(F.sin(t * a) / F.sin(a)) * sign
    out = [wa * x + wb * y for x, y in zip(q0, q1)]
    n = F.sqrt(sum((v * v for v in out), F.lit(0.0)))
    return [v / n for v in out]
