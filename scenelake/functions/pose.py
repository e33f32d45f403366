"""Column expressions: rotations, rigid transforms, planes, sensor models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import col

Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: Vector) -> list[Column]:
    """The vector at length one; a zero vector stays."""
    n = F.sqrt(dot(a, a))
    return [F.when(n > 0, x / n).otherwise(F.lit(0.0)) for x in a]


def vector(names: str | Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


def turned(p: Vector, axis: Vector, c: Column, s: Column) -> list[Column]:
    """p about a unit axis by the angle of cosine c and sine s."""
    k, d = cross(axis, p), dot(axis, p)
    return [x * c + y * s + a * d * (1 - c) for x, y, a in zip(p, k, axis)]


def axis_angle(p: Vector, w: Vector) -> list[Column]:
    """p turned by a rotation vector, whose length is the angle."""
    n = F.sqrt(dot(w, w))
    return turned(p, unit(w), F.cos(n), F.sin(n))


def from_to(p: Vector, a: Vector, b: Vector) -> list[Column]:
    """p under the least rotation that takes unit vector a to unit vector b; if
    they are opposite, half a turn about an axis across a."""
    axis, c = cross(a, b), dot(a, b)
    s = F.sqrt(dot(axis, axis))
    x, y = F.lit(1.0), F.lit(0.0)
    across = unit(cross(a, [F.when(F.abs(a[0]) < 0.9, x).otherwise(y), F.when(F.abs(a[0]) < 0.9, y).otherwise(x), y]))
    some, half = turned(p, unit(axis), c, s), turned(p, across, F.lit(-1.0), F.lit(0.0))
    return [F.when(s > 1e-9, u).when(c > 0, q).otherwise(v) for u, v, q in zip(some, half, p)]


def to_up(p: Vector, normal: Vector) -> list[Column]:
    """p under the rotation that takes a normal to +z."""
    return from_to(p, unit(normal), [F.lit(0.0), F.lit(0.0), F.lit(1.0)])


def rotation_vector(m: Sequence[Column]) -> list[Column]:
    """Rotation vector of a row-major 3 x 3 rotation by less than half a turn."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[4] + m[8] - 1) / 2))
    angle = F.acos(c)
    k = F.when(angle > 1e-9, angle / (2 * F.sin(angle))).otherwise(0.5)
    return [(m[7] - m[5]) * k, (m[2] - m[6]) * k, (m[3] - m[1]) * k]


def yaw_matrix(yaw: Column) -> list[Column]:
    z, o = F.lit(0.0), F.lit(1.0)
    return [F.cos(yaw), -F.sin(yaw), z, F.sin(yaw), F.cos(yaw), z, z, z, o]


def se3(x: Column, y: Column, yaw: Column) -> list[Column]:
    """Row-major 4 x 4 of a pose in the plane."""
    m, z, o = yaw_matrix(yaw), F.lit(0.0), F.lit(1.0)
    return [*m[:3], x, *m[3:6], y, *m[6:], z, z, z, z, o]


def se2(m: Sequence[Column]) -> tuple[Column, Column, Column]:
    """x, y, yaw of a row-major 4 x 4."""
    return m[3], m[7], F.atan2(m[4], m[0])


def rigid3d(p: Vector, m: Sequence[Column | float]) -> list[Column]:
    """p under a row-major 4 x 4."""
    m = [v if isinstance(v, Column) else F.lit(float(v)) for v in m]
    return [m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3)]


def relative(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """inverse(a) b of poses (x, y, yaw) in the plane."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    yaw = b[2] - a[2]
    return F.cos(a[2]) * dx + F.sin(a[2]) * dy, -F.sin(a[2]) * dx + F.cos(a[2]) * dy, F.atan2(F.sin(yaw), F.cos(yaw))


def plane_distance(p: Vector, plane: Sequence[float]) -> Column:
    """Signed distance from the plane ax + by + cz + d = 0."""
    a, b, c, d = map(float, plane)
    return (p[0] * a + p[1] * b + p[2] * c + d) / math.sqrt(a * a + b * b + c * c)


def plane_projection(p: Vector, plane: Sequence[float]) -> list[Column]:
    n = math.sqrt(sum(float(v) ** 2 for v in plane[:3]))
    t = plane_distance(p, plane)
    return [v - t * (float(k) / n) for v, k in zip(p, plane)]


def deskewed(p: Vector, motion: tuple[float, float, float]) -> list[Column]:
    """A point of a turning sensor brought to the scan's end: the share of the
    motion (x, y, yaw of a whole turn) still to come follows from its azimuth."""
    left = 1 - F.pmod(F.atan2(p[1], p[0]), F.lit(2 * math.pi)) / (2 * math.pi)
    yaw = -left * motion[2]
    x, y = p[0] - left * motion[0], p[1] - left * motion[1]
    return [F.cos(yaw) * x - F.sin(yaw) * y, F.sin(yaw) * x + F.cos(yaw) * y, p[2]]


def range_covariance(p: Vector, range_error: float, angle_error: float) -> list[Column]:
    """Upper triangle of a point's covariance from errors along its ray and
    across it: s^2 uu' + (r t)^2 (I - uu')."""
    u, r2 = unit(p), dot(p, p)
    along, across = F.lit(range_error**2), r2 * angle_error**2
    return [along * u[i] * u[j] + across * ((1.0 if i == j else 0.0) - u[i] * u[j]) for i in range(3) for j in range(i, 3)]


def calibrated(p: Vector, degrees: float = 0.15) -> list[Column]:
    """A point with its vertical angle raised by that many degrees, at the same range."""
    r, flat = F.sqrt(dot(p, p)), F.sqrt(p[0] * p[0] + p[1] * p[1])
    up = F.atan2(p[2], flat) + math.radians(degrees)
    k = F.when(flat > 0, r * F.cos(up) / flat).otherwise(0.0)
    return [p[0] * k, p[1] * k, r * F.sin(up)]


def two_point_pose(s: Sequence[Column], t: Sequence[Column]) -> tuple[Column, Column, Column]:
    """(x, y, yaw) that takes two source points' middle and direction to those
    of two targets. s and t: x1, y1, x2, y2."""
    yaw = F.atan2(t[3] - t[1], t[2] - t[0]) - F.atan2(s[3] - s[1], s[2] - s[0])
    mx, my = (s[0] + s[2]) / 2, (s[1] + s[3]) / 2
    return (t[0] + t[2]) / 2 - (F.cos(yaw) * mx - F.sin(yaw) * my), (t[1] + t[3]) / 2 - (F.sin(yaw) * mx + F.cos(yaw) * my), F.atan2(F.sin(yaw), F.cos(yaw))


def grid_of(value: Column | str, origin: float, size: float) -> Column:
    """Grid number of a place, halves away from zero."""
    return F.round((col(value) - origin) / size).cast("int")


def place_of(number: Column | str, origin: float, size: float) -> Column:
    return col(number) * F.lit(size) + origin
