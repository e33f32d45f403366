"""Rotations, rigid transforms, planes and sensor models over points."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.functions import pose as op

from .registry import query

P = "xyz"
Q = f"WITH {b.POINTS}"


def show(df, columns, names="xyz", digits=5):
    return df.select("point_idx", *[(F.round(c, digits) + 0.0).alias(n) for c, n in zip(columns, names)])


ROUND = lambda *e: ", ".join(f"round({x}, 5) + 0.0 AS {n}" for x, n in zip(e, "xyz"))
#: u across v times sine, cosine and the rest of Rodrigues' formula, about the unit axis (a, b, c).
TURN = ("px*co + (ab*pz - ac*py)*si + aa*dt*(1-co)", "py*co + (ac*px - aa*pz)*si + ab*dt*(1-co)", "pz*co + (aa*py - ab*px)*si + ac*dt*(1-co)")


@query(Q + ", n AS (SELECT point_idx, sqrt(r*r+g*g+b*b) AS n, r, g, b, x AS px, y AS py, z AS pz FROM p), k AS (SELECT *, cos(n) AS co, sin(n) AS si, r/n AS aa, g/n AS ab, b/n AS ac, (r*x0 + g*y0 + b*z0)/n AS dt FROM (SELECT *, px AS x0, py AS y0, pz AS z0 FROM n)) SELECT point_idx, " + ROUND(*TURN) + " FROM k")
def axis_angle(spark, d):
    return show(b.points(spark, d), op.axis_angle(op.vector(P), op.vector("rgb")))


@query(Q + ", n AS (SELECT point_idx, 10*r AS px, 10*g AS py, 10*b AS pz, x/sqrt(x*x+y*y+z*z) AS nx, y/sqrt(x*x+y*y+z*z) AS ny, z/sqrt(x*x+y*y+z*z) AS co FROM p), k AS (SELECT *, sqrt(nx*nx+ny*ny) AS si, ny/sqrt(nx*nx+ny*ny) AS aa, -nx/sqrt(nx*nx+ny*ny) AS ab, 0.0::DOUBLE AS ac, (px*ny - py*nx)/sqrt(nx*nx+ny*ny) AS dt FROM n) SELECT point_idx, " + ROUND(*TURN) + " FROM k")
def normal_to_up(spark, d):
    return show(b.points(spark, d), op.to_up([F.col(c) * 10 for c in "rgb"], op.vector(P)))


@query(Q + " SELECT point_idx, round((x - 2*y + 2*z + 1.5)/3, 5) AS dist, " + ROUND("x - (x-2*y+2*z+1.5)/9", "y + 2*(x-2*y+2*z+1.5)/9", "z - 2*(x-2*y+2*z+1.5)/9") + " FROM p")
def point_plane(spark, d):
    plane = (1, -2, 2, 1.5)
    return show(b.points(spark, d), [op.plane_distance(op.vector(P), plane), *op.plane_projection(op.vector(P), plane)], ("dist", "x", "y", "z"))


@query(Q + " SELECT point_idx, round(x, 5) AS x, round(y, 5) AS y, round(atan2(sin(z), cos(z)), 5) AS yaw FROM p")
def se3_round_trip(spark, d):
    """A pose in the plane made a 4 x 4 and read back."""
    return show(b.points(spark, d), op.se2(op.se3(*op.vector(P))), ("x", "y", "yaw"))


@query(Q + " SELECT point_idx, " + ROUND("0.36::DOUBLE*x + 0.48::DOUBLE*y - 0.8::DOUBLE*z + 1", "-0.8::DOUBLE*x + 0.6::DOUBLE*y + 2", "0.48::DOUBLE*x + 0.64::DOUBLE*y + 0.6::DOUBLE*z - 1") + " FROM p")
def rigid_3d(spark, d):
    return show(b.points(spark, d), op.rigid3d(op.vector(P), (0.36, 0.48, -0.8, 1, -0.8, 0.6, 0, 2, 0.48, 0.64, 0.6, -1, 0, 0, 0, 1)))


@query(Q + " SELECT point_idx, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, round(atan2(sin(z), cos(z)), 5) + 0.0 AS z FROM p WHERE abs(atan2(sin(z), cos(z))) < 3.1")
def rotation_log(spark, d):
    """The rotation vector of a turn about z."""
    p = b.points(spark, d).filter(F.abs(F.atan2(F.sin("z"), F.cos("z"))) < 3.1)
    return show(p, op.rotation_vector(op.yaw_matrix(F.col("z"))))


@query(Q + ", m AS (SELECT *, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2*pi() ELSE atan2(y, x) END AS az FROM p), k AS (SELECT *, 1 - az/(2*pi()) AS f FROM m), q AS (SELECT point_idx, x - f*0.5::DOUBLE AS u, y + f*0.2::DOUBLE AS v, z, -f*0.3::DOUBLE AS w FROM k) SELECT point_idx, " + ROUND("cos(w)*u - sin(w)*v", "sin(w)*u + cos(w)*v", "z") + " FROM q")
def deskew(spark, d):
    return show(b.points(spark, d), op.deskewed(op.vector(P), (0.5, -0.2, 0.3)))


@query(Q + ", n AS (SELECT *, x*x+y*y+z*z AS q FROM p) SELECT point_idx, round(0.0004::DOUBLE*x*x/q + 0.000025::DOUBLE*(q - x*x), 7) AS xx, round((0.0004::DOUBLE/q - 0.000025::DOUBLE)*x*y, 7) + 0.0 AS xy, round(0.0004::DOUBLE*z*z/q + 0.000025::DOUBLE*(q - z*z), 7) AS zz FROM n")
def range_covariance(spark, d):
    c = op.range_covariance(op.vector(P), 0.02, 0.005)
    return show(b.points(spark, d), (c[0], c[1], c[5]), ("xx", "xy", "zz"), 7)


@query(Q + ", n AS (SELECT *, sqrt(x*x+y*y+z*z) AS q, sqrt(x*x+y*y) AS f FROM p), k AS (SELECT *, atan2(z, f) + radians(0.15) AS up FROM n) SELECT point_idx, " + ROUND("x*q*cos(up)/f", "y*q*cos(up)/f", "q*sin(up)") + " FROM k")
def vertical_calibration(spark, d):
    return show(b.points(spark, d), op.calibrated(op.vector(P)))


@query(f"WITH {b.SEGMENTS} SELECT seg_id, round(1.25::DOUBLE, 4) AS x, round(-0.5::DOUBLE, 4) AS y, round(0.7::DOUBLE, 4) AS yaw FROM s")
def two_point_pose(spark, d):
    """Recovers a known pose from each segment and its moved copy."""
    from scenelake.functions.geometry import rigid2d

    t = [*rigid2d("x1", "y1", 1.25, -0.5, 0.7), *rigid2d("x2", "y2", 1.25, -0.5, 0.7)]
    found = op.two_point_pose(op.vector(["x1", "y1", "x2", "y2"]), t)
    return b.segments(spark, d).select("seg_id", *[F.round(c, 4).alias(n) for c, n in zip(found, ("x", "y", "yaw"))])


@query(Q + ", k AS (SELECT point_idx, CAST(round((x + 1)/0.25) AS INT) AS gx, CAST(round((y + 1)/0.25) AS INT) AS gy FROM p) SELECT point_idx, gx, gy, gx*0.25::DOUBLE - 1 AS cx, gy*0.25::DOUBLE - 1 AS cy FROM k")
def grid_points(spark, d):
    k = b.points(spark, d).select("point_idx", op.grid_of("x", -1.0, 0.25).alias("gx"), op.grid_of("y", -1.0, 0.25).alias("gy"))
    return k.select("*", op.place_of("gx", -1.0, 0.25).alias("cx"), op.place_of("gy", -1.0, 0.25).alias("cy"))


@query("WITH t AS (SELECT user_id AS traj, event_id, value AS x, event_id % 7 AS y, event_id % 5 / 2.0 AS yaw, ts FROM events), q AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(yaw) OVER w AS nyaw, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(yaw) OVER w AS pyaw FROM t WINDOW w AS (PARTITION BY traj ORDER BY ts, event_id)), s AS (SELECT event_id, x, y, yaw, CASE WHEN px IS NOT NULL THEN px ELSE nx END AS ox, CASE WHEN px IS NOT NULL THEN py ELSE ny END AS oy, CASE WHEN px IS NOT NULL THEN pyaw ELSE nyaw END AS oyaw FROM q) SELECT event_id, round(coalesce(cos(yaw)*(ox-x) + sin(yaw)*(oy-y), 0), 5) + 0.0 AS x, round(coalesce(-sin(yaw)*(ox-x) + cos(yaw)*(oy-y), 0), 5) + 0.0 AS y, round(coalesce(atan2(sin(oyaw-yaw), cos(oyaw-yaw)), 0), 5) + 0.0 AS yaw FROM s")
def ego_motion_se2(spark, d):
    """inverse(T_i) T_{i-1}; the first of a trajectory uses the next, a single one has none."""
    from pyspark.sql import Window

    e = b.read(spark, d, "events").select(F.col("user_id").alias("traj"), "event_id", "ts", F.col("value").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"), (F.col("event_id") % 5 / 2).alias("yaw"))
    w = Window.partitionBy("traj").orderBy("ts", "event_id")
    other = [F.coalesce(F.lag(c).over(w), F.lead(c).over(w)).alias(f"o{c}") for c in ("x", "y", "yaw")]
    q = e.select("*", *other)
    r = op.relative(tuple(op.vector(["x", "y", "yaw"])), tuple(op.vector(["ox", "oy", "oyaw"])))
    return q.select("event_id", *[(F.round(F.coalesce(c, F.lit(0.0)), 5) + 0.0).alias(n) for c, n in zip(r, ("x", "y", "yaw"))])
