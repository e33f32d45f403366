"""Height bands, votes, grids and stencils."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.operators import raster as op

from .registry import query

HIST = f"WITH {b.CLOUD}, r AS (SELECT min(z) AS a, max(z) AS b, count(*) AS total FROM c), h AS (SELECT CAST(greatest(0, least(99, floor((z-a)/(b-a)*100))) AS INT) AS bin, count(*) AS n FROM c, r GROUP BY 1)"


@query(HIST + " SELECT * FROM h")
def z_histogram(spark, d):
    return op.z_histogram(b.cloud(spark, d))


@query(
    HIST
    + """, p AS (SELECT min(bin) FILTER (n > 0.02*total) AS p, max(bin) FILTER (n > 0.02*total) AS q, any_value(a) AS a, any_value(b) AS b FROM h, r),
 f AS (SELECT p IS NOT NULL AND q > p AS two, a + (p+0.5)*((b-a)/100) AS fl, a + (q+0.5)*((b-a)/100) AS ce, a, b FROM p)
 SELECT round(CASE WHEN two THEN fl END, 6) AS floor_z, round(CASE WHEN two THEN ce END, 6) AS ceiling_z, round(CASE WHEN two THEN fl + greatest(0.1*(ce-fl), 0.2) ELSE a + 0.2*(b-a) END, 6) AS low, round(CASE WHEN two THEN ce - greatest(0.1*(ce-fl), 0.2) ELSE a + 0.8*(b-a) END, 6) AS high FROM f"""
)
def floor_ceiling_band(spark, d):
    r = op.height_band(b.cloud(spark, d))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query(f"WITH {b.CLOUD}, k AS (SELECT DISTINCT CAST(floor(x/2) AS INT) AS gx, CAST(floor(y/2) AS INT) AS gy, least(CAST(floor((z-0.5)/0.4) AS INT), 4) AS s FROM c WHERE z BETWEEN 0.5 AND 2.5) SELECT gx, gy, count(*) AS votes FROM k GROUP BY gx, gy HAVING count(*) >= 3")
def slice_votes(spark, d):
    return op.slice_votes(b.cloud(spark, d), 0.5, 2.5, 5, 2.0, 3)


@query(f"WITH {b.CLOUD}, q AS (SELECT CAST(floor(x/1.5) AS INT) AS i, CAST(floor(y/1.5) AS INT) AS j, x/1.5 - floor(x/1.5) AS a, y/1.5 - floor(y/1.5) AS b FROM c), f AS (SELECT i AS gx, j AS gy, (1-a)*(1-b) AS w FROM q UNION ALL SELECT i, j+1, (1-a)*b FROM q UNION ALL SELECT i+1, j, a*(1-b) FROM q UNION ALL SELECT i+1, j+1, a*b FROM q) SELECT gx, gy, round(sum(w), 4) AS w FROM f GROUP BY ALL")
def bilinear_splat(spark, d):
    return op.bilinear_splat(b.cloud(spark, d), 1.5).withColumn("w", F.round("w", 4))


GRID = f"WITH {b.CLOUD}, g AS (SELECT CAST(floor(x/3) AS INT) AS gx, CAST(floor(y/3) AS INT) AS gy, count(*) AS n FROM c GROUP BY 1, 2)"
SPARSE = GRID + ", k AS (SELECT * FROM g WHERE n >= 12)"
AROUND = SPARSE + ", o AS (SELECT CAST(a.range - 1 AS INT) AS di, CAST(e.range - 1 AS INT) AS dj FROM range(3) a, range(3) e), s AS (SELECT gx + di AS gx, gy + dj AS gy, n, di = 0 AND dj = 0 AS own FROM k, o)"


def grid(spark, d):
    return op.density(b.cloud(spark, d), 3.0)


def sparse(spark, d):
    return grid(spark, d).filter("n >= 12")


@query(GRID + " SELECT * FROM g")
def density_raster(spark, d):
    return grid(spark, d)


@query(GRID + " SELECT g.* FROM g WHERE n >= (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k FROM g) WHERE k = (SELECT CAST(floor(0.7 * (count(*) - 1)) AS BIGINT) FROM g))")
def density_percentile(spark, d):
    return op.density_percentile(grid(spark, d), 0.7)


@query(f"WITH {b.POINTS}, a AS (SELECT x - lag(x) OVER (ORDER BY x) AS d FROM (SELECT DISTINCT x FROM p)), e AS (SELECT y - lag(y) OVER (ORDER BY y) AS d FROM (SELECT DISTINCT y FROM p)), m AS (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM a WHERE d > 1e-6 AND d < 0.5) WHERE k = n // 2 UNION ALL SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM e WHERE d > 1e-6 AND d < 0.5) WHERE k = n // 2) SELECT round(min(d), 8) AS step FROM m")
def grid_infer(spark, d):
    return op.grid_step(b.points(spark, d)).select(F.round("step", 8).alias("step"))


@query(AROUND + " SELECT gx, gy FROM s GROUP BY gx, gy HAVING count(*) = 9")
def grid_erode(spark, d):
    return op.erode(sparse(spark, d), 1)


@query(AROUND + " SELECT gx, gy, max(CASE WHEN own THEN greatest(CAST(n AS DOUBLE), 0.8) ELSE CAST(0.8 AS DOUBLE) END) AS v FROM s GROUP BY gx, gy")
def grid_dilate(spark, d):
    return op.dilate(sparse(spark, d), 1)


@query(AROUND + " SELECT gx, gy, CAST(sum(n) AS BIGINT) AS total FROM s GROUP BY gx, gy HAVING max(own)")
def grid_neigh_sum(spark, d):
    return op.neighbour_sum(sparse(spark, d), 1)


@query(SPARSE + ", o AS (SELECT CAST(a.range - 2 AS INT) AS di, CAST(e.range - 2 AS INT) AS dj FROM range(5) a, range(5) e) SELECT gx + di AS gx, gy + dj AS gy, round(max(1 - sqrt(CAST(di*di + dj*dj AS DOUBLE)) / 3), 6) AS v FROM k, o WHERE sqrt(CAST(di*di + dj*dj AS DOUBLE)) < 3 GROUP BY 1, 2")
def distance_score(spark, d):
    return op.distance_score(sparse(spark, d), 2).withColumn("v", F.round("v", 6))


ANGLES = 12


@query(
    SPARSE
    + ", t AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {math.cos(math.pi * k / ANGLES)!r}::DOUBLE, {math.sin(math.pi * k / ANGLES)!r}::DOUBLE)" for k in range(ANGLES))
    + ") v(theta, co, si)) SELECT CAST(theta AS INT) AS theta, CAST(floor((gx * co + gy * si) / 1.7 + 0.5) AS INT) AS r, count(*) AS votes FROM k, t GROUP BY 1, 2 HAVING count(*) >= 8"
)
def hough_votes(spark, d):
    return op.hough_votes(sparse(spark, d), ANGLES, 1.7, 8)


@query(f"WITH {b.POINTS} SELECT round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 5) AS yaw FROM p")
def pca_yaw(spark, d):
    return op.pca_yaw(b.points(spark, d)).select(F.round("yaw", 5).alias("yaw"))


@query(f"WITH {b.POINTS}, m AS (SELECT label, avg(x) AS cx, avg(y) AS cy, 0.5*atan2(2*covar_pop(x,y), var_pop(x)-var_pop(y)) AS yaw FROM p GROUP BY label) SELECT label, round(any_value(cx),5) AS cx, round(any_value(cy),5) AS cy, round(any_value(yaw),5) AS yaw, round(min((x-cx)*cos(yaw)+(y-cy)*sin(yaw)),5) AS t0, round(max((x-cx)*cos(yaw)+(y-cy)*sin(yaw)),5) AS t1 FROM p JOIN m USING (label) GROUP BY label")
def line_moments(spark, d):
    f = op.line_fit(b.points(spark, d), "label")
    return f.select("label", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "yaw", "t0", "t1")])
