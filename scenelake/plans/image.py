"""The raster chain over grids from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.operators import image as op

from .registry import query

GRID = f"WITH {b.CLOUD}, g AS (SELECT CAST(floor(x/2) AS INT) AS gx, CAST(floor(y/2) AS INT) AS gy, CAST(count(*) AS DOUBLE) AS value FROM c GROUP BY 1, 2 HAVING count(*) >= 8)"
BOX = "o AS (SELECT CAST(a.range - 1 AS INT) AS a, CAST(e.range - 1 AS INT) AS b FROM range(3) a, range(3) e)"
CLOSED = GRID + f", {BOX}, dl AS (SELECT CAST(gx+a AS INT) AS gx, CAST(gy+b AS INT) AS gy, max(value) AS value FROM g, o GROUP BY 1, 2), cl AS (SELECT CAST(gx+a AS INT) AS gx, CAST(gy+b AS INT) AS gy, min(value) AS value FROM dl, o GROUP BY 1, 2 HAVING count(*) = 9)"
MEDIAN = CLOSED + ", md AS (SELECT gx, gy, v[5] AS value FROM (SELECT CAST(gx+a AS INT) AS gx, CAST(gy+b AS INT) AS gy, list_reverse_sort(list(value)) AS v FROM cl, o GROUP BY 1, 2 HAVING count(*) >= 5))"
BLUR = MEDIAN + ", gs AS (SELECT CAST(gx+a AS INT) AS gx, CAST(gy+b AS INT) AS gy, sum(value * power(2.0, 2 - abs(a) - abs(b)) / 16) AS value FROM md, o GROUP BY 1, 2)"


def grid(spark, d):
    c = b.cloud(spark, d).groupBy(F.floor(F.col("x") / 2).cast("int").alias("gx"), F.floor(F.col("y") / 2).cast("int").alias("gy"))
    return c.agg(F.count("*").cast("double").alias("value")).filter("value >= 8")


@query(f"WITH {b.CLOUD} SELECT CAST(floor(x/2) AS INT) AS gx, CAST(floor(y/2) AS INT) AS gy, count(*) AS n, round(avg(x), 8) AS x, round(avg(y), 8) AS y FROM c GROUP BY 1, 2")
def cell_centres(spark, d):
    return op.cell_centres(b.cloud(spark, d), 2.0).withColumns({a: F.round(a, 8) for a in "xy"})


@query(CLOSED + " SELECT * FROM cl")
def image_close(spark, d):
    return op.close(grid(spark, d), 1)


@query(MEDIAN + " SELECT * FROM md")
def image_median(spark, d):
    return op.median(op.close(grid(spark, d), 1))


@query(BLUR + " SELECT gx, gy, round(value, 6) AS value FROM gs")
def image_gaussian(spark, d):
    return op.gaussian(op.median(op.close(grid(spark, d), 1))).withColumn("value", F.round("value", 6))


@query(BLUR + " SELECT gx, gy, CAST(1.0 AS DOUBLE) AS value FROM gs WHERE value >= 6.01")
def image_chain(spark, d):
    return op.chain(grid(spark, d), 1, 6.01)


@query(GRID + " SELECT gx, gy, 5 + (gx + 0.5::DOUBLE) * 2 AS x, -3 + (gy + 0.5::DOUBLE) * 2 AS y FROM g")
def mask_to_points(spark, d):
    return op.to_points(grid(spark, d), 2.0, 5.0, -3.0)


AFFINE = f"WITH {b.POINTS}, {BOX}, i AS (SELECT DISTINCT CAST(floor(4.0::DOUBLE*x + 1.0::DOUBLE*y + 20.0::DOUBLE + 0.5) AS INT) AS gx, CAST(floor(-1.0::DOUBLE*x + 4.0::DOUBLE*y + 20.0::DOUBLE + 0.5) AS INT) AS gy FROM p), m AS (SELECT DISTINCT CAST(gx+a AS INT) AS gx, CAST(gy+b AS INT) AS gy FROM i, o)"


@query(AFFINE + " SELECT gx, gy, CAST(1.0 AS DOUBLE) AS value FROM m")
def points_to_image(spark, d):
    return op.from_points(b.points(spark, d), (4, 1, 20, -1, 4, 20), 1)


@query(AFFINE + " SELECT CAST(x.range AS INT) AS gx, CAST(y.range AS INT) AS gy, CAST(1.0 AS DOUBLE) AS value FROM range(40) x, range(40) y WHERE NOT EXISTS (SELECT 1 FROM m WHERE gx = x.range AND gy = y.range)")
def image_invert(spark, d):
    return op.inverted(op.from_points(b.points(spark, d), (4, 1, 20, -1, 4, 20), 1), 40, 40)


@query(f"WITH {b.CLOUD}, {BOX}, q AS (SELECT CAST(floor(x/2) AS INT) AS u, CAST(floor(y/2) AS INT) AS v, min(z) AS depth FROM c GROUP BY 1, 2) SELECT CAST(u+a AS INT) AS gx, CAST(v+b AS INT) AS gy, min(depth) AS depth FROM q, o GROUP BY 1, 2")
def depth_image(spark, d):
    c = b.cloud(spark, d).select(F.floor(F.col("x") / 2).cast("int").alias("u"), F.floor(F.col("y") / 2).cast("int").alias("v"), F.col("z").alias("depth"))
    return op.depth_image(c, 1)


@query(GRID + ", t AS (SELECT CAST(x.range - 120 AS INT) AS u, CAST(y.range - 120 AS INT) AS v FROM range(320) x, range(320) y) SELECT u AS gx, v AS gy, value FROM t JOIN g ON floor(cos(0.4)*(u+0.5) + sin(0.4)*(v+0.5)) = gx AND floor(-sin(0.4)*(u+0.5) + cos(0.4)*(v+0.5)) = gy")
def image_rotate(spark, d):
    return op.rotated(grid(spark, d), 0.4)


@query(GRID + f", q AS (SELECT point_idx, greatest(0.0, least(47.0, x*4+20)) AS u, greatest(0.0, least(59.0, y*4+20)) AS v FROM (WITH {b.POINTS} SELECT * FROM p)), k AS (SELECT point_idx, CAST(floor(u)+a.range AS INT) AS gx, CAST(floor(v)+e.range AS INT) AS gy, (CASE a.range WHEN 1 THEN u-floor(u) ELSE 1-(u-floor(u)) END) * (CASE e.range WHEN 1 THEN v-floor(v) ELSE 1-(v-floor(v)) END) AS w FROM q, range(2) a, range(2) e) SELECT point_idx, round(sum(w * coalesce(value, 0)), 5) AS value FROM k LEFT JOIN g USING (gx, gy) GROUP BY 1")
def pixel_bilinear(spark, d):
    p = b.points(spark, d).select("point_idx", (F.col("x") * 4 + 20).alias("u"), (F.col("y") * 4 + 20).alias("v"))
    return op.bilinear(p, grid(spark, d), "point_idx", 48, 60).withColumn("value", F.round("value", 5))


@query(f"WITH {b.CLOUD}, t AS (SELECT point_idx % 5 AS tile, CAST(floor(x/2) AS INT) AS gx, CAST(floor(y/2) AS INT) AS gy, count(*) AS value FROM c GROUP BY 1, 2, 3), q AS (SELECT tile, gx + tile * 3 AS gx, gy - tile AS gy, value FROM t) SELECT gx, gy, arg_max(value, tile) AS value FROM q GROUP BY 1, 2")
def paste_tiles(spark, d):
    c = b.cloud(spark, d).select((F.col("point_idx") % 5).alias("tile"), F.floor(F.col("x") / 2).cast("int").alias("gx"), F.floor(F.col("y") / 2).cast("int").alias("gy"))
    offsets = spark.range(5).select(F.col("id").alias("tile"), (F.col("id") * 3).alias("dx"), (-F.col("id")).alias("dy"))
    return op.pasted(c.groupBy("tile", "gx", "gy").agg(F.count("*").alias("value")), offsets)
