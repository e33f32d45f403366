"""Voxels, radius joins, neighbours, views of point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.functions import geometry as geo
from scenelake.operators import cells
from scenelake.operators.raster import z_buffer

from .registry import query

CLOUD_CELLS = f"WITH {b.CLOUD}, v AS (SELECT point_idx, CAST(floor(x/2) AS INT) AS vx, CAST(floor(y/2) AS INT) AS vy, CAST(floor(z/2) AS INT) AS vz FROM c), k AS (SELECT vx, vy, vz, count(*) AS n, min(point_idx) AS first_idx FROM v GROUP BY ALL)"


@query(CLOUD_CELLS + " SELECT * FROM k")
def voxel_index(spark, d):
    return cells.voxel_index(b.cloud(spark, d), 2.0)


@query(CLOUD_CELLS + " SELECT count(*) AS n_voxels, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM k")
def voxel_stats(spark, d):
    return cells.voxel_stats(b.cloud(spark, d), 2.0)


@query(f"WITH {b.POINTS} SELECT CAST(floor(x) AS INT) AS vx, CAST(floor(y) AS INT) AS vy, CAST(floor(z) AS INT) AS vz, round(avg(x),4) AS x, round(avg(y),4) AS y, round(avg(z),4) AS z, round(avg(r),4) AS r, round(avg(g),4) AS g, round(avg(b),4) AS b FROM p GROUP BY 1,2,3")
def voxel_downsample(spark, d):
    return cells.voxel_downsample(b.points(spark, d), 1.0)


@query(f"WITH {b.POINTS} SELECT DISTINCT CAST(round_even(x/0.5, 0) AS INT) AS gx, CAST(round_even(y/0.5, 0) AS INT) AS gy, CAST(round_even(z/0.5, 0) AS INT) AS gz FROM (SELECT x, y, z FROM p UNION ALL SELECT x + 0.25, y, z FROM p)")
def voxel_union(spark, d):
    p = b.points(spark, d)
    return cells.voxel_union([p, p.withColumn("x", F.col("x") + 0.25)], 0.5)


@query(CLOUD_CELLS + " SELECT * FROM k WHERE vx BETWEEN 5 AND 20 AND vy BETWEEN 2 AND 15 AND vz BETWEEN 0 AND 1")
def voxel_aabb(spark, d):
    return cells.voxels_in_box(b.cloud(spark, d), 2.0, (10.0, 4.0, 0.0), (40.5, 30.5, 3.0))


@query(f"WITH {b.CLOUD} SELECT point_idx, CAST(trunc(CASE WHEN (x-48)/8 < 0 THEN (x-48)/8 - 1 ELSE (x-48)/8 END) AS BIGINT) AS kx, CAST((CAST(floor(y/2) AS INT) + 0.5) * 2 AS DOUBLE) AS cy FROM c")
def voxel_keys_truncated(spark, d):
    c = b.cloud(spark, d)
    return c.select("point_idx", cells.truncated_cell(F.col("x") - 48, 8.0).alias("kx"), cells.centre(cells.cell("y", 2.0), 2.0).alias("cy"))


NEAR = f"WITH {b.POINTS}, h AS (SELECT a.point_idx AS i, c.point_idx AS j, (a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z) AS d2 FROM p a JOIN p c ON a.point_idx <> c.point_idx)"


@query(NEAR + " SELECT i AS point_idx, j AS point_idx_2, round(d2, 6) AS d2 FROM h WHERE i < j AND d2 <= 0.25")
def radius_self_join(spark, d):
    return cells.radius_self_join(b.points(spark, d), 0.5).withColumn("d2", F.round("d2", 6))


KNN = NEAR + ", k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM h)"


@query(KNN + " SELECT i AS point_idx, j AS neighbour, CAST(rank AS INT) AS rank, round(sqrt(d2), 6) AS dist FROM k WHERE rank <= 5")
def knn(spark, d):
    k = cells.knn_exact(b.points(spark, d), 5, 1.0)
    return k.select("point_idx", "neighbour", F.col("rank").cast("int").alias("rank"), F.round(F.sqrt("d2"), 6).alias("dist"))


@query(KNN + ", m AS (SELECT i AS point_idx, avg(sqrt(d2)) AS m FROM k WHERE rank <= 10 GROUP BY i) SELECT point_idx, round(m, 6) AS mean_distance, m < (SELECT avg(m) + 1.5 * stddev_samp(m) FROM m) AS kept FROM m")
def statistical_outlier(spark, d):
    return cells.statistical_outliers(b.points(spark, d), 10, 1.5, 1.0)


@query(f"WITH {b.POINTS} SELECT point_idx FROM p WHERE abs((x-0.2)*0.8 + (y+0.1)*0.6) <= 1.0 AND abs(-(x-0.2)*0.6 + (y+0.1)*0.8) <= 0.75 AND abs(z) <= 1.25")
def point_in_obb(spark, d):
    inside = geo.in_obb(("x", "y", "z"), (0.2, -0.1, 0.0), ((0.8, 0.6, 0), (-0.6, 0.8, 0), (0, 0, 1)), (2.0, 1.5, 2.5))
    return b.points(spark, d).filter(inside).select("point_idx")


POSE = (1.0, 0.0, 0.0, 0.3, 0.0, 1.0, 0.0, -0.2, 0.0, 0.0, 1.0, 4.0, 0.0, 0.0, 0.0, 1.0)
PIXELS = f"WITH {b.POINTS}, q AS (SELECT point_idx, x-0.3 AS cx, -(y+0.2) AS cy, -(z-4.0) AS depth FROM p), w AS (SELECT point_idx, CAST(trunc(cx*40/depth+100+0.5) AS INT) AS u, CAST(trunc(cy*40/depth+100+0.5) AS INT) AS v, depth FROM q WHERE depth > 0.1), s AS (SELECT * FROM w WHERE depth > 0.1 AND depth < 6.0 AND u >= 1 AND u < 199 AND v >= 1 AND v < 199)"


def pixels(spark, d):
    x, y, depth = geo.camera(POSE)
    q = b.points(spark, d).select("point_idx", x.alias("cx"), y.alias("cy"), depth.alias("depth")).filter("depth > 0.1")
    u, v = geo.pinhole(F.col("cx"), F.col("cy"), F.col("depth"), 40.0, 40.0, 100.0, 100.0)
    return q.select("point_idx", u.alias("u"), v.alias("v"), "depth").filter(geo.in_view(F.col("u"), F.col("v"), F.col("depth"), 200, 200, 6.0))


@query(PIXELS + " SELECT point_idx, u, v, round(depth, 6) AS depth FROM s")
def pinhole_project(spark, d):
    return pixels(spark, d).withColumn("depth", F.round("depth", 6))


@query(PIXELS + " SELECT point_idx, u, v FROM (SELECT *, min(depth) OVER (PARTITION BY u // 4, v // 4) AS least FROM s) WHERE depth <= least + 0.3")
def zbuffer_select(spark, d):
    p = pixels(spark, d).withColumns({"pu": F.col("u"), "pv": F.col("v"), "u": F.floor(F.col("u") / 4), "v": F.floor(F.col("v") / 4)})
    return z_buffer(p, 0.3).select("point_idx", F.col("pu").alias("u"), F.col("pv").alias("v"))


@query(PIXELS + ", m AS (SELECT DISTINCT u // 25 AS mu, v // 25 AS mv, (u // 25 + v // 25) % 4 AS det FROM s) SELECT CAST(det AS INT) AS det, count(DISTINCT point_idx) AS n FROM s JOIN m ON s.u // 25 = mu AND s.v // 25 = mv GROUP BY det")
def mask_pixel_join(spark, d):
    """Visible points met with a mask of square detections by pixel."""
    p = pixels(spark, d).withColumns({"mu": F.floor(F.col("u") / 25), "mv": F.floor(F.col("v") / 25)})
    mask = p.select("mu", "mv", ((F.col("mu") + F.col("mv")) % 4).cast("int").alias("det")).distinct()
    return p.join(mask, ["mu", "mv"]).groupBy("det").agg(F.countDistinct("point_idx").alias("n"))


@query(f"WITH {b.POINTS}, n AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM p), q AS (SELECT max(n)*100 AS rr FROM n) SELECT point_idx, round(x*(1+2*(rr-n)/n), 3) AS x, round(y*(1+2*(rr-n)/n), 3) AS y, round(z*(1+2*(rr-n)/n), 3) AS z FROM n, q")
def spherical_flip(spark, d):
    f = geo.spherical_flip(b.points(spark, d))
    return f.select("point_idx", *[F.round(a, 3).alias(a) for a in "xyz"])


@query(f"WITH {b.POINTS}, h AS (SELECT a.point_idx AS i, min((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z)) AS d2 FROM p a JOIN p c ON a.label % 2 = 0 AND c.label % 2 = 1 GROUP BY a.point_idx) SELECT round(avg(least(sqrt(d2), 0.8)), 6) AS chamfer, round(avg(CASE WHEN sqrt(d2) <= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM h")
def chamfer(spark, d):
    """Truncated one-way chamfer distance: neighbours beyond the truncation
    don't matter, so the radius join at that distance is exact."""
    p = b.points(spark, d)
    a, c = p.filter("label % 2 = 0"), p.filter("label % 2 = 1")
    near = cells.radius_pairs(a, c.withColumnRenamed("point_idx", "other"), 0.8, "point_idx", "other").groupBy("point_idx").agg(F.min("d2").alias("d2"))
    dist = F.coalesce(F.least(F.sqrt("d2"), F.lit(0.8)), F.lit(0.8))
    return a.select("point_idx").join(near, "point_idx", "left").agg(F.round(F.avg(dist), 6).alias("chamfer"), F.round(F.avg(F.when(F.sqrt("d2") <= 0.8, 1.0).otherwise(0.0)), 6).alias("overlap"))


@query(f"WITH {b.POINTS} SELECT label, count(*) AS n, round(avg(x),4) AS cx, round(avg(y),4) AS cy, round(avg(z),4) AS cz, round(max(x)-min(x),6) AS ex, round(max(y)-min(y),6) AS ey, round(max(z)-min(z),6) AS ez FROM p GROUP BY label")
def centroid_extent(spark, d):
    ext = [F.round(F.max(a) - F.min(a), 6).alias(f"e{a}") for a in "xyz"]
    return b.points(spark, d).groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(a), 4).alias(f"c{a}") for a in "xyz"], *ext)


@query(f"WITH {b.CLOUD} SELECT point_idx, round(x - min(x) OVER (), 6) AS x, round(y - min(y) OVER (), 6) AS y FROM c")
def shift_to_positive(spark, d):
    c = b.cloud(spark, d)
    low = c.agg(F.min("x").alias("_x"), F.min("y").alias("_y"))
    return c.join(F.broadcast(low)).select("point_idx", F.round(F.col("x") - F.col("_x"), 6).alias("x"), F.round(F.col("y") - F.col("_y"), 6).alias("y"))


@query("WITH b AS (SELECT o_orderkey, sum(1) OVER (ORDER BY o_orderkey) AS k FROM orders) SELECT CAST((k - 1) // 4000 AS BIGINT) AS block, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM b GROUP BY 1")
def tile_blocks(spark, d):
    """Tiles of at most 4,000 points in the order of the id. Places come from
    counts of ranges and ranks inside a range, not from one global window."""
    from scenelake.operators.ordering import global_rank

    o = global_rank(b.read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "k")
    block = F.floor((F.col("k") - 1) / 4000).cast("bigint")
    return o.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
