"""Planes, boxes, rays, components, tiles and look-ups."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.functions import geometry as geo
from scenelake.operators import cells, graph, raster
from scenelake.operators import shapes as op
from scenelake.operators.ordering import global_rank

from .registry import query


@query(f"WITH {b.POINTS} SELECT label, count(*) AS n, round(avg(x),5) AS cx, round(covar_pop(x,x),5) AS xx, round(covar_pop(x,y),5) AS xy, round(covar_pop(x,z),5) AS xz, round(covar_pop(y,z),5) AS yz, round(covar_pop(z,z),5) AS zz FROM p GROUP BY label")
def plane_moments(spark, d):
    m = op.moments(b.points(spark, d), ["label"])
    return m.select("label", "n", *[F.round(c, 5).alias(c) for c in ("cx", "xx", "xy", "xz", "yz", "zz")])


@query(f"WITH {b.POINTS}, m AS (SELECT label, count(*) AS n, covar_pop(x,x) AS a, covar_pop(x,y) AS b, covar_pop(x,z) AS c, covar_pop(y,y) AS d, covar_pop(y,z) AS e, covar_pop(z,z) AS f FROM p GROUP BY label HAVING count(*) >= 5), q AS (SELECT *, (a+d+f)/3 AS me, sqrt(((a-(a+d+f)/3)*(a-(a+d+f)/3)+(d-(a+d+f)/3)*(d-(a+d+f)/3)+(f-(a+d+f)/3)*(f-(a+d+f)/3)+2*(b*b+c*c+e*e))/6) AS pp FROM m), r AS (SELECT *, acos(greatest(-1, least(1, ((a-me)*((d-me)*(f-me)-e*e)-b*(b*(f-me)-e*c)+c*(b*e-(d-me)*c))/(2*pp*pp*pp))))/3 AS ph FROM q), v AS (SELECT *, me+2*pp*cos(ph) AS l2, me+2*pp*cos(ph+2*pi()/3) AS l0 FROM r) SELECT label, n, round(l0, 5) AS l0, round(3*me-l0-l2, 5) AS l1, round(sqrt(l2), 5) AS radius, l0 < 0.5 AS planar FROM v")
def plane_fit(spark, d):
    p = op.plane_fit(b.points(spark, d), ["label"], 5, 0.5)
    return p.select("label", "n", *[F.round(c, 5).alias(c) for c in ("l0", "l1", "radius")], "planar")


@query()
def planarity_filter(spark, d):
    return op.planarity(b.points(spark, d), 0.8, 4, 0.35)


@query()
def ransac_ground(spark, d):
    return op.ransac_plane(b.points(spark, d), 64, 0.3)


STEPS = 12
TURNS = ", ".join(f"({k}, {math.cos(math.pi / 2 * k / STEPS)!r}::DOUBLE, {math.sin(math.pi / 2 * k / STEPS)!r}::DOUBLE)" for k in range(STEPS))


@query(
    f"""WITH {b.POINTS}, t AS (SELECT * FROM (VALUES {TURNS}) v(k, co, si)), e AS (SELECT label, k, min(x*co+y*si) AS a, max(x*co+y*si) AS c, min(y*co-x*si) AS e, max(y*co-x*si) AS f, max(z)-min(z) AS ez FROM p, t GROUP BY label, k),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round((c-a)*(f-e), 9), k) AS n FROM e) SELECT label, round(c-a, 5) AS ex, round(f-e, 5) AS ey, round(ez, 5) AS ez FROM r WHERE n = 1"""
)
def yaw_aligned_box(spark, d):
    return op.yaw_box(b.points(spark, d), "label", STEPS).select("label", *[F.round(c, 5).alias(c) for c in ("ex", "ey", "ez")])


RAYS = f"""WITH {b.POINTS}, k AS (SELECT point_idx AS ray_id, x AS ox, y AS oy, z AS oz, 0.6 AS dx, 0.8 AS dy, 0.0 AS dz FROM p),
 s AS (SELECT ray_id, CAST(range AS INT) AS step, CAST(floor((ox + 0.6::DOUBLE*(range*0.25::DOUBLE))/0.5) AS INT) AS vx, CAST(floor((oy + 0.8::DOUBLE*(range*0.25::DOUBLE))/0.5) AS INT) AS vy, CAST(floor(oz/0.5) AS INT) AS vz FROM k, range(16)),
 m AS (SELECT ray_id, vx, vy, vz, min(step) AS step FROM s GROUP BY ALL), v AS (SELECT CAST(floor(x/0.5) AS INT) AS vx, CAST(floor(y/0.5) AS INT) AS vy, CAST(floor(z/0.5) AS INT) AS vz FROM p GROUP BY ALL HAVING count(*) >= 2),
 q AS (SELECT ray_id, min(step) AS stop FROM m JOIN v USING (vx, vy, vz) GROUP BY ray_id)"""


@query(RAYS + " SELECT m.ray_id, m.vx, m.vy, m.vz, m.step FROM m LEFT JOIN q USING (ray_id) WHERE stop IS NULL OR step <= stop")
def ray_cast(spark, d):
    p = b.points(spark, d)
    rays = p.select(F.col("point_idx").alias("ray_id"), *[F.col(a).alias(f"o{a}") for a in "xyz"], *[F.lit(v).alias(f"d{a}") for a, v in zip("xyz", (0.6, 0.8, 0.0))])
    dense = cells.voxel_index(p, 0.5).filter("n >= 2")
    return op.ray_cells(rays, 0.5, 16, dense).select("ray_id", "vx", "vy", "vz", "step")


@query(
    f"""WITH {b.SEGMENTS}, g AS (SELECT seg_id, CAST(floor(x1/0.5+0.5) AS INT) AS a, CAST(floor(y1/0.5+0.5) AS INT) AS b, CAST(floor(x2/0.5+0.5) AS INT) AS c, CAST(floor(y2/0.5+0.5) AS INT) AS d FROM s), n AS (SELECT *, greatest(abs(c-a), abs(d-b)) AS n FROM g), k AS (SELECT *, unnest(range(0, n+1)) AS k FROM n)
 SELECT DISTINCT seg_id, CASE WHEN n > 0 THEN CAST(floor(a+(c-a)*k/n+0.5) AS INT) ELSE a END AS gx, CASE WHEN n > 0 THEN CAST(floor(b+(d-b)*k/n+0.5) AS INT) ELSE b END AS gy FROM k"""
)
def line_raster(spark, d):
    return op.line_cells(b.segments(spark, d), 0.5)


GRID = f"WITH RECURSIVE {b.CLOUD}, g AS (SELECT CAST(floor(x/3) AS INT) AS gx, CAST(floor(y/3) AS INT) AS gy, count(*) AS n FROM c GROUP BY 1, 2), k AS (SELECT gx, gy, n, row_number() OVER (ORDER BY gx, gy) AS id FROM g WHERE n >= 17)"


def dense(spark, d):
    return raster.density(b.cloud(spark, d), 3.0).filter("n >= 17")


@query(GRID + ", s AS (SELECT p.id AS a, q.id AS b FROM k p JOIN k q ON abs(p.gx-q.gx) <= 1 AND abs(p.gy-q.gy) <= 1 AND p.id <> q.id), w(id, root) AS (SELECT id, id FROM k UNION SELECT s.b, w.root FROM w JOIN s ON s.a = w.id), m AS (SELECT id, min(root) AS root FROM w GROUP BY id), r AS (SELECT root, count(*) AS n, greatest(max(gx)-min(gx)+1, max(gy)-min(gy)+1)/least(max(gx)-min(gx)+1, max(gy)-min(gy)+1) AS aspect FROM m JOIN k USING (id) GROUP BY root) SELECT k.gx, k.gy FROM m JOIN k USING (id) JOIN r USING (root) WHERE r.n >= 4 OR aspect >= 3")
def component_filter(spark, d):
    return op.component_filter(dense(spark, d), 4, 3.0).select("gx", "gy")


@query(GRID.replace("RECURSIVE ", "") + ", o AS (SELECT CAST(a.range-1 AS INT) AS a, CAST(e.range-1 AS INT) AS b FROM range(3) a, range(3) e), s AS (SELECT gx-a AS gx, gy-b AS gy, n*a*(CASE WHEN b = 0 THEN 2 ELSE 1 END) AS x, n*b*(CASE WHEN a = 0 THEN 2 ELSE 1 END) AS y FROM k, o), t AS (SELECT gx, gy, abs(sum(x)) AS x, abs(sum(y)) AS y FROM s GROUP BY gx, gy) SELECT gx, gy, CAST(x + y AS BIGINT) AS mag, y >= x AS horizontal FROM t WHERE x + y > 0")
def image_gradient(spark, d):
    return op.sobel(dense(spark, d), "n")


@query()
def skeleton(spark, d):
    return op.thin(raster.density(b.cloud(spark, d), 3.0).filter("n >= 12"))


@query()
def direction_modes(spark, d):
    s = b.segments(spark, d).select(geo.angle180("x1", "y1", "x2", "y2").alias("ang"))
    return op.mean_shift(s, 8.0, 10)


@query(f"WITH {b.POINTS}, h AS (SELECT a.point_idx, c.x, c.y, c.z FROM p a JOIN p c ON (a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z) <= 0.49), m AS (SELECT covar_pop(x,x) AS a, covar_pop(x,y) AS b, covar_pop(x,z) AS c, covar_pop(y,y) AS d, covar_pop(y,z) AS e, covar_pop(z,z) AS f FROM h GROUP BY point_idx) SELECT round(avg(0.5*ln(17.079468445347132::DOUBLE*greatest(a*(d*f-e*e)-b*(b*f-e*c)+c*(b*e-d*c), 0)+1e-6)), 4) AS entropy FROM m")
def neighbourhood_entropy(spark, d):
    return op.entropy(b.points(spark, d), 0.7).select(F.round("entropy", 4).alias("entropy"))


@query()
def icp_registration(spark, d):
    p = b.points(spark, d).select("point_idx", "x", "y")
    x, y = geo.rigid2d("x", "y", 0.05, -0.04, 0.02)
    motion = op.icp(p, p.withColumns({"x": x, "y": y}), 0.6, 8)
    return spark.createDataFrame([tuple(round(v, 4) for v in motion)], "x double, y double, yaw double")


@query(f"WITH {b.CLOUD}, v AS (SELECT CAST(floor(x/2) AS INT) AS vx, CAST(floor(y/2) AS INT) AS vy, CAST(floor(z/2) AS INT) AS vz, count(*) AS n FROM c GROUP BY 1,2,3), r AS (SELECT *, sum(n) OVER (ORDER BY vx, vy, vz ROWS UNBOUNDED PRECEDING) - n AS b4 FROM v) SELECT CAST(floor(b4/2000) AS INT) AS block, count(*) AS voxels, CAST(sum(n) AS BIGINT) AS points FROM r GROUP BY 1")
def block_info(spark, d):
    v = op.pack_blocks(cells.voxel_index(b.cloud(spark, d), 2.0), 2000)
    return v.groupBy("block").agg(F.count("*").alias("voxels"), F.sum("n").alias("points"))


@query(f"WITH {b.CLOUD} SELECT point_idx FROM c WHERE z BETWEEN 100 AND 200 OR (SELECT count(*) FROM c WHERE z BETWEEN 100 AND 200) = 0")
def crop_with_fallback(spark, d):
    return op.accepted(F.col("z").between(100, 200), b.cloud(spark, d)).select("point_idx")


@query(f"WITH {b.CLOUD}, r AS (SELECT *, CAST(x AS INT) AS col FROM c), s AS (SELECT point_idx, degrees(atan2(abs(z - lag(z) OVER w), sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2))) AS s FROM r WINDOW w AS (PARTITION BY col ORDER BY y, point_idx)) SELECT point_idx FROM s WHERE s <= 10")
def ground_slope(spark, d):
    return op.ground_steps(b.cloud(spark, d).withColumns({"col": F.col("x").cast("int"), "ring": F.col("y")}), 10.0).select("point_idx")


@query("SELECT CAST(i.range AS INT) AS i, CAST(j.range AS INT) AS j, round((2*j.range+1)/(2.0*8), 6) AS u, round((2*i.range+1)/(2.0*8), 6) AS v FROM range(8) i, range(8) j".replace("2.0*8", "16.0::DOUBLE"))
def prompt_grid(spark, d):
    k = spark.range(8).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    return k.select("i", "j", F.round((2 * F.col("j") + 1) / 16, 6).alias("u"), F.round((2 * F.col("i") + 1) / 16, 6).alias("v"))


@query("WITH t AS (SELECT p_partkey % 50 AS gx, p_size AS gy, p_retailprice AS v, p_partkey AS block FROM part) SELECT gx, gy, max_by(v, block) AS v FROM t GROUP BY gx, gy")
def tile_merge(spark, d):
    t = b.read(spark, d, "part").select((F.col("p_partkey") % 50).alias("gx"), F.col("p_size").alias("gy"), F.col("p_retailprice").alias("v"), F.col("p_partkey").alias("block"))
    return t.groupBy("gx", "gy").agg(F.max_by("v", "block").alias("v"))


@query("WITH r AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM r) SELECT round(avg(CASE WHEN k <= 1 AND event_type = 'click' THEN 1.0 ELSE 0 END) FILTER (event_type = 'click'), 6) AS top1, round(avg(CASE WHEN k <= 3 THEN 1.0 ELSE 0 END) FILTER (event_type = 'click'), 6) AS top3 FROM k")
def topk_accuracy(spark, d):
    r = b.read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    k = r.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).filter("event_type = 'click'")
    return k.agg(*[F.round(F.avg(F.when(F.col("k") <= n, 1.0).otherwise(0.0)), 6).alias(f"top{n}") for n in (1, 3)])


@query("SELECT event_id AS new_id, user_id FROM (SELECT row_number() OVER (ORDER BY e.event_id) + (SELECT max(user_id) FROM events) AS event_id, user_id FROM events e WHERE value > 90)")
def adopt_with_fresh_ids(spark, d):
    e = b.read(spark, d, "events")
    top = e.agg(F.max("user_id").alias("top"))
    k = global_rank(e.filter("value > 90").select("event_id", "user_id"), ["event_id"], "k")
    return k.join(F.broadcast(top)).select((F.col("k") + F.col("top")).alias("new_id"), "user_id")


@query(f"WITH {b.POSES}, n AS (SELECT traj, event_id, us, x FROM t) SELECT a.traj, a.event_id, min(c.us) AS end_us FROM n a JOIN n c ON a.traj = c.traj AND c.us > a.us AND abs(c.x - a.x) > 60 AND c.us < a.us + 864000000000 GROUP BY ALL")
def displacement_end(spark, d):
    """First time after a row, within ten days, at which x has moved by over
    60; ten-day buckets make the range an equi-join."""
    t = b.poses(spark, d)
    span = 864_000_000_000
    k = F.floor(F.col("us") / span)
    a = t.select("traj", "event_id", F.col("us").alias("au"), F.col("x").alias("ax"), F.explode(F.array(k, k + 1)).alias("k"))
    met = a.join(t.select("traj", F.col("us").alias("cu"), F.col("x").alias("cx"), k.alias("k")), ["traj", "k"])
    met = met.filter((F.col("cu") > F.col("au")) & (F.col("cu") < F.col("au") + span) & (F.abs(F.col("cx") - F.col("ax")) > 60))
    return met.groupBy("traj", "event_id").agg(F.min("cu").alias("end_us"))


@query("WITH t AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) AS k, unnest(string_split(p_name, ' ')) AS w FROM part) SELECT p_partkey, CAST(k AS INT) AS k, w, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY p_partkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS beg FROM t")
def caption_spans(spark, d):
    words = F.split("p_name", " ")
    k = b.read(spark, d, "part").select("p_partkey", F.explode(F.transform(words, lambda w, i: F.struct((i + 1).alias("k"), w.alias("w"), F.aggregate(F.slice(words, 1, i), F.lit(0), lambda s, v: s + F.length(v) + 1).alias("beg")))).alias("x"))
    return k.select("p_partkey", "x.k", "x.w", "x.beg")


@query("SELECT regr_slope(o_totalprice, o_custkey) IS NOT NULL AS ok, count(*) AS n, o_orderpriority, round(regr_slope(o_totalprice, o_custkey), 4) AS slope, round(regr_intercept(o_totalprice, o_custkey), 1) AS intercept FROM orders GROUP BY o_orderpriority")
def polyfit_lines(spark, d):
    o = b.read(spark, d, "orders").groupBy("o_orderpriority")
    return o.agg(F.regr_slope("o_totalprice", "o_custkey").isNotNull().alias("ok"), F.count("*").alias("n"), F.round(F.regr_slope("o_totalprice", "o_custkey"), 4).alias("slope"), F.round(F.regr_intercept("o_totalprice", "o_custkey"), 1).alias("intercept"))


@query(f"WITH {b.SEGMENTS}, a AS (SELECT seg_id, atan2(y2-y1, x2-x1) AS a, seg_id % 5 AS g FROM s) SELECT g, round(atan2(sum(sin(a)), sum(cos(a))), 5) AS mean FROM a GROUP BY g")
def circular_mean(spark, d):
    s = b.segments(spark, d).select((F.col("seg_id") % 5).alias("g"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("a"))
    return s.groupBy("g").agg(F.round(geo.circular_mean("a"), 5).alias("mean"))


@query(f"WITH {b.SEGMENTS}, a AS (SELECT seg_id, ((degrees(atan2(y2-y1, x2-x1)) % 180) + 180) % 180 AS g FROM s), n AS (SELECT p.seg_id, count(*) AS n FROM a p JOIN a q ON least(abs(p.g-q.g), 180-abs(p.g-q.g)) <= 3 GROUP BY p.seg_id) SELECT max_by(seg_id, n * 1000000 - seg_id) AS seg_id, max(n) AS inliers FROM n")
def angle_inliers(spark, d):
    """The direction with the most others within 3 degrees, met by bins."""
    s = b.segments(spark, d).select("seg_id", geo.angle180("x1", "y1", "x2", "y2").alias("g"))
    k = F.floor(F.col("g") / 3).cast("int")
    p = s.select("seg_id", F.col("g").alias("pg"), F.explode(F.array(*[F.pmod(k + o, F.lit(60)) for o in (-1, 0, 1)])).alias("k"))
    met = p.join(s.select(F.col("g").alias("qg"), k.alias("k")), "k").filter(geo.angle_gap("pg", "qg") <= 3)
    n = met.groupBy("seg_id").agg(F.count("*").alias("n"))
    return n.agg(F.max_by("seg_id", F.struct(F.col("n"), -F.col("seg_id"))).alias("seg_id"), F.max("n").alias("inliers"))


@query(f"WITH {b.BOXES}, k AS (SELECT frame, box_id, cx-w/2 AS x1, cy-h/2 AS y1, cx+w/2 AS x2, cy+h/2 AS y2 FROM b), c AS (SELECT frame, box_id, greatest(x1, -1) AS x1, greatest(y1, -1) AS y1, least(x2, 1) AS x2, least(y2, 1) AS y2 FROM k) SELECT frame, box_id, round((x1+1)*320, 4) AS x1, round((y1+1)*240, 4) AS y1, round((x2+1)*320, 4) AS x2, round((y2+1)*240, 4) AS y2 FROM c WHERE x2 > x1 AND y2 > y1")
def crop_boxes(spark, d):
    """Boxes cropped to a view, scaled to its pixels; those without area go."""
    k = b.boxes(spark, d).select("frame", "box_id", *[c.alias(n) for c, n in zip(geo.to_corners(), ("x1", "y1", "x2", "y2"))])
    one = F.lit(1.0)
    c = k.select("frame", "box_id", F.greatest("x1", -one).alias("x1"), F.greatest("y1", -one).alias("y1"), F.least("x2", one).alias("x2"), F.least("y2", one).alias("y2")).filter("x2 > x1 and y2 > y1")
    return c.select("frame", "box_id", *[F.round((F.col(n) + 1) * s, 4).alias(n) for n, s in (("x1", 320), ("y1", 240), ("x2", 320), ("y2", 240))])


@query(f"WITH {b.POINTS}, q AS (SELECT point_idx, x+2 AS a, y+2 AS b FROM p), g AS (SELECT point_idx, CAST(floor(100 + (degrees(atan2(y, x)))/2) AS INT) AS col, CAST(floor(20 + z*4) AS INT) AS row FROM p) SELECT col, row, max(point_idx) AS point_idx FROM g GROUP BY col, row")
def range_image(spark, d):
    """Azimuth columns and height rows; the last point of a cell stays."""
    g = b.points(spark, d).select("point_idx", F.floor(100 + F.degrees(F.atan2("y", "x")) / 2).cast("int").alias("col"), F.floor(20 + F.col("z") * 4).cast("int").alias("row"))
    return g.groupBy("col", "row").agg(F.max("point_idx").alias("point_idx"))


@query(f"WITH {b.POINTS}, s AS (SELECT point_idx, a.range AS k, 1 - a.range/10.0::DOUBLE AS wa, a.range/10.0::DOUBLE AS wb, x, y FROM p, range(11) a) SELECT point_idx, k, round(2*atan2(sin((0.2::DOUBLE+0.6::DOUBLE*k/10)/2), cos((0.2::DOUBLE+0.6::DOUBLE*k/10)/2)), 6) AS yaw, round(wa*x + wb*y, 6) AS tx FROM s")
def pose_slerp(spark, d):
    """Eleven steps between two turns about z and two places."""
    p = b.points(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(10).cast("bigint"))))
    t = F.col("k") / 10
    q = lambda a: [F.lit(math.cos(a / 2)), F.lit(0.0), F.lit(0.0), F.lit(math.sin(a / 2))]
    r = geo.slerp(q(0.2), q(0.8), t)
    return p.select("point_idx", "k", F.round(2 * F.atan2(r[3], r[0]), 6).alias("yaw"), F.round((1 - t) * F.col("x") + t * F.col("y"), 6).alias("tx"))


@query()
def seeded_sample(spark, d):
    """A hundred points by seeded hash order: a sampling operator."""
    return b.cloud(spark, d).orderBy(F.xxhash64("point_idx", F.lit(42)), "point_idx").limit(100).select("point_idx")


@query(f"WITH RECURSIVE {b.POINTS}, v AS (SELECT CAST(floor(x/0.7) AS INT) AS kx, CAST(floor(y/0.7) AS INT) AS ky, count(*) AS votes, min(point_idx) AS id FROM p GROUP BY 1, 2 HAVING count(*) >= 3), s AS (SELECT a.id AS a, c.id AS b FROM v a JOIN v c ON a.id <> c.id AND (a.kx-c.kx)*(a.kx-c.kx)+(a.ky-c.ky)*(a.ky-c.ky) <= 1), w(id, root) AS (SELECT id, id FROM v UNION SELECT s.b, w.root FROM w JOIN s ON s.a = w.id), m AS (SELECT id, min(root) AS root FROM w GROUP BY id) SELECT root, max(votes) AS votes FROM m JOIN v USING (id) GROUP BY root")
def pose_nms(spark, d):
    """Vote bins near one another form groups; each shows its best count."""
    v = b.points(spark, d).groupBy(F.floor(F.col("x") / 0.7).cast("int").alias("kx"), F.floor(F.col("y") / 0.7).cast("int").alias("ky")).agg(F.count("*").alias("votes"), F.min("point_idx").alias("id")).filter("votes >= 3")
    pairs = cells.radius_self_join(v.select("id", F.col("kx").cast("double").alias("x"), F.col("ky").cast("double").alias("y")), 1.0, "id", "xy").select(F.col("id").alias("a"), F.col("id_2").alias("b"))
    root = graph.components(v.select(F.col("id").alias("node")), pairs)
    return v.join(root.withColumnRenamed("node", "id"), "id").groupBy("root").agg(F.max("votes").alias("votes"))
