"""Voxel maps of planes, look-ups by box and frustum, and graph tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.functions import geometry as geo
from scenelake.operators import voxelmap as op

from . import points  # noqa: F401
from .registry import ORACLES, QUERIES, query

KEYED = f"WITH RECURSIVE {b.POINTS}, k AS (SELECT *, CAST(floor(x) AS INT) AS vx, CAST(floor(y) AS INT) AS vy, CAST(floor(z) AS INT) AS vz FROM p)"


@query(
    f"""WITH {b.POINTS}, v AS (SELECT CAST(floor(x/0.5) AS INT) AS vx, CAST(floor(y/0.5) AS INT) AS vy, CAST(floor(z/0.5) AS INT) AS vz, count(*) AS n FROM p GROUP BY ALL), o AS (SELECT unnest([0, 1]) AS o),
 c AS (SELECT vx, vy, vz, n, (vx+i.o)*0.5 - 0.53 AS x, (vy+j.o)*0.5 - 0.02 AS y, (vz+l.o)*0.5 - 0.01 AS z FROM v, o i, o j, o l) SELECT DISTINCT vx, vy, vz, n FROM c WHERE abs(x*0.8 + y*0.6) <= 1.5 AND abs(y*0.8 - x*0.6) <= 1 AND abs(z) <= 1"""
)
def voxels_in_obb(spark, d):
    return op.voxels_in_obb(b.points(spark, d), 0.5, (0.53, 0.02, 0.01), ((0.8, 0.6, 0), (-0.6, 0.8, 0), (0, 0, 1)), (3, 2, 2))


@query(
    f"""WITH {b.POINTS}, z AS (SELECT 0.5 + range*0.25::DOUBLE AS z FROM range(14)), w AS (SELECT z, z/500.0::DOUBLE*640 AS w, z/500.0::DOUBLE*480 AS h FROM z),
 x AS (SELECT z, h, -w/2 + unnest(range(0, 2*(CAST(trunc(w/0.5) AS INT)+1)))*0.25::DOUBLE AS x FROM w), g AS (SELECT z, x, -h/2 + unnest(range(0, 2*(CAST(trunc(h/0.5) AS INT)+1)))*0.25::DOUBLE AS y FROM x),
 s AS (SELECT DISTINCT CAST(floor((x*0.8 - z*0.6 + 0.11)/0.5) AS INT) AS vx, CAST(floor((y + 0.07)/0.5) AS INT) AS vy, CAST(floor((x*0.6 + z*0.8 - 1.93)/0.5) AS INT) AS vz FROM g),
 v AS (SELECT CAST(floor(x/0.5) AS INT) AS vx, CAST(floor(y/0.5) AS INT) AS vy, CAST(floor(z/0.5) AS INT) AS vz, count(*) AS n FROM p GROUP BY ALL) SELECT vx, vy, vz, n FROM v SEMI JOIN s USING (vx, vy, vz)"""
)
def frustum_cells(spark, d):
    pose = (0.8, 0, -0.6, 0.11, 0, 1, 0, 0.07, 0.6, 0, 0.8, -1.93, 0, 0, 0, 1)
    return op.frustum_cells(b.points(spark, d), 0.5, pose, 500, 500, 640, 480, 0.5, 4.0)


def level(p):
    """Level planes of unit cells, with the variances of their fit."""
    k = p.withColumns({f"v{a}": op.cell(a, 1.0) for a in "xyz"})
    v = F.var_pop("z")
    g = k.groupBy(*op.KEYS).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"c{a}") for a in "xyz"], F.sqrt(F.greatest(F.var_pop("x"), F.var_pop("y"))).alias("radius"), (v / F.count("*")).alias("pvar")).filter("n >= 5")
    return g.withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0), "d": -F.col("cz"), "tvar": F.lit(0.001)})


def lean(a: str) -> str:
    return f"v{a} + CASE WHEN {a}-(v{a}+0.5) > 0.25 THEN 1 WHEN {a}-(v{a}+0.5) < -0.25 THEN -1 ELSE 0 END"


@query(
    f"""{KEYED}, q AS (SELECT vx, vy, vz, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sqrt(greatest(var_pop(x), var_pop(y))) AS radius, var_pop(z)/count(*) AS pv FROM k GROUP BY ALL HAVING count(*) >= 5),
 c AS (SELECT point_idx, x, y, z, 0 AS step, vx, vy, vz FROM k UNION ALL SELECT point_idx, x, y, z, 1, {lean('x')}, {lean('y')}, {lean('z')} FROM k),
 m AS (SELECT point_idx, step, vx, vy, vz, radius, pv, abs(z-cz) AS dist, (x-cx)*(x-cx)+(y-cy)*(y-cy) AS r2 FROM c JOIN q USING (vx, vy, vz)), s AS (SELECT *, 0.01+pv+0.001*r2 AS s FROM m),
 r AS (SELECT *, exp(-0.5*dist*dist/s)/sqrt(s) AS prob FROM s WHERE sqrt(r2) <= 3*radius AND dist < 3*sqrt(s)) SELECT point_idx, vx, vy, vz, round(dist, 5) AS dist, round(prob, 5) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY point_idx ORDER BY step, prob DESC) AS k FROM r) WHERE k = 1"""
)
def point_plane_match(spark, d):
    p = b.points(spark, d)
    return op.match_planes(p, level(p), 1.0, 0.01).withColumns({c: F.round(c, 5) for c in ("dist", "prob")})


@query(
    f"""{KEYED}, q AS (SELECT vx, vy, vz, label % 2 AS main, avg(z) AS a, avg(r) AS b, avg(x) AS d, var_pop(z)+0.01 AS va, var_pop(r)+0.01 AS vb, var_pop(x)+0.01 AS vd, ((vx+1048576)::BIGINT*4398046511104 + (vy+1048576)::BIGINT*2097152 + (vz+1048576)) AS node FROM (SELECT *, min(label) OVER (PARTITION BY vx, vy, vz) AS l0 FROM k) WHERE label = l0 GROUP BY ALL),
 e AS (SELECT u.node AS a, w.node AS b FROM q u JOIN q w ON u.main = w.main AND abs(u.vx-w.vx)+abs(u.vy-w.vy)+abs(u.vz-w.vz) = 1 WHERE (abs(u.a-w.a) < 0.4 AND abs(u.b-w.b) < 0.4) OR sqrt((u.a-w.a)*(u.a-w.a)/(u.va+w.va) + (u.b-w.b)*(u.b-w.b)/(u.vb+w.vb) + (u.d-w.d)*(u.d-w.d)/(u.vd+w.vd)) < 0.5),
 t(node, root) AS (SELECT node, node FROM q UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node), r AS (SELECT node, min(root) AS root FROM t GROUP BY node), f AS (SELECT *, 1/sqrt(va*va+vb*vb+vd*vd) AS w FROM q JOIN r USING (node))
 SELECT root, main, count(*) AS n_cells, round(sum(a*w)/sum(w), 5) AS a, round(sum(b*w)/sum(w), 5) AS b, round(sum(d*w)/sum(w), 5) AS d FROM f GROUP BY root, main"""
)
def merged_planes(spark, d):
    k = b.points(spark, d).withColumns({f"v{a}": op.cell(a, 1.0) for a in "xyz"})
    least = k.groupBy(*op.KEYS).agg(F.min("label").alias("label"))
    v = lambda c: (F.var_pop(c) + 0.01)
    q = k.join(least, [*op.KEYS, "label"]).groupBy(*op.KEYS, (F.col("label") % 2).alias("main")).agg(F.avg("z").alias("a"), F.avg("r").alias("b"), F.avg("x").alias("d"), v("z").alias("va"), v("r").alias("vb"), v("x").alias("vd"))
    return op.merge_planes(q, 0.4, 0.5).withColumns({c: F.round(c, 5) for c in "abd"})


@query(f"WITH c AS ({ORACLES['dbscan']}) SELECT * FROM c WHERE cluster IN (SELECT cluster FROM c GROUP BY cluster HAVING count(*) >= 8)")
def cluster_size_filter(spark, d):
    return op.large_clusters(QUERIES["dbscan"](spark, d), 8)


@query("SELECT vec_id AS box_id, array_to_string(list_filter(range(len(embedding)), lambda i: embedding[i+1] > 0.15), ',') AS tokens FROM embeddings WHERE embedding[5] > 0.05")
def confident_boxes(spark, d):
    e = b.read(spark, d, "embeddings").select(F.col("vec_id").alias("box_id"), F.col("embedding")[4].alias("score"), F.col("embedding").alias("tokens"))
    return op.confident(e, "tokens", 0.05, 0.15).select("box_id", F.array_join("tokens", ",").alias("tokens"))


@query(f"WITH {b.POINTS}, m AS (SELECT point_idx AS src, (point_idx*7+3) % 1500 AS ref FROM p) SELECT src, ref, a.label AS src_instance, c.label AS ref_instance, round(c.x-a.x, 5) AS dx FROM m JOIN p a ON a.point_idx = src JOIN p c ON c.point_idx = ref")
def node_matches(spark, d):
    p = b.points(spark, d)
    nodes = p.select(F.col("point_idx").alias("node"), F.col("label").alias("instance"), "x", "y", "z")
    m = p.select(F.col("point_idx").alias("src"), ((F.col("point_idx") * 7 + 3) % 1500).alias("ref"))
    return op.node_matches(m, nodes, nodes).select("src", "ref", "src_instance", "ref_instance", F.round(F.col("ref_x") - F.col("src_x"), 5).alias("dx"))


TURN = "(x{1}-x{0})*((gy+0.5)*0.25-y{0}) - (y{1}-y{0})*((gx+0.5)*0.25-x{0})"


@query(
    f"""WITH t AS (SELECT label, {', '.join(f'CAST(embedding[{2*k+1}] AS DOUBLE)*10 AS x{k+1}, CAST(embedding[{2*k+2}] AS DOUBLE)*10 AS y{k+1}' for k in range(3))} FROM embeddings), u AS (SELECT *, unnest(range(CAST(floor(least(x1,x2,x3)/0.25) AS INT), CAST(floor(greatest(x1,x2,x3)/0.25) AS INT)+1)) AS gx FROM t),
 v AS (SELECT *, unnest(range(CAST(floor(least(y1,y2,y3)/0.25) AS INT), CAST(floor(greatest(y1,y2,y3)/0.25) AS INT)+1)) AS gy FROM u), s AS (SELECT label, gx, gy, {TURN.format(1, 2)} AS a, {TURN.format(2, 3)} AS b, {TURN.format(3, 1)} AS c FROM v)
 SELECT label, count(*)*0.0625::DOUBLE AS area FROM (SELECT DISTINCT label, gx, gy FROM s WHERE (a >= 0 AND b >= 0 AND c >= 0) OR (a <= 0 AND b <= 0 AND c <= 0)) GROUP BY label"""
)
def union_area(spark, d):
    t = b.read(spark, d, "embeddings").select("label", *[b.dim(2 * k + i).alias(f"{a}{k + 1}") for k in range(3) for i, a in enumerate("xy")])
    return op.union_area(t, "label", 0.25)


@query(f"WITH {b.POINTS} SELECT DISTINCT CAST(floor(x) AS INT) AS vx, CAST(floor(y) AS INT) AS vy FROM p WHERE label % 2 = 0 INTERSECT SELECT CAST(floor(x) AS INT), CAST(floor(y) AS INT) FROM p WHERE label % 2 = 1")
def common_keys(spark, d):
    k = b.points(spark, d).select("label", op.cell("x", 1.0).alias("vx"), op.cell("y", 1.0).alias("vy"))
    return op.common_keys(k.filter("label % 2 = 0"), k.filter("label % 2 = 1"), ["vx", "vy"])


@query(f"WITH {b.CLOUD}, g AS (SELECT x, z, floor(x/2.0+0.5) AS a, floor(z/2.0+0.5) AS b FROM c) SELECT m.x AS x, m.z AS z FROM (SELECT min({{'x': x, 'z': z}}) AS m FROM g GROUP BY a, b)")
def distinct_matches(spark, d):
    return op.distinct_matches(b.cloud(spark, d), ["x", "z"], 2.0)


@query(
    """WITH RECURSIVE t AS (SELECT DISTINCT user_id AS traj, epoch_us(ts)//86400000000 AS frame FROM events), n AS (SELECT t.traj, t.frame, min(u.frame) AS nxt FROM t JOIN t u ON u.traj = t.traj AND u.frame >= t.frame + 20 GROUP BY ALL),
 u AS (SELECT traj, min(frame) AS frame FROM t GROUP BY traj UNION ALL SELECT n.traj, n.nxt FROM u JOIN n ON n.traj = u.traj AND n.frame = u.frame) SELECT traj, CAST(frame AS BIGINT) AS frame FROM u"""
)
def periodic_updates(spark, d):
    f = b.poses(spark, d).select("traj", F.floor(F.col("us") / 86400000000).alias("frame"))
    return op.periodic(f, "traj", "frame", 20)


NAME = "CASE label % 5 WHEN 0 THEN 'floor' WHEN 1 THEN 'carpet' WHEN 2 THEN 'ceiling' ELSE 'wall' END"


@query(f"WITH {b.POINTS}, q AS (SELECT point_idx AS instance_id, {NAME} AS label FROM p) SELECT label, instance_id FROM q WHERE label <> 'wall'")
def floor_dictionary(spark, d):
    return op.floor_instances(b.points(spark, d).select(F.col("point_idx").alias("instance_id"), F.expr(NAME).alias("label")))


@query(f"WITH {b.POINTS}, n AS (SELECT DISTINCT label AS node, label*10 AS instance FROM p WHERE label % 3 <> 0) SELECT n.node, n.instance, count(*) AS n, round(avg(x), 5) AS x FROM p JOIN n ON n.node = p.label GROUP BY ALL")
def graph_points(spark, d):
    p = b.points(spark, d).withColumnRenamed("label", "node")
    at = lambda ts, keep: p.filter(keep).select(F.lit(ts).alias("ts"), "node", (F.col("node") * 10).alias("instance")).distinct()
    nodes = op.ingest(op.ingest(at(1.0, "node = 1"), at(2.0, "node % 3 <> 0")), at(2.005, "node = 2"))
    return op.dense_points(nodes, p).groupBy("node", "instance").agg(F.count("*").alias("n"), F.round(F.avg("x"), 5).alias("x"))


UNIT = "SELECT label, x1 AS sx, y1 AS sy, (x2-x1)/l AS sdx, (y2-y1)/l AS sdy, cos(0.3)*x1 - sin(0.3)*y1 + 0.5 AS tx, sin(0.3)*x1 + cos(0.3)*y1 - 0.25 + 0.01*(seg_id % 3) AS ty, cos(0.3)*(x2-x1)/l - sin(0.3)*(y2-y1)/l AS tdx, sin(0.3)*(x2-x1)/l + cos(0.3)*(y2-y1)/l AS tdy"


@query(
    f"""WITH {b.SEGMENTS}, m AS (SELECT s.*, label, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS l FROM s JOIN embeddings ON vec_id = seg_id), u AS ({UNIT} FROM m), w AS (SELECT label, atan2(sum(sdx*tdy-sdy*tdx), sum(sdx*tdx+sdy*tdy)) AS yaw FROM u GROUP BY label),
 v AS (SELECT u.*, yaw, cos(yaw)*sx - sin(yaw)*sy - tx AS ex, sin(yaw)*sx + cos(yaw)*sy - ty AS ey FROM u JOIN w USING (label)), n AS (SELECT label, yaw, sum(1-tdx*tdx) AS a, sum(-tdx*tdy) AS b, sum(1-tdy*tdy) AS c, sum(-((1-tdx*tdx)*ex - tdx*tdy*ey)) AS p, sum(-(-tdx*tdy*ex + (1-tdy*tdy)*ey)) AS q FROM v GROUP BY ALL)
 SELECT label, round((p*c-q*b)/(a*c-b*b), 5) AS x, round((q*a-p*b)/(a*c-b*b), 5) AS y, round(yaw, 5) AS yaw FROM n"""
)
def line_registration(spark, d):
    s = b.segments(spark, d).join(b.points(spark, d).select(F.col("point_idx").alias("seg_id"), "label"), "seg_id").withColumn("l", geo.length("x1", "y1", "x2", "y2"))
    return op.register_lines(s.selectExpr(*UNIT.removeprefix("SELECT ").split(", ")), "label").select("label", *[F.round(c, 5).alias(c) for c in ("x", "y", "yaw")])


@query(f"WITH {b.POINTS}, g AS (SELECT CAST(floor(x/0.3) AS INT) AS vx, CAST(floor(y/0.3) AS INT) AS vy, CAST(floor(z/0.3) AS INT) AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1, 2, 3) SELECT vx, vy, vz, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM g WHERE z < 0.01")
def free_cells(spark, d):
    return op.free_cells(b.points(spark, d)).withColumns({a: F.round(a, 5) for a in "xyz"})


@query(f"WITH {b.POINTS}, m AS (SELECT label, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(r) AS wx FROM p GROUP BY label) SELECT label, n, round(-x/sqrt(x*x+y*y+z*z)*9.81, 5) AS gx, round(-z/sqrt(x*x+y*y+z*z)*9.81, 5) AS gz, round(wx, 5) AS wx FROM m")
def imu_rest_state(spark, d):
    s = b.points(spark, d).select("label", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), F.col("r").alias("wx"), F.col("g").alias("wy"), F.col("b").alias("wz"))
    return op.rest_state(s, "label").select("label", "n", *[F.round(c, 5).alias(c) for c in ("gx", "gz", "wx")])


@query(
    f"""WITH {b.POSES}, a AS (SELECT traj, event_id, us, us/86400000000.0::DOUBLE AS t, x FROM t), l AS (SELECT *, coalesce(t - lag(t) OVER w, 0) AS dt, coalesce(lag(x) OVER w, 0) AS acc FROM a WINDOW w AS (PARTITION BY traj ORDER BY us, event_id)),
 s AS (SELECT *, sum(acc*dt) OVER w AS speed FROM l WINDOW w AS (PARTITION BY traj ORDER BY us, event_id)), v AS (SELECT *, coalesce(lag(speed) OVER w, 0)*dt + 0.5*acc*dt*dt AS way FROM s WINDOW w AS (PARTITION BY traj ORDER BY us, event_id))
 SELECT event_id, round(speed, 3) AS speed, round(sum(way) OVER (PARTITION BY traj ORDER BY us, event_id), 2) AS way FROM v"""
)
def imu_propagation(spark, d):
    s = b.poses(spark, d).select("traj", "event_id", "us", (F.col("us") / F.lit(86400000000.0)).alias("t"), F.col("x").alias("acc"), F.lit(0.0).alias("rate"))
    return op.propagated(s, ["traj"], ["us", "event_id"]).select("event_id", F.round("speed", 3).alias("speed"), F.round("way", 2).alias("way"))
