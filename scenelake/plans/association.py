"""Matching, label fusion and merging over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.operators import association as op
from scenelake.operators import graph
from scenelake.operators.cells import containment

from .registry import query

IOU = f"""WITH {b.SETS}, x AS (SELECT frame, det, inst, count(*) AS n_inter FROM d JOIN i USING (point) GROUP BY ALL),
 da AS (SELECT frame, det, count(*) AS a FROM d GROUP BY ALL), ia AS (SELECT inst, count(*) AS b FROM i GROUP BY ALL),
 m AS (SELECT frame, det, inst, n_inter, n_inter / (a + b - n_inter) AS iou FROM x JOIN da USING (frame, det) JOIN ia USING (inst)),
 k AS (SELECT *, row_number() OVER (PARTITION BY frame, det ORDER BY iou DESC, inst) AS r, row_number() OVER (PARTITION BY frame, inst ORDER BY iou DESC, det) AS c FROM m)
"""


def matrix(spark, d):
    return op.iou_matrix(b.detections(spark, d), b.instances(spark, d))


@query(IOU + "SELECT frame, det, inst, n_inter, round(iou, 6) AS iou FROM m")
def iou_matrix(spark, d):
    return matrix(spark, d).withColumn("iou", F.round("iou", 6))


@query(IOU + "SELECT frame, det, inst, n_inter, round(iou, 6) AS iou FROM k WHERE r = 1 AND c = 1 AND iou > 0.3")
def iou_mutual_best(spark, d):
    return op.mutual_best(matrix(spark, d), 0.3).withColumn("iou", F.round("iou", 6))


@query(IOU + "SELECT x.frame, x.det, x.inst AS best, y.inst AS second FROM k x JOIN k y ON x.frame = y.frame AND x.det = y.det AND x.r = 1 AND y.r = 2 WHERE x.iou - y.iou <= 0.05")
def ambiguous_pairs(spark, d):
    return op.ambiguous(matrix(spark, d), 0.05)


@query(f"WITH {b.SETS} SELECT inst, count(*) AS observed FROM i WHERE point IN (SELECT point FROM d WHERE det = 'click') GROUP BY inst")
def observed_semi_join(spark, d):
    seen = b.detections(spark, d).filter("det = 'click'").select("point")
    return b.instances(spark, d).join(seen, "point", "left_semi").groupBy("inst").agg(F.count("*").alias("observed"))


@query(f"WITH {b.SETS} SELECT DISTINCT point FROM d WHERE point NOT IN (SELECT point FROM i WHERE inst LIKE '%purchase' AND point % 3 <> 0)")
def removed_anti_join(spark, d):
    gone = b.instances(spark, d).filter(F.col("inst").endswith("purchase") & (F.col("point") % 3 != 0)).select("point")
    return b.detections(spark, d).select("point").distinct().join(gone, "point", "left_anti")


@query(f"WITH {b.SETS}, u AS (SELECT point FROM d WHERE det = 'click' UNION SELECT point FROM i WHERE inst LIKE '%view'), n AS (SELECT point FROM d WHERE det = 'click' INTERSECT SELECT point FROM d WHERE det = 'purchase'), x AS (SELECT point FROM d EXCEPT SELECT point FROM n) SELECT (SELECT count(*) FROM u) AS n_union, (SELECT count(*) FROM n) AS n_inter, (SELECT count(*) FROM x) AS n_except")
def point_set_operations(spark, d):
    dets, insts = b.detections(spark, d), b.instances(spark, d)
    a = dets.filter("det = 'click'").select("point")
    union = a.union(insts.filter(F.col("inst").endswith("view")).select("point")).distinct()
    inter = a.intersect(dets.filter("det = 'purchase'").select("point"))
    minus = dets.select("point").subtract(inter)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(union, "n_union").join(count(inter, "n_inter")).join(count(minus, "n_except"))


LABELS = f"WITH {b.OBSERVED}, l AS (SELECT instance_id, label, sum(score) AS score, count(*) AS n FROM o GROUP BY ALL)"


@query(LABELS + " SELECT instance_id, label, round(score, 4) AS score, n FROM l")
def label_fusion(spark, d):
    return op.label_sums(b.observations(spark, d)).withColumn("score", F.round("score", 4))


@query(LABELS + " SELECT instance_id, label, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, label) AS k FROM l) WHERE k = 1")
def label_argmax(spark, d):
    return op.label_argmax(op.label_sums(b.observations(spark, d))).select("instance_id", "label", F.round("score", 4).alias("score"))


@query(
    LABELS
    + """, u AS (SELECT DISTINCT instance_id, label FROM o), t AS (SELECT label, count(*) AS t FROM u GROUP BY label),
 q AS (SELECT a.label AS measured, c.label AS predicted, count(*) / any_value(t) AS p FROM u a JOIN u c USING (instance_id) JOIN t ON t.label = a.label GROUP BY ALL),
 v AS (SELECT instance_id, predicted, sum(score * p) AS s FROM o JOIN q ON measured = label GROUP BY ALL)
 SELECT instance_id, predicted, round(s / sqrt(sum(s * s) OVER (PARTITION BY instance_id)), 6) AS p FROM v"""
)
def bayes_vector(spark, d):
    obs = b.observations(spark, d)
    u = obs.select("instance_id", "label").distinct()
    total = u.groupBy(F.col("label").alias("measured")).agg(F.count("*").alias("t"))
    both = u.withColumnRenamed("label", "measured").join(u.withColumnRenamed("label", "predicted"), "instance_id").groupBy("measured", "predicted").agg(F.count("*").alias("n"))
    likelihood = both.join(total, "measured").select("measured", "predicted", (F.col("n") / F.col("t")).alias("p"))
    return op.bayes_vector(obs, likelihood).withColumn("p", F.round("p", 6))


@query(LABELS + " SELECT instance_id, string_agg(label || '(' || printf('%.2f', score) || ')', ',' ORDER BY label) AS labels FROM l GROUP BY instance_id")
def label_json(spark, d):
    sums = op.label_sums(b.observations(spark, d))
    item = F.struct("label", F.concat("label", F.lit("("), F.format_string("%.2f", "score"), F.lit(")")).alias("s"))
    return sums.groupBy("instance_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), ",").alias("labels"))


NODES = """n AS (SELECT CAST(label AS BIGINT) AS instance_id, count(*) AS n, avg(CAST(embedding[1] AS DOUBLE)*10) AS x, avg(CAST(embedding[2] AS DOUBLE)*10) AS y, avg(CAST(embedding[3] AS DOUBLE)*10) AS z FROM embeddings GROUP BY label)"""


def places(spark, d):
    return b.points(spark, d).groupBy(F.col("label").cast("bigint").alias("instance_id")).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in "xyz"])


@query(f"WITH {NODES}, m AS (SELECT *, CASE WHEN instance_id % 2 = 0 THEN 'floor' ELSE 'chair' END AS label FROM n), r AS (SELECT * FROM m WHERE label = 'floor' ORDER BY n DESC, instance_id LIMIT 1) SELECT m.instance_id, r.instance_id AS root FROM m, r WHERE m.label = 'floor' AND r.n >= 10 AND abs(m.z - r.z) < 1.0")
def structural_merge(spark, d):
    p = places(spark, d).withColumn("label", F.when(F.col("instance_id") % 2 == 0, "floor").otherwise("chair"))
    return op.structural_merge(p, ["floor", "carpet"], 1.0, 10)


@query(f"WITH {NODES}, l AS (SELECT instance_id, instance_id % 3 AS label FROM n WHERE n >= 5) SELECT DISTINCT a.instance_id AS i, c.instance_id AS j FROM l a JOIN l c ON a.label = c.label AND a.instance_id < c.instance_id JOIN n p ON p.instance_id = a.instance_id JOIN n q ON q.instance_id = c.instance_id WHERE (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z) <= 9.0")
def share_label_pairs(spark, d):
    p = places(spark, d)
    return op.share_label_pairs(p.select("instance_id", (F.col("instance_id") % 3).alias("label")), p, 5, 3.0)


@query(f"WITH {b.POINTS}, v AS (SELECT label, CAST(floor(x/0.5) AS INT) AS vx, CAST(floor(y/0.5) AS INT) AS vy, CAST(floor(z/0.5) AS INT) AS vz FROM p), g AS (SELECT DISTINCT label AS b, vx, vy, vz FROM v), t AS (SELECT label AS a, count(*) AS total FROM v GROUP BY label), q AS (SELECT label AS a, b, count(*) AS inside FROM v JOIN g USING (vx, vy, vz) GROUP BY ALL) SELECT a, b, inside, total, round(inside / total, 6) AS ratio FROM q JOIN t USING (a)")
def containment_ratio(spark, d):
    p = b.points(spark, d)
    return containment(p.select(F.col("label").alias("a"), "x", "y", "z"), p.select(F.col("label").alias("b"), "x", "y", "z"), 0.5)


@query(
    f"""WITH {b.POINTS}, x AS (SELECT label AS instance_id, count(*) AS n, avg(x)-0.6 AS lx, avg(x)+0.6 AS hx, avg(y)-0.6 AS ly, avg(y)+0.6 AS hy, avg(z)-0.6 AS lz, avg(z)+0.6 AS hz FROM p GROUP BY label)
 SELECT point_idx, instance_id FROM (SELECT point_idx, instance_id, row_number() OVER (PARTITION BY point_idx ORDER BY n, instance_id) AS k FROM p JOIN x ON p.x BETWEEN lx AND hx AND p.y BETWEEN ly AND hy AND p.z BETWEEN lz AND hz) WHERE k = 1"""
)
def greedy_fill(spark, d):
    p = b.points(spark, d)
    box = p.groupBy(F.col("label").alias("instance_id")).agg(F.count("*").alias("n"), *[(F.avg(a) + s * 0.6).alias(f"{k}{a}") for a in "xyz" for k, s in (("l", -1), ("h", 1))])
    return op.greedy_fill(box, p)


@query(f"WITH {NODES} SELECT instance_id, CAST((instance_id >> 16) & 255 AS INT) AS red, CAST((instance_id >> 8) & 255 AS INT) AS green, CAST(instance_id & 255 AS INT) AS blue FROM (SELECT instance_id * 70001 AS instance_id FROM n)")
def id_color(spark, d):
    from scenelake.functions.geometry import id_color as colours

    p = places(spark, d).select((F.col("instance_id") * 70001).alias("instance_id"))
    return p.select("instance_id", *[c.alias(k) for k, c in zip(("red", "green", "blue"), colours("instance_id"))])


@query(f"WITH {NODES} SELECT instance_id FROM n WHERE sqrt(x*x + y*y + z*z) <= 0.5 AND n > 3")
def active_instances_radius(spark, d):
    return places(spark, d).filter((F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) <= 0.5) & (F.col("n") > 3)).select("instance_id")


GRAPH = f"WITH {b.POINTS}, g AS (SELECT point_idx AS node_id, CASE point_idx % 7 WHEN 0 THEN 'wall' WHEN 1 THEN 'floor' WHEN 2 THEN 'ceiling' ELSE 'chair' END AS semantic, x*3 AS x, y*3 AS y, z*3 AS z, 0.5 + (point_idx % 4) AS radius FROM p)"
EDGES = """, e AS (SELECT a.node_id AS i, c.node_id AS j, sqrt((a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z)) AS dist,
 greatest(1.0, least(2.0, 0.6 * greatest(CASE WHEN a.semantic = 'wall' THEN 1.0 ELSE a.radius END, CASE WHEN c.semantic = 'wall' THEN 1.0 ELSE c.radius END))) AS reach
 FROM g a JOIN g c ON a.node_id < c.node_id WHERE a.semantic NOT IN ('floor','ceiling') AND c.semantic NOT IN ('floor','ceiling'))"""


def nodes(spark, d):
    k = F.col("point_idx") % 7
    semantic = F.when(k == 0, "wall").when(k == 1, "floor").when(k == 2, "ceiling").otherwise("chair")
    return b.points(spark, d).select(F.col("point_idx").alias("node_id"), semantic.alias("semantic"), *[(F.col(a) * 3).alias(a) for a in "xyz"], (F.lit(0.5) + F.col("point_idx") % 4).alias("radius"))


@query(GRAPH + EDGES + " SELECT i, j, round(dist, 4) AS dist FROM e WHERE dist < reach")
def graph_edges(spark, d):
    return graph.graph_edges(nodes(spark, d), 0.6, 1.0, 2.0).withColumn("dist", F.round("dist", 4))


@query(GRAPH + " SELECT node_id, floor_id FROM (SELECT a.node_id, f.node_id AS floor_id, row_number() OVER (PARTITION BY a.node_id ORDER BY (a.x-f.x)*(a.x-f.x)+(a.y-f.y)*(a.y-f.y)+(a.z-f.z)*(a.z-f.z), f.node_id) AS k FROM g a JOIN g f ON f.semantic = 'floor' AND a.node_id <> f.node_id) WHERE k = 1")
def nearest_floor(spark, d):
    n = nodes(spark, d)
    return graph.nearest(n, n.filter("semantic = 'floor'"))


@query(GRAPH + EDGES + ", h AS (SELECT i, j FROM e WHERE dist < reach), s AS (SELECT i AS centre, j AS a FROM h UNION ALL SELECT j, i FROM h) SELECT s.centre, s.a, t.a AS b FROM s JOIN s t ON s.centre = t.centre AND s.a < t.a")
def graph_triplets(spark, d):
    return graph.triplets(graph.graph_edges(nodes(spark, d), 0.6, 1.0, 2.0))


PAIRS = f"""WITH RECURSIVE {b.POINTS}, h AS (SELECT a.point_idx AS i, c.point_idx AS j FROM p a JOIN p c ON a.point_idx < c.point_idx WHERE (a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z) <= 0.25),
 s AS (SELECT i AS a, j AS b FROM h UNION ALL SELECT j, i FROM h)"""


@query(PAIRS + ", w(node, root) AS (SELECT point_idx, point_idx FROM p UNION SELECT s.b, w.root FROM w JOIN s ON s.a = w.node) SELECT node, min(root) AS root FROM w GROUP BY node")
def connected_components(spark, d):
    from scenelake.operators.cells import radius_self_join

    p = b.points(spark, d)
    pairs = radius_self_join(p, 0.5).select(F.col("point_idx").alias("a"), F.col("point_idx_2").alias("b"))
    return graph.components(p.select(F.col("point_idx").alias("node")), pairs)


@query(
    PAIRS
    + """, q AS (SELECT a, count(*) AS n FROM s GROUP BY a), k AS (SELECT a AS node FROM q WHERE n + 1 >= 5), u AS (SELECT s.a, s.b FROM s JOIN k x ON x.node = s.a JOIN k y ON y.node = s.b),
 w(node, root) AS (SELECT node, node FROM k UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.node), m AS (SELECT node, min(root) AS root FROM w GROUP BY node)
 SELECT node AS point_idx, root AS cluster, true AS core FROM m UNION ALL SELECT s.a, min(m.root), false FROM s JOIN m ON m.node = s.b WHERE s.a NOT IN (SELECT node FROM k) GROUP BY s.a"""
)
def dbscan(spark, d):
    return graph.dbscan(b.points(spark, d), 0.5, 5)


@query("""WITH q AS (SELECT p_partkey, p_name, p_retailprice, p_size FROM part), o AS (SELECT p_partkey, p_name || '*' AS p_name, p_retailprice * 2 AS p_retailprice, p_size + (p_partkey % 3) - 1 AS p_size FROM part WHERE p_partkey % 2 = 0)
 SELECT coalesce(q.p_partkey, o.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NOT NULL AND (q.p_partkey IS NULL OR o.p_size > q.p_size) THEN o.p_name ELSE q.p_name END AS p_name FROM q FULL JOIN o ON q.p_partkey = o.p_partkey""")
def upsert_last_writer(spark, d):
    from scenelake.sources.sinks import upsert

    q = b.read(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").alias("version"))
    o = q.filter(F.col("p_partkey") % 2 == 0).select("p_partkey", F.concat("p_name", F.lit("*")).alias("p_name"), (F.col("version") + F.col("p_partkey") % 3 - 1).alias("version"))
    return upsert(q, o, ["p_partkey"], "version").select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paging(spark, d):
    from scenelake.sources.sinks import page

    return page(b.read(spark, d, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 40, 20).select("o_orderkey", "o_custkey")
