"""Frame intake and the instances' life over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.operators import frames as op

from .registry import query


@query("WITH p AS (SELECT l_orderkey AS k, count(*) AS n_entries, max(l_linenumber) AS top_label FROM lineitem GROUP BY 1) SELECT 'frame' || CAST(k AS VARCHAR) AS frame, n_entries, CAST(top_label AS BIGINT) AS top_label FROM p WHERE n_entries >= 2 AND n_entries = top_label")
def frame_intake(spark, d):
    g = b.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_entries"), F.max("l_linenumber").cast("bigint").alias("top_label"))
    name = lambda end: F.concat(F.lit("run/frame"), F.col("l_orderkey").cast("string"), F.lit(end)).alias("name")
    return op.intake(g.select(name(".json"), "n_entries"), g.select(name(".png"), "top_label"))


@query("SELECT o_orderkey, c_name, CAST(row_number() OVER (ORDER BY o_custkey % 2, o_orderkey) AS BIGINT) AS place FROM orders JOIN customer ON c_custkey = o_orderkey")
def frame_table(spark, d):
    images = b.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 2).alias("camera"), F.concat(F.lit("cam/im"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("name"))
    poses = b.read(spark, d, "customer").select(F.concat(F.lit("im"), F.col("c_custkey").cast("string")).alias("name"), "c_name")
    return op.frame_table(images, poses).select("o_orderkey", "c_name", "place")


@query("SELECT o_orderkey, p_name FROM orders JOIN part ON p_partkey = o_orderkey")
def bigint_merge_join(spark, d):
    a = b.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("000"), F.col("o_orderkey").cast("string")).alias("ts"))
    return op.by_big_integer(a, b.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("ts"), "p_name"), "ts").select("o_orderkey", "p_name")


@query("WITH a AS (SELECT o_orderkey AS rgb, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_custkey % 2 = 0), c AS (SELECT o_orderkey AS depth, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_custkey % 2 = 1) SELECT place, rgb, depth FROM a JOIN c USING (place) WHERE place <= 6000")
def rgbd_pairs(spark, d):
    """Two cameras' frames by order; the format takes 6,000 at most."""
    o = b.read(spark, d, "orders")
    a, c = (o.filter(F.col("o_custkey") % 2 == k).select(F.col("o_orderkey").alias(n)) for k, n in ((0, "rgb"), (1, "depth")))
    return op.zipped(a, c, "rgb", "depth", 6000)


@query("WITH n AS (SELECT c_custkey, 'f' || CAST(c_custkey * 37 % 1009 AS VARCHAR) || '_' || CAST(c_custkey % 13 AS VARCHAR) || '.png' AS name FROM customer) SELECT c_custkey, list_aggregate(list_transform(regexp_extract_all(name, '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), 'string_agg', '') AS key FROM n")
def natural_order(spark, d):
    name = F.concat(F.lit("f"), (F.col("c_custkey") * 37 % 1009).cast("string"), F.lit("_"), (F.col("c_custkey") % 13).cast("string"), F.lit(".png"))
    return b.read(spark, d, "customer").select("c_custkey", op.natural_key(name).alias("key"))


MEMBERS = "i AS (SELECT DISTINCT user_id % 40 AS instance_id, CAST(floor(value) AS BIGINT) AS point FROM events), l AS (SELECT user_id % 40 AS instance_id, event_type AS label, sum(value) AS score, count(*) AS n FROM events GROUP BY 1, 2)"


def member_sets(spark, d):
    e = b.read(spark, d, "events").withColumn("instance_id", F.col("user_id") % 40)
    labels = e.groupBy("instance_id", F.col("event_type").alias("label")).agg(F.sum("value").alias("score"), F.count("*").alias("n"))
    return e.select("instance_id", F.floor("value").alias("point")).distinct(), labels


OVERLAP = (
    "WITH RECURSIVE "
    + MEMBERS
    + """, s AS (SELECT instance_id, count(*) AS n FROM i GROUP BY 1), q AS (SELECT a.instance_id AS a, c.instance_id AS b FROM i a JOIN i c ON a.point = c.point AND a.instance_id < c.instance_id JOIN s x ON x.instance_id = a.instance_id JOIN s y ON y.instance_id = c.instance_id GROUP BY 1, 2, x.n, y.n HAVING count(*) > 0.8 * least(x.n, y.n)),
 e AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q), w(node, root) AS (SELECT instance_id, instance_id FROM s UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node), r AS (SELECT node, min(root) AS root FROM w GROUP BY node)"""
)


@query(OVERLAP + " SELECT root AS instance_id, count(DISTINCT point) AS n FROM i JOIN r ON r.node = i.instance_id GROUP BY root")
def overlap_merge(spark, d):
    sets, labels = member_sets(spark, d)
    return op.overlap_merge(sets, labels, 0.8)[0].groupBy("instance_id").agg(F.count("*").alias("n"))


@query(OVERLAP + " SELECT root AS instance_id, label, round(sum(score), 4) AS score, CAST(sum(l.n) AS BIGINT) AS n FROM l JOIN r ON r.node = l.instance_id GROUP BY root, label")
def merged_labels(spark, d):
    sets, labels = member_sets(spark, d)
    return op.overlap_merge(sets, labels, 0.8)[1].withColumn("score", F.round("score", 4))


@query("WITH m AS (SELECT DISTINCT l_suppkey AS instance_id, l_partkey AS point FROM lineitem), n AS (SELECT instance_id, count(*) AS n FROM m GROUP BY 1) SELECT instance_id, point FROM m WHERE instance_id IN (SELECT instance_id FROM n WHERE n <= 560) AND point IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def instance_reload(spark, d):
    m = b.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("instance_id"), F.col("l_partkey").alias("point")).distinct()
    info = m.groupBy("instance_id").agg(F.count("*").alias("n"))
    return op.reload(info, m, b.read(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("point")), 560)


@query("SELECT l_suppkey AS det, count(*) AS pixels, round(max(l_extendedprice), 2) AS area FROM lineitem GROUP BY 1 HAVING count(*) >= 580 AND max(l_extendedprice) <= 104900")
def detection_size_filter(spark, d):
    g = b.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("det")).agg(F.count("*").alias("pixels"), F.round(F.max("l_extendedprice"), 2).alias("area"))
    return op.keep_detections(g, 580, 104900.0)


FLOORS = "WITH n AS (SELECT s_suppkey AS instance_id, CASE s_nationkey % 3 WHEN 0 THEN 'floor' WHEN 1 THEN 'carpet' ELSE 'chair' END AS label, s_acctbal / 1000 AS z, count(*) AS n, count(DISTINCT l_orderkey) AS seen FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"


@query(FLOORS + ", q AS (SELECT * FROM n WHERE label IN ('floor', 'carpet')), r AS (SELECT instance_id, z FROM q WHERE n >= 100 ORDER BY n DESC, instance_id LIMIT 1) SELECT q.instance_id AS node, r.instance_id AS root FROM q, r WHERE q.z - r.z < 1.0 AND q.seen >= 100")
def floor_merge(spark, d):
    s = b.read(spark, d, "supplier").join(b.read(spark, d, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"))
    k = F.col("s_nationkey") % 3
    label = F.when(k == 0, "floor").when(k == 1, "carpet").otherwise("chair")
    n = s.groupBy(F.col("s_suppkey").alias("instance_id"), label.alias("label"), (F.col("s_acctbal") / 1000).alias("z")).agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("seen"))
    return op.floor_roots(n, ["floor", "carpet"], 1.0, 100, 100)


@query(f"WITH {b.CLOUD}, m AS (SELECT o_custkey % 300 AS instance_id, o_orderkey AS point FROM orders), k AS (SELECT instance_id FROM m GROUP BY 1 HAVING count(*) >= 50), v AS (SELECT instance_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM m JOIN c ON point_idx = point WHERE instance_id IN (SELECT instance_id FROM k) GROUP BY instance_id, floor(x/4), floor(y/4), floor(z/4)) SELECT instance_id, count(*) AS n, round(avg(x), 3) AS x, round(avg(y), 3) AS y, round(avg(z), 3) AS z FROM v GROUP BY instance_id")
def export_centroids(spark, d):
    m = b.read(spark, d, "orders").select((F.col("o_custkey") % 300).alias("instance_id"), F.col("o_orderkey").alias("point"))
    return op.export(m, b.cloud(spark, d), 50, 4.0).select("instance_id", "n", *[F.round(a, 3).alias(a) for a in "xyz"])


INFO = f"WITH {b.OBSERVED}, l AS (SELECT instance_id, label, sum(score) AS score FROM o GROUP BY 1, 2), n AS (SELECT instance_id, min(frame) AS frame, count(*) AS n FROM o GROUP BY 1), t AS (SELECT instance_id, string_agg(printf('%s(%.2f)', label, score), ',' ORDER BY label) AS t FROM l GROUP BY 1), v AS (SELECT instance_id, printf('%d %d %s', instance_id, frame, t) AS value FROM n JOIN t USING (instance_id) WHERE n >= 5)"


def info(spark, d):
    o = b.observations(spark, d)
    labels = o.groupBy("instance_id", "label").agg(F.sum("score").alias("score"))
    return op.info_lines(o.groupBy("instance_id").agg(F.min("frame").alias("frame"), F.count("*").alias("n")), labels, 5)


@query(INFO + " SELECT * FROM v")
def instance_info(spark, d):
    return info(spark, d)


@query(INFO + ", p AS (SELECT instance_id, unnest(regexp_extract_all(string_split(value, ' ')[3], '([^,()]+)\\(([-0-9.]+)\\)', 1)) AS label, unnest(regexp_extract_all(string_split(value, ' ')[3], '([^,()]+)\\(([-0-9.]+)\\)', 2)) AS s FROM v) SELECT instance_id, label, CAST(s AS DOUBLE) AS score FROM p")
def info_parse(spark, d):
    """The labels of the text lines, read back."""
    t = info(spark, d).select("instance_id", op.parse_labels(F.split("value", " ")[2]).alias("m"))
    return t.select("instance_id", F.explode("m").alias("label", "score"))


@query("WITH m AS (SELECT l_partkey AS point, max(l_suppkey) AS instance_id FROM lineitem GROUP BY 1) SELECT point, instance_id, CAST((instance_id * 70001 >> 16) & 255 AS INT) AS red FROM m")
def owner_colour(spark, d):
    from scenelake.functions.geometry import id_color

    o = op.owner(b.read(spark, d, "lineitem").select(F.col("l_partkey").alias("point"), F.col("l_suppkey").alias("instance_id")))
    return o.select("point", "instance_id", id_color(F.col("instance_id") * 70001)[0].alias("red"))


@query("SELECT o_orderkey AS frame FROM orders WHERE EXISTS (SELECT 1 FROM nation WHERE o_orderkey BETWEEN n_nationkey * 500 AND n_nationkey * 500 + 120)")
def frames_in_windows(spark, d):
    w = b.read(spark, d, "nation").select((F.col("n_nationkey") * 500).alias("lo"), (F.col("n_nationkey") * 500 + 120).alias("hi"))
    return op.inside_windows(b.read(spark, d, "orders").select(F.col("o_orderkey").alias("frame")), w)
