"""Boxes, masks, tags, retrieval and text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.operators import detect as op
from scenelake.sources import sinks

from .registry import query

CORNERS = f"WITH {b.BOXES}, k AS (SELECT frame, box_id, score, cx-w/2 AS x1, cy-h/2 AS y1, cx+w/2 AS x2, cy+h/2 AS y2 FROM b)"
IOU = CORNERS + """, p AS (SELECT a.frame, a.box_id AS i, c.box_id AS j, greatest(0, least(a.x2,c.x2)-greatest(a.x1,c.x1))*greatest(0, least(a.y2,c.y2)-greatest(a.y1,c.y1)) AS inter, (a.x2-a.x1)*(a.y2-a.y1)+(c.x2-c.x1)*(c.y2-c.y1) AS s, (greatest(a.x2,c.x2)-least(a.x1,c.x1))*(greatest(a.y2,c.y2)-least(a.y1,c.y1)) AS hull, a.score AS sa, c.score AS sc FROM k a JOIN k c ON a.frame = c.frame AND a.box_id < c.box_id), u AS (SELECT *, inter/(s-inter) AS iou, s-inter AS un FROM p)"""


@query(CORNERS + " SELECT frame, box_id, round(x1,6) AS x1, round(y1,6) AS y1, round(x2,6) AS x2, round(y2,6) AS y2 FROM k")
def box_convert(spark, d):
    return op.corners(b.boxes(spark, d)).select("frame", "box_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(IOU + " SELECT frame, i, j, round(iou, 6) AS iou FROM u WHERE iou > 0")
def box_iou(spark, d):
    return op.pair_iou(op.corners(b.boxes(spark, d))).filter("iou > 0").select("frame", "i", "j", F.round("iou", 6).alias("iou"))


@query(IOU + " SELECT frame, i, j, round(iou - (hull-un)/hull, 6) AS giou FROM u")
def box_giou(spark, d):
    return op.pair_iou(op.corners(b.boxes(spark, d))).select("frame", "i", "j", F.round("giou", 6).alias("giou"))


@query(
    CORNERS.replace("WITH", "WITH RECURSIVE", 1)
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box_id) AS n FROM k), o AS (SELECT a.frame, a.n AS a, c.n AS c FROM r a JOIN r c ON a.frame = c.frame AND a.n < c.n WHERE greatest(0, least(a.x2,c.x2)-greatest(a.x1,c.x1))*greatest(0, least(a.y2,c.y2)-greatest(a.y1,c.y1)) > 0.5 * ((a.x2-a.x1)*(a.y2-a.y1)+(c.x2-c.x1)*(c.y2-c.y1) - greatest(0, least(a.x2,c.x2)-greatest(a.x1,c.x1))*greatest(0, least(a.y2,c.y2)-greatest(a.y1,c.y1)))),
 l AS (SELECT r.frame, r.n, coalesce(list(o.a) FILTER (o.a IS NOT NULL), []) AS over FROM r LEFT JOIN o ON o.frame = r.frame AND o.c = r.n GROUP BY r.frame, r.n),
 g(frame, n, kept) AS (SELECT frame, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT frame FROM r) UNION ALL SELECT g.frame, l.n, CASE WHEN list_has_any(l.over, g.kept) THEN g.kept ELSE list_append(g.kept, l.n) END FROM g JOIN l ON l.frame = g.frame AND l.n = g.n + 1),
 z AS (SELECT frame, max_by(kept, n) AS kept FROM g GROUP BY frame) SELECT r.frame, r.box_id FROM r JOIN z ON z.frame = r.frame AND list_contains(z.kept, r.n)"""
)
def nms(spark, d):
    return op.nms(op.corners(b.boxes(spark, d)), 0.5)


MASK = "WITH m AS (SELECT o_orderkey AS px, o_custkey % 20 AS frame, CAST(o_totalprice > 150000 AS INT) AS on_ FROM orders)"


def mask(spark, d):
    return b.read(spark, d, "orders").select(F.col("o_orderkey").alias("px"), (F.col("o_custkey") % 20).alias("frame"), (F.col("o_totalprice") > 150000).cast("int").alias("on_"))


@query(MASK + ", s AS (SELECT *, CASE WHEN lag(on_) OVER w IS NOT DISTINCT FROM on_ THEN 0 ELSE 1 END AS st FROM m WINDOW w AS (PARTITION BY frame ORDER BY px)), r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY frame ORDER BY px ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM s) SELECT frame, run, any_value(on_) AS on_, min(px) AS start, count(*) AS n FROM r GROUP BY frame, run")
def rle_encode(spark, d):
    return op.run_lengths(mask(spark, d), ["frame"], "px", "on_")


@query("SELECT o_custkey % 20 AS frame, min(o_orderkey % 641) AS u0, min(o_orderkey // 641) AS v0, max(o_orderkey % 641) AS u1, max(o_orderkey // 641) AS v1, count(*) AS area FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
def mask_to_box(spark, d):
    p = mask(spark, d).filter("on_ = 1").select("frame", (F.col("px") % 641).alias("u"), F.floor(F.col("px") / 641).alias("v"))
    return op.mask_box(p, ["frame"])


@query("SELECT o_custkey % 20 AS frame, round(count(*) FILTER (o_totalprice > 200000) / count(*) FILTER (o_totalprice > 150000), 6) AS stability FROM orders GROUP BY 1")
def stability_score(spark, d):
    o = b.read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("frame"), "o_totalprice")
    return op.stability(o, ["frame"], "o_totalprice", 150000.0, 200000.0).withColumn("stability", F.round("stability", 6))


@query("WITH t AS (SELECT event_type AS tag, round(avg(value), 4) AS threshold, event_type = 'click' AS deleted FROM events GROUP BY event_type) SELECT event_id AS image, tag, value AS score FROM events JOIN t ON tag = event_type WHERE NOT deleted AND value > threshold")
def tag_threshold(spark, d):
    e = b.read(spark, d, "events").select(F.col("event_id").alias("image"), F.col("event_type").alias("tag"), F.col("value").alias("score"))
    vocabulary = e.groupBy("tag").agg(F.round(F.avg("score"), 4).alias("threshold")).withColumn("deleted", F.col("tag") == "click")
    return op.tag_threshold(e, vocabulary)


RANKED = "WITH r AS (SELECT event_type AS k, event_id AS id, value AS score, CAST(user_id % 3 = 0 AS INT) AS positive FROM events)"


def ranked(spark, d):
    return b.read(spark, d, "events").select(F.col("event_type").alias("k"), F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("user_id") % 3 == 0).cast("int").alias("positive"))


@query(RANKED + ", p AS (SELECT k, positive, row_number() OVER w AS n, sum(positive) OVER (PARTITION BY k ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS t FROM r WINDOW w AS (PARTITION BY k ORDER BY score DESC, id)) SELECT k, round(avg(t / n), 6) AS ap FROM p WHERE positive = 1 GROUP BY k")
def average_precision(spark, d):
    return op.average_precision(ranked(spark, d), "k").withColumn("ap", F.round("ap", 6))


@query(RANKED + " SELECT k, round(sum(CASE WHEN score > 50 THEN positive ELSE 0 END) / sum(CASE WHEN score > 50 THEN 1 ELSE 0 END), 6) AS precision, round(sum(CASE WHEN score > 50 THEN positive ELSE 0 END) / sum(positive), 6) AS recall FROM r GROUP BY k")
def precision_recall(spark, d):
    r = op.precision_recall(ranked(spark, d).withColumn("predicted", (F.col("score") > 50).cast("int")), "k")
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    """WITH q AS (SELECT vec_id AS q, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT q.q, e.vec_id, list_dot_product(CAST(q.a AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.a AS DOUBLE[]), CAST(q.a AS DOUBLE[])) * list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS cos FROM q, embeddings e),
 s AS (SELECT *, exp(10*cos) / sum(exp(10*cos)) OVER (PARTITION BY q) AS p FROM c) SELECT q, vec_id, round(cos, 5) AS cos, round(p, 7) AS p FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, vec_id) AS k FROM s) WHERE k <= 10"""
)
def cosine_softmax(spark, d):
    """Every hundredth vector as a query against all vectors."""
    e = b.read(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("a"))
    c = op.cosine_softmax(q, e, 10, 10.0)
    return c.select("q", "vec_id", F.round("cos", 5).alias("cos"), F.round("p", 7).alias("p"))


@query("WITH t AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS tag FROM part) SELECT tag, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM t WHERE tag <> '' GROUP BY tag")
def tag_tokens(spark, d):
    t = b.read(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("tag")).filter("tag <> ''")
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


@query("SELECT p_partkey, CASE WHEN lower(trim(p_name)) LIKE '%.' THEN lower(trim(p_name)) ELSE lower(trim(p_name)) || '.' END AS caption, replace(replace(lower(p_type), '_', ' '), '/', ' or ') AS tag, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS name FROM part")
def caption_normalise(spark, d):
    c = F.lower(F.trim("p_name"))
    tag = F.replace(F.replace(F.lower("p_type"), F.lit("_"), F.lit(" ")), F.lit("/"), F.lit(" or "))
    return b.read(spark, d, "part").select("p_partkey", F.when(c.endswith("."), c).otherwise(F.concat(c, F.lit("."))).alias("caption"), tag.alias("tag"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return b.read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"WITH {b.POINTS} SELECT point_idx, printf('%.6f %.6f %.6f', x, y, z) AS value FROM p")
def pcd_ascii(spark, d):
    return sinks.pcd_lines(b.points(spark, d))


@query(f"WITH {b.SEGMENTS} SELECT seg_id, printf('<line x1=\"%.3f\" y1=\"%.3f\" x2=\"%.3f\" y2=\"%.3f\" stroke=\"black\"/>', x1, y1, x2, y2) AS value FROM s")
def svg_lines(spark, d):
    return sinks.svg_lines(b.segments(spark, d))


@query(f"WITH {b.SEGMENTS} SELECT seg_id, printf('0\n%s\n8\n%s\n10\n%.4f\n20\n%.4f\n11\n%.4f\n21\n%.4f', 'LINE', 'WALLS', x1, -y1, x2, -y2) AS value FROM s")
def dxf_lines(spark, d):
    return sinks.dxf_lines(b.segments(spark, d))


@query("SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS digits, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS number FROM customer")
def natural_sort_key(spark, d):
    n = F.regexp_extract("c_name", r"([0-9]+)$", 1)
    return b.read(spark, d, "customer").select("c_custkey", n.alias("digits"), n.cast("bigint").alias("number"))


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000")
def frame_pose_join(spark, d):
    """Frames met with their poses by name: an equi-join."""
    o = b.read(spark, d, "orders").filter("o_totalprice > 200000")
    return o.join(b.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
