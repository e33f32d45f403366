"""Wall plans, masks, captions and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.operators import detect, masks, walls

from .registry import query

S = f"WITH RECURSIVE {b.SEGMENTS}, m AS (SELECT *, (x1+x2)/2 AS x, (y1+y2)/2 AS y, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS l, CASE WHEN degrees(atan2(y2-y1, x2-x1)) < 0 THEN degrees(atan2(y2-y1, x2-x1)) + 180 WHEN degrees(atan2(y2-y1, x2-x1)) >= 180 THEN degrees(atan2(y2-y1, x2-x1)) - 180 ELSE degrees(atan2(y2-y1, x2-x1)) END AS u FROM s), h AS (SELECT a.seg_id AS a, c.seg_id AS b FROM m a JOIN m c ON a.seg_id < c.seg_id AND (a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y) <= %s)"
GAP = "least(abs(a.u-c.u), 180-abs(a.u-c.u))"
ROOTS = ", e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k), w(node, root) AS (SELECT seg_id, seg_id FROM s UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node), r AS (SELECT node, min(root) AS root FROM w GROUP BY node)"


@query(S % 0.0064 + ", k AS (SELECT * FROM h)" + ROOTS + " SELECT node AS seg_id, root AS cluster FROM r WHERE root IN (SELECT root FROM r GROUP BY root HAVING count(*) >= 2)")
def segment_clusters(spark, d):
    return walls.single_link(b.segments(spark, d), 0.08)


SIMILAR = S % 0.25 + f", k AS (SELECT h.a, h.b FROM h JOIN m a ON a.seg_id = h.a JOIN m c ON c.seg_id = h.b WHERE {GAP} <= 15 AND least(sqrt((a.x1-c.x1)*(a.x1-c.x1)+(a.y1-c.y1)*(a.y1-c.y1)) + sqrt((a.x2-c.x2)*(a.x2-c.x2)+(a.y2-c.y2)*(a.y2-c.y2)), sqrt((a.x1-c.x2)*(a.x1-c.x2)+(a.y1-c.y2)*(a.y1-c.y2)) + sqrt((a.x2-c.x1)*(a.x2-c.x1)+(a.y2-c.y1)*(a.y2-c.y1))) <= 1.0)"


@query(SIMILAR + ROOTS + ", o AS (SELECT seg_id, CASE WHEN x1 > x2 OR (x1 = x2 AND y1 > y2) THEN [x2, y2, x1, y1] ELSE [x1, y1, x2, y2] END AS v FROM s) SELECT root AS cluster, count(*) AS n, round(avg(v[1]), 5) AS x1, round(avg(v[2]), 5) AS y1, round(avg(v[3]), 5) AS x2, round(avg(v[4]), 5) AS y2 FROM r JOIN o ON o.seg_id = node GROUP BY root")
def segment_merge(spark, d):
    return walls.merge_similar(b.segments(spark, d), 0.5, 15.0, 1.0).withColumns({c: F.round(c, 5) for c in walls.ENDS})


COLLINEAR = S % 0.25 + f", k AS (SELECT h.a, h.b FROM h JOIN m a ON a.seg_id = h.a JOIN m c ON c.seg_id = h.b WHERE {GAP} <= 8 AND abs(-(c.x-a.x)*sin(radians(a.u)) + (c.y-a.y)*cos(radians(a.u))) <= 0.1 AND abs(-(c.x-a.x)*sin(radians(c.u)) + (c.y-a.y)*cos(radians(c.u))) <= 0.1)" + ROOTS


@query(COLLINEAR + " SELECT node AS seg_id, root AS cluster FROM r")
def collinear_clusters(spark, d):
    return walls.collinear(b.segments(spark, d), 0.5, 8.0, 0.1)


@query(COLLINEAR + ", q AS (SELECT root AS cluster, count(*) AS n, atan2(sum(l*sin(radians(2*u))), sum(l*cos(radians(2*u))))/2 AS t, sum(l*x)/sum(l) AS cx, sum(l*y)/sum(l) AS cy FROM r JOIN m ON seg_id = node GROUP BY root), v AS (SELECT cluster, n, t, cx, cy, min(least((x1-cx)*cos(t)+(y1-cy)*sin(t), (x2-cx)*cos(t)+(y2-cy)*sin(t))) AS lo, max(greatest((x1-cx)*cos(t)+(y1-cy)*sin(t), (x2-cx)*cos(t)+(y2-cy)*sin(t))) AS hi FROM q JOIN r ON root = cluster JOIN m ON seg_id = node GROUP BY ALL) SELECT cluster, n, round(cx+lo*cos(t), 4) AS x1, round(cy+lo*sin(t), 4) AS y1, round(cx+hi*cos(t), 4) AS x2, round(cy+hi*sin(t), 4) AS y2 FROM v")
def joined_lines(spark, d):
    s = b.segments(spark, d)
    return walls.joined_lines(s, walls.collinear(s, 0.5, 8.0, 0.1)).select("cluster", "n", *[F.round(c, 4).alias(c) for c in walls.ENDS])


@query(S % 0.25 + f", z AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h), t AS (SELECT a.seg_id, side, c.seg_id AS other, c.u AS cu, c.x AS cx, c.y AS cy, CASE side WHEN 1 THEN a.x1 ELSE a.x2 END AS ex, CASE side WHEN 1 THEN a.y1 ELSE a.y2 END AS ey FROM z JOIN m a ON a.seg_id = z.a JOIN m c ON c.seg_id = z.b, (SELECT unnest([1, 2]) AS side) WHERE {GAP} >= 80), o AS (SELECT *, -(ex-cx)*sin(radians(cu)) + (ey-cy)*cos(radians(cu)) AS off FROM t) SELECT seg_id, CAST(side AS INT) AS side, other, round(ex + off*sin(radians(cu)), 5) AS x, round(ey - off*cos(radians(cu)), 5) AS y FROM (SELECT *, row_number() OVER (PARTITION BY seg_id, side ORDER BY abs(off), other) AS k FROM o) WHERE k = 1")
def snap_targets(spark, d):
    return walls.snap_targets(b.segments(spark, d), 0.5, 10.0).withColumns({"x": F.round("x", 5), "y": F.round("y", 5)})


@query(S % 0.0 + ", n AS (SELECT *, floor(u/10) AS bin FROM m WHERE l >= 1.0), q AS (SELECT bin, sum(l) AS t FROM n GROUP BY 1) SELECT seg_id FROM n WHERE bin IN (SELECT bin FROM q WHERE t >= 0.055 * (SELECT sum(t) FROM q))")
def major_segments(spark, d):
    return walls.minor(b.segments(spark, d), 1.0, 10.0, 0.055)


@query(S % 0.0 + ", g AS (SELECT m.*, label, radians(4*u) AS t FROM m JOIN embeddings ON vec_id = seg_id), q AS (SELECT label, atan2(sum(l*sin(t)), sum(l*cos(t))) AS ax FROM g GROUP BY 1) SELECT label, count(*) AS n, round(sum(l*abs(atan2(sin(t-ax), cos(t-ax)))/4*180/pi())/sum(l), 5) AS residual FROM g JOIN q USING (label) GROUP BY label")
def block_regularity(spark, d):
    s = b.segments(spark, d).join(b.points(spark, d).select(F.col("point_idx").alias("seg_id"), "label"), "seg_id")
    return walls.direction_residual(s, "label").withColumn("residual", F.round("residual", 5))


@query(f"WITH {b.SEGMENTS}, g AS (SELECT seg_id, CAST(floor(x1/0.5+0.5) AS INT) AS a, CAST(floor(y1/0.5+0.5) AS INT) AS b, CAST(floor(x2/0.5+0.5) AS INT) AS c, CAST(floor(y2/0.5+0.5) AS INT) AS d FROM s), n AS (SELECT *, greatest(abs(c-a), abs(d-b)) AS n FROM g), k AS (SELECT *, unnest(range(0, n+1)) AS k FROM n), r AS (SELECT DISTINCT seg_id, CASE WHEN n > 0 THEN CAST(floor(a+(c-a)*k/n+0.5) AS INT) ELSE a END AS gx, CASE WHEN n > 0 THEN CAST(floor(b+(d-b)*k/n+0.5) AS INT) ELSE b END AS gy FROM k), i AS (SELECT gx, gy FROM r GROUP BY 1, 2 HAVING count(*) >= 20) SELECT seg_id, round(avg(CASE WHEN i.gx IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share FROM r LEFT JOIN i USING (gx, gy) GROUP BY 1 HAVING avg(CASE WHEN i.gx IS NULL THEN 0.0 ELSE 1.0 END) >= 0.3")
def path_validity(spark, d):
    from scenelake.operators.shapes import line_cells

    c = line_cells(b.segments(spark, d), 0.5)
    image = c.groupBy("gx", "gy").agg(F.count("*").alias("n")).filter("n >= 20")
    return walls.white_share(c, image, 0.3).withColumn("share", F.round("share", 6))


@query(f"WITH {b.SEGMENTS}, t AS (SELECT *, (-1-x1)/(x2-x1) AS a, (0.5-x1)/(x2-x1) AS b, (-0.5-y1)/(y2-y1) AS c, (1-y1)/(y2-y1) AS d FROM s) SELECT seg_id FROM t WHERE greatest(0, least(a, b), least(c, d)) <= least(1, greatest(a, b), greatest(c, d))")
def segments_in_crop(spark, d):
    return b.segments(spark, d).filter(walls.crosses_box("x1", "y1", "x2", "y2", (-1.0, -0.5, 0.5, 1.0))).select("seg_id")


@query(f"WITH {b.SEGMENTS}, o AS (SELECT seg_id, CASE WHEN x1 > x2 OR (x1 = x2 AND y1 > y2) THEN [x2, y2, x1, y1] ELSE [x1, y1, x2, y2] END AS v FROM s) SELECT min(seg_id) AS seg_id FROM o GROUP BY round(v[1], 0), round(v[2], 0), round(v[3], 0), round(v[4], 0)")
def distinct_segments(spark, d):
    return walls.distinct_segments(b.segments(spark, d), 0)


CORNERS = f"WITH {b.BOXES}, k AS (SELECT frame, box_id, score, cx-w/2 AS x1, cy-h/2 AS y1, cx+w/2 AS x2, cy+h/2 AS y2 FROM b), p AS (SELECT a.frame, a.box_id AS i, c.box_id AS j, greatest(0, least(a.x2,c.x2)-greatest(a.x1,c.x1))*greatest(0, least(a.y2,c.y2)-greatest(a.y1,c.y1)) AS inter, (a.x2-a.x1)*(a.y2-a.y1) AS sa, (c.x2-c.x1)*(c.y2-c.y1) AS sc FROM k a JOIN k c ON a.frame = c.frame AND a.box_id <> c.box_id)"


def corners(spark, d):
    return detect.corners(b.boxes(spark, d))


@query(CORNERS + " SELECT frame, i AS prompt, j AS box_id, round(inter/(sa+sc-inter), 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY frame, i ORDER BY inter/(sa+sc-inter) DESC, j) AS n FROM p WHERE i % 2 = 0 AND j % 2 = 1 AND inter > 0) WHERE n = 1")
def prompt_to_mask(spark, d):
    k = corners(spark, d)
    prompts = k.filter("box_id % 2 = 0").select("frame", F.col("box_id").alias("prompt"), *masks.BOX)
    return masks.prompt_masks(prompts, k.filter("box_id % 2 = 1")).withColumn("iou", F.round("iou", 6))


@query(CORNERS + " SELECT frame, box_id FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.frame = k.frame AND p.i = k.box_id AND (sc > sa OR (sc = sa AND j < i)) AND inter > 0.8 * sa)")
def containment_suppress(spark, d):
    k = corners(spark, d)
    return k.select("frame", "box_id").join(masks.contained(k, 0.8), ["frame", "box_id"], "left_anti")


@query(CORNERS + " SELECT frame, box_id FROM k WHERE NOT (abs(x1 + 1) <= 0.2 OR abs(x2 - 1) <= 0.2 OR abs(y2 - 2) <= 0.2)")
def crop_edge_filter(spark, d):
    return masks.crop_edge(corners(spark, d), (-1, -5, 1, 2), (-5, -5, 5, 5), 0.2).select("frame", "box_id")


@query(CORNERS + " SELECT frame, box_id FROM k WHERE (x2-x1)/2 >= 0.5 AND score >= 0.0")
def good_masks(spark, d):
    k = corners(spark, d).withColumns({"predicted_iou": (F.col("x2") - F.col("x1")) / 2, "stability": F.col("score")})
    return masks.good_masks(k, 0.5, 0.0).select("frame", "box_id")


@query(CORNERS + " SELECT box_id, round(x1+(x2-x1)/2, 6) AS cx, round(y2-y1, 6) AS h, round(x1+3, 6) AS u1 FROM k")
def box_formats(spark, d):
    c = [F.col(n) for n in masks.BOX]
    k = masks.box_formats(c)
    return corners(spark, d).select("box_id", F.round(k["cxcywh"][0], 6).alias("cx"), F.round(k["xywh"][3], 6).alias("h"), F.round(masks.uncropped(c, 3.0, 0.0)[0], 6).alias("u1"))


@query("WITH r AS (SELECT p_partkey AS mask, [CAST(p_size % 5 AS BIGINT), CAST(p_size AS BIGINT), CAST(p_partkey % 7 AS BIGINT), CAST(p_partkey % 3 AS BIGINT)] AS c FROM part) SELECT mask, c[2] + c[4] AS area FROM r")
def rle_area(spark, d):
    return runs(spark, d).select("mask", masks.rle_area("counts").alias("area"))


def runs(spark, d):
    p = b.read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("mask"), F.array(*[c.cast("bigint") for c in (F.col("p_size") % 5, F.col("p_size"), F.col("p_partkey") % 7, F.col("p_partkey") % 3)]).alias("counts"))


@query("WITH r AS (SELECT p_partkey AS mask, CAST(p_size % 5 AS BIGINT) AS a, CAST(p_size AS BIGINT) AS b, CAST(p_partkey % 7 AS BIGINT) AS c, CAST(p_partkey % 3 AS BIGINT) AS d FROM part) SELECT mask, unnest(range(a, a+b)) AS px FROM r UNION ALL SELECT mask, unnest(range(a+b+c, a+b+c+d)) FROM r")
def rle_decode(spark, d):
    return masks.rle_decode(runs(spark, d), "mask", "counts")


@query("WITH m AS (SELECT DISTINCT l_suppkey AS mask, l_linenumber AS u, CAST(l_quantity AS INT) AS v FROM lineitem), p AS (SELECT DISTINCT CAST(p_size % 7 + 1 AS INT) AS u, CAST(p_size AS INT) AS v, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS sign FROM part) SELECT mask, CAST(sum(sign) AS BIGINT) AS votes FROM m JOIN p USING (u, v) GROUP BY mask HAVING sum(sign) > 0")
def point_prompt(spark, d):
    m = b.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("mask"), F.col("l_linenumber").alias("u"), F.col("l_quantity").cast("int").alias("v")).distinct()
    p = b.read(spark, d, "part").select((F.col("p_size") % 7 + 1).alias("u"), F.col("p_size").alias("v"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("sign")).distinct()
    return masks.point_prompts(m, p)


@query("SELECT p_partkey, CAST(CASE WHEN strpos(lower(p_type), 'steel') > 0 THEN 0 WHEN strpos(lower(p_type), 'brass') > 0 THEN 1 WHEN strpos(lower(p_type), 'standard') > 0 THEN 2 ELSE -1 END AS INT) AS class_id FROM part")
def phrase_class(spark, d):
    p = b.read(spark, d, "part").select("p_partkey", F.lower("p_type").alias("phrase"))
    return masks.phrase_class(p, ["steel", "brass", "standard"]).select("p_partkey", "class_id")


@query(r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[.!"()*#:;~]+', ' ', 'g'), '[-/]', ' ', 'g'), '\s{2,}', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, array_to_string(string_split(t, ' ')[1:50], ' ') AS caption FROM c""")
def caption_clean(spark, d):
    return b.read(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", masks.clean_caption("text").alias("caption"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), '^[aeiou]') THEN 'an ' ELSE 'a ' END || replace(replace(regexp_replace(lower(p_type), '\\.$', ''), '_', ' '), '/', ' or ') AS tag FROM part")
def tag_clean(spark, d):
    return b.read(spark, d, "part").select("p_partkey", masks.clean_tag("p_type").alias("tag"))


@query("WITH t AS (SELECT p_partkey, trim(p_name) AS name, CAST(p_size / 100.0 AS DOUBLE) AS score FROM part) SELECT p_partkey, unnest(string_split(name, ' ')) AS word, score FROM t")
def phrase_words(spark, d):
    p = b.read(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("("), (F.col("p_size") / 100).cast("string"), F.lit(")")).alias("phrase"))
    return p.select("p_partkey", F.explode(masks.word_scores("phrase")).alias("w")).select("p_partkey", "w.word", "w.score")


@query("WITH m AS (SELECT o_custkey, o_orderpriority AS label, sum(o_totalprice) AS score FROM orders GROUP BY 1, 2) SELECT o_custkey, count(*) AS labels, round(max(score), 2) AS best FROM m GROUP BY 1")
def map_accumulate(spark, d):
    """Labels and scores gathered into a map for each key, and read from it."""
    m = b.read(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("label")).agg(F.sum("o_totalprice").alias("score"))
    maps = m.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("scores"))  # five labels
    return maps.select("o_custkey", F.size("scores").cast("bigint").alias("labels"), F.round(F.array_max(F.map_values("scores")), 2).alias("best"))


@query("SELECT l_orderkey, list(l_linenumber ORDER BY l_shipdate, l_linenumber, l_partkey)[1] AS first_line, count(*) AS n FROM lineitem GROUP BY 1")
def scan_by_offset(spark, d):
    """Points of each scan in the order of their time offset; the first is shown."""
    g = b.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_partkey"))).alias("s"), F.count("*").alias("n"))
    return g.select("l_orderkey", F.col("s")[0]["l_linenumber"].alias("first_line"), "n")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders")
def anchors_by_gradient(spark, d):
    from scenelake.operators.ordering import global_rank

    o = b.read(spark, d, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("low"))
    return global_rank(o, ["low", "o_orderkey"], "place").select("o_orderkey", "place")


@query(f"WITH {b.CLOUD}, u AS (SELECT point_idx, x, 0 AS part FROM c UNION ALL SELECT point_idx, x + 1, 1 FROM c), k AS (SELECT part, point_idx, row_number() OVER (ORDER BY part, point_idx) - 1 AS k FROM u) SELECT part, point_idx FROM k WHERE k % 300 = 0")
def concat_decimate(spark, d):
    """Clouds one after another, every 300th point: the operator's own step."""
    from scenelake.operators.ordering import global_rank

    c = b.cloud(spark, d)
    u = c.select(F.lit(0).alias("part"), "point_idx").unionByName(c.select(F.lit(1).alias("part"), "point_idx"))
    return global_rank(u, ["part", "point_idx"], "k").filter((F.col("k") - 1) % 300 == 0).select("part", "point_idx")


@query("SELECT count(*) AS rows, CAST(ceil(count(*) / 64.0) AS BIGINT) AS pages, CAST(count(*) % 64 AS BIGINT) AS last FROM orders")
def page_count(spark, d):
    n = F.count("*")
    return b.read(spark, d, "orders").agg(n.alias("rows"), F.ceil(n / 64).alias("pages"), (n % 64).alias("last"))


@query("WITH m AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std FROM m")
def submap_size(spark, d):
    m = b.read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return m.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"))


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 5) AS mean, max(value) AS most FROM events GROUP BY 1")
def stage_timers(spark, d):
    return b.read(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.max("value").alias("most"))


@query("WITH q AS (SELECT event_type, value, percent_rank() OVER (PARTITION BY event_type ORDER BY value) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value > 0.2) SELECT event_type, n, quantile_disc(value, 0.9) AS cut FROM q WHERE n >= 100 GROUP BY event_type, n")
def masked_depth(spark, d):
    """Valid depths of each mask and the one at the 90th percentile's place."""
    from scenelake.operators.ordering import discrete_quantile

    q = discrete_quantile(b.read(spark, d, "events").filter("value > 0.2"), "event_type", ["value", "event_id"], 0.9)
    return q.filter("n >= 100").select("event_type", "n", F.col("value").alias("cut"))



