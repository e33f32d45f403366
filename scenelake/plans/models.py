"""Models' surroundings and packets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenelake import bindings as b
from scenelake.operators import models as op

from .registry import query

CLASSES = ("chair", "door", "table", "wall")


@query()
def annotate_stub(spark, d):
    """Images through the three stub models; fixed by a hash, so tests can say what comes out."""
    images = b.read(spark, d, "pages").select(F.concat(F.lit("im"), F.col("page_id").cast("string")).alias("image"))
    vocabulary = spark.createDataFrame([(c, 0.5) for c in CLASSES], "tag string, threshold double")
    return op.annotate(images, vocabulary, op.tagger(CLASSES), op.detector(), op.segmenter(), 0.35)


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings) SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / n, 6) AS first, round(CAST(embedding[64] AS DOUBLE) / n, 6) AS last FROM n")
def unit_vectors(spark, d):
    e = op.unit_vectors(b.read(spark, d, "embeddings"), "embedding")
    return e.select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[63], 6).alias("last"))


@query(f"WITH {b.POINTS} SELECT point_idx, round((r*255/255 - 0.485::DOUBLE)/0.229::DOUBLE, 6) AS r, round((g - 0.456::DOUBLE)/0.224::DOUBLE, 6) AS g, round((b - 0.406::DOUBLE)/0.225::DOUBLE, 6) AS b FROM p")
def image_normalise(spark, d):
    p = b.points(spark, d).select("point_idx", *[(F.col(c) * 255).alias(c) for c in "rgb"])
    return op.normalised(p, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)).select("point_idx", *[F.round(c, 6).alias(c) for c in "rgb"])


@query("WITH q AS (SELECT o_orderkey AS point_idx, CAST(o_custkey % 20 AS INT) AS line, CAST(o_custkey % 64 AS INT) AS tag, CAST(o_custkey % 97 - 48 AS DOUBLE) AS x, o_totalprice/5000 - 40 AS y, day(o_orderdate)/4.0::DOUBLE - 4 AS z FROM orders) SELECT point_idx, CAST(floor((degrees(atan2(z, sqrt(x*x + y*y))) + 15)/2 + 0.5) AS INT) AS ring FROM q WHERE line < 16 AND (tag & 48) IN (0, 16) AND point_idx % 3 = 0 AND x*x + y*y + z*z > 16")
def sensor_packets(spark, d):
    """Lines and tags told good from bad, every third point: the adapter's own step."""
    from scenelake.sources.arrays import packets

    o = b.read(spark, d, "orders")
    raw = o.select(F.col("o_orderkey").alias("point_idx"), (F.col("o_custkey") % 20).cast("int").alias("line"), (F.col("o_custkey") % 64).cast("int").alias("tag"), (F.col("o_custkey") % 97 - 48).cast("double").alias("x"), (F.col("o_totalprice") / 5000 - 40).alias("y"), (F.dayofmonth("o_orderdate") / F.lit(4.0) - 4).alias("z"))
    return packets(raw, 3, 4.0).select("point_idx", "ring")
