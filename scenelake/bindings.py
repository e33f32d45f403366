"""The driver's tables seen through the library's generic schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dim(k: int, scale: float = 10.0):
    """Component k of an embedding, widened before arithmetic."""
    return F.col("embedding")[k].cast("double") * F.lit(scale)


def micros(ts: str):
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(point_idx, x, y, z) and colours r, g, b in 0..1."""
    unit = lambda k: F.abs(F.col("embedding")[k].cast("double"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_idx"), dim(0).alias("x"), dim(1).alias("y"), dim(2).alias("z"), unit(3).alias("r"), unit(4).alias("g"), unit(5).alias("b"), F.col("label"))


POINTS = """p AS (SELECT vec_id AS point_idx, CAST(embedding[1] AS DOUBLE)*10 AS x, CAST(embedding[2] AS DOUBLE)*10 AS y, CAST(embedding[3] AS DOUBLE)*10 AS z,
 abs(CAST(embedding[4] AS DOUBLE)) AS r, abs(CAST(embedding[5] AS DOUBLE)) AS g, abs(CAST(embedding[6] AS DOUBLE)) AS b, label FROM embeddings)"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger cloud from orders: x, y, z on a coarse floor plan."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("point_idx"), (F.col("o_custkey") % 97).cast("double").alias("x"), (F.col("o_totalprice") / 5000).alias("y"), (F.dayofmonth("o_orderdate") / F.lit(10.0)).alias("z"))


CLOUD = "c AS (SELECT o_orderkey AS point_idx, CAST(o_custkey % 97 AS DOUBLE) AS x, o_totalprice/5000 AS y, day(o_orderdate)/10.0::DOUBLE AS z FROM orders)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point sets of detections: (frame, det, point)."""
    e = read(spark, sf_dir, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("frame"), F.col("event_type").alias("det"), F.col("user_id").alias("point")).distinct()


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point sets of known instances: (inst, point)."""
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.weekofyear("ts").cast("string"), F.lit("-"), F.col("event_type")).alias("inst"), F.col("user_id").alias("point")).distinct()


SETS = """d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS frame, event_type AS det, user_id AS point FROM events),
 i AS (SELECT DISTINCT CAST(weekofyear(ts) AS VARCHAR) || '-' || event_type AS inst, user_id AS point FROM events)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label scores: (instance_id, frame, label, score)."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("instance_id"), F.col("event_id").alias("frame"), F.col("event_type").alias("label"), F.col("value").alias("score"))


OBSERVED = "o AS (SELECT user_id AS instance_id, event_id AS frame, event_type AS label, value AS score FROM events)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segments(seg_id, x1, y1, x2, y2)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seg_id"), dim(0).alias("x1"), dim(1).alias("y1"), dim(2).alias("x2"), dim(3).alias("y2"))


SEGMENTS = "s AS (SELECT vec_id AS seg_id, CAST(embedding[1] AS DOUBLE)*10 AS x1, CAST(embedding[2] AS DOUBLE)*10 AS y1, CAST(embedding[3] AS DOUBLE)*10 AS x2, CAST(embedding[4] AS DOUBLE)*10 AS y2 FROM embeddings)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes(frame, box_id, cx, cy, w, h, score)."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("frame"), F.col("vec_id").alias("box_id"), dim(0).alias("cx"), dim(1).alias("cy"), (F.abs(dim(2)) + 0.5).alias("w"), (F.abs(dim(3)) + 0.5).alias("h"), dim(4, 1.0).alias("score"))


BOXES = "b AS (SELECT label AS frame, vec_id AS box_id, CAST(embedding[1] AS DOUBLE)*10 AS cx, CAST(embedding[2] AS DOUBLE)*10 AS cy, abs(CAST(embedding[3] AS DOUBLE)*10)+0.5 AS w, abs(CAST(embedding[4] AS DOUBLE)*10)+0.5 AS h, CAST(embedding[5] AS DOUBLE) AS score FROM embeddings)"


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples over time: (traj, ts in seconds, x)."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("traj"), micros("ts").alias("us"), F.col("value").alias("x"), F.col("event_id"))


POSES = "t AS (SELECT user_id AS traj, epoch_us(ts) AS us, value AS x, event_id FROM events)"
