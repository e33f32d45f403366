"""Detection files, pose graphs, frames, likelihood matrices and line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTION = "raw_tags string, tags string, mask array<struct<value: int, label: string, labels: map<string, float>, box: array<double>>>"


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """(file, det_id, label, score, u0, v0, u1, v1) of each detection. A file
    with the background alone is left out, as are entries of value 0."""
    raw = spark.read.schema(DETECTION).json(path, multiLine=True).withColumn("file", F.input_file_name())
    one = raw.filter(F.size("mask") >= 2).select("file", F.explode("mask").alias("m")).filter("m.value <> 0")
    return one.select("file", F.col("m.value").alias("det_id"), F.explode("m.labels").alias("label", "score"), *[F.get("m.box", F.lit(i)).alias(c) for i, c in enumerate(("u0", "v0", "u1", "v1"))])


def tags(raw: DataFrame) -> DataFrame:
    """(file, tag): the dotted tag string in parts."""
    return raw.select("file", F.explode(F.split("tags", r"\.")).alias("tag")).select("file", F.ltrim("tag").alias("tag")).filter("tag <> ''")


def valid_masks(pixels: DataFrame, counts: DataFrame, least: int = 2000) -> DataFrame:
    """pixels(frame, u, v, det) of frames whose greatest label is their number
    of detections, without masks of fewer pixels than ``least``."""
    top = pixels.groupBy("frame").agg(F.max("det").alias("top"))
    good = top.join(counts, "frame").filter(F.col("top") == F.col("n")).select("frame")
    big = pixels.groupBy("frame", "det").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("frame", "det")
    return pixels.join(good, "frame", "left_semi").join(big, ["frame", "det"], "left_semi")


def read_pose_graph(spark: SparkSession, path: str) -> DataFrame:
    """(name, pose): a JSON object of 16 numbers by name."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("name", "pose")).filter(F.size("pose") == 16)


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """(ts, tx, ty, tz, qx, qy, qz, qw); lines with # are comments. Times are
    scaled to ten integer digits."""
    n = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").contains("#")).select(n.alias("n")).filter(F.size("n") >= 8)
    ts = F.get("n", F.lit(0)).cast("double")
    digits = F.floor(F.log10(F.greatest(F.abs(ts), F.lit(1.0)))) + 1
    names = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    return rows.select((ts / F.pow(F.lit(10.0), F.greatest(digits - 10, F.lit(0)))).alias("ts"), *[F.get("n", F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate(names)])


def read_likelihood(spark: SparkSession, path: str) -> DataFrame:
    """(measured, predicted, p): a header, a line of measured labels, one of
    predicted labels, then a row of numbers for each measured label."""
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    t = spark.read.text(path, wholetext=True).select(lines.alias("l"))
    t = t.select(F.split(F.get("l", F.lit(1)), r"\s+").alias("m"), F.split(F.get("l", F.lit(2)), r"\s+").alias("q"), F.slice("l", F.lit(4), F.size("l")).alias("rows"))
    one = t.select("m", "q", F.posexplode("rows").alias("i", "row")).select(F.get("m", "i").alias("measured"), "q", F.split("row", r"\s+").alias("v"))
    return one.select("measured", F.posexplode(F.arrays_zip("q", "v")).alias("j", "x")).select("measured", F.col("x.q").alias("predicted"), F.col("x.v").cast("float").alias("p")).filter("measured is not null and predicted is not null")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """x1 y1 x2 y2 by line."""
    return spark.read.csv(path, sep=" ", schema="x1 double, y1 double, x2 double, y2 double").filter("x1 is not null and y2 is not null")
