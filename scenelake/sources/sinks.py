"""Upserts, paging, and text forms: ASCII clouds, DXF, SVG, info lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of the greater version for each key; the old one on a tie."""
    a, b = old.select(F.struct("*").alias("_a"), *keys), new.select(F.struct("*").alias("_b"), *keys)
    met = a.join(b, list(keys), "full")
    take = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col(f"_b.{version}") > F.col(f"_a.{version}")))
    return met.select(*[F.when(take, F.col("_b")[c]).otherwise(F.col("_a")[c]).alias(c) for c in old.columns])


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def pcd_lines(points: DataFrame, colour: bool = False) -> DataFrame:
    """One line of text for each point, six decimals."""
    cols = ["x", "y", "z", *(["r", "g", "b"] if colour else [])]
    return points.select("point_idx", F.format_string(" ".join(["%.6f"] * len(cols)), *cols).alias("value"))


def pcd_header(n: int, colour: bool = False) -> str:
    names = "x y z r g b" if colour else "x y z"
    k = len(names.split())
    lines = ["# .PCD v0.7 - Point Cloud Data file format", "VERSION 0.7", f"FIELDS {names}", f"SIZE {' '.join(['4'] * k)}", f"TYPE {' '.join(['F'] * k)}", f"COUNT {' '.join(['1'] * k)}", f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"]
    return "\n".join(lines)


def write_pcd(points: DataFrame, path: str, colour: bool = False) -> None:
    """A folder of text parts, the header first: parts keep the points' order."""
    spark = points.sparkSession
    head = spark.createDataFrame([(-1, pcd_header(points.count(), colour))], "point_idx bigint, value string")
    pcd_lines(points, colour).unionByName(head).repartitionByRange("point_idx").sortWithinPartitions("point_idx").select("value").write.text(path)


def dxf_lines(segments: DataFrame, layer: str = "WALLS") -> DataFrame:
    """An R12 LINE entity for each segment in metres, y negated."""
    form = f"0\nLINE\n8\n{layer}\n10\n%.4f\n20\n%.4f\n11\n%.4f\n21\n%.4f"
    return segments.select("seg_id", F.format_string(form, "x1", -F.col("y1"), "x2", -F.col("y2")).alias("value"))


def write_dxf(segments: DataFrame, path: str) -> None:
    spark = segments.sparkSession
    ends = spark.createDataFrame([(-1, "0\nSECTION\n2\nENTITIES"), (1 << 62, "0\nENDSEC\n0\nEOF")], "seg_id bigint, value string")
    dxf_lines(segments).unionByName(ends).repartitionByRange("seg_id").sortWithinPartitions("seg_id").select("value").write.text(path)


def svg_lines(segments: DataFrame) -> DataFrame:
    return segments.select("seg_id", F.format_string('<line x1="%.3f" y1="%.3f" x2="%.3f" y2="%.3f" stroke="black"/>', "x1", "y1", "x2", "y2").alias("value"))


def instance_lines(instances: DataFrame, labels: DataFrame) -> DataFrame:
    """"id frame l:s,l:s" for instances(instance_id, frame_id) and
    labels(instance_id, label, score)."""
    item = F.struct("label", F.concat("label", F.lit(":"), F.format_string("%.2f", "score")).alias("s"))
    text = labels.groupBy("instance_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), ",").alias("l"))
    return instances.join(text, "instance_id", "left").select("instance_id", F.concat_ws(" ", F.lpad(F.col("instance_id").cast("string"), 6, "0"), F.col("frame_id").cast("string"), F.coalesce("l", F.lit(""))).alias("value"))
