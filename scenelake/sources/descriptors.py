"""Descriptor tables kept by key, directory slices, and text outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_descriptors(rows: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """A table bucketed and sorted by the descriptor's keys: joins of two such
    tables on them need no shuffle. ``buckets`` grows with the data; tables
    that meet take the same number."""
    first, *more = keys
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, first, *more).sortBy(first, *more).saveAsTable(table)


def load_descriptors(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def sliced(files: DataFrame, start: int = 0, n: int = -1) -> DataFrame:
    """files(path, ..) from place ``start`` on, ``n`` of them, in the order of
    their names; all the rest for a negative n."""
    some = files.orderBy("path").offset(start)
    return some if n < 0 else some.limit(n)


def not_black(points: DataFrame, red: str = "r") -> DataFrame:
    """Points whose red isn't zero, as walls are marked."""
    return points.filter(F.col(red) != 0)


def _line(columns: Sequence[str | Column], form: str) -> Column:
    return F.format_string(" ".join([form] * len(columns)), *columns)


def segment_text(segments: DataFrame) -> DataFrame:
    """(seg_id, value): both ends, six decimals."""
    return segments.select("seg_id", _line(["x1", "y1", "x2", "y2"], "%.6f").alias("value"))


def match_text(matches: DataFrame) -> DataFrame:
    """(src, ref, value) of matches(src, ref, src_x .., ref_x ..): both
    instances' numbers, then both centroids."""
    places = _line([f"{s}_{a}" for s in ("src", "ref") for a in "xyz"], "%.4f")
    return matches.select("src", "ref", F.concat_ws(" ", F.col("src_instance").cast("string"), F.col("ref_instance").cast("string"), places).alias("value"))


def pose_text(poses: DataFrame, key: str) -> DataFrame:
    """(key, value) of 4 x 4 poses as four lines; poses(key, pose ARRAY<DOUBLE>)
    of 16 numbers by row, null if there are fewer."""
    rows = F.array(*[F.array_join(F.transform(F.slice("pose", 4 * i + 1, 4), lambda v: F.format_string("%.6f", v)), " ") for i in range(4)])
    return poses.select(key, F.when(F.size("pose") == 16, F.array_join(rows, "\n")).alias("value"))
