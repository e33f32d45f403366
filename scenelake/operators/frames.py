"""Frame intake, natural order, instances over their life: reload, merge, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .ordering import global_rank

#: Digits that a number in a name may have.
DIGITS = 20


def stem(name: Column | str) -> Column:
    """File name without folder and extension."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(c, r"([^/]*?)(?:\.[^./]*)?$", 1)


def natural_key(name: Column | str) -> Column:
    """A text that sorts as the name does when runs of digits count as numbers."""
    c = F.col(name) if isinstance(name, str) else name
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, DIGITS, "0")).otherwise(p)), "")


def intake(predictions: DataFrame, masks: DataFrame, least: int = 2) -> DataFrame:
    """predictions(name, n_entries) met with masks(name, top_label) by stem; a
    frame stays if it has ``least`` entries and its greatest label is their number."""
    a = predictions.select(stem("name").alias("frame"), "n_entries")
    b = masks.select(stem("name").alias("frame"), "top_label")
    return a.join(b, "frame").filter((F.col("n_entries") >= least) & (F.col("n_entries") == F.col("top_label")))


def frame_table(images: DataFrame, poses: DataFrame) -> DataFrame:
    """images(camera, name) met with poses(name, ...) by stem, numbered from 1
    in the order of camera and natural name."""
    met = images.withColumn("frame", stem("name")).join(poses.withColumnRenamed("name", "frame"), "frame")
    return global_rank(met.withColumn("_key", natural_key("name")), ["camera", "_key"], "place").drop("_key")


def by_big_integer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Equi-join on numbers of up to 38 digits in text, leading zeros aside."""
    number = F.col(key).cast("decimal(38,0)")
    return left.withColumn("_n", number).join(right.withColumn("_n", number).drop(key).hint("merge"), "_n").drop("_n")


def zipped(left: DataFrame, right: DataFrame, key: str, other: str, most: int) -> DataFrame:
    """The k-th of left with the k-th of right by their keys, the first
    ``most`` pairs (the format's own limit)."""
    a, b = global_rank(left.select(key), [key], "place"), global_rank(right.select(other), [other], "place")
    return a.filter(F.col("place") <= most).join(b, "place")


def reload(info: DataFrame, members: DataFrame, points: DataFrame, most: int = 100_000_000) -> DataFrame:
    """Instances from their stored members: sizes over ``most`` are refused as
    damaged, members that are no points any more are skipped."""
    sound = info.filter((F.col("n") >= 0) & (F.col("n") <= most)).select("instance_id")
    return members.join(sound, "instance_id", "left_semi").join(points.select("point"), "point", "left_semi")


def keep_detections(dets: DataFrame, least_pixels: int, most_area: float) -> DataFrame:
    """dets(..., pixels, area): neither small masks nor boxes of nearly the whole image."""
    return dets.filter((F.col("pixels") >= least_pixels) & (F.col("area") <= most_area))


def overlap_pairs(members: DataFrame, share: float) -> DataFrame:
    """Pairs a < b of instances of which one holds more than ``share`` of the
    other's points: members(instance_id, point)."""
    size = members.groupBy("instance_id").agg(F.count("*").alias("n"))
    a, b = (members.select(F.col("instance_id").alias(k), "point") for k in "ab")
    met = a.join(b, "point").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    met = met.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return met.filter(F.col("both") > share * F.least("na", "nb")).select("a", "b")


def merged(members: DataFrame, labels: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and label sums of the instances after merging: point sets are
    united, scores and counts added; roots(node, root)."""
    to = roots.withColumnRenamed("node", "instance_id")
    into = lambda df: df.join(to, "instance_id", "left").withColumn("instance_id", F.coalesce("root", "instance_id")).drop("root")
    return into(members).distinct(), into(labels).groupBy("instance_id", "label").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))


def overlap_merge(members: DataFrame, labels: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Instances that overlap, directly or through others, become one."""
    nodes = members.select(F.col("instance_id").alias("node")).distinct()
    return merged(members, labels, components(nodes, overlap_pairs(members, share)))


def floor_roots(insts: DataFrame, labels: Sequence[str], dz: float, least_root: int, least_seen: int) -> DataFrame:
    """The older rule: of insts(instance_id, label, z, n, seen) of the labels,
    the largest with ``least_root`` points takes those that lie less than dz
    above or anywhere below it and were seen often enough: (node, root)."""
    pool = insts.filter(F.col("label").isin(*labels))
    root = pool.filter(F.col("n") >= least_root).agg(F.max_by(F.struct("instance_id", "z"), F.struct("n", -F.col("instance_id"))).alias("r"))
    met = pool.join(F.broadcast(root)).filter((F.col("z") - F.col("r.z") < dz) & (F.col("seen") >= least_seen))  # one row
    return met.select(F.col("instance_id").alias("node"), F.col("r.instance_id").alias("root"))


def export(members: DataFrame, points: DataFrame, least: int, size: float | None = None) -> DataFrame:
    """(instance_id, n, x, y, z): centroids of instances of ``least`` points or
    more, over one point for each voxel if a size is given."""
    met = members.join(points.select(F.col("point_idx").alias("point"), "x", "y", "z"), "point")
    big = met.groupBy("instance_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("instance_id")
    met = met.join(big, "instance_id", "left_semi")
    if size:
        met = met.groupBy("instance_id", *[F.floor(F.col(a) / size).alias(f"_{a}") for a in "xyz"]).agg(*[F.avg(a).alias(a) for a in "xyz"])
    return met.groupBy("instance_id").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in "xyz"])


def info_lines(insts: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """(instance_id, value): the text ``id frame label(score),...`` of each
    instance of ``least`` points or more; insts(instance_id, frame, n)."""
    item = F.struct("label", F.format_string("%s(%.2f)", "label", "score").alias("s"))
    text = labels.groupBy("instance_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), ",").alias("t"))
    kept = insts.filter(F.col("n") >= least).join(text, "instance_id")
    return kept.select("instance_id", F.format_string("%d %d %s", "instance_id", "frame", "t").alias("value"))


def parse_labels(text: Column | str) -> Column:
    """The map of ``label(score),...``; parts without a score are left out."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.filter(F.split(c, ","), lambda p: p.rlike(r"^[^()]+\([-0-9.eE+]+\)$"))
    return F.map_from_entries(F.transform(found, lambda p: F.struct(F.substring_index(p, "(", 1), F.regexp_extract(p, r"\(([^)]*)\)", 1).cast("double"))))


def owner(members: DataFrame) -> DataFrame:
    """(point, instance_id): the last instance in id order that holds a point."""
    return members.groupBy("point").agg(F.max("instance_id").alias("instance_id"))


def inside_windows(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Frames within one of windows(lo, hi): these are a short list that the
    planner broadcasts by its size check."""
    return frames.join(windows, F.col("frame").between(F.col("lo"), F.col("hi")), "left_semi")
