"""Set overlap, matching, label fusion and merging of instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import cell, offsets, voxel_keys


def iou_matrix(dets: DataFrame, insts: DataFrame) -> DataFrame:
    """dets(frame, det, point) and insts(inst, point) to (frame, det, inst,
    n_inter, iou) of all that meet. Points are met by an equi-join; the sizes
    come back by key."""
    inter = dets.join(insts, "point").groupBy("frame", "det", "inst").agg(F.count("*").alias("n_inter"))
    a = dets.groupBy("frame", "det").agg(F.count("*").alias("_a"))
    b = insts.groupBy("inst").agg(F.count("*").alias("_b"))
    iou = F.col("n_inter") / (F.col("_a") + F.col("_b") - F.col("n_inter"))
    return inter.join(a, ["frame", "det"]).join(b, "inst").select("frame", "det", "inst", "n_inter", iou.alias("iou"))


def mutual_best(matrix: DataFrame, least: float) -> DataFrame:
    """Pairs that are each other's best above ``least``; ties go to the lesser name."""
    row = Window.partitionBy("frame", "det").orderBy(F.desc("iou"), "inst")
    col = Window.partitionBy("frame", "inst").orderBy(F.desc("iou"), "det")
    ranked = matrix.withColumn("_r", F.row_number().over(row)).withColumn("_c", F.row_number().over(col))
    return ranked.filter((F.col("_r") == 1) & (F.col("_c") == 1) & (F.col("iou") > least)).drop("_r", "_c")


def ambiguous(matrix: DataFrame, gap: float) -> DataFrame:
    """Detections whose runner-up is within ``gap`` of the best."""
    w = Window.partitionBy("frame", "det").orderBy(F.desc("iou"), "inst")
    two = matrix.withColumn("_k", F.row_number().over(w)).filter("_k <= 2").groupBy("frame", "det")
    two = two.agg(F.max(F.when(F.col("_k") == 1, F.struct("inst", "iou"))).alias("a"), F.max(F.when(F.col("_k") == 2, F.struct("inst", "iou"))).alias("b"))
    return two.filter("b is not null").filter(F.col("a.iou") - F.col("b.iou") <= gap).select("frame", "det", F.col("a.inst").alias("best"), F.col("b.inst").alias("second"))


def label_sums(obs: DataFrame) -> DataFrame:
    """(instance_id, label, score, n) from observations."""
    return obs.groupBy("instance_id", "label").agg(F.sum("score").alias("score"), F.count("*").alias("n"))


def label_argmax(sums: DataFrame) -> DataFrame:
    """Best label of each instance; ties go to the lesser label."""
    w = Window.partitionBy("instance_id").orderBy(F.desc("score"), "label")
    return sums.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def bayes_vector(obs: DataFrame, likelihood: DataFrame) -> DataFrame:
    """(instance_id, predicted, p): likelihood rows weighted by scores, scaled
    to unit length. Labels that the matrix lacks are skipped. The matrix is a
    small dimension and is left to the planner's size check."""
    w = obs.join(likelihood, obs["label"] == likelihood["measured"]).groupBy("instance_id", "predicted").agg(F.sum(F.col("score") * F.col("p")).alias("s"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("instance_id")))
    return w.select("instance_id", "predicted", F.when(norm > 0, F.col("s") / norm).otherwise(0.0).alias("p"))


def remap(rows: DataFrame, merges: DataFrame, id_col: str) -> DataFrame:
    """rows with id_col replaced by its root in merges(node, root)."""
    return rows.join(merges.withColumnRenamed("node", id_col), id_col, "left").withColumn(id_col, F.coalesce("root", id_col)).drop("root")


def structural_merge(insts: DataFrame, labels: list[str], dz: float, least_root: int) -> DataFrame:
    """insts(instance_id, label, z, n): those of the labels within dz of the
    largest join it, if that one has enough points: (instance_id, root)."""
    pool = insts.filter(F.col("label").isin(labels))
    root = pool.agg(F.max_by(F.struct("instance_id", "z", "n"), F.struct("n", -F.col("instance_id"))).alias("root"))
    met = pool.join(F.broadcast(root)).filter((F.col("root.n") >= least_root) & (F.abs(F.col("z") - F.col("root.z")) < dz))
    return met.select("instance_id", F.col("root.instance_id").alias("root"))


def share_label_pairs(labels: DataFrame, places: DataFrame, least_points: int, reach: float) -> DataFrame:
    """Pairs i < j that share a label, each with enough points, near one
    another, met by label and neighbouring cells of the reach: labels(instance_id, label), places(instance_id, x, y, z, n)."""
    mine = labels.join(places.filter(F.col("n") >= least_points), "instance_id")
    keys = [cell(c, reach).alias(f"k{c}") for c in "xyz"]
    a = mine.select(F.col("instance_id").alias("i"), "label", *[F.col(c).alias(f"a{c}") for c in "xyz"], *keys, F.explode(offsets(1, 3)).alias("o"))
    a = a.select("i", "label", "ax", "ay", "az", *[(F.col(f"k{c}") + F.col("o")[f"d{n}"]).alias(f"k{c}") for n, c in enumerate("xyz")])
    b = mine.select(F.col("instance_id").alias("j"), "label", *[F.col(c).alias(f"b{c}") for c in "xyz"], *keys)
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return a.join(b, ["label", "kx", "ky", "kz"]).filter((F.col("i") < F.col("j")) & (d2 <= reach * reach)).select("i", "j").distinct()


def greedy_fill(boxes: DataFrame, points: DataFrame, claimed: DataFrame | None = None, size: float = 2.0) -> DataFrame:
    """Each unclaimed point goes to the smallest instance whose box holds it:
    boxes(instance_id, n, lx, hx, ly, hy, lz, hz), points(point_idx, x, y, z).
    Boxes depend on their own points only, so the order of claims is a rank;
    they are spread over the cells of ``size`` that they meet."""
    free = points if claimed is None else points.join(claimed.select("point_idx").distinct(), "point_idx", "left_anti")
    inside = [F.col(a).between(F.col(f"l{a}"), F.col(f"h{a}")) for a in "xyz"]
    spread = boxes
    for a in "xyz":
        spread = spread.withColumn(f"v{a}", F.explode(F.sequence(cell(f"l{a}", size), cell(f"h{a}", size))))
    met = voxel_keys(free, size).join(spread, ["vx", "vy", "vz"]).filter(inside[0] & inside[1] & inside[2])
    w = Window.partitionBy("point_idx").orderBy("n", "instance_id")
    return met.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("point_idx", "instance_id")
