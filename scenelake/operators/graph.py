"""Components, density clustering, scene-graph edges and triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.sources.tables import materialise

from .cells import nearest_exact, radius_pairs, radius_self_join


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with the least node of each component, for nodes(node) and
    links(a, b). Labels are taken over from neighbours and then from the
    label's own label, so the rounds follow the logarithm of the diameter.
    Each round is written out, which ends the lineage."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).filter("a is not null and b is not null and a <> b").distinct(), "links")
    now = materialise(nodes.select("node", F.col("node").alias("root")).distinct(), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = now.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialise(low.join(jump, "root", "left").select("node", F.coalesce("up", "root").alias("root"), "old"), "labels")
        if new.filter("root <> old").isEmpty():
            return new.select("node", "root")
        now = new.select("node", "root")


def dbscan(points: DataFrame, radius: float, least: int, id_col: str = "point_idx", axes: str = "xyz") -> DataFrame:
    """(id, cluster, core): cluster is the least core point of it; a border
    point joins its least core neighbour's cluster; noise is left out."""
    pairs = materialise(radius_self_join(points, radius, id_col, axes).select(F.col(id_col).alias("a"), F.col(f"{id_col}_2").alias("b")), "pairs")
    both = pairs.union(pairs.select("b", "a"))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    core = materialise(degree.filter(F.col("n") + 1 >= least).select(F.col("a").alias("node")), "core") if least > 1 else points.select(F.col(id_col).alias("node"))
    inner = both.join(core.withColumnRenamed("node", "a"), "a", "left_semi").join(core.withColumnRenamed("node", "b"), "b", "left_semi")
    label = components(core, inner)
    border = both.join(core.withColumnRenamed("node", "a"), "a", "left_anti").join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("root"))
    return label.select(F.col("node").alias(id_col), F.col("root").alias("cluster"), F.lit(True).alias("core")).union(border.select("a", "root", F.lit(False)))


def graph_edges(nodes: DataFrame, ratio: float, low: float = 1.0, high: float = 6.0, left_out: tuple[str, ...] = ("floor", "ceiling")) -> DataFrame:
    """(i, j, dist) for i < j nearer than clamp(ratio * greater radius): nodes
    (node_id, semantic, x, y, z, radius). Cells of the clamp's upper bound
    hold all pairs that can be near enough. Radii travel with the nodes, so they
    aren't joined to the pairs."""
    use = nodes.filter(~F.col("semantic").isin(*left_out)) if left_out else nodes
    radius = F.when(F.col("semantic") == "wall", low).otherwise(F.col("radius"))
    one = use.select(F.struct(F.col("node_id").alias("id"), radius.alias("r")).alias("_n"), *"xyz")
    pairs = radius_pairs(one, one, high, "_n", "_n").filter(F.col("_n.id") < F.col("_n_2.id"))
    d = F.sqrt("d2")
    reach = F.greatest(F.lit(low), F.least(F.lit(high), ratio * F.greatest("_n.r", "_n_2.r")))
    return pairs.filter(d < reach).select(F.col("_n.id").alias("i"), F.col("_n_2.id").alias("j"), d.alias("dist"))


def nearest(nodes: DataFrame, floors: DataFrame) -> DataFrame:
    """(node_id, floor_id) with the closest floor but itself, by cells that
    grow for nodes without one."""
    two = nearest_exact(nodes, floors.withColumnRenamed("node_id", "floor_id"), 2, 4.0, "node_id", "floor_id")
    return two.filter("node_id <> floor_id").groupBy("node_id").agg(F.min_by("floor_id", "rank").alias("floor_id"))


def triplets(edges: DataFrame) -> DataFrame:
    """(centre, a, b): pairs a < b of each node's neighbours."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("i").alias("centre"), F.col("j").alias("a")), F.struct(F.col("j").alias("centre"), F.col("i").alias("a")))).alias("_e")).select("_e.*")
    return ends.join(ends.withColumnRenamed("a", "b"), "centre").filter("a < b").select("centre", "a", "b")
