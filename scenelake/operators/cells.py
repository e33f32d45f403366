"""Voxel and grid keys, and the joins that they make into equi-joins."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.sources.tables import materialise


def cell(value: Column | str, size: float) -> Column:
    """Floor key of a coordinate."""
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(v / F.lit(size)).cast("int")


def truncated_cell(value: Column | str, size: float) -> Column:
    """Key by truncation after a step down below zero; it differs from the
    floor at exact negative multiples."""
    v = (F.col(value) if isinstance(value, str) else value) / F.lit(size)
    return F.when(v < 0, v - 1).otherwise(v).cast("bigint")


def centre(key: Column | str, size: float) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return (k + F.lit(0.5)) * F.lit(size)


def voxel_keys(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({f"v{a}": cell(a, size) for a in "xyz"})


def voxel_index(points: DataFrame, size: float) -> DataFrame:
    """(vx, vy, vz, n, first_idx): the index's cells with their counts."""
    return voxel_keys(points, size).groupBy("vx", "vy", "vz").agg(F.count("*").alias("n"), F.min("point_idx").alias("first_idx"))


def voxel_stats(points: DataFrame, size: float) -> DataFrame:
    """One row: cells, least, most and mean points of a cell."""
    return voxel_index(points, size).agg(F.count("*").alias("n_voxels"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def voxel_downsample(points: DataFrame, size: float, columns: Sequence[str] = ("x", "y", "z", "r", "g", "b")) -> DataFrame:
    """Mean of each cell's positions and colours."""
    return voxel_keys(points, size).groupBy("vx", "vy", "vz").agg(*[F.round(F.avg(c), 4).alias(c) for c in columns])


def voxel_union(clouds: Sequence[DataFrame], size: float) -> DataFrame:
    """Distinct grid points of several clouds, rounded half to even."""
    keys = [c.select(*[F.bround(F.col(a) / size, 0).cast("int").alias(f"g{a}") for a in "xyz"]) for c in clouds]
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return out.distinct()


def voxels_in_box(points: DataFrame, size: float, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Cells of the index that meet an axis-aligned box: a range on the keys."""
    keys = voxel_index(points, size)
    for a, lo, hi in zip("xyz", low, high):
        keys = keys.filter(F.col(f"v{a}").between(int(lo // size), int(hi // size)))
    return keys


def offsets(reach: int, dims: int) -> Column:
    """Array of structs (d0, d1, ...) of all offsets within reach."""
    import itertools

    return F.array(*[F.struct(*[F.lit(v).alias(f"d{i}") for i, v in enumerate(o)]) for o in itertools.product(range(-reach, reach + 1), repeat=dims)])


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, axes: str = "xyz") -> DataFrame:
    """Pairs within the radius: (left_id, right_id, d2). Cells of the radius's
    size make the range an equi-join: one side visits its 3^n neighbours."""
    dims = len(axes)
    near = left.select(F.col(left_id).alias("_l"), *[F.col(a).alias(f"_l{a}") for a in axes], F.explode(offsets(1, dims)).alias("_o"))
    near = near.select("_l", *[f"_l{a}" for a in axes], *[(cell(f"_l{a}", radius) + F.col("_o")[f"d{i}"]).alias(f"_k{a}") for i, a in enumerate(axes)])
    far = right.select(F.col(right_id).alias("_r"), *[F.col(a).alias(f"_r{a}") for a in axes], *[cell(a, radius).alias(f"_k{a}") for a in axes])
    d2 = sum(((F.col(f"_l{a}") - F.col(f"_r{a}")) ** 2 for a in axes), F.lit(0.0))
    met = near.join(far, [f"_k{a}" for a in axes]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    return met.select(F.col("_l").alias(left_id), F.col("_r").alias(f"{right_id}_2" if left_id == right_id else right_id), "d2")


def radius_self_join(points: DataFrame, radius: float, id_col: str = "point_idx", axes: str = "xyz") -> DataFrame:
    """Each pair once, the lesser id first."""
    return radius_pairs(points, points, radius, id_col, id_col, axes).filter(F.col(id_col) < F.col(f"{id_col}_2"))


def knn(points: DataFrame, k: int, radius: float, id_col: str = "point_idx") -> DataFrame:
    """The k nearest other points within ``radius``: (id, neighbour, rank, d2).

    Ties go to the lesser id. Points with fewer than k others in the radius
    show fewer rows; ``knn_exact`` completes them."""
    pairs = radius_pairs(points, points, radius, id_col, id_col).filter(F.col(id_col) != F.col(f"{id_col}_2"))
    w = Window.partitionBy(id_col).orderBy("d2", f"{id_col}_2")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnRenamed(f"{id_col}_2", "neighbour")


def knn_exact(points: DataFrame, k: int, radius: float, id_col: str = "point_idx", axes: str = "xyz") -> DataFrame:
    """The k nearest other points of every point: (id, neighbour, d2, rank)."""
    return nearest_exact(points, points, k, radius, id_col, id_col, axes).withColumnRenamed(f"{id_col}_2", "neighbour")


def nearest_exact(left: DataFrame, right: DataFrame, k: int, radius: float, left_id: str, right_id: str, axes: str = "xyz") -> DataFrame:
    """The k nearest of right to every row of left, itself left out where the
    ids are of one column: (left_id, right_id, d2, rank). The radius doubles
    for the rows that lack neighbours, so only the sparse ones visit larger
    cells; each round is written out, and the last one's cells hold everything."""
    same = left_id == right_id
    other = f"{right_id}_2" if same else right_id
    total = right.count()
    want = min(k, total - 1 if same else total)
    done, todo = [], left
    while True:
        pairs = radius_pairs(todo, right, radius, left_id, right_id, axes)
        pairs = pairs.filter(F.col(left_id) != F.col(other)) if same else pairs
        w = Window.partitionBy(left_id).orderBy("d2", other)
        near = materialise(pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(left_id, other, "d2", "rank"), "near")
        full = near.filter(F.col("rank") >= want).select(left_id).distinct()
        done.append(near.join(full, left_id, "left_semi"))
        todo = todo.join(full, left_id, "left_anti")
        if want <= 0 or todo.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        todo = materialise(todo, "sparse")
        radius *= 2


def statistical_outliers(points: DataFrame, k: int, ratio: float, radius: float, id_col: str = "point_idx") -> DataFrame:
    """Points whose mean distance to their k neighbours is within ``ratio``
    deviations of the mean of all: (id, mean_distance, kept)."""
    mean = knn_exact(points, k, radius, id_col).groupBy(id_col).agg(F.avg(F.sqrt("d2")).alias("m"))
    stat = mean.agg(F.avg("m").alias("_a"), F.stddev_samp("m").alias("_s"))
    return mean.join(F.broadcast(stat)).select(id_col, F.round("m", 6).alias("mean_distance"), (F.col("m") < F.col("_a") + ratio * F.col("_s")).alias("kept"))


def containment(small: DataFrame, large: DataFrame, size: float) -> DataFrame:
    """Share of each small set's points that lie in a voxel of each large set:
    small(a, x, y, z), large(b, x, y, z) to (a, b, inside, total)."""
    cells = voxel_keys(large, size).select("b", "vx", "vy", "vz").distinct()
    mine = voxel_keys(small, size).groupBy("a", "vx", "vy", "vz").agg(F.count("*").alias("n"))
    total = mine.groupBy("a").agg(F.sum("n").alias("total"))
    met = mine.join(cells, ["vx", "vy", "vz"]).groupBy("a", "b").agg(F.sum("n").alias("inside"))
    return met.join(total, "a").select("a", "b", "inside", "total", F.round(F.col("inside") / F.col("total"), 6).alias("ratio"))
