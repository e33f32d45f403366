"""Sparse images: grids (gx, gy, value) without rows for zero cells."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAUSS = {o: 2.0 ** (2 - sum(map(abs, o))) / 16 for o in itertools.product((-1, 0, 1), repeat=2)}


def spread(grid: DataFrame, weights: dict[tuple[int, int], float], value: str = "value") -> DataFrame:
    """Every cell's value sent to its neighbours: (gx, gy, w, value)."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(w)).alias("w")) for (a, b), w in weights.items()])
    s = grid.select("gx", "gy", F.col(value).alias("value"), F.explode(steps).alias("o"))
    return s.select((F.col("gx") + F.col("o.a")).cast("int").alias("gx"), (F.col("gy") + F.col("o.b")).cast("int").alias("gy"), F.col("o.w").alias("w"), "value")


def box(reach: int) -> dict[tuple[int, int], float]:
    return dict.fromkeys(itertools.product(range(-reach, reach + 1), repeat=2), 1.0)


def cell_centres(points: DataFrame, size: float) -> DataFrame:
    """(gx, gy, n, x, y): mean of each cell's points."""
    keys = [F.floor(F.col(a) / size).cast("int").alias(f"g{a}") for a in "xy"]
    return points.select(*keys, "x", "y").groupBy("gx", "gy").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def dilate(grid: DataFrame, reach: int) -> DataFrame:
    """Greatest value in reach of each cell."""
    return spread(grid, box(reach)).groupBy("gx", "gy").agg(F.max("value").alias("value"))


def erode(grid: DataFrame, reach: int) -> DataFrame:
    """Least value in reach; cells with an empty one in reach go."""
    g = spread(grid, box(reach)).groupBy("gx", "gy").agg(F.count("*").alias("_n"), F.min("value").alias("value"))
    return g.filter(F.col("_n") == (2 * reach + 1) ** 2).drop("_n")


def close(grid: DataFrame, reach: int) -> DataFrame:
    return erode(dilate(grid, reach), reach)


def median(grid: DataFrame) -> DataFrame:
    """Median of 3 x 3 cells, absent ones as zero: the fifth greatest of nine.
    Values are above zero."""
    s = spread(grid, box(1)).groupBy("gx", "gy").agg(F.sort_array(F.collect_list("value"), False).alias("v"))  # nine at most
    return s.filter(F.size("v") >= 5).select("gx", "gy", F.col("v")[4].alias("value"))


def gaussian(grid: DataFrame) -> DataFrame:
    """Weights 1 2 1 each way, over sixteen."""
    return spread(grid, GAUSS).groupBy("gx", "gy").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def threshold(grid: DataFrame, least: float, to: float = 1.0) -> DataFrame:
    return grid.filter(F.col("value") >= least).select("gx", "gy", F.lit(float(to)).alias("value"))


def chain(grid: DataFrame, reach: int, least: float) -> DataFrame:
    """Close, median, Gaussian, threshold."""
    return threshold(gaussian(median(close(grid, reach))), least)


def to_points(grid: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Occupied cells as points at their centres."""
    return grid.select("gx", "gy", (F.lit(x0) + (F.col("gx") + 0.5) * size).alias("x"), (F.lit(y0) + (F.col("gy") + 0.5) * size).alias("y"))


def from_points(points: DataFrame, affine: Sequence[float], reach: int = 0) -> DataFrame:
    """Pixels of points under (a, b, c, d, e, f): u = ax + by + c, v = dx + ey + f,
    rounded half up and dilated."""
    a, b, c, d, e, f = map(float, affine)
    u, v = F.floor(a * F.col("x") + b * F.col("y") + c + 0.5), F.floor(d * F.col("x") + e * F.col("y") + f + 0.5)
    g = points.select(u.cast("int").alias("gx"), v.cast("int").alias("gy")).distinct().withColumn("value", F.lit(1.0))
    return dilate(g, reach) if reach else g


def inverted(grid: DataFrame, width: int, height: int) -> DataFrame:
    """The empty cells of an image of that size."""
    rows = grid.sparkSession.range(height).select(F.col("id").cast("int").alias("gy"))
    cells = rows.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).select("gx", "gy")
    return cells.join(grid.select("gx", "gy"), ["gx", "gy"], "left_anti").withColumn("value", F.lit(1.0))


def depth_image(pixels: DataFrame, reach: int) -> DataFrame:
    """Least depth of each pixel's points in reach: pixels(u, v, depth)."""
    g = pixels.groupBy(F.col("u").alias("gx"), F.col("v").alias("gy")).agg((-F.min("depth")).alias("value"))
    return dilate(g, reach).select("gx", "gy", (-F.col("value")).alias("depth"))


def rotated(grid: DataFrame, angle: float) -> DataFrame:
    """Nearest-neighbour rotation about the origin: a target cell takes the
    source cell that its centre turned back falls into. Targets are looked for
    around each source's own turned centre, so the image needn't be dense."""
    c, s = math.cos(angle), math.sin(angle)
    x, y = F.col("gx") + 0.5, F.col("gy") + 0.5
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in box(1)])
    t = grid.select("gx", "gy", "value", F.floor(c * x - s * y).alias("u"), F.floor(s * x + c * y).alias("v"), F.explode(near).alias("o"))
    t = t.select("gx", "gy", "value", (F.col("u") + F.col("o.a")).cast("int").alias("u"), (F.col("v") + F.col("o.b")).cast("int").alias("v"))
    u, v = F.col("u") + 0.5, F.col("v") + 0.5
    hit = t.filter((F.floor(c * u + s * v) == F.col("gx")) & (F.floor(-s * u + c * v) == F.col("gy")))
    return hit.select(F.col("u").alias("gx"), F.col("v").alias("gy"), "value")


def bilinear(points: DataFrame, image: DataFrame, id_col: str, width: int, height: int) -> DataFrame:
    """points(id, u, v) with the image's value (gx, gy, value) between the four
    pixels around them; places beyond the border count as on it, absent pixels as zero."""
    u, v = F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), F.col("u"))), F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), F.col("v")))
    p = points.select(id_col, u.alias("u"), v.alias("v"))
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    p = p.withColumn("o", F.explode(corners))
    part = lambda c, k: F.when(F.col(f"o.{k}") == 1, F.col(c) - F.floor(c)).otherwise(1 - (F.col(c) - F.floor(c)))
    at = p.select(id_col, (F.floor("u") + F.col("o.a")).cast("int").alias("gx"), (F.floor("v") + F.col("o.b")).cast("int").alias("gy"), (part("u", "a") * part("v", "b")).alias("w"))
    return at.join(image.select("gx", "gy", "value"), ["gx", "gy"], "left").groupBy(id_col).agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value"))


def pasted(tiles: DataFrame, offsets: DataFrame) -> DataFrame:
    """One image of tiles(tile, gx, gy, value) at their offsets(tile, dx, dy);
    of overlapping pixels that are not black the last tile's stays."""
    t = tiles.filter("value > 0").join(offsets, "tile")
    return t.groupBy((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy")).agg(F.max_by("value", "tile").alias("value"))
