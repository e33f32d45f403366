"""Height bands, votes, grids, stencils and line votes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import gaps, global_rank

from .cells import offsets


def z_histogram(points: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, n) over the height range; the top value falls into the last bin."""
    r = points.agg(F.min("z").alias("_a"), F.max("z").alias("_b"))
    span = F.col("_b") - F.col("_a")
    k = F.when(span > 0, F.floor((F.col("z") - F.col("_a")) / span * bins)).otherwise(0).cast("int")
    return points.join(F.broadcast(r)).select(F.greatest(F.lit(0), F.least(F.lit(bins - 1), k)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def height_band(points: DataFrame, bins: int = 100, share: float = 0.02, margin: float = 0.1, least: float = 0.2) -> DataFrame:
    """One row (floor_z, ceiling_z, low, high): first and last bins above the
    share are floor and ceiling, the band lies between with a margin; with no
    two peaks it is the middle 60 %."""
    r = points.agg(F.min("z").alias("a"), F.max("z").alias("b"), F.count("*").alias("total"))
    h = z_histogram(points, bins).join(F.broadcast(r))
    big = F.col("n") > share * F.col("total")
    g = h.groupBy("a", "b").agg(F.min(F.when(big, F.col("bin"))).alias("p"), F.max(F.when(big, F.col("bin"))).alias("q"))
    step = (F.col("b") - F.col("a")) / bins
    floor, ceiling = F.col("a") + (F.col("p") + 0.5) * step, F.col("a") + (F.col("q") + 0.5) * step
    two = F.col("p").isNotNull() & (F.col("q") > F.col("p"))
    m = F.greatest(margin * (ceiling - floor), F.lit(least))
    return g.select(
        F.when(two, floor).alias("floor_z"),
        F.when(two, ceiling).alias("ceiling_z"),
        F.when(two, floor + m).otherwise(F.col("a") + 0.2 * (F.col("b") - F.col("a"))).alias("low"),
        F.when(two, ceiling - m).otherwise(F.col("a") + 0.8 * (F.col("b") - F.col("a"))).alias("high"),
    )


def slice_votes(points: DataFrame, low: float, high: float, slices: int, size: float, least: int) -> DataFrame:
    """Cells that hold points in ``least`` or more height slices: (gx, gy, votes)."""
    inside = points.filter(F.col("z").between(low, high))
    s = F.least(F.floor((F.col("z") - low) / ((high - low) / slices)).cast("int"), F.lit(slices - 1))
    cells = inside.select(F.floor(F.col("x") / size).cast("int").alias("gx"), F.floor(F.col("y") / size).cast("int").alias("gy"), s.alias("s")).distinct()
    return cells.groupBy("gx", "gy").agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)


def density(points: DataFrame, size: float) -> DataFrame:
    return points.groupBy(F.floor(F.col("x") / size).cast("int").alias("gx"), F.floor(F.col("y") / size).cast("int").alias("gy")).agg(F.count("*").alias("n"))


def bilinear_splat(points: DataFrame, size: float) -> DataFrame:
    """Each point shared among its four cells: (gx, gy, w)."""
    u, v = F.col("x") / size, F.col("y") / size
    base = points.select(F.floor(u).cast("int").alias("i"), F.floor(v).cast("int").alias("j"), (u - F.floor(u)).alias("a"), (v - F.floor(v)).alias("b"))
    four = F.array(*[F.struct((F.col("i") + di).alias("gx"), (F.col("j") + dj).alias("gy"), ((F.col("a") if di else 1 - F.col("a")) * (F.col("b") if dj else 1 - F.col("b"))).alias("w")) for di in (0, 1) for dj in (0, 1)])
    return base.select(F.explode(four).alias("c")).groupBy("c.gx", "c.gy").agg(F.sum("c.w").alias("w"))


def grid_step(points: DataFrame, low: float = 1e-6, high: float = 0.5) -> DataFrame:
    """One row: the lesser of the axes' upper-median gaps between neighbouring
    coordinates. Values are dealt by range, and so are the gaps within the
    limits, of which the middle one is looked up by its global rank."""
    out = None
    for a in "xy":
        near = gaps(points, a).filter((F.col("d") > low) & (F.col("d") < high))
        ranked = global_rank(near.withColumn("_u", F.monotonically_increasing_id()), ["d", "_u"], "k")
        mid = ranked.filter(F.col("k") == near.count() // 2 + 1).select("d")
        out = mid if out is None else out.unionByName(mid)
    return out.agg(F.min("d").alias("step"))


def density_percentile(grid: DataFrame, p: float) -> DataFrame:
    """Cells at or above the discrete percentile of the counts: the value at
    place int(p (n - 1)). Counts are few, so their histogram is ranked."""
    hist = grid.groupBy("n").agg(F.count("*").alias("m"))
    up = hist.withColumn("hi", F.sum("m").over(Window.orderBy("n"))).join(F.broadcast(grid.agg(F.count("*").alias("total"))))
    cut = up.filter(F.col("hi") > F.floor(p * (F.col("total") - 1))).agg(F.min("n").alias("cut"))
    return grid.join(F.broadcast(cut)).filter(F.col("n") >= F.col("cut")).select("gx", "gy", "n")


def shifted(grid: DataFrame, width: int, *more: str) -> DataFrame:
    """Each cell's value at all cells within the width."""
    o = F.explode(offsets(width, 2)).alias("o")
    return grid.select("gx", "gy", *more, o).select((F.col("gx") + F.col("o.d0")).alias("gx"), (F.col("gy") + F.col("o.d1")).alias("gy"), *more, ((F.col("o.d0") == 0) & (F.col("o.d1") == 0)).alias("own"))


def erode(grid: DataFrame, width: int) -> DataFrame:
    """Cells whose whole neighbourhood is occupied."""
    full = (2 * width + 1) ** 2
    n = shifted(grid.select("gx", "gy").distinct(), width).groupBy("gx", "gy").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") == full).select("gx", "gy")


def dilate(grid: DataFrame, width: int, value: float = 0.8) -> DataFrame:
    """Neighbours get ``value``, occupied cells the greater of theirs and it."""
    s = shifted(grid, width, "n").select("gx", "gy", F.when(F.col("own"), F.greatest(F.col("n").cast("double"), F.lit(value))).otherwise(value).alias("v"))
    return s.groupBy("gx", "gy").agg(F.max("v").alias("v"))


def neighbour_sum(grid: DataFrame, width: int) -> DataFrame:
    """Sum of each occupied cell's neighbourhood."""
    s = shifted(grid, width, "n")
    return s.groupBy("gx", "gy").agg(F.sum("n").cast("bigint").alias("total"), F.max("own").alias("own")).filter("own").drop("own")


def distance_score(grid: DataFrame, reach: int) -> DataFrame:
    """(gx, gy, v): cells within reach of an occupied one, 1 there and falling
    linearly with the distance."""
    o = F.explode(offsets(reach, 2)).alias("o")
    d = F.sqrt((F.col("o.d0") * F.col("o.d0") + F.col("o.d1") * F.col("o.d1")).cast("double"))
    s = grid.select("gx", "gy", o).select((F.col("gx") + F.col("o.d0")).alias("gx"), (F.col("gy") + F.col("o.d1")).alias("gy"), (1 - d / (reach + 1)).alias("v"))
    return s.filter("v > 0").groupBy("gx", "gy").agg(F.max("v").alias("v"))


def hough_votes(grid: DataFrame, angles: int, rho: float, least: int) -> DataFrame:
    """(theta, r, votes) of lines through occupied cells: angle steps of
    pi / angles, distance steps of rho."""
    t = F.explode(F.array(*[F.struct(F.lit(k).alias("theta"), F.lit(math.cos(math.pi * k / angles)).alias("c"), F.lit(math.sin(math.pi * k / angles)).alias("s")) for k in range(angles)])).alias("t")
    r = F.floor((F.col("gx") * F.col("t.c") + F.col("gy") * F.col("t.s")) / rho + 0.5).cast("int")
    return grid.select("gx", "gy", t).groupBy(F.col("t.theta").alias("theta"), r.alias("r")).agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)


def z_buffer(pixels: DataFrame, tolerance: float) -> DataFrame:
    """Points within the tolerance of their pixel's least depth: the least is
    aggregated map-side and joined back, so a pixel's points never gather."""
    least = pixels.groupBy("u", "v").agg(F.min("depth").alias("_least"))
    return pixels.join(least, ["u", "v"]).filter(F.col("depth") <= F.col("_least") + tolerance).drop("_least")


def pca_yaw(points: DataFrame) -> DataFrame:
    """One row: direction of the main axis in the plane, from second moments."""
    m = points.agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    return m.select((0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("yaw"))


def line_fit(points: DataFrame, key: str) -> DataFrame:
    """For each key: centre, direction and extent of the least-squares line."""
    m = points.groupBy(key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    m = m.select(key, "cx", "cy", (0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("yaw"))
    t = (F.col("x") - F.col("cx")) * F.cos("yaw") + (F.col("y") - F.col("cy")) * F.sin("yaw")
    return points.join(m, key).groupBy(key, "cx", "cy", "yaw").agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
