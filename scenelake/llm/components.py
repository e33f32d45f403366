"""Connected components of a table of links, by alternating stars.

A large-star step ties each node's greater neighbours to its least one, a
small-star step ties its lesser neighbours and itself to the least; the two
alternate until nothing changes, after a number of rounds that follows the
logarithm of the longest path. Every round is written to the shared folder.
No node's links are ever gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mark, materialise, release


def star(links: DataFrame, large: bool) -> DataFrame:
    """links(u, v) with u > v."""
    pairs = links.union(links.select("v", "u")) if large else links
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        near = pairs.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
    return near.toDF("u", "v").filter("u <> v").distinct()


def state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v) but the roots themselves;
    the root is the least node that can be reached. Self-links, repeated links
    and links with a null are ignored."""
    whole = links.filter("u is not null and v is not null and u <> v")
    now = whole.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = mark()
    now = materialise(now, "links")
    seen = state(now)
    while seen[0]:
        now = materialise(star(star(now, True), False), "links")
        release(now.sparkSession, before, now)
        if (new := state(now)) == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
