"""Ranks over a whole table without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.sources.tables import materialise


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with its place from 1 in the order of columns that are unique
    together: rows are dealt by range and written out, each range is counted,
    and a row's place is its range's start and its rank inside."""
    dealt = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_k", inner).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_k")).drop("_range", "_k", "_start")


def running_sums(df: DataFrame, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """df with, for each name in values, the sum of that column over all rows
    before a row in the order of columns that are unique together, range by
    range as in ``global_rank``."""
    dealt = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_n{i}") for i, v in enumerate(values.values())])
    w = Window.orderBy("_range")
    starts = sums.select("_range", *[(F.sum(f"_n{i}").over(w) - F.col(f"_n{i}")).alias(f"_s{i}") for i in range(len(values))])
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = {f"_k{i}": F.sum(v).over(inner) - F.col(v) for i, v in enumerate(values.values())}
    out = dealt.withColumns(within).join(F.broadcast(starts), "_range")
    return out.withColumns({n: F.col(f"_s{i}") + F.col(f"_k{i}") for i, n in enumerate(values)}).drop("_range", *[f"_{c}{i}" for i in range(len(values)) for c in "ks"])


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """``running_sums`` of one column."""
    return running_sums(df, order, {name: value})


def gaps(df: DataFrame, column: str) -> DataFrame:
    """(d): differences of neighbouring distinct values, inside ranges and
    between the greatest of one range and the least of the next."""
    dealt = materialise(df.select(F.col(column).alias("v")).filter("v is not null").distinct().repartitionByRange("v").withColumn("_range", F.spark_partition_id()), "ranges")
    inner = dealt.select((F.col("v") - F.lag("v").over(Window.partitionBy("_range").orderBy("v"))).alias("d"))
    ends = dealt.groupBy("_range").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return inner.filter("d is not null").union(ends.select((F.col("a") - F.lag("b").over(Window.orderBy("a"))).alias("d")).filter("d is not null"))


def discrete_quantile(df: DataFrame, key: str, order: Sequence[str], p: float) -> DataFrame:
    """(key, n, value): each key's size and the first of ``order`` at place
    ceil(p n), from ranks over ranges of all rows; a key is no single task."""
    ranked = global_rank(df.select(key, *order), [key, *order], "_place")
    first = ranked.groupBy(key).agg(F.min("_place").alias("_f"), F.count("*").alias("n"))
    at = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p)))
    return ranked.join(first, key).filter(F.col("_place") - F.col("_f") + 1 == at).select(key, "n", F.col(order[0]).alias("value"))
