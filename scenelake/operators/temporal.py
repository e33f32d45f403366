"""As-of joins, interpolation and windows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_interpolate(queries: DataFrame, samples: DataFrame, key: str, gap: int) -> DataFrame:
    """queries(key, qid, us) against samples(key, us, x), us in microseconds:
    the samples before and after, and x between them; nulls where a side is
    missing or the two are further apart than the gap. One sort of both
    tables' union replaces a range join. Samples of one time: the greatest x
    stands before, the least after."""
    u = queries.select(key, "us", "qid", F.lit(None).cast("double").alias("x"), F.lit(1).alias("o")).unionByName(
        samples.groupBy(key, "us").agg(F.max("x").alias("x")).select(key, "us", F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), "x", F.lit(0).alias("o"))
    )
    back = Window.partitionBy(key).orderBy("us", "o").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("us"), "o").rowsBetween(Window.unboundedPreceding, 0)
    s = F.when(F.col("o") == 0, F.struct("us", "x"))
    both = u.withColumn("a", F.last(s, ignorenulls=True).over(back)).withColumn("b", F.last(s, ignorenulls=True).over(ahead)).filter("o = 1")
    span = F.col("b.us") - F.col("a.us")
    x = F.when(span == 0, F.col("a.x")).otherwise(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("us") - F.col("a.us")) / span)
    return both.select(key, "qid", "us", F.when(span <= gap, x).alias("x"))


def ego_motion(poses: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Step from the row before; the first row takes the step to the next, and
    a lone row 0."""
    w = Window.partitionBy(key).orderBy(*order)
    return poses.withColumn("dx", F.coalesce(F.col("x") - F.lag("x").over(w), F.lead("x").over(w) - F.col("x"), F.lit(0.0)))


def distance_windows(poses: DataFrame, key: str, order: list[str], start: float, length: float) -> DataFrame:
    """(key, w, n): overlapping windows over the distance travelled, one every
    ``start``, each ``length`` long."""
    w = Window.partitionBy(key).orderBy(*order)
    d = poses.withColumn("_s", F.abs(F.col("x") - F.lag("x").over(w))).withColumn("d", F.sum(F.coalesce("_s", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.floor(F.col("d") / start).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("d") - length) / start).cast("int") + 1)
    return d.withColumn("w", F.explode(F.sequence(first, last))).groupBy(key, "w").agg(F.count("*").alias("n"))


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("mean", F.avg(value).over(w)).withColumn("median", F.percentile(value, F.lit(0.5)).over(w))


def travelled(poses: DataFrame, key: str, order: list[str], step: float) -> DataFrame:
    """Distance along accepted rows: a row counts if it lies over ``step`` from
    the last accepted one. A state runs through each key's rows, in the order
    of columns that are unique together: (key, *order, d)."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        at, d, out = None, 0.0, []
        for x in g["x"]:
            if at is None:
                at = x
            elif abs(x - at) > step:
                d, at = d + abs(x - at), x
            out.append(d)
        return g[[key, *order]].assign(d=out)

    kinds = [f"{c} {poses.schema[c].dataType.simpleString()}" for c in (key, *order)]
    return poses.select(key, *order, "x").groupBy(key).applyInPandas(run, ", ".join([*kinds, "d double"]))


def end_frames(walked: DataFrame, key: str, order: list[str], length: float) -> DataFrame:
    """(key, *order, end_id): for each row the first one at least ``length``
    further along, -1 for none, by one search in the key's distances."""
    import numpy as np
    import pandas as pd

    last = order[-1]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        d = g["d"].to_numpy()
        at = np.searchsorted(d, d + length - 1e-9)
        ids = np.append(g[last].to_numpy(), -1)
        return g[[key, *order]].assign(end_id=ids[at])

    kinds = [f"{c} {walked.schema[c].dataType.simpleString()}" for c in (key, *order)]
    return walked.groupBy(key).applyInPandas(run, ", ".join([*kinds, "end_id bigint"]))
