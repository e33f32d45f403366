"""Streams of scans: sources under one schema, downsampled scans, published maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scenelake.operators.cells import cell


def merged_sources(sources: dict[str, DataFrame], columns: Sequence[str], late: str = "1 second") -> DataFrame:
    """Streams of several sensors as one, each with its name and the event time
    ``ts`` under a watermark; columns that a source lacks are null."""
    out = None
    for name, df in sources.items():
        one = df.withWatermark("ts", late).select(F.lit(name).alias("sensor"), "ts", *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])
        out = one if out is None else out.unionByName(one)
    return out


def scan_cells(points: DataFrame, size: float, every: str = "100 milliseconds", late: str = "1 second") -> DataFrame:
    """Mean point of each cell of a scan, the points(ts, x, y, z) of one window
    of time. A window's state goes once the watermark has passed it."""
    keyed = points.withWatermark("ts", late).withColumns({f"v{a}": cell(a, size) for a in "xyz"})
    return keyed.groupBy(F.window("ts", every).alias("scan"), "vx", "vy", "vz").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in "xyz"])


def publish(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each batch's views, as cloud, odometry, path or markers, written as
    Parquet under ``path``/name/batch=id. A batch that runs again overwrites
    its own folder, so a restart neither loses nor repeats rows. Both folders
    are shared ones."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, view in sinks.items():
                view(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def plane_markers(planes: DataFrame) -> DataFrame:
    """Centre, normal and a colour by trust of planes(vx, vy, vz, n, nx, ny, nz,
    d, planar): planar ones alone, redder with fewer points."""
    trust = F.least(F.lit(1.0), F.col("n") / 50.0)
    return planes.filter("planar").select("vx", "vy", "vz", "nx", "ny", "nz", (1 - trust).alias("r"), trust.alias("g"), F.lit(0.0).alias("b"))
