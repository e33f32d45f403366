"""Point clouds in text and PCD files, as a DataFrame reader and a Python data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Text clouds: 3 or 6 numbers, white space or commas, # comments.
    Colours above 1 are divided by 255, judged over the whole file set."""
    n = F.filter(F.split(F.trim("value"), r"[,\s]+"), lambda x: x != "")
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#")).select(n.alias("n")).filter(F.size("n") >= 3)
    cols = [F.get("n", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyzrgb")]
    rows = rows.select(*cols).filter(" and ".join(f"{a} is not null and not isnan({a}) and abs({a}) < double('infinity')" for a in "xyz"))
    top = rows.agg(F.max(F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in "rgb"])).alias("_top"))
    scale = F.when(F.col("_top") > 1, 255.0).otherwise(1.0)
    return rows.join(F.broadcast(top)).select("x", "y", "z", *[(F.col(c) / scale).alias(c) for c in "rgb"])


class PcdSource(DataSource):
    """``spark.read.format("pcd").load(path)``: ASCII and binary PCD v0.7 files
    of float fields; a file must hold ``least`` points (default 3)."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return "file string, point_idx bigint, x double, y double, z double, r double, g double, b double"

    def reader(self, schema: StructType) -> "PcdReader":
        return PcdReader(self.options)


class PcdReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.least = options["path"], int(options.get("least", "3"))

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        path = self.path.removeprefix("file://")
        found = sorted(glob.glob(f"{path}/*.pcd")) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(self.path)
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from parse_pcd(partition.value, f.read(), self.least)


def parse_pcd(name: str, data: bytes, least: int = 3) -> Iterator[tuple]:
    """(file, point_idx, x, y, z, r, g, b) of a file's points; points that
    aren't finite keep their index and are left out."""
    import numpy as np

    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"{name}: no DATA line")
        key, *rest = data[at:end].decode("ascii", "replace").split() or ["#"]
        head[key.upper()] = rest
        at = end + 1
    fields, n = [f.lower() for f in head["FIELDS"]], int(head["POINTS"][0])
    if n < least:
        raise ValueError(f"{name}: {n} points, at least {least} are needed")
    if head["DATA"] == ["ascii"]:
        rows = np.array(data[at:].split()[: n * len(fields)], float).reshape(n, len(fields))
        columns = {f: rows[:, i] for i, f in enumerate(fields)}
    elif head["DATA"] == ["binary"]:
        kinds = [f"<{t.lower()}{s}" for t, s in zip(head["TYPE"], head["SIZE"])]
        table = np.frombuffer(data, np.dtype(list(zip(fields, kinds))), n, at)
        columns = {f: table[f] for f in fields}
    else:
        raise ValueError(f"{name}: {head['DATA']} isn't read")
    if "rgb" in columns:
        packed = columns["rgb"].astype("<f4").view("<u4") if columns["rgb"].dtype.kind == "f" else columns["rgb"].astype("<u4")
        columns |= {c: (packed >> s & 255) / 255.0 for c, s in (("r", 16), ("g", 8), ("b", 0))}
    xyz = np.stack([columns[a].astype(float) for a in "xyz"], 1)
    colour = [columns[c] if c in columns else None for c in "rgb"]
    for i in np.flatnonzero(np.isfinite(xyz).all(1)):
        yield name, int(i), *map(float, xyz[i]), *(None if c is None else float(c[i]) for c in colour)
