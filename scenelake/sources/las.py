"""LAS files as points, by the public LAS 1.0 to 1.4 layout."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: byte at which red, green and blue start, by point format.
COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
FORMATS = range(11)
#: Rows of a batch sent on.
ROWS = 1 << 18
SCHEMA = "path string, point_idx bigint, x double, y double, z double, red int, green int, blue int"


def las_batches(name: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """Batches of a file's points in file order, those that aren't finite left
    out; colours are null where the point format has none. ValueError for
    anything but LAS, for compressed points and for files cut short."""
    if data[:4] != b"LASF" or len(data) < 227:
        raise ValueError(f"{name}: not a LAS file")
    start, form, width, n = struct.unpack_from("<I", data, 96)[0], data[104], *struct.unpack_from("<HI", data, 105)
    if data[25] >= 4 and len(data) >= 255:
        n = struct.unpack_from("<Q", data, 247)[0] or n
    if form & 0x80 or form not in FORMATS:
        raise ValueError(f"{name}: compressed or unknown point format {form}")
    if start + n * width > len(data):
        raise ValueError(f"{name}: {len(data)} bytes hold fewer than {n} points")
    scale, shift = np.frombuffer(data, "<f8", 3, 131), np.frombuffer(data, "<f8", 3, 155)
    kinds = pa.schema([("path", pa.string()), ("point_idx", pa.int64()), *[(a, pa.float64()) for a in "xyz"], *[(c, pa.int32()) for c in ("red", "green", "blue")]])
    for first in range(0, n, ROWS):
        m = min(ROWS, n - first)
        rows = np.frombuffer(data, np.uint8, m * width, start + first * width).reshape(m, width)
        p = np.ascontiguousarray(rows[:, :12]).view("<i4") * scale + shift
        keep = np.flatnonzero(np.isfinite(p).all(1))
        if form in COLOUR_AT:
            at = COLOUR_AT[form]
            rgb = np.ascontiguousarray(rows[keep, at : at + 6]).view("<u2").astype(np.int32)
            colours = [pa.array(rgb[:, k]) for k in range(3)]
        else:
            colours = [pa.nulls(len(keep), pa.int32())] * 3
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(keep), pa.string()), pa.array(first + keep), *[pa.array(p[keep, k]) for k in range(3)], *colours], schema=kinds)


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """points(path, point_idx, x, y, z, red, green, blue) of LAS files on any
    file system, a task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                yield from las_batches(name, data.as_py())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def unit_colours(points: DataFrame) -> DataFrame:
    """red, green, blue over the greatest value of their own file; files without
    colour, or all black, keep nulls or zeros."""
    top = points.groupBy("path").agg(F.max(F.greatest("red", "green", "blue")).alias("_top"))
    return points.join(top, "path").withColumns({c: F.col(c) / F.greatest(F.col("_top"), F.lit(1)) for c in ("red", "green", "blue")}).drop("_top")
