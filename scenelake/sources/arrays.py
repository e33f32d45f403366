"""Point files by Spark's binary reader: NPY, ASCII PLY; sensor packets; settings."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "path string, point_idx bigint, x double, y double, z double"


def npy_points(data: bytes) -> np.ndarray:
    """(N, 3) of an NPY array (N, C) or (C, N), C from 3 to 9; the longer side is N."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    long = data[6] > 1
    size = int.from_bytes(data[8 : 12 if long else 10], "little")
    at = (12 if long else 10) + size
    head = ast.literal_eval(data[at - size : at].decode("latin-1"))
    if np.dtype(head["descr"]).hasobject:
        raise ValueError("arrays of objects aren't read")
    a = np.frombuffer(data, np.dtype(head["descr"]), offset=at).reshape(head["shape"], order="F" if head["fortran_order"] else "C")
    if a.ndim != 2 or min(a.shape) < 3:
        raise ValueError("points need two axes and three columns")
    a = a if a.shape[1] <= a.shape[0] or a.shape[1] <= 9 and a.shape[0] > 9 else a.T
    return a[:, :3].astype(float)


def ply_points(data: bytes) -> np.ndarray:
    """(N, 3) of an ASCII PLY's vertices."""
    head, _, body = data.partition(b"end_header\n")
    lines = head.decode().splitlines()
    if not lines or lines[0] != "ply" or not any(x.startswith("format ascii") for x in lines):
        raise ValueError("only ASCII PLY is read")
    n, names, inside = 0, [], False
    for x in lines:
        if x.startswith("element "):
            inside = x.split()[1] == "vertex"
            n = int(x.split()[2]) if inside else n
        elif x.startswith("property ") and inside:
            names.append(x.split()[-1])
    rows = [r.split() for r in body.decode().splitlines()[:n]]
    at = [names.index(c) for c in "xyz"]
    return np.array([[float(r[k]) for k in at] for r in rows]).reshape(len(rows), 3)


READERS = {".npy": npy_points, ".ply": ply_points}


def read_points(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """points(path, point_idx, x, y, z) of NPY and PLY files, any file system;
    values that aren't numbers are left out, files of under ``least`` points refused."""
    kinds = pa.schema([("path", pa.string()), ("point_idx", pa.int64()), *[(a, pa.float64()) for a in "xyz"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = READERS[name[name.rfind(".") :].lower()](data)
                if len(p) < least:
                    raise ValueError(f"{name}: under {least} points")
                idx = np.flatnonzero(np.isfinite(p).all(1))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(idx)), pa.array(idx), *[pa.array(p[idx, k]) for k in range(3)]], schema=kinds)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, POINTS)


def packets(raw: DataFrame, every: int, blind: float, lines: int = 16, low: float = -15.0, step: float = 2.0) -> DataFrame:
    """raw(point_idx, line, tag, x, y, z) without bad lines and tags (bits 4
    and 5 of a good one say 0 or 1), every ``every``-th point, outside the
    blind radius, with its scan ring by elevation."""
    good = raw.filter((F.col("line") < lines) & F.col("tag").bitwiseAND(F.lit(0x30)).isin(0, 0x10))
    some = good.filter((F.col("point_idx") % every == 0) & (F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 > blind**2))
    up = F.degrees(F.atan2("z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)))
    return some.withColumn("ring", F.floor((up - low) / step + 0.5).cast("int"))


def settings(text: str, defaults: dict) -> dict:
    """``key: value`` lines over the defaults; a value takes its default's kind,
    other keys and lines are left out."""
    out = dict(defaults)
    for line in text.splitlines():
        m = re.match(r"\s*([A-Za-z_][\w.]*)\s*:\s*(.*?)\s*(?:#.*)?$", line)
        if m and m[1] in out and m[2]:
            kind, value = type(out[m[1]]), m[2].strip("\"'")
            out[m[1]] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
    return out


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(row, x, y, yaw): header skipped, rows numbered in the order of the file."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    t = spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("row", "line")).filter("row > 0")
    v = F.split(F.trim("line"), r"[\s,]+")
    return t.select((F.col("row") - 1).alias("row"), *[v[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "yaw"))])
