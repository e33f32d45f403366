"""Sensor streams: scans met with samples, voxel states, resets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scan_samples(scans: DataFrame, samples: DataFrame, late: str = "1 second", guard: str = "20 milliseconds") -> DataFrame:
    """scans(scan_id, sensor, beg, end, n) with the samples(sensor, ts, value)
    of their span and a guard after it. Both sides carry watermarks, so a scan
    is done once samples beyond its end have come; scans of one point or none
    are dropped."""
    s = scans.filter("n > 1").withWatermark("end", late)
    i = samples.withColumnRenamed("sensor", "_sensor").withWatermark("ts", late)
    met = F.expr(f"sensor = _sensor AND ts >= beg AND ts <= end + INTERVAL {guard} AND end <= ts + INTERVAL 10 minutes")
    return s.join(i, met).drop("_sensor")


STATE = "n bigint, sx double, sy double, sz double, xx double, xy double, xz double, yy double, yz double, zz double, done boolean"
PLANE = "vx int, vy int, vz int, n bigint, nx double, ny double, nz double, d double, planar boolean, frozen boolean"


def voxel_planes(points: DataFrame, size: float, least: int = 5, most: int = 1000, flat: float = 0.01) -> DataFrame:
    """Plane of each voxel, kept up as points(x, y, z) come: moments are the
    state; a voxel shows a row for each batch that changes it once it holds
    ``least`` points, and stops learning at ``most``."""
    keyed = points.select(*[F.floor(F.col(a) / size).cast("int").alias(f"v{a}") for a in "xyz"], "x", "y", "z")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = list(state.get) if state.exists else [0, *[0.0] * 9, False]
        changed = False
        for f in frames:
            if m[10]:
                break
            p = f[["x", "y", "z"]].to_numpy()
            q = p.T @ p
            m[0] += len(p)
            for k, v in enumerate([*p.sum(0), q[0, 0], q[0, 1], q[0, 2], q[1, 1], q[1, 2], q[2, 2]]):
                m[k + 1] += float(v)
            changed = True
            m[10] = m[0] >= most
        state.update(tuple(m))
        if changed and m[0] >= least:
            normal, d, value = plane(m)
            yield pd.DataFrame([[*key, m[0], *normal, d, bool(value < flat), m[10]]], columns=["vx", "vy", "vz", "n", "nx", "ny", "nz", "d", "planar", "frozen"])

    return keyed.groupBy("vx", "vy", "vz").applyInPandasWithState(update, PLANE, STATE, "update", GroupStateTimeout.NoTimeout)


def plane(m: list) -> tuple[np.ndarray, float, float]:
    """Normal, offset and least eigenvalue of a voxel's moments."""
    n, c = m[0], np.array(m[1:4]) / m[0]
    second = np.array([[m[4], m[5], m[6]], [m[5], m[7], m[8]], [m[6], m[8], m[9]]]) / n
    value, vector = np.linalg.eigh(second - np.outer(c, c))
    normal = vector[:, 0] * (1 if vector[np.abs(vector[:, 0]).argmax(), 0] > 0 else -1)
    return normal, float(-normal @ c), float(max(value[0], 0))


def with_resets(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, ts DOUBLE) with the number of the run: a time before the last
    one starts a new run, as a sensor that restarts. Nothing is dropped as
    late."""
    kind = rows.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (float("-inf"), 0)
        for f in frames:
            runs = []
            for t in f["ts"]:
                run += t < last
                last = t
                runs.append(run)
            yield pd.DataFrame({key: f[key], "ts": f["ts"], "run": runs})
        state.update((last, int(run)))

    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, ts double, run bigint", "last double, run bigint", "append", GroupStateTimeout.NoTimeout)
