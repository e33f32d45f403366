"""Operator 8: SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has the majority bits of the XXH64 values (seed 42) of
its three-word shingles. Two fingerprints link at ``RADIUS`` or fewer
differing bits. Equal fingerprints are one row from then on.

Distinct fingerprints are laid into tiles by the population counts of their
four 16-bit quarters. The counts of two fingerprints within the radius differ
by no more than the radius in sum, so a pair of tiles whose counts differ
beyond it is skipped, and no link is lost. Every other pair of tiles is
compared whole with numpy's exclusive-or and bit count. Large tiles are split
by hash to at most about ``TILE`` rows, so no task holds a group. From each
pair of tiles come the links of a spanning forest, not all pairs; alternating
stars then find the components.

Defined results: a null text or one without words has fingerprint zero and
links like any other; A-Z are lower-cased, nothing else; fewer than three
words make one shingle; rows of equal ids keep a row each; a null id is
ignored as a component's least id (null if there is no other); further columns
are left out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .common import map_rows, mark, materialise, release, small_batches, text_bytes
from .components import components

RADIUS = 2
TILE = 1024
WORDS = 3
SEED = 42


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.array([digest(join(w), SEED) for w in zip(words, words[1:], words[2:])], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_536):
        part = h[k : k + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(h))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp, the fingerprint as a signed BIGINT."""

    def run(keys: list, texts: list) -> list:
        return [keys, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("key"), text_bytes(text_col).alias("bytes")), run, ["key", "bytes"], f"{id_col} {kind}, fp bigint")


def forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever of a and b (None: a with itself) is within the
    radius, one for each node but a group's first."""
    both = a if b is None else np.concatenate([a, b])
    near = np.bitwise_count(a[:, None] ^ (a if b is None else b)[None, :]) <= radius
    i, j = np.nonzero(near)
    if b is None:
        i, j = i[i < j], j[i < j]
    else:
        j = j + len(a)
    label = np.arange(len(both))
    while len(i):
        old = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (old == label).all():
            break
    child = np.flatnonzero(label != np.arange(len(both)))
    return both[child], both[label[child]]


#: Differences of the quarters' counts to a tile's neighbours: itself and one of each two opposite ones.
def neighbours(radius: int) -> list[tuple[int, ...]]:
    near = [o for o in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, o)) <= radius]
    return [o for o in near if o >= (0, 0, 0, 0)]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) of a spanning forest of distinct(fp) within the radius."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    key = sum((q.cast("int") * 17**k for k, q in enumerate(quarter)), F.lit(0))
    rows = distinct.select("fp", key.alias("t"))
    # at most 17^4 = 83,521 rows
    sizes = F.broadcast(rows.groupBy("t").agg(F.ceil(F.count("*") / tile).cast("int").alias("n")))
    dealt = rows.join(sizes, "t").select("t", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("s"), "fp")
    tiles = materialise(dealt.groupBy("t", "s").agg(F.collect_list("fp").alias("fps")), "tiles")

    heads = tiles.select("t", "s")
    steps = F.array(*[F.lit(sum(d * 17**k for k, d in enumerate(o))) for o in neighbours(radius)])
    digits = [F.floor(F.col("t") / 17**k).cast("int") % 17 for k in range(4)]
    apart = [F.floor(F.col("t2") / 17**k).cast("int") % 17 - d for k, d in enumerate(digits)]
    pairs = heads.select("t", "s", F.explode(steps).alias("d")).withColumn("t2", F.col("t") + F.col("d"))
    pairs = pairs.filter(sum((F.abs(x) for x in apart), F.lit(0)) <= radius).drop("d")  # else a digit ran over
    pairs = pairs.join(heads.toDF("t2", "s2"), "t2").filter("t2 <> t or s2 >= s")
    pairs = pairs.join(tiles.toDF("t", "s", "a"), ["t", "s"]).join(tiles.toDF("t2", "s2", "b"), ["t2", "s2"])

    def run(t: list, s: list, a: list, t2: list, s2: list, b: list) -> list:
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(len(t)):
            same = (t[k], s[k]) == (t2[k], s2[k])
            x, y = forest(np.array(a[k], np.int64).view(np.uint64), None if same else np.array(b[k], np.int64).view(np.uint64), radius)
            u.append(x.view(np.int64))
            v.append(y.view(np.int64))
        return [np.concatenate(u), np.concatenate(v)]

    return map_rows(pairs, run, ["t", "s", "a", "t2", "s2", "b"], "u bigint, v bigint")


def roots(prints: DataFrame, id_col: str, radius: int) -> DataFrame:
    """prints(id, fp) to (fp, root, component_id), a row for each fingerprint."""
    begun = mark()
    first = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct")
    root = components(links(first.select("fp"), radius))
    of = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of = materialise(of, "rooted")
    release(of.sparkSession, begun, of)
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return of.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the least id in reach)."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    named = roots(prints, id_col, radius)
    return prints.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all its columns: that of the least id.

    Rows of one id in one component are repeated rows, of which the one with
    the least text stays, of equal texts that with the least hash of all its
    columns; of a component without any id, one row stays, chosen likewise."""
    n = len(docs.columns)
    src = docs.toDF(*[f"c{i}" for i in range(n)])  # names may be anything
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    begun = mark()
    prints = materialise(fingerprints(src.select(F.col(key).alias("id"), text), "id", text), "fingerprints")
    judged = materialise(prints.join(roots(prints, "id", radius), "fp").select("id", "fp", "component_id", "root"), "judged")
    release(docs.sparkSession, begun, judged)
    same = F.col(key).eqNullSafe(F.col("id"))
    if judged.groupBy("id").count().filter("count > 1").isEmpty():
        gone = judged.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id")
        return src.join(gone, same, "left_anti").toDF(*docs.columns)
    own = judged.filter(F.col("id").eqNullSafe(F.col("component_id"))).select("id", "fp", "root").distinct()
    marked = with_fingerprint(src, text)
    hashed = F.xxhash64(*[f"c{i}" for i, f in enumerate(docs.schema) if not has_map(f.dataType)])
    first = marked.join(own, same & (marked["_fp"] == own["fp"])).groupBy("id", "root").agg(F.min_by(F.struct(*src.columns), F.struct(F.col(text), hashed)).alias("row"))
    return first.select(*[F.col("row")[c] for c in src.columns]).toDF(*docs.columns)


def has_map(kind: DataType) -> bool:
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and has_map(kind.elementType) or isinstance(kind, StructType) and any(has_map(f.dataType) for f in kind)


def with_fingerprint(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with ``_fp``."""

    def add(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], schema=pa.schema([*list(b.schema)[:-1], pa.field("_fp", pa.int64())]))

    src = docs.withColumn("_fp", text_bytes(text_col))
    small_batches(docs.sparkSession)
    return src.mapInArrow(add, docs.withColumn("_fp", F.lit(0).cast("bigint")).schema)
