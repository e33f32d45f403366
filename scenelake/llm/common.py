"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.sources.tables import gone_at_exit, mark, materialise, new_path, release

__all__ = ["gone_at_exit", "mark", "materialise", "new_path", "release"]

#: Rows of one Arrow batch. Documents may have a hundred thousand characters,
#: so the default of 10,000 rows would let one batch hold a gigabyte.
BATCH_ROWS = 500

#: Bytes of the small batches that are looked at together.
GATHER = 4 << 20

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session (never raises it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this worker keeps between tasks: one operator's tables at a time.
_held: dict = {}


def held(key, make: Callable):
    """make(), remembered under its key until another key is asked for, so a
    worker that serves one stage after another holds one stage's memory."""
    if key not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Free memory that Arrow and the C library keep goes back to the machine,
    or the next stage's tables would come on top of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def text_bytes(col: str | Column) -> Column:
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def map_rows(df: DataFrame, fn: Callable[..., list], columns: list[str], schema: str, arrow: bool = False, gather: int = GATHER) -> DataFrame:
    """mapInArrow by columns: fn gets one Python list (``arrow``: one array,
    batches joined up to ``gather`` bytes) for each of ``columns`` and returns
    one for each column of ``schema``."""
    small_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    kinds = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, gather) if arrow else batches:
            got = fn(*(c if arrow else c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([as_array(x, f.type) for x, f in zip(got, kinds)], schema=kinds)

    return df.select(*columns).mapInArrow(run, out)


def gathered(batches: Iterator[pa.RecordBatch], gather: int = GATHER) -> Iterator[pa.RecordBatch]:
    """Batches joined up to ``gather`` bytes, so that what texts have in common
    is looked up less often."""
    have, size = [], 0
    for b in batches:
        if b.num_rows:
            have.append(b)
            size += b.nbytes
        if size >= gather:
            yield from pa.Table.from_batches(have).combine_chunks().to_batches()
            have, size = [], 0
    if have:
        yield from pa.Table.from_batches(have).combine_chunks().to_batches()


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def strings(values: pa.Array) -> pa.Array:
    """Text or its bytes as an array of strings with 32-bit offsets, null as
    empty; bytes that are no UTF-8 are replaced."""
    try:
        return pc.fill_null(values.cast(pa.string()), "")
    except pa.ArrowInvalid:
        return pa.array([(x if isinstance(x, bytes) else x.encode()).decode(errors="replace") if x is not None else "" for x in values.to_pylist()], pa.string())


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def byte_strings(values: pa.Array) -> list[bytes]:
    """A string array's values as bytes; slices of its buffer are far cheaper
    than a scalar object each."""
    if not len(values):
        return []
    cuts = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).tolist()
    data = values.buffers()[2].to_pybytes() if values.buffers()[2] is not None else b""
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class Chunks:
    """A batch's texts, null as empty: its different chunks between ASCII
    white space, each text's chunks among them, and where each text ends."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = strings(texts)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        coded = lists.flatten().dictionary_encode()
        self.chunks, self.which = byte_strings(coded.dictionary), coded.indices.to_numpy()
        self.ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        if b"" in self.chunks:  # before and after white space at a text's ends
            some = self.which != self.chunks.index(b"")
            self.ends = np.append(0, np.cumsum(some))[self.ends]
            self.which = self.which[some]

    def rows(self) -> list[tuple[int, int]]:
        return list(zip([0, *self.ends[:-1].tolist()], self.ends.tolist())) if len(self.ends) else []


def filter_rows(df: DataFrame, text_col: str, keep: Callable[[pa.Array], list]) -> DataFrame:
    """The rows of df for whose text (an array of bytes, null as empty)
    ``keep`` says True, with all their columns and without a shuffle."""
    small_batches(df.sparkSession)
    src = df.select("*", text_bytes(text_col).alias("_bytes"))
    src = src.toDF(*[f"c{i}" for i in range(len(src.columns))])  # names may repeat
    out = src.drop(src.columns[-1]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            mask = pa.array(keep(b.column(b.num_columns - 1)), pa.bool_())
            yield b.select(range(b.num_columns - 1)).filter(mask)

    return src.mapInArrow(run, out).toDF(*df.columns)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def id_crc(id_col: str) -> Column:
    """CRC-32 of the id as text; null as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0))
