"""Operator 4: token ids in wavelet-matrix shards.

Documents are dealt out by ranges of their id and sorted, encoded with the
tokenizers library, closed with an end id and packed into shards. A shard is
one row of a Parquet file: its documents, their ends, and a wavelet matrix,
which is one bit-plane for each bit of an id, each with sampled ranks. Any
token can be read, counted or looked up from that one file.

Format of ``matrix`` (little endian): "WVM1", uint8 planes, uint64 n, then for
each plane from the highest bit: uint64 zeros, the ranks (uint32 ones before
each block of 512 bits), the bits (64-bit words, lowest bit first).

Defined results: a null text counts as empty; an empty text has the end id
alone; null ids come first; rows of equal ids are ordered by text and each
keeps its place; further columns are left out; an empty table writes no shard.

The library is asked for each chunk (see ``bpe.told_apart``), once for as long
as the chunk is remembered: its pattern drops white space and its normaliser
joins nothing across it, so a text's ids are its chunks' ids. Lower-case Latin
words go straight to the library's model, many at a time. The file must be of
the kind that ``bpe.WordBpe`` reads, its pattern of words included.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.operators.ordering import running_sum

from . import bpe
from .common import arrow_schema, gathered, held, small_batches

BLOCK = 512

#: A shard is closed at the document that brings it to this many ids.
SHARD_TOKENS = 1 << 20

#: Remembered chunks of each worker: about 70 MB each generation.
CHUNKS = 400_000

#: Shards whose starts are broadcast (24 bytes each); more are joined.
MOST_BROADCAST = 200_000


class WaveletMatrix:
    """Access, rank, select and occurrences over a sequence of small integers."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> "WaveletMatrix":
        n, planes = len(ids), []
        for b in range(width - 1, -1, -1):
            one = ((ids >> b).astype(np.uint8) & 1).view(bool)
            bits = np.packbits(one, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)]).view("<u8")
            ones = np.bitwise_count(bits).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
            low = np.compress(~one, ids)
            planes.append((len(low), ranks, bits))
            ids = np.concatenate([low, np.compress(one, ids)])
        return cls(n, planes)

    def to_bytes(self) -> bytes:
        out = [b"WVM1", struct.pack("<BQ", len(self.planes), self.n)]
        for zeros, ranks, bits in self.planes:
            out += [struct.pack("<Q", zeros), ranks.astype("<u4").tobytes(), bits.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> "WaveletMatrix":
        if data[:4] != b"WVM1":
            raise ValueError("not a wavelet matrix")
        width, n = struct.unpack_from("<BQ", data, 4)
        blocks, at, planes = -(-n // BLOCK), 13, []
        for _ in range(width):
            (zeros,) = struct.unpack_from("<Q", data, at)
            ranks = np.frombuffer(data, "<u4", blocks + 1, at + 8)
            at += 8 + 4 * (blocks + 1)
            planes.append((zeros, ranks, np.frombuffer(data, "<u8", blocks * BLOCK // 64, at)))
            at += blocks * BLOCK // 8
        return cls(n, planes)

    @staticmethod
    def _ones(ranks: np.ndarray, bits: np.ndarray, i: int) -> int:
        """Ones before place i of a plane."""
        w, r = divmod(i, 64)
        first = i // BLOCK * (BLOCK // 64)
        count = int(ranks[i // BLOCK]) + int(np.bitwise_count(bits[first:w]).sum())
        return count + (int(bits[w]) & ((1 << r) - 1)).bit_count() if r else count

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for zeros, ranks, bits in self.planes:
            one = int(bits[i // 64]) >> (i % 64) & 1
            ones = self._ones(ranks, bits, i)
            i = zeros + ones if one else i - ones
            value = value << 1 | one
        return value

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        width = len(self.planes)
        if token < 0 or token >> width:
            return 0, 0
        for k, (zeros, ranks, bits) in enumerate(self.planes):
            a, b = self._ones(ranks, bits, i), self._ones(ranks, bits, j)
            i, j = (zeros + a, zeros + b) if token >> (width - 1 - k) & 1 else (i - a, j - b)
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """How often the token stands at places i to j - 1."""
        a, b = self._range(token, i, self.n if j is None else j)
        return b - a

    def _select(self, plane: tuple[int, np.ndarray, np.ndarray], one: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th ones (or zeros) of a plane, k ascending: the
        sampled ranks give the block, counts of its words the word, and the
        word's bits the place. Only the blocks that hold one are read."""
        _, ranks, bits = plane
        before = ranks.astype(np.int64)
        if not one:
            before = np.arange(len(ranks)) * BLOCK - before
        block = np.searchsorted(before, k, "right") - 1
        words = bits.reshape(-1, BLOCK // 64)[block]
        if not one:
            words = ~words
        upto = np.cumsum(np.bitwise_count(words), 1, dtype=np.int64)
        left = k - before[block]
        word = (upto <= left[:, None]).sum(1)
        at = np.arange(len(k))
        left = left - np.where(word > 0, upto[at, np.maximum(word, 1) - 1], 0)
        bit = np.unpackbits(words[at, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * BLOCK + word * 64 + np.argmax(np.cumsum(bit, 1, dtype=np.int64) > left[:, None], 1)

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        """Places in the sequence of places in the token's run at the bottom."""
        for k, plane in enumerate(reversed(self.planes)):
            at = self._select(plane, 1, at - plane[0]) if token >> k & 1 else self._select(plane, 0, at)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of the token, ascending: its run at the bottom, taken up
        plane by plane with select."""
        a, b = self._range(token, 0, self.n)
        return np.concatenate([np.zeros(0, np.int64), *(self._up(token, np.arange(i, min(b, i + STRIDE))) for i in range(a, b, STRIDE))])

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0; -1 if there are fewer."""
        a, b = self._range(token, 0, self.n)
        return int(self._up(token, np.array([a + k]))[0]) if 0 <= k < b - a else -1

    def all(self) -> np.ndarray:
        """The whole sequence."""
        dtype = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.n, dtype)
        for k, (zeros, _, bits) in enumerate(reversed(self.planes)):
            one = np.unpackbits(bits.view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, dtype)
            up[np.flatnonzero(~one)] = ids[:zeros]
            up[np.flatnonzero(one)] = ids[zeros:] | dtype(1 << k)
            ids = up
        return ids


#: Occurrences that are taken up through the planes at a time.
STRIDE = 1 << 16


class Encoder:
    """Ids of whole texts by the tokenizers library."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        kind = bpe.word_bpe(path)  # refuses a file of another kind
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.plain = Tokenizer(self.lib.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        names = self.lib.get_vocab(with_added_tokens=True)
        top = max([*names.values(), end_id])
        self.width = top.bit_length()
        self.dtype = np.dtype("<u2" if self.width <= 16 else "<u4")
        self.last = np.zeros(top + 1, bool)  # tokens that end a word
        self.last[[i for s, i in names.items() if kind.end and s.endswith(kind.end)]] = True
        self.end = np.array([end_id], self.dtype).tobytes()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ask(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids from the library, a batch at a time."""
        out = {}
        for k in range(0, len(chunks), 10_000):
            part = chunks[k : k + 10_000]
            for c, e in zip(part, self.lib.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)):
                out[c] = np.array(e.ids, self.dtype).tobytes()
        return out

    def ask_plain(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of plain words from the library's model, all in one text; each
        word's last token says that it is."""
        ids = np.array(self.plain.encode(b" ".join(words).decode(), add_special_tokens=False).ids, self.dtype)
        cuts = ((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()
        if len(cuts) != len(words):
            return self.ask(words)
        data = ids.tobytes()
        return {w: data[a:b] for w, a, b in zip(words, [0, *cuts], cuts)}

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that the young generation lacks."""
        old = self.old.get
        got = {c: v for c in chunks if (v := old(c)) is not None}
        new = [c for c in chunks if c not in got] if got else chunks
        plain = bpe.plain(new)
        if words := [c for c, p in zip(new, plain) if p]:
            got |= self.ask_plain(words)
        if rest := [c for c, p in zip(new, plain) if not p]:
            got |= self.ask(rest)
        if len(self.young) + len(got) > CHUNKS:
            self.old, self.young = self.young, {}
        self.young |= {c: v for c, v in got.items() if len(c) <= bpe.LONGEST_KEY}
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, each closed by the end id, and the
        texts' ends among them. Only the batch's different chunks are looked up."""
        chunks, which, last = bpe.told_apart(texts)
        ids = list(map(self.young.get, chunks))
        if None in ids:
            got = self.learn([c for c, v in zip(chunks, ids) if v is None])
            ids = [got[c] if v is None else v for c, v in zip(chunks, ids)]
        ids.append(self.end)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        which = np.insert(which, last, len(ids) - 1)
        n = size[which]
        up = np.cumsum(n)
        at = np.repeat(first[which] - (up - n), n)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(ids), self.dtype).take(at), up[last + np.arange(len(last))]


def encoder(path: str, end_id: int) -> Encoder:
    return held(("encoder", path, end_id), lambda: Encoder(path, end_id))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the shards in ascending order of the id."""
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], f"part int, seq int, n_tokens bigint, ids array<{kind}>, ends array<bigint>, matrix binary").schema
    arrow = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        keys, ends, data, n = [], [], [], 0

        def shard() -> pa.RecordBatch:
            row = [part], [seq], [n], [keys], [ends], [WaveletMatrix.build(np.concatenate(data), enc.width).to_bytes()]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, arrow)], schema=arrow)

        for b in gathered(batches):
            ids, stops = enc.encode(b.column(1))
            stops, done = stops.tolist(), 0
            for key, begin, stop in zip(b.column(0).to_pylist(), [0, *stops], stops):
                n += stop - begin
                keys.append(key)
                ends.append(n)
                if n >= shard_tokens:
                    data.append(ids[done:stop])
                    yield shard()
                    seq, keys, ends, data, n, done = seq + 1, [], [], [], 0, stop
            data.append(ids[done:])
        if keys:
            yield shard()

    src = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    # rows of one id are dealt out by their texts' beginnings
    ordered = src.repartitionByRange("key", F.substring("content", 1, 64)).sortWithinPartitions("key", "content")
    ordered.mapInArrow(run, out).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of each document, from the files."""
    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType.simpleString()
    small_batches(spark)
    starts = running_sum(files.select("part", "seq", "n_tokens"), ["part", "seq"], "n_tokens", "start").select("part", "seq", "start")
    if files.count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    out = spark.createDataFrame([], f"{id_col} {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").schema
    arrow = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                start, keys, ends, data = (b.column(k)[i].as_py() for k in range(4))
                tokens = WaveletMatrix.from_bytes(data).all().astype("<u4")
                begins = [0, *ends[:-1]]
                crc = [zlib.crc32(tokens[x:y]) for x, y in zip(begins, ends)]
                row = keys, [start + x for x in begins], [y - x for x, y in zip(begins, ends)], crc
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, arrow)], schema=arrow)

    return files.join(starts, ["part", "seq"]).select("start", "ids", "ends", "matrix").mapInArrow(run, out)
