"""Operator 6: BPE encoding and decoding by a contiguous rank array.

Every text is encoded as the tokenizers library encodes it with
``add_special_tokens=False`` and decoded as its ``decode(ids,
skip_special_tokens=False)``: a file without a decoder joins the tokens'
names by one space.

Defined results: a null text counts as empty; an empty text or one of white
space has no ids and decodes to an empty text; a special token's string inside
a text is that token; rows with equal or null ids each keep a row; further
columns of the input are left out. Words of over ``bpe.SHORT_WORD`` symbols
use the heap of ``bpe.heap_parts`` with the same result, because the scans of
a rank array cost the square of the length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import held, map_rows, text_bytes

#: Remembered chunks and words of each worker: about 90 MB each generation.
CHUNKS, WORDS = 200_000, 150_000

#: Bytes of text that are looked at together; the arrays about them take some thirty times as much.
GATHER = 1 << 20


class Codec:
    def __init__(self, path: str):
        self.bpe = bpe.word_bpe(path)
        self.word = bpe.Memory(self._word, WORDS)
        self.chunk = bpe.Memory(self._chunk, CHUNKS)

    def _ids(self, piece: str) -> list[int]:
        b = self.bpe
        if piece in b.special:
            return [b.special[piece]]
        return [b.vocab[p] for p in bpe.rank_array_cuts(piece, b.end, b.ranks)]

    def ids(self, text: str) -> list[int]:
        return [i for piece in self.bpe.pieces(text) for i in self._ids(piece)]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.bpe.names[i] for i in ids if i in self.bpe.names])

    def _word(self, piece: str) -> tuple[int, bytes, bytes]:
        ids = self._ids(piece)
        return len(ids), " ".join(map(str, ids)).encode(), self.decode(ids).encode()

    def _chunk(self, chunk: bytes) -> tuple[int, bytes, bytes]:
        got = [self.word(x) for x in self.bpe.pieces(chunk.decode())]
        if len(got) == 1:
            return got[0]
        return sum([x[0] for x in got]), b" ".join([x[1] for x in got]), b" ".join([x[2] for x in got])

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Of each text its number of ids, and SHA-256 of the ids and of the
        decoded text. Only the batch's different chunks are looked up."""
        chunks, which, ends = bpe.told_apart(texts)
        got = self.chunk.all(chunks)
        ids, names = [x[1] for x in got], [x[2] for x in got]
        n = np.fromiter((x[0] for x in got), np.int64, len(got))[which]
        some = n > 0  # the others are empty or Unicode's other white space
        total, left = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(some))
        which = which[some]
        begins = np.append(0, ends[:-1])
        out: tuple[list, list, list] = ([], [], [])
        for a, b, k in zip(left[begins].tolist(), left[ends].tolist(), (total[ends] - total[begins]).tolist()):
            w = which[a:b].tolist()
            out[0].append(k)
            out[1].append(hashlib.sha256(b" ".join([ids[i] for i in w])).hexdigest())
            out[2].append(hashlib.sha256(b" ".join([names[i] for i in w])).hexdigest())
        return out


def codec(path: str) -> Codec:
    return held(("codec", path), lambda: Codec(path))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids ARRAY<INT> and decoded STRING of each row."""

    def run(keys: list, texts: list) -> list:
        c = codec(tokenizer)
        ids = [c.ids(t.decode()) for t in texts]
        return [keys, ids, [c.decode(x) for x in ids]]

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("key"), text_bytes(text_col).alias("bytes"))
    return map_rows(src, run, ["key", "bytes"], f"{id_col} {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row."""

    def run(keys: pa.Array, texts: pa.Array) -> list:
        return [keys, *codec(tokenizer).digests(texts)]

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("key"), text_bytes(text_col).alias("bytes"))
    return map_rows(src, run, ["key", "bytes"], f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", arrow=True, gather=GATHER)
