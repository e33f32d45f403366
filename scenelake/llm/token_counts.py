"""Operator 9: token counts by heap-and-linked-list merging.

A text's count is, over its words, the initial symbols less the merges; no
identifier is emitted. It equals the length of the tokenizers library's
encoding without added special tokens.

Defined results: a null text counts as empty; empty texts and texts of white
space have 0 tokens; a special token's string inside a text is one token;
rows with equal or null ids each keep a row; further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import held, map_rows, text_bytes

#: Remembered chunks and words of each worker: about 40 MB each generation.
CHUNKS, WORDS = 200_000, 150_000


class Counter:
    def __init__(self, path: str):
        self.bpe = bpe.word_bpe(path)
        self.word = bpe.Memory(self._word, WORDS)
        self.chunk = bpe.Memory(self._chunk, CHUNKS)

    def _word(self, piece: str) -> int:
        b = self.bpe
        return 1 if piece in b.special else bpe.heap_count(piece, b.end, b.ranks)

    def _chunk(self, chunk: bytes) -> int:
        return sum(map(self.word, self.bpe.pieces(chunk.decode())))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Only the batch's different chunks are looked up."""
        chunks, which, ends = bpe.told_apart(texts)
        n = np.fromiter(self.chunk.all(chunks), np.int64, len(chunks))[which]
        return np.diff(np.append(0, np.cumsum(n))[np.append(0, ends)])


def counter(path: str) -> Counter:
    return held(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more tokens than ``limit``)."""

    def run(keys: pa.Array, texts: pa.Array) -> list:
        n = counter(tokenizer).counts(texts)
        return [keys, pc.binary_length(texts), n, n > limit]

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("key"), text_bytes(text_col).alias("bytes"))
    return map_rows(src, run, ["key", "bytes"], f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", arrow=True)
