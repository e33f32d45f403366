"""Operator 1: benchmark decontamination by pigeonhole edit matching.

Texts and items become lower-case words: runs of letters, digits and
underscores, and each character of a script that is written without spaces.
An item of m words may differ from a passage by up to ``BUDGET`` * m word
edits, rounded down: a similarity of 0.8 or more, so items of fewer than five
words must stand there as they are. An item is split into one piece more than
that, so a passage within the budget holds at least one piece unchanged. All
pieces of a block of items go into one Aho-Corasick automaton; where a piece
is found, the item's place is known to within the budget, and Myers'
bit-parallel distance, over words, verifies that window.

Documents are only read through: nothing is shuffled, and a document's hits
never meet another's. Items come in blocks of bounded size, one at a time; if
there are several, each block's result is written before the next is read.

Defined results: a null text or item has no words and matches nothing; equal items and
equal rows each keep their rows; empty tables give no rows; further columns
are left out.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, held, map_rows, mark, materialise, release, strings

BUDGET = 0.2

#: Bytes of item text that one block, and so one pass over the documents, takes.
BLOCK_BYTES = 16 << 20

#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han (fixed ranges).
NO_SPACES = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
RUN = re.compile(r"\w+")
SCRIPT = re.compile(f"[{NO_SPACES}]")
MIXED = re.compile(rf"[{NO_SPACES}]|(?:(?![{NO_SPACES}])\w)+")


def words_of(text: str) -> list[str]:
    text = text.lower()
    return RUN.findall(text) if text.isascii() or not SCRIPT.search(text) else MIXED.findall(text)


def myers(pattern: dict, m: int, words: list) -> list[int]:
    """Edits between the pattern and the nearest passage that ends at each
    word. pattern: for each word of it, the bits of its places."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    for w in words:
        eq = pattern.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & mask
        pv = (mh << 1 & mask) | (~(xv | ph) & mask)
        mv = ph & xv
        out.append(score)
    return out


def places(words: list[str]) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, w in enumerate(words):
        bits[w] = bits.get(w, 0) | 1 << i
    return bits


class Matcher:
    """The pieces of a block of items and what to verify them with."""

    def __init__(self, items: tuple[tuple[object, str], ...], budget: float):
        self.items, self.find = [], ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            words = words_of(text)
            m = len(words)
            if not m:
                continue
            k, n = int(budget * m), len(self.items)
            self.items.append((key, m, k, places(words), places(words[::-1])))
            cuts = [m * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(f" {' '.join(words[a:b])} ", []).append((n, a))
        for piece, at in pieces.items():
            self.find.add_word(piece, (len(piece), at))
        if pieces:
            self.find.make_automaton()

    def match(self, text: str) -> list[tuple]:
        """(item, edits, first word, end word) of each item in the text."""
        if not self.items:
            return []
        words, out = words_of(text), []
        hits: dict[int, set[int]] = {}
        counted = seen = 0
        text = f" {' '.join(words)} "
        for end, (size, at) in self.find.iter(text):
            begin = end - size + 1
            if begin > seen:
                counted, seen = counted + text.count(" ", seen, begin), begin
                first = counted
            else:  # a longer piece that ends here began earlier
                first = counted - text.count(" ", begin, seen)
            for n, a in at:
                hits.setdefault(n, set()).add(first - a)
        for n, starts in hits.items():
            if best := self._verify(n, sorted(starts), words):
                out.append((self.items[n][0], *best))
        return out

    def _verify(self, n: int, starts: list[int], words: list[str]) -> tuple[int, int, int] | None:
        """The least edits within the budget, at the earliest place."""
        _, m, k, pattern, backwards = self.items[n]
        best: tuple[int, int, int] | None = None
        i = 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * k:
                j += 1
            low, high = max(0, starts[i] - k), min(len(words), starts[j] + m + k)
            scores = myers(pattern, m, words[low:high])
            least = min(scores, default=m)
            if least <= k and (best is None or least < best[0]):
                end = low + scores.index(least) + 1
                back = myers(backwards, m, words[max(0, end - m - k) : end][::-1])
                best = (least, end - 1 - back.index(min(back)), end)
            i = j + 1
        return best


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Callable[[int], tuple[str, tuple]]]:
    """The number of blocks of bounded size that the items make, and how to
    read one: its name and its items."""
    rows = items.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter("t <> ''")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // block_bytes)
    of = F.pmod(F.xxhash64("k", "t"), F.lit(max(n, 1)))
    return n, lambda i: (uuid.uuid4().hex, tuple(sorted(((r.k, r.t) for r in rows.filter(of == i).collect()), key=str)))


def contaminated(
    docs: DataFrame, items: DataFrame, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """A row for each document and each item that it holds: id, item,
    contaminated (true), n_edits, first_word, end_word (exclusive)."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {item_col} {item_kind}, contaminated boolean, n_edits int, first_word int, end_word int"
    src = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("content")).filter("content is not null")

    def scan(name: str, block: tuple) -> DataFrame:
        def run(keys: list, texts: list) -> list:
            match = held(name, lambda: Matcher(block, budget)).match
            got = [(key, item, True, *where) for key, t in zip(keys, texts) for item, *where in match(t)]
            return [list(x) for x in zip(*got)] if got else [[]] * 6

        return map_rows(src, run, ["key", "content"], schema)

    n, block = blocks(items, item_col, item_text, block_bytes)
    if n == 1:
        return scan(*block(0))
    found = [materialise(scan(*block(i)), "hits") for i in range(n)]
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, budget: float = BUDGET, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    n, block = blocks(items, item_col, item_text, block_bytes)

    def clean(name: str, of: tuple) -> Callable[[pa.Array], list]:
        def run(texts: pa.Array) -> list:
            match = held(name, lambda: Matcher(of, budget)).match
            return [not match(t) for t in strings(texts).to_pylist()]

        return run

    begun, names = mark(), docs.columns
    for i in range(n):
        docs = filter_rows(docs, text_col, clean(*block(i)))
        if n > 1:
            text_col = f"c{names.index(text_col)}" if i == 0 else text_col
            docs = materialise(docs.toDF(*[f"c{k}" for k in range(len(names))]), "clean")
            release(docs.sparkSession, begun, docs)
    return docs.toDF(*names)
