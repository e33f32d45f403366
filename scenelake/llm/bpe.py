"""Byte-pair encoding by two methods, for tokenizer files of the word-end kind.

``rank_array_cuts`` holds a short word's part boundaries and the ranks of its
adjacent pairs in two contiguous lists, and scans for the minimum until no
pair can be merged. ``heap_merges`` pops pairs from a heap over a linked list
and only counts the merges; the token count is the initial symbols less the
merges, and no identifier is formed. Both take the lowest rank first and, of
equal ranks, the leftmost pair, which is the order of the file's own library.

Text is cut at ASCII white space first. The tokenizer drops white space and
its normaliser joins nothing across it, so each chunk can be encoded alone and
remembered. What is remembered is bounded (see ``Memory``).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import byte_strings, strings

#: Words of more symbols than this use the heap instead of the rank array,
#: whose scans cost the square of the length.
SHORT_WORD = 200

#: A chunk of more bytes than this is never remembered.
LONGEST_KEY = 64

NO_RANK = 1 << 60


class Memory:
    """A bounded map of two generations: when the young one is full it becomes
    the old one, and what is still asked for moves back."""

    def __init__(self, make: Callable, size: int):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def __call__(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(key) <= LONGEST_KEY:
                if len(self.young) >= self.size:
                    self.old, self.young = self.young, {}
                self.young[key] = got
        return got

    def all(self, keys: list) -> list:
        got = list(map(self.young.get, keys))
        if None in got:
            got = [self(k) if v is None else v for k, v in zip(keys, got)]
        return got


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable in Latin-1 (fixed ranges), else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class WordBpe:
    """Vocabulary, merges and word pattern of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models are read")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normaliser: {kinds}")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["pattern"].get("Regex") != PATTERN or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("unknown pattern of words")
        self.words = regex.compile(PATTERN.replace("\\s", WHITE))
        if not all("<" in x for x in self.special):
            raise ValueError("special tokens are looked for only where a text has <")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes = dict(enumerate(byte_symbols()))

    def pieces(self, text: str) -> list[str]:
        """The words of a text in byte symbols; a special token stays whole."""
        if self.cut is None or "<" not in text:
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self._plain(part)
        return out

    def _plain(self, part: str) -> list[str]:
        if part.isascii():
            got = self.words.findall(part.lower())
            if part.isprintable():
                return got
        else:
            part = unicodedata.normalize("NFC", part)
            part = part.lower() if SIGMA not in part else "".join([c.lower() for c in part])  # each letter alone
            got = self.words.findall(part)
        return [w.encode().decode("latin-1").translate(self.bytes) for w in got]


#: Its small form depends on its place in a word for str.lower, not for the tokenizer.
SIGMA = "\u03a3"

#: Marks that are a word of their own to the tokenizer after a letter.
MARKS = b".,;:!?|#$%&*"

#: The first character after the Latin blocks.
LATIN_END = 0x250

#: What each Latin character is: 1 a lower-case letter that no normaliser changes, 2 one of MARKS.
LATIN = np.zeros(LATIN_END, np.uint8)
LATIN[[c for c in range(LATIN_END) if (x := chr(c)).isalpha() and x == x.lower() and unicodedata.is_normalized("NFC", x)]] = 1
LATIN[list(MARKS)] = 2


def kinds(data: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8 its character's entry in LATIN, 0 beyond."""
    out = np.where(data < 0x80, LATIN[np.minimum(data, 0x7F)], 0)
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    if len(two):
        points = (data[two].astype(np.int64) & 0x1F) << 6 | data[two + 1] & 0x3F
        out[two] = out[two + 1] = np.where(points < LATIN_END, LATIN[np.minimum(points, LATIN_END - 1)], 0)
    return out


def word_bytes(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The bytes of each chunk's word if it is a lower-case Latin word and
    MARKS, or none, after it; 0 for any other chunk."""
    kind = kinds(data)
    upto = lambda k: np.concatenate([np.zeros(1, np.int32), np.cumsum(kind == k, dtype=np.int32)])
    letters, begin = upto(1), cuts[:-1]
    n = letters[cuts[1:]] - letters[begin]
    front = letters[begin + n] - letters[begin] == n
    if (kind == 2).any():
        marks = upto(2)
        whole = n + marks[cuts[1:]] - marks[begin] == cuts[1:] - begin
    else:
        whole = n == cuts[1:] - begin
    return np.where(whole & front, n, 0)


def plain(chunks: list[bytes]) -> list[bool]:
    """Whether each chunk is one lower-case Latin word."""
    cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))])
    n = word_bytes(np.frombuffer(b"".join(chunks), np.uint8), cuts)
    return ((n > 0) & (n == np.diff(cuts))).tolist()


def told_apart(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The batch's different chunks, the number of each text's chunks among
    them, text after text, and where each text ends in that.

    A chunk is what stands between ASCII white space, with A-Z lower-cased if
    no special token can be in the text; marks behind a plain word are a chunk
    of their own, as they are a word of their own to the tokenizer. Some are empty."""
    texts = strings(texts)
    lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    flat = lists.flatten()
    ends = 2 * np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    if not len(flat):
        return [], np.zeros(0, np.int64), ends
    cuts = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, 4 * flat.offset)
    data = flat.buffers()[2] if flat.buffers()[2] is not None else pa.py_buffer(b"")
    size = np.diff(cuts)
    word = word_bytes(np.frombuffer(data, np.uint8, cuts[-1]), cuts)
    both = np.empty(2 * len(flat) + 1, np.int32)
    both[::2], both[1::2] = cuts, cuts[:-1] + np.where(word > 0, word, size)
    coded = pa.StringArray.from_buffers(2 * len(flat), pa.py_buffer(both), data).dictionary_encode()
    return byte_strings(coded.dictionary), coded.indices.to_numpy(), ends




#: The pattern of words of the files that are read (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: White space as the tokenizer's pattern language has it (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def rank_array_cuts(word: str, end: str, ranks: dict) -> list[str]:
    """The word's final parts. cuts has the part boundaries, near the rank of
    each part joined with the next."""
    n = len(word)
    if n > SHORT_WORD:
        return heap_parts(word, end, ranks)[0]
    text = word + end
    cuts = [*range(n), len(text)]
    get = ranks.get
    near = [get((text[cuts[i] : cuts[i + 1]], text[cuts[i + 1] : cuts[i + 2]]), NO_RANK) for i in range(n - 1)]
    while near:
        low = min(near)
        if low == NO_RANK:
            break
        i = near.index(low)
        del cuts[i + 1], near[i]
        a, b = cuts[i], cuts[i + 1]
        if i < len(near):
            near[i] = get((text[a:b], text[b : cuts[i + 2]]), NO_RANK)
        if i:
            near[i - 1] = get((text[cuts[i - 1] : a], text[a:b]), NO_RANK)
    return [text[cuts[i] : cuts[i + 1]] for i in range(len(cuts) - 1)]


def heap_parts(word: str, end: str, ranks: dict) -> tuple[list[str], int]:
    """Final parts and the number of merges, by a heap over a linked list."""
    n = len(word)
    part = list(word)
    part[-1] += end
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    get = ranks.get
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get((part[i], part[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or part[i] != a or part[j] != b:
            continue  # one of the two has been merged meanwhile
        part[i], part[j] = a + b, ""
        k = after[i] = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            if (r := get((part[i], part[k]))) is not None:
                heapq.heappush(heap, (r, i, part[i], part[k]))
        h = before[i]
        if h >= 0 and (r := get((part[h], part[i]))) is not None:
            heapq.heappush(heap, (r, h, part[h], part[i]))
    return [p for p in part if p], merges


def heap_count(word: str, end: str, ranks: dict) -> int:
    """Tokens of a word: its initial symbols less the merges."""
    return len(word) - heap_parts(word, end, ranks)[1]
