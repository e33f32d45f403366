"""Operator 10: toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned from labelled rows: words, and stems of words, that
occur in toxic texts far oftener than chance allows (a likelihood-ratio test,
corrected for the number of words looked at). An occurrence counts once for
each different pair of neighbours, so copies of one text don't make a term.

All terms go into one trie. Words are run through the intersection of the trie
with Levenshtein automata (``Automaton``): one edit, or one exchange of
neighbours, for terms of five letters or more, two for nine or more, the first
letter included; its states are made as they are met. Signs and digits that
stand for letters are folded, those at a word's ends too. A word is a run of
letters, digits and their marks, however it is joined to the next; what holds
no hit is also tried together with its neighbours in the same run without
spaces ('stu.pid', 'a$$hat'). Text that isn't cut into words by any sign
(Chinese, Thai) has its runs as words. Misspelled forms that clean labelled texts
hold are no hits.

Each hit is weighed by its window: inside quotation marks or beside a word of
reporting it counts less. A text's features are its plain, misspelled and
quoted evidence and the densest window; logistic regression, fitted on the
labelled rows, turns them into the score. Of the labelled rows at most
``TRAIN_ROWS`` are used, in the order of their id's hash; all of their words
are candidates, so the lexicon is bounded by that sample and by nothing else.

Texts are read a batch at a time: the batch's different chunks are told apart,
all of them run through the automaton at once, letter by letter (``suspects``),
and only chunks that reach a term, or that aren't one plain Latin word, are
looked at one by one.

Defined results: a null text counts as empty and scores as a text without
hits; without labels, or without toxic ones, the score is the share of toxic
labels (0 without labels); a row labelled twice counts as toxic if any label
says so; rows of equal or null ids each keep a row; further columns are left
out of the scores and kept by ``keep``.
"""

from __future__ import annotations

import collections
import math
import re
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Chunks, filter_rows, held, id_crc, map_rows, mark, materialise, release, text_bytes

TRAIN_ROWS = 20_000
STEMS = (4, 5)
DOUBT = 0.01

#: Words to either side of a hit that can mark it as quoted.
WINDOW = 6
DENSE = 30
QUOTED = 0.3

#: Remembered chunks of each worker: about 40 MB each generation.
CHUNKS = 200_000

#: Entries of the automaton's remembered states: about 100 MB.
ENTRIES = 1_000_000

#: Words that report others' words, quotation marks, and signs that stand for letters.
REPORTS = frozenset("said says say saying called calling wrote writes quote quoted quotes quoting word words term terms insult insults slur slurs dit disait appelle mot mots sagte sagt nannte wort dijo dice palabra".split())
OPENING, CLOSING = "\"'“‘«„‹", "\"'”’»“›"
SIGNS = str.maketrans("013457@$!", "oieastasi")
MARKS = "".join(chr(c) for c in range(0x300, 0x20000) if unicodedata.category(chr(c)) in ("Mn", "Mc")) + "\u200c\u200d"
WORD = re.compile(f"[^\\W_](?:[^\\W_]|[{MARKS}])*")
SIGN = re.compile("[013457@$!]")
JOINED = re.compile(rb"[^A-Za-z0-9][A-Za-z0-9]|[\x80-\xff]")


def limit(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def clean(chunk: str) -> str:
    """Lower case, without what isn't a letter or digit at either end."""
    w = chunk.lower()
    if w.isalnum():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def places(chunk: str) -> list[tuple[int, int, int, int]]:
    """The begin and end of each word with the signs around it, and of the word
    itself. A quotation mark or folded sign right before a word goes with it if
    other signs stand before; an apostrophe between letters goes with neither."""
    words = [m.span() for m in WORD.finditer(chunk)]
    if len(words) < 2:
        return [(0, len(chunk), *(words[0] if words else (0, 0)))]
    out, begin = [], 0
    for (x, end), (after, _) in zip(words, words[1:]):
        gap = chunk[end:after]
        k = len(gap)
        while k and (gap[k - 1] in OPENING or ord(gap[k - 1]) in SIGNS):
            k -= 1
        if k == 0 and (gap[0] in CLOSING or gap[0] not in OPENING):
            k = len(gap)
        bare = gap in ("'", "’")
        out.append((begin, end if bare else end + k, x, end))
        begin = after if bare else end + k
    return [*out, (begin, len(chunk), *words[-1])]


def pieces(text: bytes) -> list[str]:
    """The text's words with the signs around them."""
    out: list[str] = []
    for c in text.split():
        x = c.decode(errors="replace")
        out += [x[a:b] for a, b, _, _ in places(x)] if JOINED.search(c, 1) else [x]
    return out


def spellings(chunk: str) -> list[str]:
    """The word with the folded signs at its start, at its end, both or
    neither, where it holds any."""
    word = clean(chunk)
    at = chunk.find(word) if word else 0
    a, b = at, at + len(word)
    while a and ord(chunk[a - 1]) in SIGNS:
        a -= 1
    while b < len(chunk) and ord(chunk[b]) in SIGNS:
        b += 1
    found = dict.fromkeys(chunk[i:j] for i in (at, a) for j in (at + len(word), b))
    return [x for x in found if any(ord(c) in SIGNS for c in x)]


class Automaton:
    """Words within their edits of a term, and words that begin with a stem.

    A state is a set of (trie node, edits, awaited letter); the awaited letter
    is the second of an exchanged pair. With ``first`` edits may be anywhere,
    without it the first letter must be right. States beyond ``ENTRIES``
    entries are forgotten and made again when they are met."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], first: bool = False):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        self.room = [0]
        for of, words in ((self.ends, terms), (self.stem, stems)):
            for word in words:
                node, room = 0, limit(word) if of is self.ends else 0
                for c in word:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.room.append(0)
                    node = self.children[node][c]
                    self.room[node] = max(self.room[node], room)
                of[node] = word
        self.weights = terms | stems
        self.room[0] = max(map(limit, terms), default=0) if first else 0

        letters = sorted({c for x in self.children for c in x})
        self.letters = ["", *letters]  # any other letter acts like the first
        self.code = {c: i for i, c in enumerate(self.letters) if c}
        self.forget()

    def forget(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.table = np.full((1024, len(self.letters)), -1, np.int32)
        self.flags = np.zeros(1024, np.uint8)
        self.entries = 0
        self._add(self._state({(0, 0, "")}))

    def _add(self, key: frozenset) -> int:
        """The state's number. Its flags: 1 dead, 2 a term ends here, 4 a stem."""
        if key not in self.number:
            k = self.number[key] = len(self.states)
            self.states.append(key)
            self.entries += len(key) + 1
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
            ended = any(not a and n in self.ends and e <= limit(self.ends[n]) for n, e, a in key)
            begun = any(not a and e == 0 and n in self.stem for n, e, a in key)
            self.flags[k] = (not key) + 2 * ended + 4 * begun
        return self.number[key]

    def _state(self, new: set) -> frozenset:
        todo = list(new)
        while todo:  # a letter too few
            node, e, awaited = todo.pop()
            if not awaited and e < self.room[node]:
                for child in self.children[node].values():
                    if (child, e + 1, "") not in new:
                        new.add((child, e + 1, ""))
                        todo.append((child, e + 1, ""))
        least: dict[tuple[int, str], int] = {}  # the same place with more edits finds nothing else
        for node, e, awaited in new:
            if e <= self.room[node] or e == 0:
                least[node, awaited] = min(e, least.get((node, awaited), e))
        return frozenset((node, e, awaited) for (node, awaited), e in least.items())

    def _step(self, state: int, c: str) -> int:
        new = set()
        for node, e, awaited in self.states[state]:
            if awaited:
                if c == awaited:
                    new.add((node, e, ""))
                continue
            children = self.children[node]
            if c in children:
                new.add((children[c], e, ""))
            if e >= self.room[node]:
                continue
            new.add((node, e + 1, ""))  # one letter too many
            for d, child in children.items():
                new.add((child, e + 1, ""))  # another letter
                if d != c and c in self.children[child]:
                    new.add((self.children[child][c], e + 1, d))  # two exchanged
        return self._add(self._state(new))

    def match(self, word: str) -> tuple[str, int] | None:
        """The term and its edits, the fewest first; a stem has 0."""
        if self.entries > ENTRIES:
            self.forget()
        at, stem = 0, None
        for c in word:
            k = self.code.get(c, 0)
            nxt = int(self.table[at, k])
            if nxt < 0:
                nxt = self._step(at, self.letters[k])
                self.table[at, k] = nxt
            at = nxt
            if not self.states[at]:
                break
            if stem is None and self.flags[at] & 4:
                stem = next(self.stem[n] for n, e, a in self.states[at] if e == 0 and not a and n in self.stem)
        found = min(((e, self.ends[n]) for n, e, a in self.states[at] if not a and n in self.ends and e <= limit(self.ends[n])), default=None)
        if found and (found[0] == 0 or stem is None):
            return found[1], found[0]
        return (stem, 0) if stem else None

    def matched(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether ``match`` finds anything in each word codes[begin:end], all
        words a letter at a time. codes: numbers of letters."""
        if self.entries > ENTRIES:
            self.forget()
        found = np.zeros(len(begin), bool)
        word, at = np.flatnonzero(end > begin), begin[end > begin]
        state = np.zeros(len(word), np.int32)
        while len(word):
            c = codes[at]
            nxt = self.table[state, c]
            if (missing := nxt < 0).any():
                for x, k in set(zip(state[missing].tolist(), c[missing].tolist())):
                    to = self._step(x, self.letters[k])
                    self.table[x, k] = to
                nxt = self.table[state, c]
            at = at + 1
            flags = self.flags[nxt]
            over = at == end[word]
            found[word[(flags & 4 > 0) | over & (flags & 2 > 0)]] = True
            going = ~over & (flags & 5 == 0)
            word, at, state = word[going], at[going], nxt[going]
        return found


#: The first character after the Latin blocks; larger ones have this entry in the tables below.
LATIN_END = 0x250

#: Of Latin characters: kind (0 no letter, 1 letter or digit, 2 and 3 the same that also is a folded sign, 4 beyond), lower case, folded.
KIND = np.full(LATIN_END + 1, 4, np.uint8)
LOW, FOLD = np.zeros((2, LATIN_END + 1), np.int64)
for _c in range(LATIN_END):
    _low = chr(_c).lower()
    if len(_low) == 1 and ord(_low) < LATIN_END:
        KIND[_c] = chr(_c).isalnum() + 2 * (ord(_low) in SIGNS)
        LOW[_c], FOLD[_c] = ord(_low), ord(_low.translate(SIGNS))


def suspects(find: Automaton, chunks: list[bytes]) -> np.ndarray:
    """Chunks that may hold a find: all but plain Latin words, with signs or
    none around them, whose spellings the automaton doesn't accept."""
    if not chunks:
        return np.zeros(0, bool)
    points = np.frombuffer(b" ".join([*chunks, b""]).decode().encode("utf-32-le"), np.uint32)
    points = np.minimum(points, LATIN_END)
    kind = KIND[points]
    gap = np.flatnonzero(points == 32)  # no chunk holds a space
    begin, end = np.append(0, gap[:-1] + 1), gap
    here = np.arange(len(points))
    alnum = (kind == 1) | (kind == 3)
    nxt = lambda x: np.minimum.accumulate(np.where(x, here, len(points))[::-1])[::-1]
    last = lambda x: np.maximum.accumulate(np.where(x, here, -1))
    first = np.minimum(nxt(alnum)[begin], end)
    stop = np.maximum(np.append(last(alnum), -1)[end - 1] + 1, begin)
    upto = lambda x: np.append(0, np.cumsum(x, dtype=np.int64))
    of, beyond, sign = upto(alnum), upto(kind == 4), (kind == 2) | (kind == 3)
    signs = upto(sign)
    word = first < end
    signed = signs[end] > signs[begin]
    out = (beyond[end] > beyond[begin]) | np.where(word, of[stop] - of[first] < stop - first, signed) & (end > begin)
    codes = np.zeros(LATIN_END + 1, np.int64)
    for c, i in find.code.items():
        if ord(c) < LATIN_END:
            codes[ord(c)] = i
    plain = np.flatnonzero(word & ~out & (stop - first > 2))
    out[plain[find.matched(codes[LOW[points]], first[plain], stop[plain])]] = True
    some = np.flatnonzero(word & ~out & signed)
    if len(some):
        folded, other = codes[FOLD[points]], ~sign
        left = np.maximum(last(other)[np.maximum(first[some] - 1, 0)] + 1, begin[some])
        left = np.where(first[some] > begin[some], left, first[some])
        right = np.minimum(nxt(other)[stop[some]], end[some])
        for a in (first[some], left):
            for b in (stop[some], right):
                long = b - a > 2
                out[some[long][find.matched(folded, a[long], b[long])]] = True
    return out


class Scorer:
    """Features of a text: evidence that is plain, misspelled, quoted, the
    densest window's share, and the number of hits."""

    N = 5

    def __init__(self, terms: tuple, stems: tuple, harmless: frozenset):
        self.find = Automaton(dict(terms), dict(stems), first=True)
        self.harmless = harmless
        self.chunk = bpe.Memory(self._chunk, CHUNKS)
        self.piece = bpe.Memory(lambda x: self.form(x) or (), CHUNKS // 4)
        self.longest = max((len(w) for w, _ in (*terms, *stems)), default=0) + 2

    def form(self, chunk: str) -> tuple[str, tuple[str, int]] | None:
        """What was matched of the chunk, its term and edits. Signs are folded
        with those at either end and without them; the fewest edits count."""
        word = clean(chunk)
        got = self.find.match(word) if len(word) > 2 else None
        if got and not got[1]:
            return word, got
        best = got and (got[1], 0, word, got[0])
        if not SIGN.search(chunk):
            return best and (word, got)
        for spelled in spellings(chunk.lower()):
            folded = clean(spelled.translate(SIGNS))
            got = self.find.match(folded) if folded != word and len(folded) > 2 else None
            if got and (best is None or (max(got[1], 1), 1) < best[:2]):
                best = max(got[1], 1), 1, spelled, got[0]
        return best and (best[2], (best[3], best[0]))

    def read(self, chunk: str) -> tuple[list[str], list]:
        """The chunk's words and what ``form`` finds in each; words without a
        find are tried together with those after them, up to two signs between
        them that aren't folded; the first of them has the find."""
        at = places(chunk)
        words = [chunk[a:b] for a, b, _, _ in at]
        if len(at) == 1:
            return words, [self.form(chunk) or ()]
        found = list(map(self.piece, words))
        i = 0
        while i < len(at):
            j, signs = i + 1, 0
            while j < len(at) and not found[i] and not found[j] and at[j][3] - at[i][2] <= self.longest:
                gap = chunk[at[j - 1][3] : at[j][2]]
                signs += sum(ord(c) not in SIGNS for c in gap)
                if signs > 2 or any(map(str.isspace, gap)):
                    break
                found[i] = self.form(chunk[at[i][0] : at[j][1]]) or ()
                j += 1
            i = j if found[i] else i + 1
        return words, found

    def mark(self, got: tuple | None) -> int:
        """0 without a hit, 1 for a term or stem, 2 for a misspelled one."""
        return 0 if not got or got[1][1] and got[0] in self.harmless else 2 if got[1][1] else 1

    def _chunk(self, chunk: bytes) -> int | tuple[list[bytes], list[int]]:
        """The mark of its one word, or its words with a mark for each."""
        if not JOINED.search(chunk, 1):
            return self.mark(self.form(chunk.decode()))
        words, found = self.read(chunk.decode(errors="replace"))
        marks = list(map(self.mark, found))
        return marks[0] if len(marks) == 1 else ([w.encode() for w in words], marks)

    def features(self, texts: pa.Array) -> list[list[float]]:
        """Of each text of a batch."""
        batch = Chunks(texts)
        marks: list = [0] * len(batch.chunks)
        hit = np.zeros(len(marks) + 1, bool)
        for i in np.flatnonzero(suspects(self.find, batch.chunks)).tolist():
            m = marks[i] = self.chunk(batch.chunks[i])
            hit[i] = m > 0 if type(m) is int else any(m[1])
        found = np.append(0, np.cumsum(hit[batch.which]))
        out = []
        for a, b in batch.rows():
            out.append(self.measure(batch.chunks, marks, batch.which[a:b].tolist()) if found[b] > found[a] else [0.0] * self.N)
        return out

    def measure(self, chunks: list[bytes], marks_of: list, text: list[int]) -> list[float]:
        words, marks = [], []
        for i in text:
            m = marks_of[i]
            if type(m) is not int:
                words += m[0]
                marks += m[1]
            else:
                words.append(chunks[i])
                marks.append(m)
        hits = [i for i, m in enumerate(marks) if m]
        plain = wrong = quoted = 0.0
        for i in hits:
            if is_quoted(words, i):
                quoted += 1
            elif marks[i] == 1:
                plain += 1
            else:
                wrong += 1
        most = first = 0
        for k, i in enumerate(hits):
            while hits[first] <= i - DENSE:
                first += 1
            most = max(most, k - first + 1)
        evidence = plain + 0.7 * wrong + QUOTED * quoted
        return [math.log1p(plain), math.log1p(wrong), math.log1p(QUOTED * quoted), math.log1p(float(most) * evidence / max(len(hits), 1)), math.log1p(100 * evidence / (len(words) + 50))]


def is_quoted(words: list[bytes], i: int) -> bool:
    """Whether the word stands inside quotation marks or beside a report."""
    near = [w.decode(errors="replace") for w in words[max(0, i - WINDOW) : i + WINDOW + 1]]
    k = min(i, WINDOW)
    opened = any(w[0] in OPENING and not any(x[-1] in CLOSING or x.rstrip(".,;:!?")[-1:] in CLOSING for x in near[j if len(w) > 1 else j + 1 : k]) for j, w in enumerate(near[: k + 1]) if w)
    closed = any((w[-1] in CLOSING or w.rstrip(".,;:!?")[-1:] in CLOSING) for w in near[k:])
    return opened and closed or any(clean(w) in REPORTS for w in near)


def likelihood(a: int, n: int, c: int, m: int) -> float:
    """Log-likelihood ratio that a of n and c of m have different rates; 0 if a's is lower."""
    if not a or a * m <= c * n:
        return 0.0
    p = (a + c) / (n + m)
    part = lambda x, y, q: (x * math.log(x / (y * q)) if x else 0.0) + ((y - x) * math.log((y - x) / (y * (1 - q))) if y > x and q < 1 else 0.0)
    return part(a, n, p) + part(c, m, p)


class Model:
    def __init__(self, terms: tuple, stems: tuple, harmless: frozenset, weights: list[float]):
        self.terms, self.stems, self.harmless, self.weights = terms, stems, harmless, weights
        self.key = uuid.uuid4().hex

    def scorer(self) -> Scorer:
        return held(self.key, lambda: Scorer(self.terms, self.stems, self.harmless))

    def scores(self, texts: pa.Array) -> list[float]:
        w = self.weights
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, w[0] + sum(a * b for a, b in zip(w[1:], x)))))) for x in self.scorer().features(texts)]


def sample_rows(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    named = labels.filter(f"{id_col} is not null and toxic is not null").groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    named = named.filter(id_crc(id_col) % 5 != 0).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    src = docs.select(F.col(id_col), text_bytes(text_col).alias("bytes"))
    return src.join(F.broadcast(named), id_col).select("bytes", F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    begun = mark()
    sample = materialise(sample_rows(docs, labels, rows, id_col, text_col), "labelled")
    count = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sum(n for y, n in count.items() if y == 1), sum(n for y, n in count.items() if y != 1)
    if not bad or not good:
        share = min(max(bad / max(bad + good, 1), 0.0), 1.0)
        return Model((), (), frozenset(), [math.log((share + 1e-6) / (1 - share + 1e-6)), *[0.0] * Scorer.N])

    def seen(texts: list) -> list:
        words, around = [], []
        for t in texts:
            w = list(map(clean, pieces(t)))
            got = {(x, zlib.crc32(f"{a} {b}".encode())) for a, x, b in zip(["", *w], w, [*w[1:], ""]) if len(x) > 2}
            got |= {(f"{x[:k]}*", h) for x, h in got for k in STEMS if len(x) > k}
            words += [x for x, _ in got]
            around += [h for _, h in got]
        return [words, around]

    toxic = map_rows(sample.filter("toxic = 1"), seen, ["bytes"], "word string, around bigint")
    toxic = toxic.distinct().groupBy("word").agg(F.count("*").alias("n"))
    looked = toxic.count()
    least = math.log(max(looked, 1) / DOUBT)
    toxic = toxic.filter(F.col("n") >= max(3, least / math.log((bad + good) / bad)))
    found = {r.word: min(r.n, bad) for r in toxic.collect()}  # bounded by the sample's words

    def members(chunk: bytes) -> tuple[str, ...]:
        w = list(map(clean, pieces(chunk)))
        return tuple(x for w in set(w) for x in (w, *(f"{w[:k]}*" for k in STEMS if len(w) > k)) if x in found)

    key = uuid.uuid4().hex

    def texts_with(texts: pa.Array) -> list:
        batch = Chunks(texts)
        of = held(key, lambda: bpe.Memory(members, CHUNKS)).all(batch.chunks)
        some = np.array([bool(x) for x in of], bool)
        n: collections.Counter[str] = collections.Counter()
        for a, b in batch.rows():
            here = batch.which[a:b]
            n.update({x for i in here[some[here]].tolist() for x in of[i]} if len(here) else ())
        return [list(n), list(n.values())]

    innocent = map_rows(sample.filter("toxic <> 1"), texts_with, ["bytes"], "word string, n bigint", arrow=True).groupBy("word").agg(F.sum("n").alias("n"))
    clean_docs = {r.word: r.n for r in innocent.collect()}
    test = {w: likelihood(a, bad, clean_docs.get(w, 0), good) for w, a in found.items()}
    kept = sorted([w for w, x in test.items() if x >= least and clean_docs.get(w, 0) * bad * 20 <= found[w] * good], key=lambda w: (-test[w], w))
    terms = tuple((w, test[w]) for w in sorted(kept) if not w.endswith("*"))
    stems = tuple((w[:-1], test[w]) for w in sorted(kept) if w.endswith("*") and not any(t.startswith(w[:-1]) and found[t] >= 0.9 * found[w] for t, _ in terms))

    loose = Model(terms, stems, frozenset(), [])

    def near(texts: pa.Array) -> list:
        scorer, chunks = loose.scorer(), Chunks(texts).chunks
        return [list({got[0] for i in np.flatnonzero(suspects(scorer.find, chunks)) for got in scorer.read(chunks[i].decode())[1] if got and got[1][1]})]

    harmless = frozenset(r.word for r in map_rows(sample.filter("toxic <> 1"), near, ["bytes"], "word string", arrow=True).distinct().collect())
    model = Model(terms, stems, harmless, [])

    def measure(texts: pa.Array, toxic: pa.Array) -> list:
        return [model.scorer().features(texts), toxic]

    rows_ = map_rows(sample, measure, ["bytes", "toxic"], "x array<double>, y int", arrow=True).groupBy("x", "y").agg(F.count("*").alias("n")).orderBy("x", "y").collect()
    release(sample.sparkSession, begun)
    x = np.array([[1.0, *r.x] for r in rows_])
    model.weights = regress(x, np.array([float(r.y == 1) for r in rows_]), np.array([float(r.n) for r in rows_]))
    return model


def regress(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.1) -> list[float]:
    """Weighted logistic regression by Newton steps; evidence can't lower the
    score, so negative weights are set to zero and the rest fitted again."""
    free = list(range(x.shape[1]))
    while True:
        w = np.zeros(len(free))
        part = x[:, free]
        shrink = penalty * np.array([0.01, *[1.0] * (len(free) - 1)])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            step = np.linalg.solve((part.T * (n * p * (1 - p))) @ part + np.diag(shrink), part.T @ (n * (y - p)) - shrink * w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        negative = [k for k, v in zip(free[1:], w[1:]) if v < 0]
        if not negative:
            out = np.zeros(x.shape[1])
            out[free] = w
            return out.tolist()
        free = [k for k in free if k not in negative]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of each row."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)

    def run(keys: pa.Array, out: pa.Array, texts: pa.Array) -> list:
        got = model.scores(texts)
        return [keys, out, got, [int(x >= 0.5) for x in got]]

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("key"), (id_crc(id_col) % 5 == 0).alias("held"), text_bytes(text_col).alias("bytes"))
    return map_rows(src, run, ["key", "held", "bytes"], f"{id_col} {kind}, held_out boolean, score double, predicted int", arrow=True)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic, with all their columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return filter_rows(docs, text_col, lambda texts: [x < 0.5 for x in model.scores(texts)])
