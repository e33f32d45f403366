"""Operator 5: LM scoring by a hashed maximum-entropy model.

Tokens are lower-cased (A-Z) words and one end for each text. The model is
class-factored: P(w | h) = P(class(w) | h) P(w | class(w), h).

* Classes: the ``FREQUENT`` commonest training words make classes of ``WIDE``
  words at most, of one main language and like frequency; the other ``HOT``
  words (all with at least a certain count) are grouped by their main language
  and, within it, by bands of equal mass; the end is a class; rarer and unknown
  words fall into ``TAIL`` classes by their last two bytes.
* Features of the history: the word before, the skipped one before it, and the
  pair of both, hashed. P(class | h) is a softmax over them, and so is P(w |
  class, h) in the classes of frequent words, with the features hashed together
  with the class. Weights come from distributed gradient updates: every training
  text is read once, in ``ROUNDS`` rounds that share the texts out; in a round
  each task makes AdaGrad steps from the shared weights on its texts, and the
  tasks' changes are averaged on the executors, bucket by bucket, weighted by
  how often a task saw the bucket, in a tree of two levels. The number of
  weights is fixed (``BUCKETS``, ``WORD_BUCKETS``); so is what a task holds.
  More tasks make fewer steps each, so scores move a little with their number.
* P(w | class, h) of other classes is relative frequency; in tail classes
  discounted by D = n1 / (n1 + 2 n2), which leaves the class's unknown word its
  share.

Scores are made in sparse numpy batches: a token costs a gather of its three
buckets' weight rows and one softmax over the classes, and the same again over
its class's words if it is a frequent one. Hot words' counts
go along with the code (bounded by ``HOT``); the others meet their counts in a
join. Counts cover all training texts.

Defined results: a null text counts as empty, with the end as its one token; a
null id has remainder 0 and is training text; null or missing languages are
one language; rows of equal ids each keep a row; with no training text the
base is 0 for every token and the score is that of the smoothed classes;
further columns are left out.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Chunks, arrow_schema, gathered, held, id_crc, mark, materialise, release, small_batches, text_bytes

HOT = 1 << 18
FREQUENT, WIDE = 768, 32
LANGS, BANDS, TAIL = 6, 2, 8
ROUNDS = 2
RATE = 0.35

#: Tokens of a gradient step: a task's first steps are short, later ones longer.
STEP, LONGEST_STEP = 2048, 16_384

#: Buckets of each feature: word before, second before, pair before; and of the same with the class of a frequent word.
BUCKETS = (8192, 4096, 8192)
WORD_BUCKETS = (16_384, 8192, 16_384)
BLOCK_ROWS = 512

#: Rows of one bucket in a step that are summed one after another.
LONG_RUN = 8

#: Words counted by a task before it passes them on.
FLUSH = 250_000

#: The end token; no word holds a space.
END = b" "

#: Odd multipliers of the feature hashes, of 64 bits.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def tail_class_sql(token: str) -> Column:
    return F.crc32(F.expr(f"substring({token}, greatest(length({token}) - 1, 1), 2)")) % TAIL


def count_tokens(train: DataFrame) -> DataFrame:
    """train(bytes, lang INT) to (token, c, lang): each token's count and the
    language that most of it comes from."""
    out = train.sparkSession.createDataFrame([], "token binary, lang int, n bigint").schema
    arrow = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict[bytes, int]] = [{} for _ in range(LANGS + 1)]

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in enumerate(counts):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array([lang] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], schema=arrow)
                c.clear()

        for b in gathered(batches):
            batch, lang = Chunks(b.column(0), lower=True), b.column(1).to_numpy()
            of = np.repeat(lang, np.diff(np.append(0, batch.ends)))
            for k in np.unique(lang).tolist():
                c = counts[k]
                c[END] = c.get(END, 0) + int((lang == k).sum())
                n = np.bincount(batch.which[of == k], minlength=len(batch.chunks))
                some = np.flatnonzero(n)
                for i, x in zip(some.tolist(), n[some].tolist()):
                    w = batch.chunks[i]
                    c[w] = c.get(w, 0) + x
            if sum(map(len, counts)) > FLUSH:
                yield from flush()
        yield from flush()

    rows = train.select("bytes", "lang").mapInArrow(run, out)
    of = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"l{k}") for k in range(LANGS + 1)]
    sums = rows.groupBy("token").agg(F.sum("n").alias("c"), *of)
    most = F.greatest(*[F.col(f"l{k}") for k in range(LANGS + 1)])
    lang = F.lit(LANGS)
    for k in reversed(range(LANGS)):
        lang = F.when(F.col(f"l{k}") == most, k).otherwise(lang)
    return sums.select("token", "c", lang.alias("lang"))


def hot_count(counts: DataFrame, hot: int) -> int:
    """The least count such that at most ``hot`` words reach it."""
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor((F.log2("c") - 10) * 64))
    hist = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("s")).collect()  # some thousands at most
    total, least = 0, 1 << 62
    for r in hist:
        total += r.n
        if total > hot:
            break
        least = r.c
    return least


class Tables:
    """What the code carries: the frequent words, their classes and weights."""

    def __init__(self, words: list[bytes], counts: np.ndarray, langs: np.ndarray, stats: dict):
        self.key = uuid.uuid4().hex
        self.words, self.counts = b"\n".join(words), counts
        self.n, self.v, self.least = stats["N"], stats["V"], stats["least"]
        self.k = len(words)
        end = words.index(END) if END in words else -1
        cls = np.zeros(self.k + TAIL + 1, np.int32)  # hot words, tail classes, an end that was never seen
        self.inner = np.zeros(len(cls), np.int32)
        mass: list[float] = []
        common = np.flatnonzero(np.arange(self.k) != end)[:FREQUENT]
        rare = np.ones(self.k, bool)
        rare[common] = False
        for lang in range(LANGS + 1):
            of = common[langs[common] == lang]
            for part in (of[k : k + WIDE] for k in range(0, len(of), WIDE)):
                cls[part], self.inner[part] = len(mass), np.arange(len(part))
                mass.append(float(counts[part].sum()))
        self.wide = len(mass)
        self.words_prior = np.full((self.wide, WIDE), -1e9, np.float32)
        self.words_prior[cls[common], self.inner[common]] = np.log(counts[common] / np.array(mass)[cls[common]])
        for lang in range(LANGS + 1):
            of = np.flatnonzero((langs == lang) & rare)
            of = of[of != end]
            if len(of):
                part = np.cumsum(counts[of], dtype=np.float64)
                band = np.minimum((part - counts[of] / 2) * BANDS // part[-1], BANDS - 1).astype(np.int64)
                _, band = np.unique(band, return_inverse=True)
                cls[of] = len(mass) + band
                mass += np.bincount(band, counts[of]).tolist()
        tail = len(mass)
        cls[self.k : self.k + TAIL] = tail + np.arange(TAIL)
        mass += stats["mass"]
        cls[-1] = len(mass)
        if end >= 0:
            cls[end] = len(mass)
        mass.append(float(counts[end]) if end >= 0 else 0.0)
        self.cls, self.classes = cls, len(mass)
        m = np.array(mass)
        self.prior = np.log((m + 1) / (self.n + len(m))).astype(np.float32)
        within = np.zeros(len(cls))
        within[: self.k] = np.log10(counts / m[cls[: self.k]])
        within[common] = 0.0  # these have a softmax of their own
        if end >= 0:
            within[end] = 0.0
        self.within = within
        self.total = self.n + self.v + 1
        base = np.zeros(len(cls))
        base[: self.k] = np.log10((counts + 1) / self.total)
        base[-1] = math.log10(1 / self.total)
        self.base = base
        self.end_id = end if end >= 0 else self.k + TAIL
        self.bos = self.k + TAIL + 1


class Ids(dict):
    """Numbers of frequent words; another word has that of its tail class."""

    first = 0

    def __missing__(self, word: bytes) -> int:
        return self.first + tail_class(word)


def ids_of(t: Tables) -> Ids:
    def make() -> Ids:
        ids = Ids((w, i) for i, w in enumerate(t.words.split(b"\n") if t.k else []))
        ids.first = t.k
        return ids

    return held(t.key, make)


def flat(t: Tables, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Chunks]:
    """All texts' numbers in one row with two begins before each; the places of
    their tokens; each text's first place among those; their chunks."""
    batch = Chunks(texts, lower=True)
    number = np.fromiter(map(ids_of(t).__getitem__, batch.chunks), np.int64, len(batch.chunks))
    texts_ = np.arange(len(batch.ends))
    sizes = np.diff(np.append(0, batch.ends))
    row = np.full(len(batch.which) + 3 * len(texts_), t.bos, np.int64)
    of = np.repeat(texts_, sizes)
    row[np.arange(len(of)) + 3 * of + 2] = number[batch.which]
    row[batch.ends + 3 * texts_ + 2] = t.end_id
    starts = np.append(0, batch.ends[:-1]) + texts_ if len(texts_) else np.zeros(0, np.int64)
    places = np.arange(len(row) - 2 * len(texts_)) + 2 * (np.repeat(texts_, sizes + 1) + 1)
    return row, places, starts, batch


def hashed(row: np.ndarray, places: np.ndarray, sizes: tuple[int, ...] = BUCKETS, cls: np.ndarray | None = None) -> np.ndarray:
    """Rows of the weights for each place: one for each feature, hashed
    together with the class if one is given."""
    a, b = (row[places - d].astype(np.uint64) + np.uint64(1) for d in (1, 2))
    out = np.empty((len(sizes), len(places)), np.int32)
    first = 0
    for i, (key, size) in enumerate(zip((a, b, a * np.uint64(MIX[1]) + b), sizes)):
        if cls is not None:
            key = key * np.uint64(MIX[2]) + cls.astype(np.uint64)
        out[i] = first + ((key * np.uint64(MIX[i])) >> np.uint64(40)).astype(np.int64) % size
        first += size
    return out


def odds(prior: np.ndarray, w: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised probabilities at each place and their sums; prior: one row
    for all or one each. Logits beyond +-60 count as that, so no exponential
    overflows and no sum is zero."""
    x = w.take(rows[0], 0)
    for r in rows[1:]:
        x += w.take(r, 0)
    x += prior
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], np.float32)


def log_odds(prior: np.ndarray, w: np.ndarray, rows: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Log probability of each place's goal."""
    x, total = odds(prior, w, rows)
    return np.log(x[np.arange(len(goal)), goal]) - np.log(total)


def run_sums(g: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of g's rows over runs of ``order`` that begin at ``first``: short
    runs row by row together, long ones by a product each."""
    count = np.diff(np.append(first, len(order)))
    out = np.empty((len(first), g.shape[1]), np.float32)
    short = np.flatnonzero(count <= LONG_RUN)
    at, n = first[short], count[short]
    sums = g.take(order[at], 0)
    for k in range(1, LONG_RUN):
        more = np.flatnonzero(n > k)
        if not len(more):
            break
        sums[more] += g.take(order[at[more] + k], 0)
    out[short] = sums
    for i in np.flatnonzero(count > LONG_RUN).tolist():
        a = first[i]
        out[i] = np.ones(count[i], np.float32) @ g.take(order[a : a + count[i]], 0)
    return out


class Layer:
    """A task's own copy of one table of weights, with AdaGrad's sums."""

    def __init__(self, w: np.ndarray):
        self.first, self.w = w, w.copy()
        self.square, self.seen = np.full(w.shape, 1e-3, np.float32), np.zeros(len(w), np.float32)

    def step(self, prior: np.ndarray, rows: np.ndarray, goal: np.ndarray, rate: float) -> None:
        g, total = odds(prior, self.w, rows)
        g *= (-1 / total)[:, None]
        g[np.arange(len(goal)), goal] += 1
        for r in rows:
            order = np.argsort(r.astype(np.uint16), kind="stable")  # buckets are below 2^16: a radix sort
            sorted_ = r[order]
            first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
            bucket = sorted_[first]
            sums = run_sums(g, order, first)
            square = self.square[bucket]
            square += sums * sums
            self.square[bucket] = square
            sums *= rate / np.sqrt(square)
            self.w[bucket] += sums
            self.seen[bucket] += np.diff(np.append(first, len(order)))

    def changes(self, number: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Of each block: the buckets that were seen, their changes and how
        often they were seen."""
        for k in range(0, len(self.w), BLOCK_ROWS):
            at = np.flatnonzero(self.seen[k : k + BLOCK_ROWS])
            if len(at):
                yield packed(k // BLOCK_ROWS * 2 + number, at, self.w[k + at] - self.first[k + at], self.seen[k + at])


def packed(block: int, at: np.ndarray, delta: np.ndarray, seen: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    return block, at.astype(np.uint16).tobytes(), delta.astype(np.float16).tobytes(), seen.astype(np.float32).tobytes()


def unpacked(at: bytes, delta: bytes, seen: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(seen, np.float32).astype(np.float64)
    return np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(delta, np.float16).reshape(len(n), -1), n


def parts(t: Tables, row: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens at the places, those of frequent words among them, and the
    rows of their word weights."""
    token = row[places]
    some = np.flatnonzero(t.cls[token] < t.wide)
    return token, some, hashed(row, places[some], WORD_BUCKETS, t.cls[token[some]])


def train_round(t: Tables, w: list[np.ndarray], train: DataFrame, rate: float) -> list[np.ndarray]:
    """One round of distributed updates of class and word weights."""
    spark = train.sparkSession
    out = spark.createDataFrame([], "block int, task int, at binary, delta binary, seen binary").schema
    arrow = arrow_schema(out)

    def row_of(x: tuple[int, bytes, bytes, bytes], task: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((x[0], task, *x[1:]), arrow)], schema=arrow)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, step, done = [Layer(x) for x in w], STEP, 0
        for b in gathered(batches):
            row, places, _, _ = flat(t, b.column(0))
            at = 0
            while at < len(places):
                here = places[at : at + step]
                token, some, rows = parts(t, row, here)
                layers[0].step(t.prior, hashed(row, here), t.cls[token], rate)
                if len(some):
                    layers[1].step(t.words_prior[t.cls[token[some]]], rows, t.inner[token[some]], rate)
                at, done = at + step, done + len(here)
                step = min(LONGEST_STEP, STEP + done // 16)
        if done:
            task = TaskContext.get().partitionId()
            yield from (row_of(x, task) for k, layer in enumerate(layers) for x in layer.changes(k))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for block, *x in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                at, d, n = unpacked(*x)
                if block not in total:
                    total[block] = [np.zeros((BLOCK_ROWS, d.shape[1])), np.zeros(BLOCK_ROWS)]
                total[block][0][at] += d * n[:, None]
                total[block][1][at] += n
        for block, (d, n) in sorted(total.items()):
            at = np.flatnonzero(n)
            yield row_of(packed(block, at, d[at] / n[at, None], n[at]), 0)

    changes = train.select("bytes").mapInArrow(learn, out)
    branches = max(1, math.isqrt(train.rdd.getNumPartitions()))
    sums = changes.repartition("block", F.col("task") % branches).mapInArrow(add, out).repartition("block").mapInArrow(add, out)
    new = [x.copy() for x in w]
    for r in sums.collect():  # as many rows as there are blocks of buckets
        at, d, _ = unpacked(r.at, r.delta, r.seen)
        new[r.block % 2][r.block // 2 * BLOCK_ROWS + at] += d
    return new


def fit(train: DataFrame, counts: DataFrame, hot: int) -> tuple[Tables, list[np.ndarray], dict]:
    """Tables, weights and the tail's figures."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = hot_count(counts, hot)
    rest = counts.filter(F.col("c") < least).filter(F.col("token") != F.lit(END))
    mass, kinds, ones, twos = [0.0] * TAIL, [0] * TAIL, 0, 0
    for r in rest.groupBy(tail_class_sql("token").alias("s")).agg(F.sum("c").alias("m"), F.count("*").alias("t"), F.sum((F.col("c") == 1).cast("int")).alias("a"), F.sum((F.col("c") == 2).cast("int")).alias("b")).collect():
        mass[r.s], kinds[r.s] = float(r.m), r.t
        ones, twos = ones + r.a, twos + r.b
    discount = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))
    frequent = counts.filter((F.col("c") >= least) | (F.col("token") == F.lit(END))).toArrow()  # at most hot + 1 rows
    order = sorted(range(frequent.num_rows), key=lambda i, c=frequent.column("c").to_pylist(), w=frequent.column("token").to_pylist(): (-c[i], w[i]))
    frequent = frequent.take(pa.array(order, pa.int64()))
    t = Tables(frequent.column("token").to_pylist(), frequent.column("c").to_numpy().astype(np.float64), frequent.column("lang").to_numpy(), {"N": n, "V": v, "least": least, "mass": mass})
    w = [np.zeros((sum(BUCKETS), t.classes), np.float32), np.zeros((sum(WORD_BUCKETS), WIDE), np.float32)]
    for r in range(ROUNDS):
        w = train_round(t, w, train.filter(F.pmod(F.shiftright("crc", 8), F.lit(ROUNDS)) == r), RATE / (1 + r))
    return t, w, {"mass": mass, "kinds": kinds, "discount": discount}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hot: int = HOT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    lang = (F.col(lang_col) if lang_col in docs.columns else F.lit(None)).cast("string")
    src = docs.select(F.col(id_col).alias("key"), id_crc(id_col).alias("crc"), text_bytes(text_col).alias("bytes"), F.coalesce(lang, F.lit("")).alias("name"))
    held = F.col("crc") % 7 == 2
    common = [r.name for r in src.filter(~held).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(LANGS).collect()]
    number = F.lit(LANGS)
    for k, name in enumerate(common):
        number = F.when(F.col("name") == name, k).otherwise(number)
    src = src.withColumn("lang", number)
    train = src.filter(~held)
    counts = materialise(count_tokens(train), "tokens")
    t, w, tail = fit(train, counts, hot)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"row bigint, key {kind}, held boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<binary>, times array<int>").schema
    arrow = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 33
        for b in gathered(batches):
            row, places, starts, batch = flat(t, b.column(2))
            token, some, word_rows = parts(t, row, places)
            cls, rows = t.cls[token], hashed(row, places)
            logp = np.empty(len(places))
            for k in range(0, len(places), STEP):
                logp[k : k + STEP] = log_odds(t.prior, w[0], rows[:, k : k + STEP], cls[k : k + STEP])
            for k in range(0, len(some), STEP):
                i = token[some[k : k + STEP]]
                logp[some[k : k + STEP]] += log_odds(t.words_prior[t.cls[i]], w[1], word_rows[:, k : k + STEP], t.inner[i])
            logp = logp / math.log(10) + t.within[token]
            ends = np.append(starts[1:], len(token))
            rare, times = [], []
            far = (token >= t.k) & (token < t.k + TAIL)
            for (x, y), s, e in zip(batch.rows(), starts, ends):
                which, n = np.unique(batch.which[x:y][far[s : e - 1]], return_counts=True)
                rare.append([batch.chunks[i] for i in which])
                times.append(n)
            known = np.add.reduceat((token < t.k).astype(np.int64), starts)
            cols = np.arange(done, done + b.num_rows), b.column(0), b.column(1), ends - starts, known, np.add.reduceat(t.base[token], starts), np.add.reduceat(logp, starts), rare, times
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(cols, arrow)], schema=arrow)

    scored = materialise(src.select("key", held.alias("held"), "bytes").mapInArrow(run, out), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    some = counts.filter(F.col("c") < t.least).select("token", "c")
    s = tail_class_sql("token").cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), s + 1)
    share = F.when(F.col("c").isNull(), (tail["discount"] * pick(tail["kinds"]) + 1)).otherwise(F.col("c") - tail["discount"]) / (pick(tail["mass"]) + 1)
    met = rare.join(some, "token", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / t.total)).alias("b"),
        F.sum(F.col("times") * F.log10(share)).alias("p"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return (
        scored.drop("rare", "times")
        .join(met, "row", "left")
        .select(F.col("key").alias(id_col), F.col("held").alias("held_out"), "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(t.n).cast("bigint").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("score", "p").alias("score"))
    )
