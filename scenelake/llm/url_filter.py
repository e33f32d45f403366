"""Operator 3: URL filters by gradient-boosted trees, in DataFrame functions.

Rules come first: a rule (host, path) fits its host and all subdomains if the
URL's path starts with the rule's; the longest wins. Every other URL is judged
by boosted trees over lexical features: lengths, depth, digit ratio, entropy,
parameter count, hyphens and the block rate of its suffix.

The trees are fitted to labelled URLs: any table (url, label), or pages whose
URL ends in the number of a labelled document (``from_documents``: 1 for
quality 0). At most ``TRAIN_ROWS`` different ones are taken, in the order of
their hash; every suffix among them has its rate. Each level of a tree is one aggregate over
the sample (gradient and curvature for each node, feature and bin); trees
become CASE expressions, so scoring is a projection.

Defined results: a null URL, or one without "://", has an empty host and path
and no rule, and is judged by its features like any other; equal rows each
keep a row; without labelled URLs the method allows all; further columns are
left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, mark, materialise, release

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, L2 = 10, 2, 0.4, 16, 1.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: str) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits for each character."""
    n = F.length(text)

    def of(chars: Column) -> Column:
        share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
        return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))

    return bind(F.filter(F.split(text, ""), lambda c: c != ""), of)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    whole = F.coalesce(url, F.lit(""))
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    digits = lambda text: F.length(F.regexp_replace(text, r"[^0-9]+", ""))
    return {
        "url_length": F.length(whole).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": count(host, "."),
        "depth": count(path, "/"),
        "digit_ratio": digits(whole) / F.greatest(F.length(whole), F.lit(1)),
        "host_digits": digits(host).cast("double"),
        "hyphens": count(host, "-"),
        "host_entropy": F.when(host == "", 0.0).otherwise(entropy(host)),
        "parameters": F.when(F.instr(whole, "?") > 0, count(whole, "&") + 1).otherwise(0.0),
    }


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def from_documents(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """(url, label) of the pages whose path ends in the number of a labelled
    document; 1 where its quality is 0 (by any of its labels)."""
    _, path = parts(url)
    found = pages.select(F.col(url).alias("url"), F.regexp_extract(path, r"([0-9]{1,18})/?$", 1).try_cast("bigint").alias("doc"))
    named = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("doc")).agg((1 - F.min("quality")).cast("int").alias("label"))
    return found.join(named, "doc").select("url", "label")


class Trees:
    """A sum of trees over named features; a tree is a leaf's value or
    (feature, threshold, tree at or below it, tree above it)."""

    def __init__(self, bias: float, trees: list, rates: DataFrame, prior: float):
        self.bias, self.trees, self.rates, self.prior = bias, trees, rates, prior

    def column(self) -> Column:
        def of(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(F.col(t[0]) <= t[1], of(t[2])).otherwise(of(t[3]))

        return sum((of(t) for t in self.trees), F.lit(self.bias))

    def with_suffix_rate(self, df: DataFrame, host: Column) -> DataFrame:
        """df with ``suffix_rate``, by a join with rates(_suffix, _rate): a row
        for each suffix of the sample, so at most ``TRAIN_ROWS``."""
        out = df.join(F.broadcast(self.rates), suffix(host) == F.col("_suffix"), "left")
        return out.withColumn("suffix_rate", F.coalesce("_rate", F.lit(self.prior))).drop("_suffix", "_rate")


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees for labelled(url, label); None without labelled URLs."""
    begun = mark()
    sample = first_by_hash(labelled.select("url", "label").filter("url is not null and label in (0, 1)"), rows)
    host, path = parts("url")
    named = features(F.col("url"), host, path)
    sample = materialise(sample.select(suffix(host).alias("suffix"), *[c.alias(k) for k, c in named.items()], F.col("label").cast("double").alias("label")), "urls")
    total, ones = sample.agg(F.count("*"), F.sum("label")).first()
    if not total:
        return None
    prior = (ones + 1) / (total + 2)
    rate = (F.sum("label") + 20 * prior) / (F.count("*") + 20)
    rates = materialise(sample.groupBy(F.col("suffix").alias("_suffix")).agg(rate.alias("_rate")), "rates")
    model = Trees(math.log(prior / (1 - prior)), [], rates, prior)
    names = [*named, "suffix_rate"]
    sample = model.with_suffix_rate(sample.withColumnRenamed("suffix", "host"), F.col("host"))
    cuts = dict(zip(names, sample.approxQuantile(names, [i / BINS for i in range(BINS)], 0.001)))
    cuts = {k: sorted(set(v)) for k, v in cuts.items()}
    bins = F.array(*[F.struct(F.lit(k).alias("f"), sum((F.when(F.col(k) > c, 1).otherwise(0) for c in v), F.lit(0)).alias("b")) for k, v in cuts.items()])
    sample = materialise(sample.select(*names, "label", bins.alias("bins")).coalesce(4), "bins")
    bins = F.col("bins")
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-model.column()))
        model.trees.append(grow(sample.withColumn("g", F.col("label") - p).withColumn("h", p * (1 - p)), bins, cuts))
    release(labelled.sparkSession, begun, rates)
    return model


def first_by_hash(labelled: DataFrame, rows: int) -> DataFrame:
    """The different rows with the least hashes. Those with a hash below a
    bound that should leave four times as many are told apart first, so not
    every URL is shuffled; if they are too few, all are."""
    span = 1 << 31
    place = F.pmod(F.xxhash64("url"), F.lit(span))
    order = [place, F.col("url"), F.col("label")]
    n = labelled.count()
    if n > 4 * rows:
        some = labelled.filter(place < span * 4 * rows // n).distinct().orderBy(*order).limit(rows)
        if some.count() == rows:
            return some
    return labelled.distinct().orderBy(*order).limit(rows)


def grow(rows: DataFrame, bins: Column, cuts: dict[str, list[float]]):
    """One tree by levels: nodes are numbered from 1, children 2i and 2i + 1."""
    splits: dict[int, tuple[str, float]] = {}
    value: dict[int, float] = {}
    level = [1]
    for _ in range(DEPTH):
        node = F.lit(1)
        for i in sorted(splits):
            f, c = splits[i]
            node = F.when(node == i, F.when(F.col(f) <= c, 2 * i).otherwise(2 * i + 1)).otherwise(node)
        sums = rows.select(node.alias("node"), "g", "h", F.explode(bins).alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        at: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
        for r in sums.collect():  # at most nodes * features * bins rows
            at.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
        below = []
        for i in level:
            if i in at and (split := best_split(at[i], cuts)):
                feature, cut, low, high = split
                splits[i] = feature, cut
                value[2 * i], value[2 * i + 1] = low, high
                below += [2 * i, 2 * i + 1]
        level = below
        if not level:
            break

    def tree(i: int):
        return (*splits[i], tree(2 * i), tree(2 * i + 1)) if i in splits else value.get(i, 0.0)

    return tree(1)


def best_split(node: dict[str, dict[int, tuple[float, float]]], cuts: dict[str, list[float]]) -> tuple[str, float, float, float] | None:
    """Feature, cut and the values of both sides; ties go to the first name."""
    best, found = 1e-6, None
    for f, hist in sorted(node.items()):
        g, h = (sum(x[k] for _, x in sorted(hist.items())) for k in (0, 1))
        a = b = 0.0
        for k, c in enumerate(cuts[f]):  # bin k holds what is above k cuts
            x = hist.get(k, (0.0, 0.0))
            a, b = a + x[0], b + x[1]
            gain = a * a / (b + L2) + (g - a) ** 2 / (h - b + L2) - g * g / (h + L2)
            if b > 0 and h - b > 1e-9 and gain > best + 1e-9:
                best, found = gain, (f, c, RATE * a / (b + L2), RATE * (g - a) / (h - b + L2))
    return found


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and score (the trees' chance of a block)."""
    model = fit(labelled)
    host, path = parts("_url")
    df = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumn("host", host).withColumn("path", path)
    if model is None:
        df = df.withColumn("score", F.lit(0.0))
    else:
        df = model.with_suffix_rate(df.withColumns(features(F.col("_url"), F.col("host"), F.col("path"))), F.col("host"))
        df = df.withColumn("score", 1 / (1 + F.exp(-model.column())))
    rule, said = rule_match(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return df.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "score")
