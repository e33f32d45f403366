"""Operator 7: quality rules with adaptive thresholds, in DataFrame functions.

Each text gets its counts in one pass inside its row (nothing is exploded or
shuffled). Four rates of it go into mergeable quantile sketches (KLL) for each
language and source; sketches merge upward into one for the language and one
for all. A group's fences lie ``WIDTH`` times its quartile distance beyond its
quartiles, where the distance is at least ``SPREAD`` of that rate; a group of
fewer than ``LEAST`` rows takes its language's fences, or those of all. The
fences are joined to the rows, and rows outside them, or that fail the base
rules, are rejected.

Defined results: a null text counts as empty; an empty one has all counts 0
and fails the base rules; a null language or source is a group of its own;
rows of equal or null ids each keep a row; missing language or source columns
count as null; in ``keep`` all columns of the input stay, whatever their names.

Repeated windows are found by their 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, materialise

WIDTH = 3.0
LEAST = 100
SKETCH_K = 400

#: Groups whose fences (about 100 bytes each) are broadcast; more are joined by shuffle.
MOST_BROADCAST = 50_000

#: Least quartile distance of each rate, and whether a low value is odd too.
SPREAD = {"mean_word": (0.6, True), "symbol_rate": (0.05, False), "dup_rate": (0.15, False), "repeat_rate": (0.15, False)}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row: a generator of one
    element, through which the optimiser copies no expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct ``_counts``; helper columns begin with ``_q``."""
    df = once(docs, "_qt", F.coalesce(F.col(text_col), F.lit("")))
    trimmed = F.trim(F.col("_qt"), F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))
    lines = F.filter(F.split("_qt", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    df = once(df, "_qw", words)
    size = F.size("_qw")
    windows = F.when(
        size >= 3, F.transform(F.slice("_qw", 1, size - 2), lambda w, i: F.xxhash64(w, F.get("_qw", i + 1), F.get("_qw", i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    df = once(df, "_qx", F.struct(windows.alias("h"), lines.alias("l")))
    h, l = F.col("_qx.h"), F.col("_qx.l")  # noqa: E741
    counts = F.struct(
        size.cast("bigint").alias("n_words"),
        F.length(F.translate("_qt", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("_qt") - F.length(F.translate("_qt", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.size(l).cast("bigint").alias("n_lines"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(0).cast("bigint").alias("n_repeat_words"),
    )
    return once(df, "_counts", counts).drop("_qt", "_qw", "_qx")


def repeated(hashes: Column) -> Column:
    """Words in three-word windows that occur twice or more: windows sorted
    with their places, those equal to a neighbour kept, their words counted."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = bind(placed, lambda s: F.filter(s, lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"])))
    return F.size(F.array_distinct(F.flatten(F.transform(same, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))


def rates(c: Column) -> dict[str, Column]:
    n = F.greatest(c["n_words"], F.lit(1))
    return {
        "mean_word": c["word_chars"] / n,
        "symbol_rate": c["n_symbols"] / n,
        "dup_rate": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        "repeat_rate": c["n_repeat_words"] / n,
    }


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def keys(docs: DataFrame, by: tuple[str, str]) -> list[Column]:
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast("string") for c in by]


def fences(measured: DataFrame) -> DataFrame:
    """measured(_lang, _source, _counts) to (_lang, _source, _fences): for each
    rate its lowest and highest allowed value."""
    rate = rates(F.col("_counts"))
    groups = measured.groupBy("_lang", "_source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(k) for k, r in rate.items()])
    groups = materialise(groups, "sketches")  # random choices within a sketch are made once
    few = groups.count() <= MOST_BROADCAST
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(k).alias(k) for k in rate]]
    langs, total = groups.groupBy("_lang").agg(*merged), groups.agg(*merged)

    def limits(df: DataFrame, name: str, by: list[str]) -> DataFrame:
        out = []
        for k in rate:
            spread, low = SPREAD[k]
            q = F.kll_sketch_get_quantile_double(k, F.array(F.lit(0.25), F.lit(0.75)))
            reach = WIDTH * F.greatest(q[1] - q[0], F.lit(spread))
            out.append(F.struct((q[0] - reach if low else F.lit(-1.0)).alias("low"), (q[1] + reach).alias("high")).alias(k))
        return df.select(*by, F.when(F.col("n") >= LEAST, F.struct(*out)).alias(name)) if by else df.filter("n > 0").select(F.struct(*out).alias(name))

    of = limits(groups, "_own", ["_lang", "_source"])
    of = of.join(limits(langs, "_wide", ["_lang"]).withColumnRenamed("_lang", "_l"), F.col("_lang").eqNullSafe(F.col("_l")), "left")
    of = of.join(F.broadcast(limits(total, "_all", [])))  # one row
    of = of.select("_lang", "_source", F.coalesce("_own", "_wide", "_all").alias("_fences"))
    return F.broadcast(of) if few else of


def verdict(df: DataFrame, limits: DataFrame) -> DataFrame:
    """df(_lang, _source, _counts, ...) with _failed and _kept."""
    of = limits.withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    joined = df.join(of, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    c = F.col("_counts")
    within = F.lit(True)
    for k, r in rates(c).items():
        within = within & r.between(F.col("_fences")[k]["low"], F.col("_fences")[k]["high"])
    return joined.withColumn("_failed", base_failed(c)).withColumn("_kept", ~F.col("_failed") & within).drop("_fences")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """id, the counts, base_failed and kept of each row."""
    lang, source = keys(docs, by)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang"), source.alias("_source"))
    measured = materialise(with_counts(src, "_text").drop("_text"), "counts")
    out = verdict(measured, fences(measured))
    shown = [F.col("_counts")[c].alias(c) for c in COUNTS if c != "n_lines"]
    return out.select(F.col("_id").alias(id_col), *shown, F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows that pass, with their own columns. Rows are measured once and
    written with their counts, from which the fences and the verdict come."""
    lang, source = keys(docs, by)
    n = len(docs.columns)
    src = docs.select("*", lang, source).toDF(*[f"c{i}" for i in range(n)], "_lang", "_source")  # names may be anything
    counted = materialise(with_counts(src, f"c{docs.columns.index(text_col)}"), "counted")
    passed = verdict(counted, fences(counted.select("_lang", "_source", "_counts")))
    return passed.filter("_kept").select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)
