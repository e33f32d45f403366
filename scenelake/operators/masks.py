"""Run lengths, box prompts, containment, filters of masks; phrases and captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo

from .cells import cell

BOX = ("x1", "y1", "x2", "y2")


def rle_area(counts: Column | str) -> Column:
    """Pixels of run lengths that begin with a run of zeros."""
    c = F.col(counts) if isinstance(counts, str) else counts
    return F.aggregate(F.transform(c, lambda n, i: F.when(i % 2 == 1, n).otherwise(0).cast("bigint")), F.lit(0).cast("bigint"), lambda s, n: s + n)


def rle_decode(masks: DataFrame, key: str, counts: str) -> DataFrame:
    """(key, px): the set pixels of each mask, one for each place."""
    ends = F.transform(counts, lambda n, i: F.struct(i.alias("i"), n.cast("bigint").alias("n"), F.aggregate(F.slice(counts, 1, i), F.lit(0).cast("bigint"), lambda s, v: s + v).alias("at")))
    runs = masks.select(key, F.explode(F.filter(ends, lambda r: (r["i"] % 2 == 1) & (r["n"] > 0))).alias("r"))
    return runs.select(key, F.explode(F.sequence(F.col("r.at"), F.col("r.at") + F.col("r.n") - 1)).alias("px"))


def touching_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Pairs of boxes a (struct ``a``) and b (struct ``b``) of one key that
    overlap, met in the cell that holds their common part's lesser corner."""
    span = lambda s, lo, hi: F.explode(F.sequence(cell(f"{s}.{lo}", size), cell(f"{s}.{hi}", size)))
    out = []
    for df, s in ((a, "a"), (b, "b")):
        out.append(df.withColumn("_cx", span(s, "x1", "x2")).withColumn("_cy", span(s, "y1", "y2")))
    met = out[0].join(out[1], [*keys, "_cx", "_cy"])
    own = (cell(F.greatest("a.x1", "b.x1"), size) == F.col("_cx")) & (cell(F.greatest("a.y1", "b.y1"), size) == F.col("_cy"))
    return met.filter(own).drop("_cx", "_cy")


def overlap(a: str = "a", b: str = "b") -> Column:
    zero = F.lit(0.0)
    side = lambda k: F.greatest(zero, F.least(f"{a}.{k}2", f"{b}.{k}2") - F.greatest(f"{a}.{k}1", f"{b}.{k}1"))
    return side("x") * side("y")


def area(s: str) -> Column:
    return (F.col(f"{s}.x2") - F.col(f"{s}.x1")) * (F.col(f"{s}.y2") - F.col(f"{s}.y1"))


def prompt_masks(prompts: DataFrame, boxes: DataFrame, size: float = 1.0) -> DataFrame:
    """(frame, prompt, box_id, iou): the mask box that fits each prompt best;
    a prompt that meets none has no row; ties go to the lesser id."""
    a = prompts.select("frame", "prompt", F.struct(*BOX).alias("a"))
    b = boxes.select("frame", "box_id", F.struct(*BOX).alias("b"))
    iou, _ = geo.box_iou([F.col(f"a.{c}") for c in BOX], [F.col(f"b.{c}") for c in BOX])
    met = touching_pairs(a, b, ["frame"], size).withColumn("iou", iou).filter("iou > 0")
    return met.groupBy("frame", "prompt").agg(F.max_by("box_id", F.struct("iou", -F.col("box_id"))).alias("box_id"), F.max("iou").alias("iou"))


def contained(boxes: DataFrame, share: float, size: float = 1.0) -> DataFrame:
    """Boxes of which more than ``share`` lies in a larger one of their frame
    (of equal areas the lesser id counts as larger): (frame, box_id)."""
    a = boxes.select("frame", F.col("box_id").alias("i"), F.struct(*BOX).alias("a"))
    b = boxes.select("frame", F.col("box_id").alias("j"), F.struct(*BOX).alias("b"))
    met = touching_pairs(a, b, ["frame"], size).filter("i <> j")
    larger = (area("b") > area("a")) | ((area("b") == area("a")) & (F.col("j") < F.col("i")))
    return met.filter(larger & (overlap() > share * area("a"))).select("frame", F.col("i").alias("box_id")).distinct()


def crop_edge(boxes: DataFrame, crop: Sequence[float], image: Sequence[float], near: float) -> DataFrame:
    """Boxes that don't touch the crop's border, unless it is the image's too."""
    bad = F.lit(False)
    for c, edge, border in zip(BOX, crop, image):
        at = F.abs(F.col(c) - float(edge)) <= near
        bad = bad | (at & F.lit(abs(edge - border) > near))
    return boxes.filter(~bad)


def good_masks(masks: DataFrame, iou: float, stability: float) -> DataFrame:
    return masks.filter((F.col("predicted_iou") >= iou) & (F.col("stability") >= stability))


def point_prompts(masks: DataFrame, prompts: DataFrame) -> DataFrame:
    """(mask, votes): masks(mask, u, v) hit by more positive than negative
    prompts(u, v, sign)."""
    return masks.join(prompts, ["u", "v"]).groupBy("mask").agg(F.sum("sign").alias("votes")).filter("votes > 0")


def box_formats(b: Sequence[Column]) -> dict[str, list[Column]]:
    """A corner box as centre and size, and as corner and size."""
    w, h = b[2] - b[0], b[3] - b[1]
    return {"cxcywh": [b[0] + w / 2, b[1] + h / 2, w, h], "xywh": [b[0], b[1], w, h]}


def uncropped(b: Sequence[Column], x0: float, y0: float) -> list[Column]:
    return [b[0] + x0, b[1] + y0, b[2] + x0, b[3] + y0]


def phrase_class(phrases: DataFrame, classes: Sequence[str]) -> DataFrame:
    """phrases with the number of the first class that stands in the phrase,
    -1 for none: a short list of names."""
    found = F.lit(-1)
    for k in range(len(classes) - 1, -1, -1):
        found = F.when(F.instr("phrase", classes[k]) > 0, k).otherwise(found)
    return phrases.withColumn("class_id", found.cast("int"))


def clean_caption(text: Column | str, words: int = 50) -> Column:
    """Lower case, punctuation as spaces, hyphens and slashes as spaces, single
    spaces, the first ``words`` words (the models' own limit)."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    c = F.regexp_replace(c, r"[.!\"()*#:;~]+", " ")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"[-/]", " "), r"\s{2,}", " "))
    return F.array_join(F.slice(F.split(c, " "), 1, words), " ")


def clean_tag(text: Column | str) -> Column:
    """Lower case, underscores as spaces, slashes as "or", no final stop, with its article."""
    c = F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"\.$", "")
    c = F.replace(F.replace(c, F.lit("_"), F.lit(" ")), F.lit("/"), F.lit(" or "))
    return F.concat(F.when(c.rlike("^[aeiou]"), "an ").otherwise("a "), c)


def word_scores(phrase: Column | str) -> Column:
    """Of ``name(score)`` an array of (word, score): each word of the name has the score."""
    c = F.col(phrase) if isinstance(phrase, str) else phrase
    score = F.regexp_extract(c, r"\(([0-9.]+)\)$", 1).try_cast("double")
    return F.transform(F.split(F.trim(F.substring_index(c, "(", 1)), " "), lambda w: F.struct(w.alias("word"), score.alias("score")))
