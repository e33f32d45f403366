"""Models as pluggable functions: batches in, batches out.

A model is any callable from a pandas frame to a pandas frame with a declared
schema; it is made once in each Python worker by its factory and applied with
``mapInPandas``. No weights come with this library, so ``Stub`` stands in: its
outputs follow from a hash of its inputs, are the same on every run, and have
the right shapes, so that everything before and after a model can be run and
tested.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def infer(rows: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """rows through a model that each worker's task makes once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for b in batches:
            yield model(b)

    return rows.mapInPandas(run, schema)


class Stub:
    """Numbers in [0, 1) that depend on the input's text alone."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def numbers(self, key: object, n: int) -> np.ndarray:
        return np.array([(zlib.crc32(f"{self.seed}/{key}/{i}".encode()) & 0xFFFFFF) / (1 << 24) for i in range(n)])


def tagger(classes: Sequence[str], seed: int = 0) -> Callable[[], Callable]:
    """(image) to (image, tag, score), a row for each class."""

    def make() -> Callable:
        stub = Stub(seed)
        return lambda b: pd.DataFrame([(x, c, float(s)) for x in b["image"] for c, s in zip(classes, stub.numbers(x, len(classes)))], columns=["image", "tag", "score"])

    return make


def detector(most: int = 5, seed: int = 1) -> Callable[[], Callable]:
    """(image, caption) to (image, phrase, score, cx, cy, w, h): a box for each
    phrase of a caption whose parts end with a stop, in shares of the image."""

    def make() -> Callable:
        stub, out = Stub(seed), ["image", "phrase", "score", "cx", "cy", "w", "h"]

        def run(b: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for x, caption in zip(b["image"], b["caption"]):
                for p in [p.strip() for p in caption.split(".") if p.strip()][:most]:
                    s, cx, cy, w, h = stub.numbers(f"{x}/{p}", 5).tolist()
                    rows.append((x, p, s, 0.25 + cx / 2, 0.25 + cy / 2, 0.05 + w / 3, 0.05 + h / 3))
            return pd.DataFrame(rows, columns=out)

        return run

    return make


def segmenter(size: int = 16, seed: int = 2) -> Callable[[], Callable]:
    """(image, phrase, cx, cy, w, h) to (image, phrase, stability,
    predicted_iou, counts): the box's cells on a size x size grid as run
    lengths in row order that begin with a run of zeros."""

    def make() -> Callable:
        stub = Stub(seed)

        def run(b: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for r in b.itertuples():
                on = np.zeros((size, size), bool)
                y0, y1, x0, x1 = (min(max(int(v * size), 0), size) for v in (r.cy - r.h / 2, r.cy + r.h / 2 + 1 / size, r.cx - r.w / 2, r.cx + r.w / 2 + 1 / size))
                on[y0:y1, x0:x1] = True
                cuts = np.flatnonzero(np.diff(np.concatenate([[False], on.ravel(), [not on.ravel()[-1]]])))
                a, c = stub.numbers(f"{r.image}/{r.phrase}", 2).tolist()
                rows.append((r.image, r.phrase, a, c, np.diff(np.concatenate([[0], cuts])).tolist()))
            return pd.DataFrame(rows, columns=["image", "phrase", "stability", "predicted_iou", "counts"])

        return run

    return make


TAGS = "image string, tag string, score double"
DETECTIONS = "image string, phrase string, score double, cx double, cy double, w double, h double"
MASKS = "image string, phrase string, stability double, predicted_iou double, counts array<bigint>"


def captions(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(image, caption): each image's tags over their thresholds, in order, each with a stop."""
    kept = tags.join(vocabulary, "tag").filter(F.col("score") > F.col("threshold"))
    return kept.groupBy("image").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_set("tag")), lambda t: F.concat(t, F.lit(".")))).alias("caption"))


def annotate(images: DataFrame, vocabulary: DataFrame, tag: Callable, detect: Callable, segment: Callable, least: float) -> DataFrame:
    """Images through tags, boxes of enough confidence and masks; each model's
    result is a plain table, so stages can be written out between them."""
    found = infer(captions(infer(images.select("image"), tag, TAGS), vocabulary), detect, DETECTIONS)
    return infer(found.filter(F.col("score") >= least), segment, MASKS)


def normalised(pixels: DataFrame, mean: Sequence[float], deviation: Sequence[float]) -> DataFrame:
    """pixels(image, u, v, r, g, b in 0..255) scaled to 0..1, less the mean, over the deviation."""
    return pixels.withColumns({c: (F.col(c) / 255 - m) / s for c, m, s in zip("rgb", mean, deviation)})


def unit_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """rows with the vector at length one; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    n: Column = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn(vector, F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
