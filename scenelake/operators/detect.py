"""Boxes, suppression, run lengths, masks, tags and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo

from .ordering import running_sums


def corners(boxes: DataFrame) -> DataFrame:
    return boxes.select("frame", "box_id", "score", *[c.alias(n) for c, n in zip(geo.to_corners(), ("x1", "y1", "x2", "y2"))])


def pair_iou(boxes: DataFrame) -> DataFrame:
    """(frame, i, j, iou, giou) of all pairs i < j of a frame."""
    n = ("x1", "y1", "x2", "y2")
    a = boxes.select("frame", F.col("box_id").alias("i"), F.struct(*n).alias("a"))
    b = boxes.select("frame", F.col("box_id").alias("j"), F.struct(*n).alias("b"))
    iou, giou = geo.box_iou([F.col(f"a.{c}") for c in n], [F.col(f"b.{c}") for c in n])
    return a.join(b, "frame").filter("i < j").select("frame", "i", "j", iou.alias("iou"), giou.alias("giou"))


def nms(boxes: DataFrame, threshold: float) -> DataFrame:
    """Kept boxes of each frame: by falling score (ties: lesser id), each drops
    what overlaps it by more than the threshold."""
    import numpy as np
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "box_id"], ascending=[False, True])
        x1, y1, x2, y2 = (g[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
        area, left, kept = (x2 - x1) * (y2 - y1), np.arange(len(g)), []
        while len(left):
            i, rest = left[0], left[1:]
            kept.append(i)
            inter = np.maximum(0, np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest])) * np.maximum(0, np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]))
            union = area[i] + area[rest] - inter
            left = rest[np.where(union > 0, inter / np.where(union > 0, union, 1), 0) <= threshold]
        return g.iloc[kept][["frame", "box_id"]]

    kinds = [boxes.schema[c].dataType.simpleString() for c in ("frame", "box_id")]
    return boxes.groupBy("frame").applyInPandas(run, f"frame {kinds[0]}, box_id {kinds[1]}")


def run_lengths(pixels: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, run, value, start, n): runs of equal values in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    r = pixels.withColumn("_s", step).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("start"), F.count("*").alias("n"))


def mask_box(pixels: DataFrame, keys: list[str], masks: DataFrame | None = None) -> DataFrame:
    """Box and area of each mask's pixels; with ``masks`` (the keys of all of
    them) an empty mask has zeros, without it no row."""
    got = pixels.groupBy(*keys).agg(F.min("u").alias("u0"), F.min("v").alias("v0"), F.max("u").alias("u1"), F.max("v").alias("v1"), F.count("*").alias("area"))
    return got if masks is None else masks.select(*keys).distinct().join(got, keys, "left").fillna(0, ["u0", "v0", "u1", "v1", "area"])


def stability(pixels: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Share of pixels over ``high`` among those over ``low``."""
    n = lambda t: F.sum(F.when(F.col(value) > t, 1).otherwise(0))
    return pixels.groupBy(*keys).agg(F.when(n(low) > 0, n(high) / n(low)).otherwise(0.0).alias("stability"))


def tag_threshold(scores: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """scores(image, tag, score) over their tag's own threshold, deleted tags
    left out: vocabulary(tag, threshold, deleted)."""
    return scores.join(vocabulary.filter("not deleted"), "tag").filter(F.col("score") > F.col("threshold")).select("image", "tag", "score")


def average_precision(ranked: DataFrame, key: str) -> DataFrame:
    """ranked(key, id, score, positive) to (key, ap): mean precision at the
    places of positives, by falling score (ties: lesser id). Ranks and running
    positives come from ranges of all rows, less what came before the key, so
    a key with most of the rows is no single task."""
    rows = ranked.select(key, "id", (-F.col("score")).alias("_low"), "positive", F.lit(1).alias("_one"))
    p = running_sums(rows, [key, "_low", "id"], {"_k": "_one", "_t": "positive"})
    first = p.groupBy(key).agg(F.min("_k").alias("_k0"), F.min("_t").alias("_t0"))
    precision = (F.col("_t") - F.col("_t0") + 1) / (F.col("_k") - F.col("_k0") + 1)
    at = p.join(first, key).groupBy(key).agg(F.avg(F.when(F.col("positive") == 1, precision)).alias("ap"))
    return at.select(key, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def precision_recall(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, predicted 0/1, positive 0/1)."""
    tp = F.sum(F.col("predicted") * F.col("positive"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.groupBy(key).agg(safe(tp, F.sum("predicted")).alias("precision"), safe(tp, F.sum("positive")).alias("recall"))


def cosine_softmax(queries: DataFrame, vectors: DataFrame, k: int, sharpness: float) -> DataFrame:
    """(q, vec_id, cos, p): the k vectors nearest to each query by cosine (ties to
    the lesser id) with their share of a softmax over all vectors. queries(q, a),
    vectors(vec_id, embedding). Every vector meets every query in blocks of numpy
    sums, taken place by place; a task passes on each query's k best and its sum
    of exponentials, so what is dealt out follows tasks times queries. A null,
    zero or otherwise long vector has no cosine and stands last."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    asked = queries.select("q", "a").toArrow()
    ids = asked.column("q").to_numpy()

    def matrix(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False) == n)
        flat = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        return at, np.ascontiguousarray(flat.astype(np.float64).reshape(len(at), n).T)

    def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(np.broadcast_shapes(a.shape[1:], b.shape[1:]))
        part = np.empty_like(out)
        for x, y in zip(a, b):
            out += np.multiply(x, y, out=part)
        return out

    lists = asked.column("a").combine_chunks()
    groups = [(n, *matrix(lists, n)) for n in sorted({x for x in pc.list_value_length(lists).to_pylist() if x})]

    def run(batches):
        many = len(ids)
        total = np.zeros(many)
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # place of the query, cosine, id
        floor = np.full(many, -np.inf)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                name, col = b.column(0).slice(at, 1024).to_numpy(), b.column(1).slice(at, 1024)
                cos = np.full((many, len(name)), -np.inf)
                for n, mine, a in groups:
                    there, v = matrix(col, n)
                    norm = dots(v, v)
                    for i in range(0, len(mine), 64):
                        part = a[:, i : i + 64]
                        with np.errstate(invalid="ignore", divide="ignore"):
                            c = dots(part[:, :, None], v[:, None, :]) / np.sqrt(dots(part, part)[:, None] * norm)
                        cos[mine[i : i + 64, None], there] = np.where(np.isnan(c), -np.inf, c)
                total += np.exp(sharpness * cos).sum(1)
                q, i = np.nonzero(cos >= floor[:, None])
                best = tuple(np.concatenate(x) for x in zip(best, (q, cos[q, i], name[i])))
                order = np.lexsort((best[2], -best[1], best[0]))
                best = tuple(x[order] for x in best)
                first = np.searchsorted(best[0], np.arange(many))
                rank = np.arange(len(best[0])) - first[best[0]]
                floor[best[0][rank == k - 1]] = best[1][rank == k - 1]
                best = tuple(x[rank < k] for x in best)
        q, cos, name = best
        lead = np.append(True, q[1:] != q[:-1])[: len(q)]
        none = np.isinf(cos)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(name, pa.int64()), pa.array(np.where(none, 0.0, cos), pa.float64(), mask=none), pa.array(np.where(lead, total[q], 0.0), pa.float64())], names=["q", "vec_id", "cos", "_t"])

    met = vectors.select("vec_id", "embedding").mapInArrow(run, "q bigint, vec_id bigint, cos double, _t double")
    w = Window.partitionBy("q")
    ranked = met.withColumn("_k", F.row_number().over(w.orderBy(F.desc("cos"), "vec_id"))).withColumn("_s", F.sum("_t").over(w))
    return ranked.filter(F.col("_k") <= k).select("q", "vec_id", "cos", (F.exp(sharpness * F.col("cos")) / F.col("_s")).alias("p"))
