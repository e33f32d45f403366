"""Cosine search over all vectors in blocks."""

import numpy as np

from scenelake.operators import detect


def test_cosine_softmax_over_blocks_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2500, 6)).astype(np.float32)
    v[1200:1300] = v[7]  # a hundred copies: ties go to the lesser id
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9001, None), (9002, [0.0] * 6), (9003, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    q = df.filter("vec_id in (7, 300)").selectExpr("vec_id as q", "embedding as a")
    out = detect.cosine_softmax(q, df, 10, 10.0)
    w = v.astype(np.float64)
    cos = {k: w @ w[k] / np.sqrt((w * w).sum(1) * (w[k] ** 2).sum()) for k in (7, 300)}
    got = out.collect()
    assert sorted(r.vec_id for r in got if r.q == 7) == [7, *range(1200, 1209)]
    assert [r.vec_id for r in sorted((r for r in got if r.q == 300), key=lambda r: -r.cos)] == np.argsort(-cos[300], kind="stable")[:10].tolist()
    for r in got:
        assert abs(r.p - np.exp(10 * cos[r.q][r.vec_id]) / np.exp(10 * cos[r.q]).sum()) < 1e-9
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_cosine_softmax_lists_vectors_without_a_cosine_last(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 2.0])], "vec_id bigint, embedding array<float>")
    out = detect.cosine_softmax(df.filter("vec_id = 1").selectExpr("vec_id as q", "embedding as a"), df, 3, 1.0)
    got = {r.vec_id: r.cos for r in out.collect()}
    assert got == {1: 1.0, 4: 0.0, 2: None}
    empty = detect.cosine_softmax(df.filter("vec_id = 77").selectExpr("vec_id as q", "embedding as a"), df, 3, 1.0)
    assert empty.collect() == []
