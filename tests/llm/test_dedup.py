"""Operators 8 and 1, and the components, against brute force."""

import random

import numpy as np
import pytest
import xxhash

from scenelake.llm import decontaminate, simhash
from scenelake.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    s = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def make_docs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [" ".join(word() for _ in range(120)) for _ in range(15)]
    out = [None, "", " \t", "one", "one two", "ONE two", "x " * 5000]
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(120)] = word()
            out.append(" ".join(w))
    return out + base[:3]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(100 - i, t, "x", "y") for i, t in enumerate(make_docs())], "doc_id bigint, text string, fp string, root string")


@pytest.mark.parametrize("radius", [2, 4])
def test_near_duplicates(docs, radius):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, radius=radius).collect()}
    fps = {100 - i: slow_fingerprint(t) for i, t in enumerate(make_docs())}
    ids = sorted(fps)
    linked = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= radius]
    assert len(linked) > 10
    of = slow_components(ids, linked)
    assert got == {i: (f"{fps[i]:016x}", of[i]) for i in ids}


def test_keep_first(docs, spark):
    got = simhash.near_duplicates(docs).collect()
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})
    again = docs.union(docs).union(spark.createDataFrame([(None, "no id here at all", "", ""), (None, "no id here at all", "", "")], docs.schema))
    ids = sorted(simhash.keep_first(again).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [r.doc_id for r in ids] == [None, *sorted({r.component_id for r in got})]
    none = spark.createDataFrame([], docs.schema)
    assert simhash.near_duplicates(none).count() == simhash.keep_first(none).count() == 0


def test_tiles_lose_no_link(spark):
    """Many near copies in a few tiles that are split: same groups, few links."""
    rng = random.Random(2)
    fps = set()
    for _ in range(4):
        f = rng.getrandbits(63)
        for _ in range(300):
            fps.add(f)
            f ^= 1 << rng.randrange(63)
    fps = sorted(fps)
    rows = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = simhash.links(rows, 2, tile=16).distinct().collect()
    arr = np.array(fps, np.uint64)
    near = [(a, int(b)) for k, a in enumerate(fps) for b in arr[k + 1 :][np.bitwise_count(arr[k + 1 :] ^ np.uint64(a)) <= 2]]
    assert slow_components(fps, [tuple(r) for r in links]) == slow_components(fps, near)


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (1, 2), (1, 2)]
    df = spark.createDataFrame([*links, (None, 3)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(df).collect()}
    want = slow_components(sorted({x for p in links for x in p}), links)
    assert got == {n: r for n, r in want.items() if n != r}


def slow_edits(item, words):
    """Least edits of the item to any passage."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 8, 20, 45])))) for k in range(40)] + [(40, None), (41, ""), (42, "!!")]
    docs = []
    for d in range(120):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        if d % 2:
            got = (items[rng.randrange(40)][1]).split()
            for _ in range(rng.randrange(0, 12)):
                at = rng.randrange(max(len(got), 1))
                what = rng.randrange(3)
                got[at : at + (what != 0)] = [] if what == 1 else [rng.choice(words)]
            at = rng.randrange(len(body) + 1)
            body[at:at] = got
        docs.append((d, " ".join(body).upper() if d % 3 else ",  ".join(body), d))
    docs += [(500, None, 1), (501, "", 1), (502, items[0][1], 1), (502, items[0][1], 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_edits int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for d, t, _ in docs:
        w = decontaminate.words_of(t or "")
        for k, x in items:
            item = decontaminate.words_of(x or "")
            if item and (n := slow_edits(item, w)) <= int(0.2 * len(item)):
                want[d, k] = n
    for size in (decontaminate.BLOCK_BYTES, 700):
        got = decontaminate.contaminated(df, bench, block_bytes=size)
        rows = got.collect()
        assert {(r.doc_id, r.item_id): r.n_edits for r in rows} == want and len(want) > 20
        assert all(r.contaminated for r in rows)
        kept = decontaminate.drop_contaminated(df, bench, block_bytes=size)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, *_ in docs if d not in {a for a, _ in want}) and kept.columns == df.columns
    none = spark.createDataFrame([], bench.schema)
    assert decontaminate.contaminated(df, none).count() == 0 and decontaminate.drop_contaminated(df, none).count() == len(docs)
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    df = spark.createDataFrame([(1, "He said yes, of course, twice."), (2, "天気がとてもいいですね、今日は"), (3, "off course"), (4, "yes")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "of course"), (2, "天気がとてもいいですよ"), (3, "yes")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_edits) for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(1, 1, 0), (2, 2, 1), (1, 3, 0), (4, 3, 0)}
    clash = df.toDF("_bytes", "c0")
    assert decontaminate.drop_contaminated(clash, items, text_col="c0", block_bytes=20).select("_bytes").collect() == [(3,)]


HELPERS = ["id", "fp", "root", "row", "c0", "c1", "_id", "_fp", "_own_root", "component_id", "first"]


def test_keep_first_with_helper_names(spark):
    rows = [(2, "a b c", *range(len(HELPERS))), (1, "a b c", *range(10, 10 + len(HELPERS))), (7, "x y z", *range(20, 20 + len(HELPERS)))]
    df = spark.createDataFrame(rows, ["doc_id", "text", *HELPERS])
    got = simhash.keep_first(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(rows[1:])
    again = df.union(spark.createDataFrame([(1, "a b c", *range(5, 5 + len(HELPERS))), (1, "b b c", *range(len(HELPERS)))], df.schema))
    for part in (1, 5):  # which of the repeated rows stays doesn't depend on how they lie
        kept = sorted(map(tuple, simhash.keep_first(again.repartition(part)).collect()))
        assert [r[:2] for r in kept] == [(1, "a b c"), (1, "b b c"), (7, "x y z")] and kept == sorted(map(tuple, simhash.keep_first(again).collect()))
