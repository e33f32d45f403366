"""Operators 6, 9 and 4 against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from scenelake.llm import bpe, bpe_codec, token_counts, wavelet  # noqa: E402
from scenelake.llm.common import new_path  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, n_tokens int, key string"
ALPHABET = [*"abcXYZ 'sSΣσςİıß \x1c\x1d\x85 ᠎​﻿0١²½Ⅷ漢字かな\U0001f642éͅ\r\n\t.,!#|　ᾼ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'re", "'ll", "Word, ", "word. "]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    long = ["".join(rng.choice("theaningéöçß") for _ in range(n)) for n in (199, 200, 201, 5000)]
    return [None, "", " \n\t", "a" * 3000, "the cat sat " * 3000, "<|endoftext|>x", "same", "same", *long, *made]


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 9 else 3 if i in (6, 7) else i, t, 7, "k") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


def want(lib):
    return [lib.encode(t or "", add_special_tokens=False).ids for t in texts()]


def test_codec(docs, lib):
    got = sorted(tuple(r)[1:] for r in bpe_codec.digests(docs, PATH).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted((len(i), sha(" ".join(map(str, i))), sha(lib.decode(i, skip_special_tokens=False))) for i in want(lib))
    ids = {(r.doc_id, tuple(r.ids)) for r in bpe_codec.encode(docs, PATH).collect()}
    assert (0, ()) in ids and len(ids) == len({(None if k == 9 else 3 if k in (6, 7) else k, tuple(i)) for k, i in enumerate(want(lib))})


def test_counts(docs, lib):
    got = sorted(tuple(r)[1:] for r in token_counts.count_tokens(docs, PATH, limit=100).collect())
    assert got == sorted((len((t or "").encode()), len(i), len(i) > 100) for t, i in zip(texts(), want(lib)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe_codec.digests(none, PATH).count() == token_counts.count_tokens(none, PATH).count() == 0
    path = new_path(spark, "test")
    wavelet.write_shards(none, path, PATH)
    assert wavelet.read_shards(spark, path).count() == 0


def test_rank_array_equals_heap():
    b = bpe.word_bpe(PATH)
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("theaning") for _ in range(rng.randint(1, 60)))
        parts = bpe.rank_array_cuts(w, b.end, b.ranks)
        assert parts == bpe.heap_parts(w, b.end, b.ranks)[0] and bpe.heap_count(w, b.end, b.ranks) == len(parts)


def test_memory_is_bounded():
    m = bpe.Memory(lambda k: len(k), 10)
    for i in range(1000):
        assert m(b"%d" % i) == len(b"%d" % i)
        assert len(m.young) <= 10 and len(m.old) <= 10
    assert m.all([b"1", b"22", b"1"]) == [1, 2, 1]


def test_shards(docs, spark, lib):
    path = new_path(spark, "test")
    wavelet.write_shards(docs, path, PATH, shard_tokens=500)
    assert spark.read.parquet(path).count() > 3
    got = sorted(((r.doc_id is not None, r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_shards(spark, path).collect())
    ids = [(None if i == 9 else 3 if i in (6, 7) else i, (t or "").encode(), x + [2]) for i, (t, x) in enumerate(zip(texts(), want(lib)))]
    start, out = 0, []
    for k, _, x in sorted(ids, key=lambda r: ((r[0] is not None, r[0] or 0), r[1])):
        out.append(((k is not None, k), start, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
        start += len(x)
    assert [g[1:] for g in sorted(got, key=lambda g: g[1])] == [o[1:] for o in out]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 40, n).astype(np.uint16)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes())
    assert (w.all() == ids).all()
    for i in range(0, n, 37):
        assert w.access(i) == ids[i]
    for t in (0, 7, 39, 40, 1 << 17):
        where = np.flatnonzero(ids == t)
        assert w.count(t) == len(where) and (w.occurrences(t) == where).all()
        assert w.count(t, n // 3, n // 2) == (ids[n // 3 : n // 2] == t).sum()
        assert w.select(t, 0) == (where[0] if len(where) else -1) and w.select(t, len(where)) == -1
        for k in range(0, len(where), 5):
            assert w.select(t, k) == where[k]


def test_select_reads_single_blocks():
    ids = np.random.default_rng(1).integers(0, 5, 100_000).astype(np.uint16)
    w = wavelet.WaveletMatrix.build(ids, 3)

    class Counted:
        def __init__(self, bits):
            self.bits, self.read = bits, 0

        def reshape(self, *shape):
            return CountedRows(self, self.bits.reshape(*shape))

    class CountedRows:
        def __init__(self, owner, rows):
            self.owner, self.rows = owner, rows

        def __getitem__(self, at):
            self.owner.read += len(at)
            return self.rows[at]

    where = np.flatnonzero(ids == 3)
    begin, end = w._range(3, 0, w.n)
    planes = [(z, r, Counted(b)) for z, r, b in w.planes]
    w.planes = planes
    assert w._up(3, np.array([begin + 700]))[0] == where[700] and end - begin == len(where)
    assert [b.read for _, _, b in planes] == [1, 1, 1]


def test_other_kinds_of_files_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "\\S+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.WordBpe(str(other))


def test_chunks_are_told_apart():
    import pyarrow as pa

    chunks, which, ends = bpe.told_apart(pa.array(["The, the. x1, été!! <|", None, "a,b"]))
    got = [chunks[i].decode() for i in which]
    assert [[x for x in got[a:b] if x] for a, b in zip([0, *ends], ends)] == [["The,", "the", ".", "x1,", "été", "!!", "<|"], [], ["a,b"]]
    chunks, which, _ = bpe.told_apart(pa.array(["The, été!! x1, É."]))
    assert [chunks[i].decode() for i in which] == ["the", ",", "été", "!!", "x1,", "", "É.", ""]
