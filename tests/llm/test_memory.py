"""What a worker keeps between stages and looks at at once."""

import pyarrow as pa

from scenelake.llm import bpe_codec, common


def test_memory_is_given_back_between_stages(monkeypatch):
    told = []
    monkeypatch.setattr(common, "_held", {})
    monkeypatch.setattr(common, "give_back", lambda: told.append(dict(common._held)))
    for key in ("a", "a", "b", "b"):
        assert common.held(key, lambda: key) == key
    assert told == [{}]


def test_give_back_runs():
    common.give_back()


def test_encoding_gathers_less_text(spark, monkeypatch):
    seen = []
    real = common.gathered
    batches = [pa.RecordBatch.from_arrays([pa.array([b"x" * 1000] * 100)], ["b"])] * 30
    assert [b.num_rows for b in real(batches, 250_000)] == [300] * 10
    monkeypatch.setattr(bpe_codec, "map_rows", lambda *a, **k: seen.append(k))
    bpe_codec.digests(spark.createDataFrame([(1, "a")], "doc_id int, text string"), "none")
    assert seen[0]["gather"] == bpe_codec.GATHER <= 1 << 20
