"""Point files, settings and the stub models."""

import numpy as np
import pandas as pd
import pytest

from scenelake.operators import masks, models
from scenelake.sources import arrays


def test_npy_and_ply(spark, tmp_path):
    p = np.random.default_rng(1).normal(size=(20, 4))
    p[3, 1] = np.nan
    np.save(tmp_path / "a.npy", p)
    np.save(tmp_path / "b.npy", np.asfortranarray(p.T.astype(np.float32)))
    rows = "\n".join(f"{i} 0 {x} {y} {z}" for i, (x, y, z, _) in enumerate(p[:5]))
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 5\nproperty int k\nproperty int c\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int v\nend_header\n" + rows + "\n3 0 1 2\n")
    got = arrays.read_points(spark, str(tmp_path / "*.*")).toPandas()
    got["path"] = got.path.str[-5:]
    for name, n in (("a.npy", 20), ("b.npy", 20), ("c.ply", 5)):
        g = got[got.path == name].sort_values("point_idx")
        assert g.point_idx.tolist() == [i for i in range(n) if i != 3]
        assert np.allclose(g[["x", "y", "z"]], p[g.point_idx, :3], atol=1e-6)
    with pytest.raises(ValueError):
        arrays.npy_points(b"no")
    with pytest.raises(ValueError):
        arrays.ply_points(b"ply\nformat binary_little_endian 1.0\nend_header\n")


def test_settings_and_ground_truth(spark, tmp_path):
    got = arrays.settings("# x\nwidth: 1600\n  fx: 785.5 # focal\nshow: true\nname: 'a b'\nother: 3\nbad line\n", {"width": 1, "fx": 0.5, "show": False, "name": "", "keep": 7})
    assert got == {"width": 1600, "fx": 785.5, "show": True, "name": "a b", "keep": 7}
    (tmp_path / "gt.txt").write_text("x y yaw\n1 2 179.5\n\n3,4,-180\n")
    assert sorted(map(tuple, arrays.ground_truth(spark, str(tmp_path / "gt.txt")).collect())) == [(0, 1.0, 2.0, 179.5), (1, 3.0, 4.0, -180.0)]


def test_models_are_made_once_and_repeat(spark):
    images = spark.createDataFrame([(f"im{i}",) for i in range(30)], "image string")
    vocabulary = spark.createDataFrame([("chair", 0.5), ("door", 0.4), ("wall", 2.0)], "tag string, threshold double")
    run = lambda: models.annotate(images, vocabulary, models.tagger(("chair", "door", "wall")), models.detector(), models.segmenter(), 0.3)
    got = sorted((r.image, r.phrase, r.stability, tuple(r.counts)) for r in run().collect())
    assert got == sorted((r.image, r.phrase, r.stability, tuple(r.counts)) for r in run().collect()) and len(got) > 10
    assert {p for _, p, _, _ in got} <= {"chair", "door"} and all(sum(c) == 256 for *_, c in got)
    tags = models.tagger(("chair", "door", "wall"))()(pd.DataFrame({"image": ["im0"]}))
    assert tags.tag.tolist() == ["chair", "door", "wall"] and tags.score.between(0, 1).all()
    area = run().select(masks.rle_area("counts").alias("a")).collect()
    assert all(r.a > 0 for r in area)
    zero = models.unit_vectors(spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>"), "v").collect()
    assert [list(r.v) for r in zero] == [[0.0, 0.0], [0.6, 0.8]]
