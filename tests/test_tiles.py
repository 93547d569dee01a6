"""The 230 features by sums over tiles against the whole-image version."""

import numpy as np
import pytest

from tessera.functions import features, tiles
from tessera.schema import WIDTH
from tessera.sources import images

SCHEMA = "path string, label int, height int, width int, n_channels int, data binary"


def pictures():
    rng = np.random.default_rng(0)
    smooth = np.kron(rng.integers(0, 256, (20, 20, 3)), np.ones((20, 20, 1)))
    flat = np.full((256, 256, 3), 77)
    lone = np.stack([rng.integers(0, 256, (260, 260)), np.full((260, 260), 5), np.zeros((260, 260))], 2)
    return [a.astype(np.uint8) for a in (rng.integers(0, 256, (300, 280, 3)), smooth, flat, rng.integers(100, 104, (256, 300, 3)), lone, rng.integers(0, 256, (90, 120, 3)))]


@pytest.mark.parametrize("cells", [1 << 14, 1000, 1 << 20])
def test_sums_over_tiles_give_the_same_features(cells):
    for image in pictures():
        made = list(tiles.tiles_of(image, cells=cells))
        assert all(len(t[-1]) <= 8 * max(cells, 256) * 1.2 + 20_000 for t in made)
        got, want = tiles.features_of(sum(map(tiles.partial_sums, made))), features.vector(image)
        assert len(got) == WIDTH and np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_images_are_measured_by_sums(spark):
    made = pictures()
    rows = [(f"p{i}", i % 2, *a.shape, bytearray(np.ascontiguousarray(a[:, :, ::-1]).tobytes())) for i, a in enumerate(made)]
    rows += [rows[1], (None, None, *rows[0][2:]), ("broken", 1, 300, 300, 3, bytearray(b"xx")), ("none", 1, None, None, None, None)]
    got = images.measured(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.path, []).append(r)
    assert len(by["p1"]) == 2 and by["p1"][0].f == by["p1"][1].f
    for i, a in enumerate(made):
        assert by[f"p{i}"][0].status == "DONE" and by[f"p{i}"][0].label == i % 2 and np.allclose(by[f"p{i}"][0].f, features.vector(a), rtol=1e-9, atol=1e-9)
    assert by[None][0].f == by["p0"][0].f and by[None][0].label is None
    assert by["broken"][0].f is None and by["broken"][0].status.startswith("error") and by["none"][0].f is None
    assert images.measured(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_images_have_no_answer_once_normalised(spark):
    a = pictures()[5]
    rows = [("small", 0, *a.shape, bytearray(a.tobytes()))]
    r = images.measured(spark.createDataFrame(rows, SCHEMA), normalise=True).first()
    assert r.status == "TOOSMALL" and r.f is None and r.path == "small"
