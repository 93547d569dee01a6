"""Edits by strips of rows: the pixels of whole-image formulas, in less time, made and digested in the task that edits them."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import pixels as px
from tessera.plans import catalog, catalog_models
from tessera.sources import images

SF = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- each formula over a whole image, with dense matrices


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    rows, cols = px.bicubic_matrix(a.shape[0], height), px.bicubic_matrix(a.shape[1], width)
    planes = [rows @ a[:, :, c].astype(np.float64) @ cols.T for c in range(a.shape[2])]
    return px.rounded(np.stack(planes, 2))


def halved(x: np.ndarray) -> np.ndarray:
    x = np.pad(x, [(0, x.shape[0] % 2), (0, x.shape[1] % 2)], mode="edge")
    return (x[::2, ::2] + x[1::2, ::2] + x[::2, 1::2] + x[1::2, 1::2]) / 4


def bilinear(x: np.ndarray, height: int, width: int) -> np.ndarray:
    def taps(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        i = np.minimum(at.astype(int), max(n - 2, 0))
        return i, np.minimum(i + 1, n - 1), at - i

    r0, r1, fr = taps(x.shape[0], height)
    c0, c1, fc = taps(x.shape[1], width)
    y = x[r0] * (1 - fr)[:, None] + x[r1] * fr[:, None]
    return y[:, c0] * (1 - fc) + y[:, c1] * fc


def decimated_chroma(a: np.ndarray) -> np.ndarray:
    ycc = px.rounded(a.astype(np.float64) @ px._TO_YCC.T + px._YCC_OFFSET).astype(np.float64)
    for c in (1, 2):
        ycc[:, :, c] = bilinear(px.rounded(halved(ycc[:, :, c])).astype(np.float64), *a.shape[:2])
    return px.rounded((px.rounded(ycc) - px._YCC_OFFSET) @ np.linalg.inv(px._TO_YCC).T)


def jpeg_round_trip(a: np.ndarray, quality: int = 85) -> np.ndarray:
    h, w = a.shape[:2]
    ycc = a.astype(np.float64) @ px._TO_JFIF.T + px._JFIF_OFFSET
    planes = []
    for c in range(3):
        x = ycc[:, :, c] if c == 0 else halved(ycc[:, :, c])
        n, m = x.shape
        x = np.pad(x, [(0, -n % 8), (0, -m % 8)], mode="edge") - 128
        blocks = x.reshape(x.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
        q = px.quantisation(quality, c > 0)
        coded = np.round(px._DCT @ blocks @ px._DCT.T / q) * q
        x = (px._DCT.T @ coded @ px._DCT).swapaxes(1, 2).reshape(x.shape)[:n, :m] + 128
        planes.append(x if c == 0 else bilinear(x, h, w))
    return px.rounded((np.stack(planes, 2) - px._JFIF_OFFSET) @ np.linalg.inv(px._TO_JFIF).T)


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(2 * sigma))
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    p = np.pad(x, reach, mode="edge")
    rows = sum(w * p[i : i + x.shape[0]] for i, w in enumerate(k))
    return sum(w * rows[:, i : i + x.shape[1]] for i, w in enumerate(k))


def by_channel(f, a):
    return px.rounded(np.stack([f(a[:, :, c].astype(np.float64)) for c in range(3)], 2))


def sharpened(a):
    return by_channel(lambda x: x + 0.8 * (x - blurred(x, 1.0)), a)


def scaled(a, factor):
    return resized(a, *(max(1, -int(-n * factor // 1)) for n in a.shape[:2]))


# ---------------------------------------------------------------- tests


def image(h, w, kind="noise", seed=0):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (h, w, 3)) if kind == "noise" else np.zeros((h, w, 3), int) + rng.integers(0, 256, 3)
    return a.astype(np.uint8)


@pytest.mark.parametrize("size", [(1, 1), (1, 9), (7, 8), (8, 8), (15, 17), (33, 31), (64, 66), (97, 130), (300, 301), (460, 460)])
@pytest.mark.parametrize("kind", ["noise", "flat"])
def test_strips_give_the_pixels_of_the_whole(size, kind):
    a = image(*size, kind)
    small = scaled(a, 0.75)
    assert (px.scaled(a, 0.75) == small).all() and (px.resized(small, *size) == resized(small, *size)).all()
    assert (px.decimated_chroma(a) == decimated_chroma(a)).all()
    assert all((px.jpeg_round_trip(a, q) == jpeg_round_trip(a, q)).all() for q in (40, 85, 95))
    assert (px.VARIANTS["denoise"](a) == by_channel(lambda x: blurred(x, 0.6), a)).all()
    assert (px.VARIANTS["web_sim"](a) == jpeg_round_trip(sharpened(small), 85)).all()
    x = np.random.default_rng(1).normal(size=size)
    assert (px.blurred(x, 1.3) == blurred(x, 1.3)).all()


def test_edits_share_an_image_and_leave_it_as_it_is():
    a = image(350, 361)
    before, s = a.copy(), px.Shared(a)
    kinds = [*px.VARIANTS, "qhi", "qlo", "soft", "rweb"]
    made = [px.edit(s, k, 77, 0.83) for k in kinds]
    want = [px.VARIANTS[k](a) if k in px.VARIANTS else px.augmented(a, k, 77, 0.83) for k in kinds]
    assert all((m == w).all() for m, w in zip(made, want)) and (a == before).all()
    assert all((px.edit(s, k, 77, 0.83) == w).all() for k, w in zip(kinds, want))


def least(f, n=5):
    took = []
    for _ in range(n):
        start = time.process_time()
        f()
        took.append(time.process_time() - start)
    return min(took)


def test_augmenting_takes_less_than_half_of_the_dense_formulas_time():
    a = image(460, 460)
    dense = lambda: [jpeg_round_trip(a, 80), jpeg_round_trip(a, 50), jpeg_round_trip(resized(scaled(a, 0.7), 460, 460), 80), jpeg_round_trip(scaled(a, 0.8), 80)]

    def strips():
        s = px.Shared(a)
        return [px.edit(s, "qhi", 80, 0), px.edit(s, "qlo", 50, 0), px.edit(s, "soft", 80, 0.7), px.edit(s, "rweb", 80, 0.8)]

    assert all((x == y).all() for x, y in zip(strips(), dense()))
    assert least(strips) < least(dense) / 2


def test_variants_take_less_than_half_of_the_dense_formulas_time():
    a = image(460, 460)

    def dense():
        small = scaled(a, 0.75)
        web = jpeg_round_trip(sharpened(scaled(a, 0.75)), 85)
        return [a, small, jpeg_round_trip(a, 85), jpeg_round_trip(a, 60), by_channel(lambda x: blurred(x, 0.6), a), sharpened(a), web]

    def strips():
        s = px.Shared(a)
        return [px.edit(s, k, 0, 0) for k in px.VARIANTS]

    assert all((x == y).all() for x, y in zip(strips(), dense()))
    assert least(strips) < least(dense) / 2


def test_normalising_takes_less_than_half_of_the_dense_formulas_time():
    a = image(460, 460)
    dense = lambda: jpeg_round_trip(decimated_chroma(resized(px.centre_crop(a, 448), 320, 320)), 85)
    assert (px.normalised(a) == dense()).all()
    assert least(lambda: px.normalised(a)) < least(dense) / 2


def test_digests_and_decoded_images_are_those_of_pixels(spark):
    rows, decode = catalog_models.images_to_make(spark, SF, 300)
    kinds, few = ["control", "normalised", "qlo", "rweb"], F.col("path").rlike("_[12][0-9]?_")
    got = images.edited(rows.where(few), kinds, decode=decode, digest=True)
    want = images.edited(catalog_models.made_images(spark, SF, 300).where(few), kinds)
    columns = ["path", "label", "variant", "quality", "factor", "edit_status", "height", "width", "n_channels"]
    got = sorted(map(tuple, got.select(*columns, "digest").collect()), key=str)
    want = sorted(((*r[:-1], r.data and hashlib.md5(r.data).hexdigest()) for r in want.select(*columns, "data").collect()), key=str)
    assert got == want and len({r[5] for r in got}) == 2


def test_a_row_that_gives_no_pixels_is_skipped(spark):
    def decode(row):
        if row["n"] == 1:
            raise ValueError("no image")
        return np.full((20, 20, 3), row["n"], np.uint8)

    made = images.edited(spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int"), ["control", "sharpen"], decode=(("n",), decode), digest=True).collect()
    assert {(r.path, r.edit_status, r.digest is None) for r in made} == {("a", "error: no image", True), ("b", "DONE", False)} and len(made) == 4


@pytest.mark.parametrize("name", ["augment_variants", "edit_variants", "normalise_images"])
def test_pixels_stay_in_the_task_that_makes_them(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "data#" not in plan
