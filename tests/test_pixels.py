"""Whole-image numerics and headers against hand fixtures and identities."""

import itertools
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import features as feat
from tessera.functions import pixels as px
from tessera.functions import planes as pl
from tessera.operators import metrics, models, names, splits
from tessera.schema import WIDTH, names as feature_names, problems, validated
from tessera.sources import images, tables


def test_constant_plane():
    x = np.full((256, 256), 7.0)
    assert feat.base_stats(x) == [7, 0, 0, 49, 0, 0, 0]
    assert feat.gradients(x) == [0] * 6 and feat.texture(x)[1] == 0
    assert np.allclose(feat.residual_stats(x), 0)


def test_two_values():
    x = np.array([[0.0, 1.0]] * 8)
    s = feat.base_stats(x)
    assert abs(s[4] - 1) < 1e-12 and abs(s[5]) < 1e-12 and abs(s[6] - 1) < 1e-12


def test_checkerboard_texture():
    x = np.indices((8, 8)).sum(0) % 2 * 255.0
    assert np.allclose(feat.texture(x), [49, -1, 0.5, 1 / 8])


def test_wavelet_is_orthogonal_inside_and_rings_hold_a_cosine():
    lo, hi = (np.array(pl.wavelet_matrix(256, h)) for h in (False, True))
    inner = slice(8, 120)
    assert np.allclose((lo @ lo.T)[inner, inner], np.eye(112), atol=1e-10)
    assert np.allclose((lo @ hi.T)[inner, inner], 0, atol=1e-10)
    assert len(lo) == 131 and len(pl.wavelet_matrix(131, True)) == 69
    y = 100 + 50 * np.cos(2 * np.pi * 40 * np.arange(256) / 256)[None, :].repeat(256, 0)
    rings = feat.radial_spectrum(y)
    assert sum(r > 1e-6 for r in rings) == 2


def test_vector_width_and_luminance():
    rng = np.random.default_rng(0)
    v = feat.vector(rng.integers(0, 256, (300, 280, 3)).astype(np.uint8))
    assert v.shape == (WIDTH,) == (len(feature_names()),) and np.isfinite(v).all()
    assert feature_names()[94][2] == "wavelet cD1 std (red)"
    red = np.zeros((1, 1, 3))
    red[..., 0] = 255
    assert feat.luminance(red)[0, 0] == 76


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**32 - 1), st.floats(-50, 50))
def test_adding_a_constant(seed, c):
    x = np.random.default_rng(seed).normal(100, 20, (16, 16))
    assert np.allclose(feat.gradients(x), feat.gradients(x + c), atol=1e-6)
    assert np.allclose(feat.residual_stats(x), feat.residual_stats(x + c), atol=1e-6)


def test_crop_origins(spark):
    n = [256, 257, 270, 272, 500]
    rows = spark.createDataFrame([(v,) for v in n], "n int").select(pl.crop_origin(F.col("n"), 256).alias("o")).collect()
    assert [r.o for r in rows] == [0, 0, 0, 8, 120]
    a = np.arange(500 * 500).reshape(500, 500)
    assert px.centre_crop(a, 256)[0, 0] == 120 * 500 + 120


def test_array_features_are_those_of_numpy(spark):
    rng = np.random.default_rng(5)
    planes = [rng.normal(0, 1, (8, 8)) for _ in range(4)] + [np.full((8, 8), 2.0)]
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(planes)], "i int, a array<double>")
    a = F.col("a")
    bands = pl.wavelet_bands(a, 8)
    got = df.select("i", *(c.alias(n) for n, c in pl.base_stats(a).items()), pl.stencil(a, 8, 8, pl.SOBEL_X).alias("gx"), pl.median3(a, 8, 8).alias("med"), pl.stencil(a, 8, 8, pl.gaussian_kernel()).alias("gauss"), pl.dft_magnitudes(a, 8).alias("mag"), *(c.alias(f"w{n}") for n, c in bands.items())).orderBy("i").collect()
    for r, x in zip(got, planes):
        assert np.allclose([r[n] for n in ("mean", "std", "variance", "energy", "entropy", "skewness", "kurtosis")], feat.base_stats(x), atol=1e-9)
        assert np.allclose(r.med, feat.median3(x).ravel()) and np.allclose(r.gauss, px.blurred(x, 1.0).ravel())
        assert np.allclose(r.mag, np.abs(np.fft.fft2(x)).ravel())
        for name, w in zip(("cA", "cH", "cV", "cD"), feat.wavelet(x)):
            assert np.allclose(r[f"w{name}"], w.ravel())


def test_resample_and_round_trip():
    flat = np.full((64, 48, 3), 77, np.uint8)
    assert (px.resized(flat, 20, 90) == 77).all() and (px.jpeg_round_trip(flat, 85) == 77).all()
    assert px.quantisation(50, False)[0, 0] == 16 and px.quantisation(100, False).max() == 1
    rng = np.random.default_rng(1)
    a = px.rounded(px.resized(rng.integers(0, 256, (12, 12, 3)).astype(np.uint8), 96, 96).astype(float))
    errors = [np.abs(px.jpeg_round_trip(a, q).astype(int) - a).mean() for q in (95, 60, 20)]
    assert errors == sorted(errors)
    assert px.normalised(np.zeros((447, 600, 3), np.uint8)) is None
    assert px.normalised(np.zeros((448, 600), np.uint8)).shape == (320, 320, 3)
    with pytest.raises(ValueError):
        px.check_sizes(450, 320)


def jpeg(width, height, sampling, tables):
    out = b"\xff\xd8"
    for n, t in enumerate(tables):
        out += b"\xff\xdb" + struct.pack(">H", 67) + bytes([n]) + bytes(t)
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes([1, sampling, 0, 2, 0x11, 1, 3, 0x11, 1]) + b"\xff\xd9"


def test_header_probe():
    a = images.probe_bytes(jpeg(320, 200, 0x22, [[16] * 64, [17] * 64]))
    assert (a["width"], a["height"], a["subsampling"], a["q_dc"], a["q_mean"]) == (320, 200, "4:2:0", 16, 16.5) and len(a["qhash"]) == 8
    assert images.probe_bytes(jpeg(1, 2, 0x11, [[1] * 64]))["subsampling"] == "4:4:4"
    with pytest.raises(ValueError):
        images.probe_bytes(b"GIF89a")


def png(pixels, depth=8):
    h, w = pixels.shape[:2]
    c = pixels.shape[2] if pixels.ndim == 3 else 1
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + pixels[r].astype(">u2" if depth == 16 else "u1").tobytes() for r in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_files_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(2)
    for i, side in enumerate((460, 300, 460)):
        (tmp_path / f"img_gen_{i}{'_qhi' if i == 2 else ''}.png").write_bytes(png(rng.integers(0, 256, (side, side, 3))))
    (tmp_path / "bad.jpg").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_text("x")
    files = images.scan(spark, str(tmp_path), 1)
    assert files.count() == 4
    probed = {r.stem: r for r in images.probes(files).collect()}
    assert probed["bad"].error and probed["img_gen_0"].width == 460 and probed["img_gen_2_qhi"].augmented and probed["img_gen_2_qhi"].source == "img_gen_2"
    pixels = images.decoded(spark, str(tmp_path), 1)
    assert pixels.where("error is not null").count() == 1
    got = images.measured(pixels.where("error is null"), normalise=True).collect()
    assert sorted(r.status for r in got) == ["DONE", "DONE", "TOOSMALL"] and all(len(r.f) == WIDTH for r in got if r.f)
    kinds = {(r.variant, r.data is None) for r in images.edited(images.variant_eligible(pixels), ["control", "rweb"]).collect()}
    assert ("control", False) in kinds


def test_png16():
    a = (np.arange(24).reshape(4, 6) * 2500).astype(np.uint16)
    assert (px.png16(png(a, 16))[:, :, 0] == a).all()
    assert px.rgb8(np.full((1, 1), 65535, np.uint16)).max() == 255


def test_features_in_and_out(spark, tmp_path):
    rows = [([float(i + j) for j in range(WIDTH)], i % 2) for i in range(5)]
    df = spark.createDataFrame(rows, "f array<double>, label int")
    tables.write_features(df, str(tmp_path / "csv"), csv=True)
    back = tables.read_features(spark, str(tmp_path / "csv"), labelled=True)
    assert sorted(map(tuple, (r.f for r in back.collect()))) == sorted(map(tuple, (r[0] for r in rows)))
    assert tables.read_features(spark, str(tmp_path / "csv"), labelled=False).where("label is null").count() == 5
    assert validated(df).count() == 5
    with pytest.raises(ValueError):
        validated(spark.createDataFrame([([1.0], 3)], "f array<double>, label int"))
    assert problems(df).first()["n"] == 5
    for n in (5, 3):
        (tmp_path / f"names{n}.txt").write_text("".join(f"p{i}\n" for i in range(n)))
    placed = tables.read_features(spark, str(tmp_path / "csv"), labelled=True, place=True)
    assert tables.joined_by_position(placed, tables.read_names(spark, str(tmp_path / "names5.txt"), place=True)).where("path is not null").count() == 5
    assert tables.joined_by_position(placed, tables.read_names(spark, str(tmp_path / "names3.txt"), place=True)).where("path is null").count() == 5


def test_names(spark):
    rows = spark.createDataFrame([("d\\IMG_a.jpg", 1), ("IMG_a_qhi.jpg", 1), ("img_b_QLO.png", 0), ("x_midjourney_3_soft.jpg", 1), ("plain.png", 1)], "path string, label int")
    stem = names.stem_of(F.col("path"))
    got = rows.select(names.group_key(stem).alias("k"), names.generator(stem, F.col("label")).alias("g")).collect()
    assert [r.k for r in got] == ["IMG_a", "IMG_a", "img_b", "x_midjourney_3", "plain"]
    assert [r.g for r in got] == ["a", "a", "real", "midjourney", "unknown"]


def test_rank_metrics(spark):
    rows = spark.createDataFrame([(0.2, 0), (0.5, 0), (0.5, 1), (0.8, 1)], "p double, y int")
    assert metrics.roc_auc(rows).first()["auc"] == 0.875
    assert metrics.roc_auc(rows.where("y = 1")).first()["auc"] is None
    edges = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (1.0,)], "p double").select(metrics.right_closed_bin(F.col("p"), 10).alias("b"))
    assert [r.b for r in edges.collect()] == [1, 1, 2, 10]
    s = spark.createDataFrame([(0.81,), (0.79,), (0.63,), (0.62,)], "p double").select(metrics.strength(F.col("p"), 0.5).alias("s"))
    assert [r.s for r in s.collect()] == ["strong", "moderate", "moderate", "weak"]


def test_splits(spark):
    rows = spark.range(4000).select((F.col("id") % 900).cast("string").alias("g"), (F.col("id") % 2).alias("label"))
    parts = splits.split_3way(rows, "g")
    assert splits.leaks(parts, "g").first()["leaking"] == 0
    share = {r.part: r.n / 4000 for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert abs(share["test"] - 0.2) < 0.05
    assert splits.kfold_count(0.4) == 2 and splits.cut_size(5, 0.5) == 2 and splits.cut_size(1, 0.1) == 1


def test_tree_values_are_exact_shapley_values():
    rng = np.random.default_rng(3)

    def grow(depth, cover):
        at = len(nodes)
        nodes.append(())
        if depth == 0:
            nodes[at] = (-1, 0.0, -1, -1, float(rng.normal()), cover)
        else:
            share = rng.uniform(0.2, 0.8)
            f, t = int(rng.integers(4)), float(rng.normal())
            nodes[at] = (f, t, grow(depth - 1, cover * share), grow(depth - 1, cover * (1 - share)), 0.0, cover)
        return at

    def value(known, x, at=0):
        f, t, left, right, v, cover = nodes[at]
        if f < 0:
            return v
        if f in known:
            return value(known, x, left if x[f] <= t else right)
        return sum(nodes[c][5] / cover * value(known, x, c) for c in (left, right))

    for _ in range(5):
        nodes = []
        grow(4, 100.0)
        x = rng.normal(size=4)
        base, phi = models.tree_values(nodes, np.stack([x, -x]))
        phi = phi[0]
        want = np.zeros(4)
        for order in itertools.permutations(range(4)):
            known = set()
            for f in order:
                before = value(known, x)
                known.add(f)
                want[f] += (value(known, x) - before) / 24
        assert abs(base - value(set(), x)) < 1e-9 and np.allclose(phi, want)


def test_web_sim_sharpens_before_it_compresses():
    a = np.random.default_rng(4).integers(0, 256, (360, 400, 3)).astype(np.uint8)
    want = px.jpeg_round_trip(px.sharpened(px.scaled(a, 0.75)), 85)
    assert (px.VARIANTS["web_sim"](a) == want).all()


def test_a_bad_image_is_skipped(spark):
    good = np.zeros((300, 300, 3), np.uint8).tobytes()
    rows = spark.createDataFrame([("a", 300, 300, 3, good), ("b", 300, 300, 3, b"short")], "path string, height int, width int, n_channels int, data binary")
    made = images.edited(rows, ["control", "normalised"])
    got = {(r.path, r.variant): r.edit_status for r in made.collect()}
    assert got["a", "control"] == "DONE" and got["a", "normalised"] == "TOOSMALL" and got["b", "control"].startswith("error")
    assert {(r.variant, r.written, r.too_small, r.skipped) for r in images.edit_counts(made).collect()} == {("control", 1, 0, 1), ("normalised", 0, 1, 1)}


def test_deep_pngs_keep_their_high_bytes(spark, tmp_path):
    deep = (np.arange(24).reshape(4, 6) * 2500).astype(np.uint16)
    (tmp_path / "deep.png").write_bytes(png(deep, 16))
    (tmp_path / "flat.png").write_bytes(png(np.arange(24).reshape(4, 6).astype(np.uint8), 8))
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.decoded(spark, str(tmp_path), 1).collect()}
    assert set(rows) == {"deep.png", "flat.png"} and rows["deep.png"].label == 1
    got = px.from_spark_image(bytes(rows["deep.png"].data), 4, 6, 3)
    assert (got == px.rgb8(deep)).all()


def test_tiff_and_webp_headers():
    entry = lambda tag, value: (tag).to_bytes(2, "little") + (3).to_bytes(2, "little") + (1).to_bytes(4, "little") + (value).to_bytes(4, "little")
    tiff = b"II*\0" + (8).to_bytes(4, "little") + (4).to_bytes(2, "little") + entry(256, 640) + entry(257, 480) + entry(262, 2) + entry(277, 3)
    assert images.probe_bytes(tiff) == {"format": "TIFF", "width": 640, "height": 480, "mode": "RGB"}
    vp8 = b"\0\0\0\x9d\x01\x2a" + (300).to_bytes(2, "little") + (200).to_bytes(2, "little")
    riff = lambda kind, body: b"RIFF" + bytes(4) + b"WEBP" + kind + len(body).to_bytes(4, "little") + body
    assert images.probe_bytes(riff(b"VP8 ", vp8)) == {"format": "WEBP", "width": 300, "height": 200, "mode": "RGB"}
    lossless = b"\x2f" + (299 | 199 << 14 | 1 << 28).to_bytes(4, "little")
    assert images.probe_bytes(riff(b"VP8L", lossless)) == {"format": "WEBP", "width": 300, "height": 200, "mode": "RGBA"}
    extended = bytes([0x10, 0, 0, 0]) + (299).to_bytes(3, "little") + (199).to_bytes(3, "little")
    assert images.probe_bytes(riff(b"VP8X", extended)) == {"format": "WEBP", "width": 300, "height": 200, "mode": "RGBA"}
