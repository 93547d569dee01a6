"""Folder scans by header and trees of files: one level, few bytes, nothing half written, runs that go on where others stopped."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import pixels as px
from tessera.plans import folders
from tessera.sources import images, trees
from tests.test_pixels import png


def jpeg(comment: int, size: int) -> bytes:
    """A JPEG header with comments before the frame, and a long body."""
    segment = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    head = b"\xff\xd8" + b"".join(segment(0xFE, b"c" * 60_000) for _ in range(comment // 60_000)) + segment(0xFE, b"c" * (comment % 60_000))
    head += segment(0xDB, b"\0" + bytes(range(1, 65))) + segment(0xC0, b"\x08" + (48).to_bytes(2, "big") + (64).to_bytes(2, "big") + b"\x03\x01\x22\0\x02\x11\0\x03\x11\0")
    head += segment(0xDB, b"\x01" + bytes(range(2, 66))) + segment(0xDA, b"\x01\x01\0\0\x3f\0")
    return head + b"x" * (size - len(head))


def tiff(at: int) -> bytes:
    tags = b"".join(t.to_bytes(2, "little") + (4).to_bytes(2, "little") + (1).to_bytes(4, "little") + v.to_bytes(4, "little") for t, v in ((256, 70), (257, 50), (277, 3)))
    return b"II*\0" + at.to_bytes(4, "little") + b"p" * (at - 8) + (3).to_bytes(2, "little") + tags + b"z" * 5000


@pytest.fixture
def nested(tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(10, 500_000))
    (tmp_path / "long.JPG").write_bytes(jpeg(150_000, 400_000))
    (tmp_path / "t.tif").write_bytes(tiff(9000))
    (tmp_path / "p.png").write_bytes(png(np.zeros((30, 40, 3), int)))
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("x")
    for sub in ("deeper", "gen=1"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "b.jpg").write_bytes(jpeg(10, 1000))
    return tmp_path


KINDS = images.AUDIT_EXTENSIONS


@pytest.mark.parametrize("files", [1, 1000])
def test_header_scan(spark, nested, files):
    rows = trees.headers(spark, str(nested), 1, KINDS, files)
    got = {r.path.rsplit("/", 1)[1]: r for r in rows.withColumn("read", F.octet_length("content")).collect()}
    assert set(got) == {"a.jpg", "long.JPG", "t.tif", "p.png", "broken.jpg", "empty.png"}
    assert got["a.jpg"].read == 1024 and got["a.jpg"].size == 500_000 and got["a.jpg"].label == 1
    assert 150_000 < got["long.JPG"].read < 310_000 and got["t.tif"].read < 19_000 and got["empty.png"].read == 0
    assert all(r.path.startswith("file:") and r.modified is not None for r in got.values())
    whole = {r.stem: r for r in images.probes(images.scan(spark, str(nested), 1, KINDS)).collect()}
    probed = {r.stem: r for r in images.probes(rows).collect()}
    fields = ("format", "width", "height", "mode", "qhash", "q_dc", "q_mean", "subsampling", "error", "size", "bpp", "label")
    assert {*whole, "empty"} == set(probed) and all(probed[k][f] == whole[k][f] for k in whole for f in fields)
    assert probed["long"].width == 64 and probed["t"].height == 50 and probed["broken"].error and probed["empty"].error


def test_scans_read_one_level(spark, nested):
    assert {r.path.rsplit("/", 1)[1] for r in images.scan(spark, str(nested)).collect()} == {"a.jpg", "long.JPG", "p.png", "broken.jpg"}  # Spark passes over empty files
    assert "b.jpg" not in {r.path.rsplit("/", 1)[1] for r in images.decoded(spark, str(nested)).collect()}
    (nested / "none").mkdir()
    assert trees.headers(spark, str(nested / "none")).count() == 0


def test_trees_come_back_whole(spark, tmp_path):
    folder = str(tmp_path / "tree")
    rows = spark.createDataFrame([(f"f{i}.bin", bytes([i]) * (i * 1000)) for i in range(40)], "name string, content binary").repartition(4)
    assert trees.in_tree(spark, folder).count() == 0
    trees.write_tree(rows, folder)
    trees.write_tree(rows.where("name = 'f3.bin'").withColumn("content", F.lit(bytearray(b"new"))), folder)
    assert sorted(os.listdir(folder)) == sorted(["_manifest", *(f"f{i}.bin" for i in range(40))])
    assert all(open(f"{folder}/f{i}.bin", "rb").read() == (bytes([i]) * (i * 1000) if i != 3 else b"new") for i in range(40))
    done = {r.target: r for r in trees.in_tree(spark, folder).collect()}
    assert len(done) == 40 and done["f7"].size == 7000
    trees.write_tree(rows.limit(0), str(tmp_path / "nothing"))
    assert trees.in_tree(spark, str(tmp_path / "nothing")).count() == 0


def test_a_failed_job_leaves_no_half_file_and_no_manifest(spark, tmp_path):
    folder = str(tmp_path / "tree")
    first = spark.createDataFrame([("ok.bin", b"1" * 5000)], "name string, content binary")
    trees.write_tree(first, folder)

    def dies(batches):
        for b in batches:
            yield b
            raise RuntimeError("killed")

    rows = spark.range(30, numPartitions=3).selectExpr("concat('g', id, '.bin') AS name", "cast(repeat('y', 2000) AS binary) AS content")
    with pytest.raises(Exception, match="killed"):
        trees.write_tree(rows.mapInPandas(dies, "name string, content binary"), folder)
    assert [r.name for r in trees.in_tree(spark, folder).collect()] == ["ok.bin"] and "_staged" not in os.listdir(folder)
    assert all(os.path.getsize(f"{folder}/{f}") == 2000 for f in os.listdir(folder) if f.startswith("g"))
    with pytest.raises(Exception, match="plain file name"):
        trees.write_tree(first.withColumn("name", F.lit("../x")), folder)
    trees.write_tree(rows, folder)
    assert trees.in_tree(spark, folder).count() == 31


def test_normalised_and_augmented_trees(spark, tmp_path):
    rng = np.random.default_rng(1)
    at = tmp_path / "in"
    at.mkdir()
    for i in range(3):
        (at / f"x_gen_{i}.png").write_bytes(png(rng.integers(0, 256, (450 + i, 460, 3))))
    pixels = images.decoded(spark, str(at), 1)
    out = str(tmp_path / "out")
    counters = folders.write_normalised(spark, pixels.where("path not like '%_2.png'"), out)
    assert counters.where("label is null").first().written == 2
    counters = folders.write_normalised(spark, pixels, out).where("label is null").first()
    assert (counters.existed, counters.written) == (2, 1)
    back = images.decoded(spark, out)
    assert sorted((r.height, r.width) for r in back.collect()) == [(320, 320)] * 3
    made = {r.target: bytes(r.data) for r in folders.normalise_folder(pixels)[0].collect()}
    assert {r.path.rsplit("/", 1)[1][:-4]: bytes(r.data) for r in back.collect()} == made
    more = str(tmp_path / "more")
    folders.write_augmented(spark, pixels.where("path like '%_0.png'"), more, kinds=("qhi", "soft"))
    assert sorted(r.target for r in trees.in_tree(spark, more).collect()) == ["x_gen_0_qhi", "x_gen_0_soft"]
    stamp = os.path.getmtime(f"{more}/x_gen_0_qhi.png")
    folders.write_augmented(spark, pixels.where("path like '%_0.png'"), more, kinds=("qhi", "qlo", "soft"))
    assert trees.in_tree(spark, more).count() == 3 and os.path.getmtime(f"{more}/x_gen_0_qhi.png") == stamp


def test_png8_round_trip():
    gray = np.arange(60).reshape(6, 10)
    for a in (gray, np.stack([gray, gray + 90, 255 - gray], axis=2)):
        head = px.png8(a)
        assert head[:8] == b"\x89PNG\r\n\x1a\n" and images.probe_bytes(head)["width"] == 10
