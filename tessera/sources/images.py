"""Image files as DataFrames: scans, pixels, container headers; and the extraction and normalisation jobs over them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions import tiles
from ..operators import names
from ..operators.splits import draw, uniform_int

#: The extensions of the container audit.
AUDIT_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


#: An image's own columns, and what gives pixels from other ones: (columns, function of a row with these).
PIXELS = ("height", "width", "n_channels", "data")
Decoder = tuple[tuple[str, ...], Callable[[dict], np.ndarray]]

#: Bytes of pixels or files that a task hands on at once, whatever its batches hold.
HANDED = 1 << 24


def frames(rows: Iterator[tuple], columns: list[str], held: str, most: int = HANDED) -> Iterator[pd.DataFrame]:
    """Rows as frames of some `most` bytes in column `held` each."""
    at, out, size = columns.index(held), [], 0
    for row in rows:
        out.append(row)
        size += len(row[at] or b"") + 64 * len(row)
        if size >= most:
            yield pd.DataFrame(out, columns=columns)
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns)


def scan(spark: SparkSession, folder: str, label: int | None = None, extensions=("jpg", "jpeg", "png")) -> DataFrame:
    """(path, size, modified, content, label) of a folder's own image files, whole; not of its subfolders'. Sort by path where order matters.

    Where only headers matter, trees.headers() reads no more than these.
    """
    files = _own(spark, "binaryFile", folder)
    files = files.where(names.extension_of(F.col("path")).isin(*extensions))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.lit(label).cast("int").alias("label"))


def _own(spark: SparkSession, kind: str, folder: str) -> DataFrame:
    """Files right in the folder, read as a kind of source. Those of subfolders are listed, but their path rules them out before they are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = spark.read.format(kind).option("recursiveFileLookup", "true").load(folder)
    if any(c in folder for c in "*?[{"):
        return files
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString().rstrip("/")
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.where(same(F.regexp_replace("_metadata.file_path", "/[^/]*$", "")) == same(F.lit(whole)))


def two_classes(spark: SparkSession, real: str, made: str) -> DataFrame:
    return scan(spark, real, 0).unionByName(scan(spark, made, 1))


def decoded(spark: SparkSession, folder: str, label: int | None = None) -> DataFrame:
    """(path, height, width, n_channels, data, label, error) from the JVM's reader; an unreadable file is a row with an error."""
    image = _own(spark, "image", folder).select("image.*")
    image = image.where(names.extension_of(F.col("origin")).isin("jpg", "jpeg", "png"))
    bad = F.col("height") < 0
    plain = image.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data", F.lit(label).cast("int").alias("label"), F.when(bad, "unreadable").alias("error"))
    # That reader keeps only the low bytes of 16-bit PNGs (byte 25 of the file is the depth): these are decoded here.
    deep = scan(spark, folder, label, ("png",)).where(F.substring("content", 25, 1) == F.lit(b"\x10"))
    paths = deep.select("path")
    deep = deep.select("path", "content", "label").mapInPandas(_deep_rows, "path string, height int, width int, n_channels int, data binary, label int, error string")
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    key = paths.select(same("path").alias("path_"))
    return plain.join(key, same("path") == F.col("path_"), "left_anti").unionByName(deep)


def _deep_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path, content, label in zip(b["path"], b["content"], b["label"], strict=True):
            try:
                a = px.rgb8(px.png16(content))
                out.append((path, a.shape[0], a.shape[1], 3, np.ascontiguousarray(a[:, :, ::-1]).tobytes(), label, None))
            except (ValueError, IndexError, zlib.error, UnboundLocalError) as e:
                out.append((path, -1, -1, -1, b"", label, f"unreadable: {e}"))
        yield pd.DataFrame(out, columns=["path", "height", "width", "n_channels", "data", "label", "error"]).astype({"label": "Int32"})


def digested(files: DataFrame) -> DataFrame:
    """files with the digest of their bytes, one of each."""
    return files.withColumn("digest", F.sha2("content", 256)).dropDuplicates(["digest"])


# ---------------------------------------------------------------- container headers


def _webp(kind: bytes, body: bytes) -> dict:
    """Size and mode of a WEBP's first chunk: lossy, lossless or extended."""
    number = lambda at, n: int.from_bytes(body[at : at + n], "little")
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        return {"format": "WEBP", "width": number(6, 2) & 0x3FFF, "height": number(8, 2) & 0x3FFF, "mode": "RGB"}
    if kind == b"VP8L" and body[:1] == b"\x2f":
        bits = number(1, 4)
        return {"format": "WEBP", "width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1, "mode": "RGBA" if bits >> 28 & 1 else "RGB"}
    if kind == b"VP8X":
        return {"format": "WEBP", "width": number(4, 3) + 1, "height": number(7, 3) + 1, "mode": "RGBA" if body[0] >> 4 & 1 else "RGB"}
    raise ValueError("unknown WEBP chunk")


def _tiff(data: bytes, order: str) -> dict:
    """Size and mode from a TIFF's first directory."""
    number = lambda at, n: int.from_bytes(data[at : at + n], order)
    at = number(4, 4)
    tags = {}
    for i in range(number(at, 2)):
        entry = at + 2 + 12 * i
        tags[number(entry, 2)] = number(entry + 8, 2 if number(entry + 2, 2) == 3 else 4)
    if 256 not in tags or 257 not in tags:
        raise ValueError("no size in the TIFF directory")
    parts = tags.get(277, 1)
    mode = "P" if tags.get(262) == 3 else {1: "L", 3: "RGB", 4: "CMYK" if tags.get(262) == 5 else "RGBA"}.get(parts, "?")
    return {"format": "TIFF", "width": tags[256], "height": tags[257], "mode": mode}


def probe_bytes(data: bytes) -> dict:
    """Format, size, quantisation tables and chroma sampling from a file's header; ValueError if it isn't one of the known kinds."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return {"format": "PNG", "width": int.from_bytes(data[16:20], "big"), "height": int.from_bytes(data[20:24], "big"), "mode": {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(data[25], "?")}
    if data[:2] == b"BM":
        return {"format": "BMP", "width": int.from_bytes(data[18:22], "little"), "height": abs(int.from_bytes(data[22:26], "little", signed=True)), "mode": "RGB"}
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data[12:16], data[20:])
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(data, "little" if data[:1] == b"I" else "big")
    if data[:2] != b"\xff\xd8":
        raise ValueError("unknown container")
    out: dict = {"format": "JPEG"}
    tables: dict[int, list[int]] = {}
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind in (0xD9, 0xDA):
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if kind == 0xDB:
            i = 0
            while i < len(body):
                wide, n = body[i] >> 4, body[i] & 15
                step = 2 if wide else 1
                raw = body[i + 1 : i + 1 + 64 * step]
                tables[n] = [int.from_bytes(raw[k : k + step], "big") for k in range(0, len(raw), step)]
                i += 1 + 64 * step
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            parts = body[5]
            out |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "mode": {1: "L", 3: "RGB", 4: "CMYK"}.get(parts, "?")}
            if parts == 3:
                h, v = body[7] >> 4, body[7] & 15
                out["subsampling"] = {(1, 1): "4:4:4", (2, 1): "4:2:2", (2, 2): "4:2:0"}.get((h, v), f"{h}x{v}")
        at += 2 + size
    if "width" not in out:
        raise ValueError("no frame header")
    flat = [v for n in sorted(tables) for v in tables[n]]
    if flat:
        out |= {"qhash": hashlib.md5(",".join(map(str, flat)).encode()).hexdigest()[:8], "q_dc": flat[0], "q_mean": sum(flat) / len(flat)}
    return out


_PROBE = "format string, width int, height int, mode string, qhash string, q_dc double, q_mean double, subsampling string, error string"
_PROBE_NAMES = [c.split()[0] for c in _PROBE.split(", ")]


def _probe_rows(rest: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for data in b["content"]:
                try:
                    found.append(probe_bytes(data or b""))
                except (ValueError, IndexError) as e:
                    found.append({"error": str(e) or type(e).__name__})
            wide = pd.DataFrame(found, columns=_PROBE_NAMES, index=b.index, dtype=object)
            yield pd.concat([b[rest], wide.where(wide.notna(), None)], axis=1)

    return run


def probes(files: DataFrame) -> DataFrame:
    """Container records: header fields of each file, and area, aspect, bytes a pixel, stem, source, extension, augmented."""
    rest = [c for c in files.columns if c != "content"]
    schema = files.select(*rest).schema.simpleString()[7:-1].replace(":", " ")
    rows = files.select(*rest, "content").mapInPandas(_probe_rows(rest), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.select(*rest).schema)}, {_PROBE}" if schema else _PROBE)
    stem = names.stem_of(F.col("path"))
    area = F.col("width") * F.col("height")
    return rows.withColumns({"stem": stem, "source": names.group_key(stem), "ext": names.extension_of(F.col("path")), "augmented": names.is_augmented(stem), "area": area, "aspect": F.col("width") / F.greatest("height", F.lit(1)), "bpp": F.try_divide("size", area)})


def png_files(made: DataFrame, target: str = "target") -> DataFrame:
    """(name, content): pixels of edited() as PNG files called <target>.png, for trees.write_tree(). Rows without pixels are left out."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for name, h, w, n, data in zip(b["name"], b["height"], b["width"], b["n_channels"], b["data"], strict=True):
                yield f"{name}.png", px.png8(px.rgb8(px.from_spark_image(bytes(data), int(h), int(w), int(n))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(files(batches), ["name", "content"], "content")

    rows = made.where(F.col("data").isNotNull()).select(F.col(target).alias("name"), "height", "width", "n_channels", "data")
    return rows.mapInPandas(run, "name string, content binary")


# ---------------------------------------------------------------- measuring


def _measures(rest: list[str], mode: str, normalise: bool, columns: tuple[str, ...], pixels: Callable[[dict], np.ndarray]):
    """f and status of each image: its tiles are summed up one by one in the task that has read it, so none is sent anywhere."""

    def one(row: dict) -> tuple[list[float] | None, str]:
        try:
            image = pixels(row)
            image = px.normalised(image) if normalise else image
            if image is None:
                return None, "TOOSMALL"
            sums = np.zeros(tiles.LENGTH)
            for tile in tiles.tiles_of(image, mode):
                sums += tiles.partial_sums(tile)
            return tiles.features_of(sums).tolist(), "DONE"
        except (ValueError, TypeError, IndexError) as e:
            return None, f"error: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one({c: b.column(c)[i].as_py() for c in columns}) for i in range(len(b))]
            f, status = pa.array([x[0] for x in found], pa.list_(pa.float64())), pa.array([x[1] for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), f, status], [*rest, "f", "status"])

    return run


def measured(images: DataFrame, mode: str = "crop", normalise: bool = False, decode: Decoder | None = None) -> DataFrame:
    """images with f (230 values, null if there is no answer) and status.

    An image becomes bounded tiles of its pixels, bands and spectrum, these become partial sums, and f follows from their sum. All of it stays in the image's
    own task: nothing is shuffled. Filter rows before this: no predicate moves below it. decode: as in edited().
    """
    columns, pixels = decode or (PIXELS, _pixels)
    rest = [c for c in images.columns if c not in (*PIXELS, *columns, "f", "status")]
    kept = images.select(*rest, *columns)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*rest).schema]
    return kept.mapInArrow(_measures(rest, mode, normalise, columns, pixels), ", ".join([*fields, "f array<double>, status string"]))


def _pixels(row: dict) -> np.ndarray:
    return px.from_spark_image(row["data"], int(row["height"]), int(row["width"]), int(row["n_channels"]))


def _edited(rest: list[str], kinds: list[str], pixels: Callable[[dict], np.ndarray], digest: bool):
    """Rows of all edits of an image, which goes to the task once, and whose edits share what they start from."""
    held = "digest" if digest else "data"
    columns = [*rest, "variant", "quality", "factor", "edit_status", "height", "width", "n_channels", held]

    def one(row: dict, image: px.Shared | Exception, kind: str, quality: int, factor: float) -> tuple:
        made, status = None, "DONE"
        try:
            if isinstance(image, Exception):
                raise image
            made = px.edit(image, kind, quality, factor)
            status = "TOOSMALL" if made is None else status
        except (ValueError, TypeError, IndexError) as e:
            status = f"error: {e}"
        found = (None, None, None, None)
        if made is not None:
            data = px.to_spark_image(made)
            found = (*made.shape[:2], 3, hashlib.md5(data).hexdigest() if digest else data)
        return (*(row[c] for c in rest), kind, quality, factor, status, *found)

    def edits(row: dict) -> Iterator[tuple]:
        try:
            image = px.Shared(pixels(row))
        except (ValueError, TypeError, IndexError) as e:
            image = e
        return (one(row, image, kind, int(q), float(f)) for kind, q, f in zip(kinds, row["qualities_"], row["factors_"], strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = (found for b in batches for row in b.to_dict("records") for found in edits(row))
        for frame in frames(made, columns, held):
            yield frame.astype({"height": "Int32", "width": "Int32", "n_channels": "Int32"})

    return run


def edited(images: DataFrame, kinds: list[str], key: str = "path", seed: int = 42, decode: Decoder | None = None, digest: bool = False) -> DataFrame:
    """A row for each image and kind of edit: variant, and the edited pixels, null where edit_status isn't DONE:
    TOOSMALL for the edit, or an error, which skips the image and no other.

    kinds: `normalised`, those of pixels.VARIANTS, or the augmentations qhi, qlo, soft, rweb, whose
    quality and factor are drawn from a hash of the key and the kind. A task holds a batch of images and some edits, not all of a batch's.

    decode: (columns, function of a row with these that gives its pixels), where images don't hold pixels; they are decoded in the task that edits them.
    digest: the edited pixels' md5 instead of them, so that they don't leave their task.
    """
    at = {k: F.concat_ws("|", F.col(key).cast("string"), F.lit(k)) for k in kinds}
    qualities = F.array(*(uniform_int(x, *((40, 70) if k == "qlo" else (70, 95)), seed) for k, x in at.items()))
    factors = F.array(*(0.6 + 0.3 * draw(x, seed + 1) for x in at.values()))
    columns, pixels = decode or (PIXELS, _pixels)
    rest = [c for c in images.columns if c not in (*PIXELS, *columns, "variant", "quality", "factor")]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*rest).schema), "variant string, quality int, factor double"])
    rows = images.select(*rest, *columns, qualities.alias("qualities_"), factors.alias("factors_"))
    return rows.mapInPandas(_edited(rest, list(at), pixels, digest), f"{fields}, edit_status string, height int, width int, n_channels int, {'digest string' if digest else 'data binary'}")


def edit_counts(made: DataFrame) -> DataFrame:
    """(variant, written, too_small, skipped) of edited()."""
    is_ = lambda c: F.count_if(c)
    return made.groupBy("variant").agg(is_(F.col("edit_status") == "DONE").alias("written"), is_(F.col("edit_status") == "TOOSMALL").alias("too_small"), is_(F.startswith(F.col("edit_status"), F.lit("error"))).alias("skipped"))


def large_enough(images: DataFrame, side: int = px.CROP) -> DataFrame:
    return images.where(F.least("height", "width") >= side)


def answered(images: DataFrame, values: list[str], side: int = px.CROP) -> DataFrame:
    """images with status: below the floor an image has no answer (TOOSMALL), and its values are null; that isn't an error."""
    fine = F.least("height", "width") >= side
    return images.withColumns({"status": F.when(fine, "DONE").otherwise("TOOSMALL"), **{v: F.when(fine, F.col(v)) for v in values}})


def variant_eligible(images: DataFrame, short: int = 350) -> DataFrame:
    return images.where(F.least("height", "width") >= short)


def already_normalised(files: DataFrame, side: int = px.SIDE, n: int = 8) -> DataFrame:
    """(normalised): whether the first n files by path all have the normalised size."""
    return files.orderBy("path").limit(n).agg(F.bool_and((F.col("width") == side) & (F.col("height") == side)).alias("normalised"))


def run_counters(rows: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Counts of each outcome and class, and their total (label null): written, existed, too small, augmented, failed."""
    of = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return rows.rollup(*by).agg(*(of(s) for s in ("written", "existed", "skipped_small", "skipped_augmented", "failed")))
