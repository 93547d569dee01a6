"""Folders of files as data sources: a header scan that reads only the bytes it needs, and a sink that writes whole files or none.

`file_headers` lists one level of a folder on the driver, as Spark does, and deals its files out in runs; a task reads a file's
first KB and goes on only while its header does. `file_tree` writes rows (name, content) as files: a task writes each file
under a hidden name and renames it, so there are no half files, and notes it in a manifest of its own; the job's commit makes the manifests
count. A name that is no plain file name is an error. A job that fails leaves whole files at most, which no manifest names and the next job writes again.

Any file system that pyarrow reaches by a URI will do (local, HDFS, S3, GCS); executors must reach it too.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FIRST = 1024
HIDDEN, MANIFEST = "_staged", "_manifest"


def file_system(uri: str):
    """(file system, path in it, what goes before the path in a URI)."""
    from pyarrow import fs

    local = "://" not in uri and not uri.startswith("file:")
    if local or uri.startswith("file:"):
        path = "/" + uri.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), path.rstrip("/") or "/", "file:"
    found, path = fs.FileSystem.from_uri(uri)
    return found, path.rstrip("/"), uri[: len(uri.rstrip("/")) - len(path.rstrip("/"))]


def header_size(data: bytes) -> int:
    """How many bytes a file's header takes, as far as `data` tells: more than there are if it goes on behind them."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data):
            kind = data[at + 1]
            if data[at] != 0xFF or kind == 0xFF:
                at += 1
            elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
                at += 2
            elif kind in (0xD9, 0xDA):
                return at + 2
            else:
                at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return at + 4
    if data[:4] in (b"II*\0", b"MM\0*") and len(data) >= 8:
        order = "little" if data[:1] == b"I" else "big"
        at = int.from_bytes(data[4:8], order)
        return at + 2 + 12 * int.from_bytes(data[at : at + 2], order) if at + 2 <= len(data) else at + 2
    return 0


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int, float]]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.run = options["path"], int(options.get("files", "1000"))
        self.kinds = tuple(k for k in options.get("extensions", "").lower().split(",") if k)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        found, path, _ = file_system(self.folder)
        listed = [x for x in found.get_file_info(fs.FileSelector(path, recursive=False)) if x.type == fs.FileType.File]
        rows = sorted((x.path, x.size, x.mtime.timestamp()) for x in listed if not self.kinds or x.extension.lower() in self.kinds)
        return [Files(rows[i : i + self.run]) for i in range(0, len(rows), self.run)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        import datetime

        found, _, prefix = file_system(self.folder)
        for path, size, modified in partition.names:
            with found.open_input_file(path) as f:
                data = f.read(FIRST)
                while (need := header_size(data)) > len(data) and len(data) < size:
                    data += f.read(max(need - len(data), len(data)))
            yield prefix + path, size, datetime.datetime.fromtimestamp(modified, datetime.timezone.utc), data


class HeaderSource(DataSource):
    """spark.read.format("file_headers").option("extensions", "jpg,png").load(folder): path, size, modified, content (the header)."""

    @classmethod
    def name(cls) -> str:
        return "file_headers"

    def schema(self) -> str:
        return "path string, size long, modified timestamp, content binary"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    manifest: str | None
    left: list[str] = field(default_factory=list)


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.job = options["path"], uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        found, path, _ = file_system(self.folder)
        task = TaskContext.get()
        own = f"{path}/{HIDDEN}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        found.create_dir(own, recursive=True)
        manifest, any_row = f"{own}.json", False
        with found.open_output_stream(manifest) as notes:
            for row in rows:
                name, content, any_row = row["name"], bytes(row["content"]), True
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"{name!r} is no plain file name")
                with found.open_output_stream(f"{own}/{name}") as f:
                    f.write(content)
                notes.write((json.dumps({"name": name, "size": len(content), "md5": hashlib.md5(content).hexdigest()}) + "\n").encode())
        if not any_row:
            return Written(None)
        with found.open_input_stream(manifest) as notes:
            for note in map(json.loads, io.TextIOWrapper(notes, "utf-8")):
                found.move(f"{own}/{note['name']}", f"{path}/{note['name']}")
        return Written(manifest)

    def commit(self, messages: list[Written | None]) -> None:
        """A rename a task."""
        found, path, _ = file_system(self.folder)
        found.create_dir(f"{path}/{MANIFEST}", recursive=True)
        for i, m in enumerate(m for m in messages if m and m.manifest):
            found.move(m.manifest, f"{path}/{MANIFEST}/{self.job}-{i:05d}.json")
        self._clear(found, path)

    def abort(self, messages: list[Written | None]) -> None:
        found, path, _ = file_system(self.folder)
        self._clear(found, path)

    def _clear(self, found, path: str) -> None:
        from pyarrow import fs

        for d in (f"{path}/{HIDDEN}/{self.job}", f"{path}/{HIDDEN}"):
            if found.get_file_info(d).type == fs.FileType.Directory and (d.endswith(self.job) or not found.get_file_info(fs.FileSelector(d))):
                found.delete_dir(d)


class TreeSink(DataSource):
    """df.write.format("file_tree").mode("append").save(folder), df: (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if overwrite:
            raise ValueError("a tree is only ever added to: use mode append")
        return TreeWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(HeaderSource)
    spark.dataSource.register(TreeSink)
    return spark


def headers(spark: SparkSession, folder: str, label: int | None = None, extensions: tuple[str, ...] = ("jpg", "jpeg", "png"), files: int = 1000) -> DataFrame:
    """(path, size, modified, content, label) like images.scan(), but content ends with the header. files: how many a task reads."""
    rows = registered(spark).read.format("file_headers").option("extensions", ",".join(extensions)).option("files", str(files)).load(folder)
    return rows.withColumn("label", F.lit(label).cast("int"))


def write_tree(rows: DataFrame, folder: str) -> None:
    """Rows (name, content) as files, beside those that are there; one with the same name is replaced."""
    registered(rows.sparkSession)
    rows.select("name", "content").write.format("file_tree").mode("append").save(folder)


def in_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(target, name, size, md5) of the files that finished jobs have written: target is the name without its extension."""
    found, path, _ = file_system(folder)
    from pyarrow import fs

    if found.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.Directory:
        return spark.createDataFrame([], "target string, name string, size long, md5 string")
    rows = spark.read.schema("name string, size long, md5 string").json(f"{folder}/{MANIFEST}")
    latest = rows.groupBy("name").agg(F.max_by(F.struct("size", "md5"), F.struct("size", "md5")).alias("v"))
    return latest.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("target"), "name", "v.size", "v.md5")
