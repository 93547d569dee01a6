"""SentencePiece encoding and decoding by a table of distinct chunks.

In this kind of model no piece has a white-space marker after another character (checked when the
model is loaded), so no merge crosses from one marked word, markers and what follows them, to the next:
segmenting each distinct marked word once and joining ids by position gives the library's ids exactly.
A task keeps the table over its batches, up to `most` chunks; ids come from the library, and each
chunk's text comes from the library's decode of its ids.

Null texts are empty and have no ids. Very long chunks are encoded but not kept. Repeated rows are encoded
alike, an empty table gives none, and columns with a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, others, plus, text_or_empty

MARK = "▁"
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
_tables: dict[str, ChunkTable] = {}


class ChunkTable:
    """ids (as text, joined by commas) and decoded text of distinct marked words."""

    def __init__(self, model: str, most: int = 300_000, longest: int = 40):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.sp.encode("a") != [self.sp.piece_to_id(f"{MARK}a")]:
            raise ValueError("pieces of this model cross white-space markers, or it adds no leading one")
        self.mark, self.stop, self.most, self.longest = self.sp.piece_to_id(MARK), self.sp.encode("a"), most, longest
        self.table: dict[str, tuple[str, str]] = {}

    def learn(self, chunks: list[str]) -> dict[str, tuple[str, str]]:
        """Each distinct chunk segmented once. The library adds the first marker itself."""
        found = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        found = [ids if len(c) > 1 else [self.mark] for c, ids in zip(chunks, found, strict=True)]
        # A piece in front keeps the library from dropping the leading space.
        texts = self.sp.decode([self.stop + ids for ids in found], num_threads=1)
        new = {}
        for c, ids, text in zip(chunks, found, texts, strict=True):
            text = text[1:]
            new[c] = (",".join(map(str, ids)), c if text == c else text)
        return new

    def encode(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """Of each text, its chunks' (ids, decoded text) by position."""
        table = self.table
        if len(table) > self.most:
            table.clear()
        split = [_CHUNK.findall(f" {t}") if t else [] for t in texts]
        new = self.learn(list({c for chunks in split for c in chunks if c not in table}))
        table.update(new)
        out = [[table[c] for c in chunks] for chunks in split]
        for c in new:
            if len(c) > self.longest:
                del table[c]
        return out


def table_of(model: str, most: int) -> ChunkTable:
    """The worker's table for a model."""
    if model not in _tables:
        _tables[model] = ChunkTable(model, most)
    return _tables[model]


def _some_at_once(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of some MB together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _digests(model: str, most: int, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model, most)
        for batch in batches:
            out = []
            for texts in _some_at_once(batch.column("t").to_pylist()):
                for chunks in table.encode(texts):
                    ids = ",".join([x[0] for x in chunks])
                    text = "".join([x[1] for x in chunks])[1:]
                    out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [*rest, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(model: str, most: int, rest: list[str], t: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model, most)
        for batch in batches:
            out = [[int(i) for x in chunks for i in x[0].split(",")] for texts in _some_at_once(batch.column(t).to_pylist()) for chunks in table.encode(texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.list_(pa.int32()))], [*rest, name])

    return run


def encoded(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", most: int = 300_000) -> DataFrame:
    """docs with text replaced by ids (array of int), which replaces a column of that name."""
    t, rest = fresh(docs, "t"), others(docs, (text,), (ids,))
    schema = plus(docs.select(*rest), **{ids: T.ArrayType(T.IntegerType())})
    return docs.select(*rest, text_or_empty(text).alias(t)).mapInArrow(_ids(model, most, rest, t, ids), schema)


def decoded(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with ids replaced by the library's text for them, which replaces a column of that name."""
    rest = others(rows, (ids,), (text,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = table_of(model, 300_000).sp
        for batch in batches:
            found = batch.column(ids).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([sp.decode(x) if x else "" for x in found], pa.string())], [*rest, text])

    return rows.select(*rest, ids).mapInArrow(run, plus(rows.select(*rest), **{text: T.StringType()}))


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", most: int = 300_000) -> DataFrame:
    """A row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    schema = plus(docs.select(F.col(doc_id).alias("doc_id")), n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType())
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(_digests(model, most, ["doc_id"]), schema)
