"""Chat formatting by token-level assembly.

A turn is <|im_start|>, the role and a line break, the text, <|im_end|> and a line break. Roles and texts are encoded
apart from the markers, and markers are spliced in as reserved ids above the vocabulary, so no text can
make one. So that the formatted text is safe as text too, control strings in texts are escaped reversibly:
every `<|` is written `<||`. The loss mask is 1 on the ids of assistant texts: +1 at a segment's first
id and -1 behind its last, summed up.

Null roles and texts are empty; a null conv_id is a conversation of its own; rows with one turn number keep an order by
a hash of role and text. Turns are formatted and read back one by one, in parallel; only the digests go over a
conversation's texts in order, as a stream in one task, so a conversation of any length fits and the longest one bounds the time.
Columns called ids or loss_mask are replaced; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, others, plus, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
_coders: dict[str, Coder] = {}
#: White space as the encoder has it, from so many characters on.
LONG = 10_000
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


def escaped(text: str) -> str:
    return text.replace("<|", "<||")


def unescaped(text: str) -> str:
    return text.replace("<||", "<|")


class Coder:
    """A tiktoken file's byte-level BPE with two reserved ids above it."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values())
        self.start, self.end = top + 2, top + 3  # the id above the last is kept for an end-of-text token
        self.line = self.bpe.encode_ordinary("\n")

    def turn(self, role: str, text: str, loss: bool) -> tuple[list[int], list[int], list[int]]:
        """Ids of a turn, its segments' ends, and which segments count for the loss."""
        head = self.encode(escaped(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n")
        body = self.encode(escaped(text))
        parts = [[self.start], head, body, [self.end], self.line]
        return [i for p in parts for i in p], [len(p) for p in parts], [0, 0, int(loss), 0, 0]

    def encode(self, text: str) -> list[int]:
        """The library's ids. Its pattern can't take very long white space, which is a piece of its own but for its last character before other text."""
        if len(text) < LONG:
            return self.bpe.encode_ordinary(text)
        ids, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            ids += self.bpe.encode_ordinary(text[at : run.start()])
            at = run.end() - (run.end() < len(text))
            ids += self.bpe._encode_single_piece(text[run.start() : at])
        return ids + self.bpe.encode_ordinary(text[at:])

    def text(self, ids: list[int]) -> str:
        return self.bpe.decode(ids)


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def masks(lengths: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """The loss mask over all segments' ids: prefix sums of +1 at the begin and -1 behind the end of counted segments."""
    ends = np.cumsum(lengths)
    steps = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    on = counted.astype(bool)
    np.add.at(steps, (ends - lengths)[on], 1)
    np.add.at(steps, ends[on], -1)
    return np.cumsum(steps)[:-1]


def _formatted(path: str, r: str, t: str, rest: list[str], loss_roles: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            turns = [code.turn(who, said, who in loss_roles) for who, said in zip(batch.column(r).to_pylist(), batch.column(t).to_pylist(), strict=True)]
            mask = masks(np.array([n for x in turns for n in x[1]], np.int64), np.array([n for x in turns for n in x[2]], np.int64))
            ends = pa.array(np.cumsum([0, *(len(x[0]) for x in turns)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(ends, pa.array(np.array([i for x in turns for i in x[0]], np.int32)))
            loss = pa.ListArray.from_arrays(ends, pa.array(mask.astype(np.int8)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), ids, loss], [*rest, "ids", "loss_mask"])

    return run


def formatted(rows: DataFrame, path: str, role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """rows with role and text replaced by ids and loss_mask (arrays of one length), which replace columns of these names."""
    r, t, rest = fresh(rows, "r"), fresh(rows, "t"), others(rows, (role, text), ("ids", "loss_mask"))
    schema = plus(rows.select(*rest), ids=T.ArrayType(T.IntegerType()), loss_mask=T.ArrayType(T.ByteType()))
    return rows.select(*rest, text_or_empty(role).alias(r), text_or_empty(text).alias(t)).mapInArrow(_formatted(path, r, t, rest, loss_roles), schema)


def placed(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Formatted turns with first_token, the place of a turn's first id in its conversation."""
    order = Window.partitionBy(conv_id).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("first_token", F.coalesce(F.sum(F.size("ids")).over(order), F.lit(0)))


def read_back(code: Coder, ids: list[int], mask: list[int]) -> tuple[str, str, int]:
    """(role, line break, text, line break; what the loss mask covers; characters as formatted) of one formatted turn."""
    end = ids.index(code.end)
    seen = code.text(ids[1:end])
    head, _, text = seen.partition("\n")
    role = unescaped(head.replace("\\\\", "\0").replace("\\n", "\n").replace("\0", "\\") if "\0" not in head else _plain(head))
    counted = unescaped(code.text([i for i, m in zip(ids, mask, strict=True) if m]))
    return f"{role}\n{unescaped(text)}\n", counted, len(START) + len(seen) + len(END) + len(code.text(ids[end + 1 :]))


def _plain(head: str) -> str:
    """Backslash escapes taken back, character by character."""
    out, i = [], 0
    while i < len(head):
        if head[i] == "\\" and i + 1 < len(head):
            out.append("\n" if head[i + 1] == "n" else head[i + 1])
            i += 1
        else:
            out.append(head[i])
        i += 1
    return "".join(out)


def _read_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            out = [read_back(code, ids, mask) for ids, mask in zip(batch.column("ids").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True)]
            said, counted, size = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "tie")), pa.array(said, pa.string()), pa.array(counted, pa.string()), pa.array(size, pa.int64())], ["conv_id", "turn", "tie", "said", "counted", "size"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums up and hashes the turns of a partition sorted by conversation, as a stream."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state = None, None

    def row() -> tuple:
        n, turns, chars, loss, size = state
        return now, n, turns.hexdigest(), chars, loss.hexdigest(), size

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        done = []
        for conv, said, counted, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "said", "counted", "size")), strict=True):
            if state is None or conv != now:
                if state:
                    done.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1].update(said.encode())
            state[3].update(counted.encode())
            state[0], state[2], state[4] = state[0] + 1, state[2] + len(counted), state[4] + size
        if done:
            yield made(done)
    if state:
        yield made([row()])


def digests(rows: DataFrame, path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a conversation, read back from its formatted ids: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.sha2(F.concat_ws("\n", F.coalesce(F.length(role), F.lit(-1)).cast("string"), F.coalesce(role, F.lit("")), F.coalesce(F.length(text), F.lit(-1)).cast("string"), F.coalesce(text, F.lit(""))), 256).alias("tie"), F.col(role).alias("role"), F.col(text).alias("text"))
    turns = formatted(rows, path)  # read back turn by turn before anything is shuffled
    kind = turns.schema["turn"].dataType.simpleString()
    turns = turns.mapInArrow(_read_rows(path), f"conv_id long, turn {kind}, tie string, said string, counted string, size long")
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    return turns.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
