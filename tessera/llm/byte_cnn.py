"""Language ID by a byte convolutional network, trained in numpy, applied to fixed-length windows of whole texts.

Filters of several widths run over the bytes. As a byte is one of 256, a filter is a table of
weights by offset and byte, and a convolution is a sum of looked-up rows. Each filter's largest
value in a window goes through a rectifier into a softmax layer. A text's scores are the means of
its windows' probabilities, the last window counting by the bytes it has.

Training takes a bounded sample (`per_class` texts a label, `per_text` windows of each, anywhere in
the text) of every label, chosen by a hash of the id; prediction takes every byte of every text. Null texts and texts
without a letter are `und` with score 0; of equally likely classes the first by name is told. Repeated rows are told
alike, an empty table gives none, and columns called lang_pred or score are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, others, plus, text_or_empty

_LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
_built: dict[int, tuple] = {}


@dataclass
class ByteCNN:
    classes: list[str]
    widths: tuple[int, ...]
    tables: list[np.ndarray]  # of each width: offsets x 256 x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    window: int

    @classmethod
    def train(cls, samples: list[bytes], labels: list[str], widths=(2, 3, 4), filters: int = 16, window: int = 256, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        """Cross entropy by Adam; every class weighs the same, however many samples it has."""
        classes = sorted(set(labels))
        rng = np.random.default_rng(seed)
        x = np.zeros((len(samples), window), np.uint8)
        for i, s in enumerate(samples):
            x[i, : min(window, len(s))] = np.frombuffer(s[:window], np.uint8)
        y = np.searchsorted(classes, labels)
        weight = (len(y) / len(classes) / np.bincount(y, minlength=len(classes)))[y].astype(np.float32)
        f = filters * len(widths)
        params = [rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in widths] + [np.zeros(f, np.float32), rng.normal(0, 0.1, (f, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32)]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                xb, n = x[part], len(part)
                top, places = [], []
                for w, table in zip(widths, params, strict=False):
                    z = sum(table[i][xb[:, i : window - w + 1 + i]] for i in range(w))
                    at = z.argmax(1)
                    places.append(at)
                    top.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
                h = np.concatenate(top, 1) + params[-3]
                r = np.maximum(h, 0)
                p = _softmax(r @ params[-2] + params[-1])
                g = p
                g[np.arange(n), y[part]] -= 1
                g *= weight[part, None] / n
                gh = (g @ params[-2].T) * (h > 0)
                grads = [np.zeros_like(q) for q in params]
                for k, (w, at) in enumerate(zip(widths, places, strict=True)):
                    own = gh[:, k * filters : (k + 1) * filters]
                    for i in range(w):
                        np.add.at(grads[k][i], (np.take_along_axis(xb, at + i, 1), np.arange(filters)), own)
                grads[-3], grads[-2], grads[-1] = gh.sum(0), r.T @ g, g.sum(0)
                step += 1
                for q, d, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return cls(classes, tuple(widths), params[:-3], *params[-3:], window)

    def lookups(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """Of each width, (offset, two bytes?, rows): neighbouring offsets' tables summed for all pairs of bytes."""
        out = []
        for w, t in zip(self.widths, self.tables, strict=True):
            pairs = [(i, True, (t[i][:, None] + t[i + 1][None]).reshape(65536, -1)) for i in range(0, w - 1, 2)]
            out.append(pairs + ([(w - 1, False, t[w - 1])] if w % 2 else []))
        return out

    def probabilities(self, x: np.ndarray, lookups: list) -> np.ndarray:
        """A row of class probabilities for each row of bytes."""
        x = x.astype(np.intp)
        two = x[:, :-1] * 256 + x[:, 1:]
        top = []
        for w, parts in zip(self.widths, lookups, strict=True):
            n = x.shape[1] - w + 1
            z = None
            for i, double, rows in parts:
                got = rows.take((two if double else x)[:, i : i + n].ravel(), axis=0)
                z = got if z is None else np.add(z, got, out=z)
            top.append(z.reshape(len(x), n, -1).max(1))
        return _softmax(np.maximum(np.concatenate(top, 1) + self.bias, 0) @ self.out + self.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(raw: bytes, window: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text as rows, each beginning with the last `overlap` bytes of the one before; and the new bytes in each."""
    step = window - overlap
    n = max(1, -(-(len(raw) - overlap) // step))
    flat = np.zeros((n - 1) * step + window, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    rows = np.lib.stride_tricks.as_strided(flat, (n, window), (step, 1))
    return rows, np.minimum(step, len(raw) - overlap - np.arange(n) * step).clip(1)


def _predictor(model: ByteCNN, t: str, rest: list[str], at_once: int = 32):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = model.lookups()
        overlap = max(model.widths) - 1

        def scored(texts: list[str], todo: list[int], names: list, scores: list) -> None:
            made = [windows_of(texts[i].encode(), model.window, overlap) for i in todo]
            rows, share = np.concatenate([r for r, _ in made]), np.concatenate([s for _, s in made]).astype(np.float64)
            first = np.cumsum([0, *(len(s) for _, s in made)])[:-1]
            p = np.concatenate([model.probabilities(rows[i : i + at_once], lookups) for i in range(0, len(rows), at_once)]) * share[:, None]
            p = np.add.reduceat(p, first) / np.add.reduceat(share, first)[:, None]
            for i, best, value in zip(todo, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                names[i], scores[i] = model.classes[best], min(1.0, value)

        for batch in batches:
            texts = batch.column(t).to_pylist()
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            todo, size = [], 0
            for i, text in enumerate(texts):
                if _LETTER.search(text):
                    todo.append(i)
                    size += len(text)
                    if size > 1 << 20:
                        scored(texts, todo, names, scores)
                        todo, size = [], 0
            if todo:
                scored(texts, todo, names, scores)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    return run


def held_out(doc_id: str | Column) -> Column:
    """Whether a document is in the fold that isn't learned from: crc32 of the id's digits modulo 5 is 0 (a null id: yes)."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", per_class: int = 500, per_text: int = 3, window: int = 256, most: int = 20_000, **how) -> ByteCNN | None:
    """A network learned from about per_class texts of each label, `most` in all; None without labelled text.

    What comes to the driver is about `most` x per_text windows of `window` characters at most; where labels are so many that
    per_class of each would be more, each gives fewer.
    """
    known = docs.where(~held_out(doc_id) & F.col(label).isNotNull() & (F.length(text) > 0))
    counts = known.groupBy(F.col(label).alias("of_label")).agg(F.count("*").alias("n"))
    labels = counts.count()
    per_class = min(per_class, most / max(1, labels))
    counts = counts.select("of_label", (F.lit(1.2 * per_class) / F.col("n")).alias("share"))
    counts = F.broadcast(counts) if labels <= 100_000 else counts  # else all texts would be shuffled by label, of which one may have most
    draw = F.pmod(F.xxhash64(F.lit("fit"), doc_id, F.length(text)), F.lit(1 << 30)) / float(1 << 30)
    at = [F.pmod(F.xxhash64(F.lit(i), doc_id), F.greatest(F.length(text) - window // 2, F.lit(1))).cast("int") + 1 for i in range(per_text)]
    rows = known.select(doc_id, text, label).join(counts, F.col(label) == F.col("of_label")).where(draw < F.col("share")).select(F.col(label).alias("label"), draw.alias("draw"), F.array(*(F.substring(F.col(text), a, F.lit(window)) for a in at)).alias("parts")).collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["draw"], r["parts"])):
        by.setdefault(r["label"], []).append(r["parts"])
    pairs = [(p.encode()[:window], name) for name, texts in sorted(by.items()) for parts in texts[: math.ceil(per_class)] for p in dict.fromkeys(parts) if p]
    return ByteCNN.train([p for p, _ in pairs], [n for _, n in pairs], window=window, **how) if pairs else None


def identify(docs: DataFrame, model: ByteCNN | None, text: str = "text") -> DataFrame:
    """docs without text, with lang_pred and score (which replace columns of these names). Without a model everything is `und`."""
    t, rest = fresh(docs, "t"), others(docs, (text,), ("lang_pred", "score"))
    rows = docs.select(*rest, text_or_empty(text).alias(t))
    if model is None:
        return rows.select(*rest, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = plus(docs.select(*rest), lang_pred=T.StringType(), score=T.DoubleType())
    return rows.mapInArrow(_predictor(model, t, rest), schema)


def known_language(docs: DataFrame, model: ByteCNN | None, text: str = "text", least: float = 0.4) -> DataFrame:
    """docs whose language is told with a score of at least `least`; the columns stay as they are.

    Without a model no language can be told, and only texts without a letter go.
    """
    if model is None:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    whole, t = fresh(docs, "whole"), F.col(text)
    got = identify(docs.select(F.struct(*docs.columns).alias(whole), t.alias(f"{whole}_text")), model, f"{whole}_text")
    return got.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(f"{whole}.*")
