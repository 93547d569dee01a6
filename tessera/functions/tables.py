"""Table functions for SQL: edits of an image as rows, and report rows of an evaluation sketch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import pixels as px

#: The columns of a sketch that report rows are made from.
CELLS = ("y", "low", "n", "sum_p")


def _constant(argument: AnalyzeArgument, name: str, kind: type):
    if not argument.isConstantExpression or not isinstance(argument.value, kind):
        raise ValueError(f"{name} must be a constant {kind.__name__}")
    return argument.value


class ImageVariants:
    """image_variants(data, height, width, channels[, kinds]): a row (variant, height, width, data) for each kind of edit, of those that the image is large enough for."""

    @staticmethod
    def analyze(data: AnalyzeArgument, height: AnalyzeArgument, width: AnalyzeArgument, channels: AnalyzeArgument, kinds: AnalyzeArgument | None = None) -> AnalyzeResult:
        unknown = [k for k in (_constant(kinds, "kinds", str).split(",") if kinds else ()) if k not in px.VARIANTS]
        if unknown:
            raise ValueError(f"no such variants: {', '.join(unknown)}")
        if not isinstance(data.dataType, T.BinaryType):
            raise ValueError("data must be binary")
        return AnalyzeResult(T.StructType().add("variant", T.StringType()).add("height", T.IntegerType()).add("width", T.IntegerType()).add("data", T.BinaryType()))

    def eval(self, data, height, width, channels, kinds=None) -> Iterator[tuple]:
        if data is None:
            return
        image = px.from_spark_image(bytes(data), int(height), int(width), int(channels))
        for kind in kinds.split(",") if kinds else px.VARIANTS:
            made = px.VARIANTS[kind](image)
            if made is not None:
                yield kind, made.shape[0], made.shape[1], np.ascontiguousarray(made[:, :, ::-1]).tobytes()


class _Report:
    """Of a sketch's cells, partitioned by a set, whose name goes into each row."""

    @staticmethod
    def shape(cells: AnalyzeArgument, by: AnalyzeArgument, *more: tuple[str, T.DataType]) -> AnalyzeResult:
        if not cells.isTable:
            raise ValueError("the first argument must be TABLE(...) PARTITION BY its set")
        column = _constant(by, "by", str)
        have = {f.name: f for f in cells.dataType.fields}
        missing = [c for c in (column, *CELLS) if c not in have]
        if missing:
            raise ValueError(f"the table lacks {', '.join(missing)}")
        out = T.StructType([T.StructField(column, have[column].dataType)])
        for name, kind in more:
            out = out.add(name, kind)
        return AnalyzeResult(out)

    def __init__(self):
        self.set, self.cells = None, []

    def keep(self, cells: Row, by: str) -> None:
        self.set = cells[by]
        self.cells.append((float(cells["low"]), int(cells["y"]), int(cells["n"]), float(cells["sum_p"])))


class ReliabilityRows(_Report):
    """reliability_rows(TABLE(sketch) PARTITION BY (set), 'set', bins): (set, bin, n, mean_p, mean_y) of the bins that aren't empty."""

    @staticmethod
    def analyze(cells: AnalyzeArgument, by: AnalyzeArgument, bins: AnalyzeArgument) -> AnalyzeResult:
        if _constant(bins, "bins", int) < 1:
            raise ValueError("bins must be positive")
        return _Report.shape(cells, by, ("bin", T.IntegerType()), ("n", T.LongType()), ("mean_p", T.DoubleType()), ("mean_y", T.DoubleType()))

    def eval(self, cells: Row, by: str, bins: int) -> None:
        self.bins = bins
        self.keep(cells, by)

    def terminate(self) -> Iterator[tuple]:
        if not self.cells:
            return
        from ..operators.sketch import right_closed

        low, y, n, p = map(np.array, zip(*self.cells, strict=True))
        at = np.searchsorted(right_closed(self.bins), low, side="right")
        for b in np.unique(at).tolist():
            mine = at == b
            yield self.set, b + 1, int(n[mine].sum()), float(p[mine].sum() / n[mine].sum()), float((n * y)[mine].sum() / n[mine].sum())


class SweepRows(_Report):
    """sweep_rows(TABLE(sketch) PARTITION BY (set), 'set', array(...)): (set, threshold, tp, tn, fp, fn, accuracy) at thresholds that are edges of the sketch."""

    @staticmethod
    def analyze(cells: AnalyzeArgument, by: AnalyzeArgument, thresholds: AnalyzeArgument) -> AnalyzeResult:
        return _Report.shape(cells, by, ("threshold", T.DoubleType()), *((c, T.LongType()) for c in ("tp", "tn", "fp", "fn")), ("accuracy", T.DoubleType()))

    def eval(self, cells: Row, by: str, thresholds: list) -> None:
        self.thresholds = [float(t) for t in thresholds]
        self.keep(cells, by)

    def terminate(self) -> Iterator[tuple]:
        if not self.cells:
            return
        low, y, n, _ = map(np.array, zip(*self.cells, strict=True))
        for t in self.thresholds:
            hit = low >= t
            tp, tn, fp, fn = (int(n[m].sum()) for m in (hit & (y == 1), ~hit & (y == 0), hit & (y == 0), ~hit & (y == 1)))
            yield self.set, t, tp, tn, fp, fn, (tp + tn) / int(n.sum())


def register(spark: SparkSession) -> SparkSession:
    """image_variants, reliability_rows and sweep_rows for SQL."""
    for name, handler in (("image_variants", ImageVariants), ("reliability_rows", ReliabilityRows), ("sweep_rows", SweepRows)):
        spark.udtf.register(name, udtf(handler))
    return spark
