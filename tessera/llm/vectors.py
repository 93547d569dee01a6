"""What the vector searches share: usable vectors, Arrow columns of vectors, the best k of many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: str, zero: bool) -> Column:
    """Whether a vector is not null or empty, has finite components only and, unless zero is allowed, a non-zero one."""
    x = F.col(v)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = x.isNotNull() & (F.size(x) > 0) & ~bad
    return F.coalesce(fine if zero else fine & F.exists(x, lambda c: c != 0), F.lit(False))


def of_one_size(rows: DataFrame, v: str) -> tuple[DataFrame, int]:
    """rows whose vectors have the commonest number of components (of equally common ones the larger), and that number. Others can't be compared with them."""
    found = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(F.size(v) == found["d"]), found["d"]) if found else (rows, 0)


def whole(vector: str, scale: float) -> Column:
    """Components as floor(scale * x), in doubles: from 2 ** 53 on every double is whole."""

    def floor(v: Column) -> Column:
        return F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)

    return F.transform(vector, lambda c: floor(F.lit(float(scale)) * c.cast("double")))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A list column as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its k pairs of largest score, ties to the smaller vec."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    order = order[rank < k]
    return query[order], vec[order], score[order]
