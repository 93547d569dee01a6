"""Pixel planes as arrays in a row: statistics, texture, stencils and small transforms without a shuffle.

A plane is an ARRAY<DOUBLE> in row-major order with a known width. All functions are Column
expressions: an image stays one row, whatever is computed of it. Transforms are matrix products over
Arrow batches, the rest is computed in the JVM. Whole-size images go through functions/features.py.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def central(a: Column, power: int) -> Column:
    """Mean of (x - mean) ** power."""
    sum_of = lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x - m, F.lit(float(power))))
    return F.try_divide(let(mean(a), sum_of), F.size(a).cast("double"))


def variance(a: Column) -> Column:
    """With n - 1; 0 for one value."""
    return F.coalesce(F.try_divide(central(a, 2) * F.size(a), F.size(a) - F.lit(1.0)), F.lit(0.0))


def skewness(a: Column) -> Column:
    return F.coalesce(F.try_divide(central(a, 3), F.pow(central(a, 2), F.lit(1.5))), F.lit(0.0))


def kurtosis(a: Column) -> Column:
    return F.coalesce(F.try_divide(central(a, 4), F.pow(central(a, 2), F.lit(2.0))), F.lit(0.0))


def entropy(a: Column, bins: int = 256) -> Column:
    """Bits, over a histogram of the plane's own range; 0 if it is constant."""
    n = F.size(a).cast("double")
    bins_of = lambda e: F.transform(a, lambda x: F.least(F.floor(F.try_divide(x - e["lo"], e["hi"] - e["lo"]) * bins), F.lit(bins - 1)))
    shares = lambda at: F.transform(F.array_distinct(at), lambda b: F.size(F.filter(at, lambda y: y == b)) / n)
    ends = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
    each = let(let(ends, bins_of), shares)
    return F.when(F.array_max(a) > F.array_min(a), -F.aggregate(each, F.lit(0.0), lambda s, p: s + p * F.log2(p))).otherwise(0.0)


def base_stats(a: Column) -> dict[str, Column]:
    var = variance(a)
    return {"mean": mean(a), "std": F.sqrt(var), "variance": var, "energy": mean(F.transform(a, lambda x: x * x)), "entropy": entropy(a), "skewness": skewness(a), "kurtosis": kurtosis(a)}


def cell(a: Column, width: int, height: int, r: Column, c: Column) -> Column:
    """The value at row r, column c; outside, that of the nearest edge."""
    at = F.greatest(F.lit(0), F.least(r, F.lit(height - 1))) * width + F.greatest(F.lit(0), F.least(c, F.lit(width - 1)))
    return F.element_at(a, (at + 1).cast("int"))


def stencil(a: Column, width: int, height: int, kernel: Sequence[tuple[int, int, float]]) -> Column:
    """Each pixel's weighted sum of neighbours (row offset, column offset, weight), edges replicated."""

    def at(i: Column) -> Column:
        r, c = F.floor(i / width), i % width
        out = None
        for dr, dc, w in kernel:
            term = cell(a, width, height, r + dr, c + dc) * F.lit(float(w))
            out = term if out is None else out + term
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), at)


LAPLACIAN = ((0, 0, 4), (-1, 0, -1), (1, 0, -1), (0, -1, -1), (0, 1, -1))
SOBEL_X = tuple((dr, dc, dc * (2 - abs(dr))) for dr in (-1, 0, 1) for dc in (-1, 1))
SOBEL_Y = tuple((dr, dc, dr * (2 - abs(dc))) for dr in (-1, 1) for dc in (-1, 0, 1))


def gaussian_kernel(sigma: float = 1.0) -> list[tuple[int, int, float]]:
    reach = math.ceil(2 * sigma)
    one = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    norm = sum(one)
    return [(i - reach, j - reach, one[i] * one[j] / norm / norm) for i in range(2 * reach + 1) for j in range(2 * reach + 1)]


def residual(a: Column, smooth: Column) -> Column:
    return F.zip_with(a, smooth, lambda x, y: x - y)


def median3(a: Column, width: int, height: int) -> Column:
    """Median of the 3 x 3 neighbours; for this radius mirrored and replicated edges are the same."""

    def at(i: Column) -> Column:
        r, c = F.floor(i / width), i % width
        near = F.array(*(cell(a, width, height, r + dr, c + dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)))
        return F.element_at(F.array_sort(near), 5)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), at)


def levels(a: Column, lo: float, hi: float, n: int = 8) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(1), F.least(F.lit(n), F.floor(n * (x - lo) / (hi - lo)) + 1)).cast("int"))


def glcm_pairs(grey: Column, width: int, height: int) -> Column:
    """(i, j) of each pixel and its right neighbour, and turned round."""

    def of(g: Column) -> Column:
        def at(k: Column) -> Column:
            r, c = F.floor(k / (width - 1)), k % (width - 1)
            i, j = cell(g, width, height, r, c), cell(g, width, height, r, c + 1)
            return F.array(F.struct(i.alias("i"), j.alias("j")), F.struct(j.alias("i"), i.alias("j")))

        return F.transform(F.sequence(F.lit(0), F.lit((width - 1) * height - 1)), at)

    return F.flatten(let(grey, of))


def glcm_properties(pairs: Column) -> dict[str, Column]:
    """Contrast, correlation (0 if undefined), energy and homogeneity of the pairs' joint distribution."""
    n = F.size(pairs).cast("double")
    over = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p["i"].cast("double"), p["j"].cast("double"))) / n
    counts = F.transform(F.array_distinct(pairs), lambda d: F.size(F.filter(pairs, lambda p: p == d)) / n)
    sums = F.struct(over(lambda i, j: i).alias("mu"), over(lambda i, j: i * i).alias("ii"), over(lambda i, j: i * j).alias("ij"))
    correlation = lambda s: F.when(s["ii"] - s["mu"] * s["mu"] > 1e-12, F.try_divide(s["ij"] - s["mu"] * s["mu"], s["ii"] - s["mu"] * s["mu"])).otherwise(0.0)
    return {
        "contrast": over(lambda i, j: (i - j) * (i - j)),
        "correlation": let(sums, correlation),
        "energy": F.aggregate(counts, F.lit(0.0), lambda s, p: s + p * p),
        "homogeneity": over(lambda i, j: 1 / (1 + F.abs(i - j))),
    }


def _over_batches(kind: T.DataType, f: Callable[[np.ndarray], object]) -> Callable[[Column], Column]:
    """f over all planes of an Arrow batch at once, as rows of one array; a null plane gives null."""

    def run(planes: pd.Series) -> pd.Series:
        have = [p for p in planes if p is not None]
        made = iter(f(np.stack(have).astype(np.float64)) if have else ())
        return pd.Series([None if p is None else next(made) for p in planes], index=planes.index, dtype=object)

    return F.pandas_udf(run, kind)


def dft_magnitudes(a: Column, n: int) -> Column:
    """Magnitudes of the 2-D transform of an n x n plane, frequencies in row-major order.

    Array expressions are interpreted value by value; a transform is a product of matrices over a batch instead: with C and S of
    cosines and sines, C x C - S x S is the real part and S x C + C x S the negative imaginary one.
    """
    turns = 2 * np.pi / n * (np.outer(np.arange(n), np.arange(n)) % n)
    c, s = np.cos(turns), np.sin(turns)

    def magnitudes(x: np.ndarray) -> np.ndarray:
        x = x.reshape(-1, n, n)
        cx, sx = c @ x, s @ x
        return np.hypot(cx @ c - sx @ s, sx @ c + cx @ s).reshape(len(x), -1)

    return _over_batches(T.ArrayType(T.DoubleType()), magnitudes)(a)


def ring_of(n: int, rings: int) -> list[int]:
    """The ring 1..rings of each frequency of an n x n transform, zero frequency in the middle."""
    far = [(r if r < n - n // 2 else r - n) for r in range(n)]
    radius = [math.hypot(y, x) for y in far for x in far]
    top = max(radius)
    return [min(rings, max(1, math.floor(d / (top * (1 + 2**-52)) * rings) + 1)) for d in radius]


def ring_means(magnitudes: Column, n: int, rings: int) -> Column:
    """Mean magnitude of each ring; 0 for an empty one."""
    at = ring_of(n, rings)
    places = [[i + 1 for i, r in enumerate(at) if r == ring] for ring in range(1, rings + 1)]
    of = lambda x: F.array(*(sum((F.element_at(x, i) for i in p), F.lit(0.0)) / max(1, len(p)) for p in places))
    return let(magnitudes, of)


#: The low-pass decomposition filter of db4.
DB4 = (-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523)


def wavelet_matrix(n: int, high: bool) -> list[list[float]]:
    """The decomposition of n values as a matrix with floor((n + 7) / 2) rows; edges are mirrored at half points."""
    taps = [(-1) ** (k + 1) * DB4[7 - k] for k in range(8)] if high else list(DB4)
    rows = []
    for i in range((n + 7) // 2):
        row = [0.0] * n
        for k, w in enumerate(taps):
            m = 2 * i + 1 - k
            while not 0 <= m < n:
                m = -m - 1 if m < 0 else 2 * n - 1 - m
            row[m] += w
        rows.append(row)
    return rows


def wavelet_bands(a: Column, n: int) -> dict[str, Column]:
    """One level of an n x n plane: cA, cH (high along rows), cV (high along columns), cD, in row-major order."""
    lo, hi = (np.array(wavelet_matrix(n, high)) for high in (False, True))
    names = ("cA", "cH", "cV", "cD")

    def bands(x: np.ndarray) -> np.ndarray:
        x = x.reshape(-1, n, n)
        return np.stack([(rows @ x @ cols.T).reshape(len(x), -1) for rows, cols in ((lo, lo), (hi, lo), (lo, hi), (hi, hi))], 1)

    made = _over_batches(T.ArrayType(T.ArrayType(T.DoubleType())), lambda x: [list(m) for m in bands(x)])(a)
    return {name: F.element_at(made, i + 1) for i, name in enumerate(names)}


def crop_origin(n: Column, side: int) -> Column:
    """Centre crop origin, snapped down to a multiple of 8."""
    o = F.floor((n - side) / 2)
    return o - F.pmod(o, F.lit(8))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.2989 * r + 0.5870 * g + 0.1140 * b + 0.5)


def halved(a: Column, width: int, height: int) -> Column:
    """Means of 2 x 2 boxes."""

    def at(i: Column) -> Column:
        r, c = 2 * F.floor(i / (width // 2)), 2 * (i % (width // 2))
        return (cell(a, width, height, r, c) + cell(a, width, height, r, c + 1) + cell(a, width, height, r + 1, c) + cell(a, width, height, r + 1, c + 1)) / 4

    return F.transform(F.sequence(F.lit(0), F.lit(width * height // 4 - 1)), at)


def correlation(a: Column, b: Column) -> Column:
    """Pearson; 0 if one is constant."""
    centred = lambda x: let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    dot = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v))
    of = lambda p: F.try_divide(dot(p["a"], p["b"]), F.sqrt(dot(p["a"], p["a"]) * dot(p["b"], p["b"])))
    return F.coalesce(let(F.struct(centred(a).alias("a"), centred(b).alias("b")), of), F.lit(0.0))
