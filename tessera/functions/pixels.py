"""Whole-size pixel work in numpy, run inside Arrow batches: decode, crop, resample, chroma, JPEG round trips, edits."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np

CROP, SIDE, QUALITY = 448, 320, 85

#: The base quantisation tables of the JPEG standard, row by row.
LUMA_TABLE = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
CHROMA_TABLE = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""


#: Rows of an image that are worked on at once, so that what is made of them stays in a core's cache.
STRIP = 32


def rounded(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """To uint8, half away from zero, clipped. With out, x is used up."""
    x = np.add(x, 0.5, out=None if out is None else x)
    np.minimum(np.maximum(x, 0, out=x), 255, out=x)
    if out is None:
        return x.astype(np.uint8)  # cuts off what is behind the point
    np.copyto(out, x, casting="unsafe")
    return out


def strips(n: int, step: int = STRIP) -> Iterator[slice]:
    return (slice(r, min(r + step, n)) for r in range(0, n, step))


def planar(a: np.ndarray) -> np.ndarray:
    """C x H x W; no copy of an image that blank() has made."""
    return np.ascontiguousarray(a.transpose(2, 0, 1))


def blank(height: int, width: int, channels: int = 3) -> np.ndarray:
    """A new H x W x C image that lies channel by channel in memory, as what is computed of it."""
    return np.empty((channels, height, width), np.uint8).transpose(1, 2, 0)


def rgb8(pixels: np.ndarray) -> np.ndarray:
    """Any channel count and integer or float type to H x W x 3 uint8: gray is repeated, alpha and further channels go."""
    if pixels.dtype == np.bool_:
        pixels = pixels.astype(np.uint8) * 255
    elif pixels.dtype == np.uint16:
        pixels = rounded(pixels / 257.0)
    elif pixels.dtype != np.uint8:
        pixels = rounded(np.nan_to_num(pixels.astype(np.float64)) * 255)
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3]


def from_spark_image(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """The image source's bytes (BGR or BGRA, row-major) as RGB."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return rgb8(a[:, :, ::-1] if channels == 3 else a[:, :, 2::-1] if channels == 4 else a)


def to_spark_image(a: np.ndarray) -> bytes:
    """The reverse for RGB: BGR, row-major."""
    out = np.empty(a.shape, np.uint8)
    for c in range(3):
        out[:, :, 2 - c] = a[:, :, c]
    return out.tobytes()


def centre_crop(a: np.ndarray, side: int) -> np.ndarray:
    at = [(n - side) // 2 for n in a.shape[:2]]
    r, c = (o - o % 8 for o in at)
    return a[r : r + side, c : c + side]


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


def bicubic_matrix(n: int, m: int) -> np.ndarray:
    """m x n weights; the kernel widens when shrinking, edges are mirrored."""
    scale = m / n
    wide = max(1.0, 1 / scale)
    centre = (np.arange(m) + 0.5) / scale - 0.5
    taps = np.floor(centre - 2 * wide).astype(int)[:, None] + np.arange(math.ceil(4 * wide) + 2)
    w = _cubic((centre[:, None] - taps) / wide)
    w /= w.sum(1, keepdims=True)
    taps = np.mod(taps, 2 * n)
    taps = np.where(taps >= n, 2 * n - 1 - taps, taps)
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m)[:, None], taps), w)
    return out


@lru_cache(512)
def bicubic_bands(n: int, m: int) -> list[tuple[slice, slice, np.ndarray]]:
    """bicubic_matrix() in strips of rows, each with the columns that it has weights in: all else is zero."""
    whole, out = bicubic_matrix(n, m), []
    for rows in strips(m):
        used = np.flatnonzero(whole[rows].any(axis=0))
        cols = slice(int(used[0]), int(used[-1]) + 1)
        out.append((rows, cols, whole[rows, cols].copy()))
    return out


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    planes, out = planar(a).astype(np.float64), blank(height, width, a.shape[2])
    for rows, used, weights in bicubic_bands(a.shape[0], height):
        across = weights @ planes[:, used]
        strip = np.empty((*across.shape[:2], width))
        for cols, near, part in bicubic_bands(a.shape[1], width):
            np.matmul(across[:, :, near], part.T, out=strip[:, :, cols])
        rounded(strip, out[rows].transpose(2, 0, 1))
    return out


def grained(plane: np.ndarray, seed: int, side: int) -> np.ndarray:
    """An image made of an 8 x 8 plane: it, its mirror images as further channels, enlarged, and seeded noise."""
    a = rounded((np.asarray(plane).reshape(8, 8, 1) + 0.6) / 1.2 * 255)
    a, out = resized(np.concatenate([a, a[::-1], a[:, ::-1]], 2), side, side), np.empty((side, side, 3), np.uint8)
    for c in range(3):
        out[:, :, c] = a[:, :, c]
    rng = np.random.default_rng(seed)
    for rows in strips(side):
        x = rng.integers(-12, 13, (rows.stop - rows.start, side, 3))
        x += out[rows]
        out[rows] = np.minimum(np.maximum(x, 0, out=x), 255, out=x)
    return out


#: BT.601, studio range.
_TO_YCC = np.array([[65.481, 128.553, 24.966], [-37.797, -74.203, 112.0], [112.0, -93.786, -18.214]]) / 255
_YCC_OFFSET = np.array([16.0, 128.0, 128.0])
#: BT.601, full range, as in JFIF.
_TO_JFIF = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
_JFIF_OFFSET = np.array([0.0, 128.0, 128.0])


def filled(x: np.ndarray, to: int) -> np.ndarray:
    """Planes whose sides are made multiples of `to` by repeating their edges."""
    n, m = x.shape[-2:]
    if not n % to and not m % to:
        return x
    out = np.empty((*x.shape[:-2], n + -n % to, m + -m % to))
    out[..., :n, :m] = x
    out[..., :n, m:] = x[..., -1:]
    out[..., n:, :] = out[..., n - 1 : n, :]
    return out


def halved(x: np.ndarray) -> np.ndarray:
    x = filled(x, 2)
    out = x[..., ::2, ::2] + x[..., 1::2, ::2]
    out += x[..., ::2, 1::2]
    out += x[..., 1::2, 1::2]
    out /= 4
    return out


def _doubled(x: np.ndarray, rows: slice) -> np.ndarray:
    """bilinear() to twice as many rows and columns: three quarters of the nearer value and a quarter of the other."""
    first = max(rows.start // 2 - 1, 0)
    x = x[:, first : rows.stop // 2 + 1]
    near, far = x * 0.75, x * 0.25
    y = np.empty((len(x), 2 * x.shape[1], x.shape[2]))
    y[:, 0], y[:, -1] = x[:, 0], x[:, -1]
    np.add(far[:, :-1], near[:, 1:], out=y[:, 2::2])
    np.add(near[:, :-1], far[:, 1:], out=y[:, 1:-1:2])
    y = np.ascontiguousarray(y[:, rows.start - 2 * first : rows.stop - 2 * first])
    near, far = (y * 0.75).ravel(), (y * 0.25).ravel()
    out = np.empty((*y.shape[:2], 2 * y.shape[2]))
    flat = out.reshape(-1)  # what runs over a row's ends is put right below
    np.add(far[:-1], near[1:], out=flat[2::2])
    np.add(near[:-1], far[1:], out=flat[1:-1:2])
    out[..., 0], out[..., -1] = y[..., 0], y[..., -1]
    return out


@lru_cache(64)
def _taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    i = np.minimum(at.astype(int), max(n - 2, 0))
    return i, np.minimum(i + 1, n - 1), at - i


def bilinear(x: np.ndarray, height: int, width: int, rows: slice) -> np.ndarray:
    """Some rows of planes enlarged."""
    if (height, width) == (2 * x.shape[-2], 2 * x.shape[-1]) and not rows.start % 2 and not rows.stop % 2:
        return _doubled(x, rows)
    r0, r1, fr = (v[rows] for v in _taps(x.shape[-2], height))
    c0, c1, fc = _taps(x.shape[-1], width)
    y = x[..., r0, :] * (1 - fr)[:, None]
    y += x[..., r1, :] * fr[:, None]
    out, other = y.take(c0, -1, mode="clip"), y.take(c1, -1, mode="clip")
    out *= 1 - fc
    other *= fc
    out += other
    return out


_FROM_YCC, _FROM_JFIF = (np.linalg.inv(m) for m in (_TO_YCC, _TO_JFIF))


def _mixed(weights: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Other channels of planes."""
    return (weights @ planes.reshape(3, -1)).reshape(planes.shape)


def decimated_chroma(a: np.ndarray) -> np.ndarray:
    h, w = a.shape[:2]
    rgb, ycc, out = planar(a), np.empty((3, h, w), np.uint8), blank(h, w)
    offset = _YCC_OFFSET[:, None, None]
    for rows in strips(h):
        x = _mixed(_TO_YCC, rgb[:, rows].astype(np.float64))
        x += offset
        rounded(x, ycc[:, rows])
    chroma = rounded(halved(ycc[1:].astype(np.float64))).astype(np.float64)
    for rows in strips(h):
        x = ycc[:, rows].astype(np.float64)
        x[1:] = rounded(bilinear(chroma, h, w, rows))
        x -= offset
        rounded(_mixed(_FROM_YCC, x), out[rows].transpose(2, 0, 1))
    return out


@lru_cache(32)
def quantisation(quality: int, chroma: bool) -> np.ndarray:
    base = np.array((CHROMA_TABLE if chroma else LUMA_TABLE).split(), np.float64).reshape(8, 8)
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip(np.floor((base * scale + 50) / 100), 1, 255)


_DCT = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])


@lru_cache(64)
def _steps(quality: int, chroma: bool, blocks: int) -> np.ndarray:
    return np.tile(quantisation(quality, chroma), blocks)


def _transformed(x: np.ndarray) -> np.ndarray:
    """The transform of planes in blocks of 8 x 8, each at its block's place."""
    x = filled(x, 8)
    out = (_DCT @ (x - 128).reshape(-1, 8, x.shape[-1])).reshape(-1, 8) @ _DCT.T
    return out.reshape(x.shape)


def _restored(x: np.ndarray, quality: int, chroma: bool) -> np.ndarray:
    """Planes from their transform, quantised."""
    steps = _steps(quality, chroma, x.shape[-1] // 8)
    out = x.reshape(-1, *steps.shape) / steps
    np.rint(out, out=out)
    out *= steps
    out = (_DCT.T @ out).reshape(-1, 8) @ _DCT
    out += 128
    return out.reshape(x.shape)


def transformed(a: np.ndarray) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
    """(size, luma, chroma): what JPEG quantises of an image, the same for all qualities (4:2:0)."""
    h, w = a.shape[:2]
    rgb, offset = planar(a), _JFIF_OFFSET[:, None, None]
    n, m = (h + 1) // 2, (w + 1) // 2
    luma, chroma = np.empty((h + -h % 8, w + -w % 8)), np.empty((2, n + -n % 8, m + -m % 8))
    for rows in strips(h):  # of whole blocks, of chroma too
        x = _mixed(_TO_JFIF, rgb[:, rows].astype(np.float64))
        x += offset
        luma[rows.start : rows.start + STRIP] = _transformed(x[0])
        chroma[:, rows.start // 2 : (rows.start + STRIP) // 2] = _transformed(halved(x[1:]))
    return (h, w), luma, chroma


def restored(size: tuple[int, int], luma: np.ndarray, chroma: np.ndarray, quality: int) -> np.ndarray:
    """An image from what transformed() gives, quantised."""
    h, w = size
    out, offset = blank(h, w), _JFIF_OFFSET[:, None, None]
    colours = _restored(chroma, quality, True)[:, : (h + 1) // 2, : (w + 1) // 2]
    for rows in strips(h):
        x = np.empty((3, rows.stop - rows.start, w))
        x[0] = _restored(luma[rows.start : rows.start + STRIP], quality, False)[: len(x[0]), :w]
        x[1:] = bilinear(colours, h, w, rows)
        x -= offset
        rounded(_mixed(_FROM_JFIF, x), out[rows].transpose(2, 0, 1))
    return out


def jpeg_round_trip(a: np.ndarray, quality: int = QUALITY) -> np.ndarray:
    """What JPEG at a quality does to pixels (4:2:0): transform, quantise, and back. No bytes are made."""
    return restored(*transformed(a), quality)


def normalised(a: np.ndarray, crop: int = CROP, side: int = SIDE, quality: int = QUALITY) -> np.ndarray | None:
    """Crop, resample, decimate chroma, compress. None if the image is smaller than the crop."""
    if min(a.shape[:2]) < crop:
        return None
    return jpeg_round_trip(decimated_chroma(resized(centre_crop(rgb8(a), crop), side, side)), quality)


def check_sizes(crop: int, side: int, least_ratio: float = 1.25) -> None:
    if crop % 8 or side < 256 or crop / side < least_ratio:
        raise ValueError("the crop must be a multiple of 8, the side at least 256, and crop / side at least 1.25")


def window_of(a: np.ndarray, side: int = 256, mode: str = "crop") -> np.ndarray:
    """The square that is measured: a centre crop, of an enlarged image if it is smaller; or the whole frame resized."""
    if mode == "resize":
        return resized(a, side, side)
    h, w = a.shape[:2]
    if min(h, w) < side:
        scale = max(side / h, side / w)
        a = resized(a, math.ceil(h * scale), math.ceil(w * scale))
    return centre_crop(a, side)


def _gaussian(sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(2 * sigma))
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def _weighted(parts: Iterator[tuple[float, np.ndarray]]) -> np.ndarray:
    """The sum of arrays by their weights, in order."""
    w, x = next(parts)
    out, one = w * x, np.empty(x.shape)
    for w, x in parts:
        out += np.multiply(x, w, out=one)
    return out


def _smoothed(p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The inner part of planes (the last two axes) that have a margin of the kernel's reach."""
    n, m = (s - len(k) + 1 for s in p.shape[-2:])
    rows = _weighted((w, p[..., i : i + n, :]) for i, w in enumerate(k))
    return _weighted((w, rows[..., i : i + m]) for i, w in enumerate(k))


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    k = _gaussian(sigma)
    return _smoothed(np.pad(x, len(k) // 2, mode="edge"), k)


def _by_strips(f: Callable[[np.ndarray, np.ndarray], np.ndarray], a: np.ndarray, sigma: float) -> np.ndarray:
    """f of an image's pixels and their blurred ones, rounded."""
    k = _gaussian(sigma)
    reach, out = len(k) // 2, blank(*a.shape)
    p = np.pad(planar(a), [(0, 0), (reach, reach), (reach, reach)], mode="edge")
    for rows in strips(a.shape[0]):
        x = p[:, rows.start : rows.stop + 2 * reach].astype(np.float64)
        rounded(f(x[:, reach:-reach, reach:-reach], _smoothed(x, k)), out[rows].transpose(2, 0, 1))
    return out


def denoised(a: np.ndarray, radius: float = 0.6) -> np.ndarray:
    return _by_strips(lambda x, soft: soft, a, radius)


def sharpened(a: np.ndarray, radius: float = 1.0, amount: float = 0.8) -> np.ndarray:
    return _by_strips(lambda x, soft: x + amount * (x - soft), a, radius)


def scaled(a: np.ndarray, factor: float) -> np.ndarray:
    return resized(a, max(1, math.ceil(a.shape[0] * factor)), max(1, math.ceil(a.shape[1] * factor)))


class Shared:
    """An image, and what several edits of it start from, made once."""

    def __init__(self, image: np.ndarray):
        self.image = image

    @cached_property
    def small(self) -> np.ndarray:
        return scaled(self.image, 0.75)

    @cached_property
    def transformed(self) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
        return transformed(self.image)

    def compressed(self, quality: int) -> np.ndarray:
        return restored(*self.transformed, quality)


_VARIANTS: dict[str, Callable[[Shared], np.ndarray]] = {
    "control": lambda s: s.image,
    "resize75": lambda s: s.small,
    "jpeg85": lambda s: s.compressed(85),
    "jpeg60": lambda s: s.compressed(60),
    "denoise": lambda s: denoised(s.image),
    "sharpen": lambda s: sharpened(s.image),
    "web_sim": lambda s: jpeg_round_trip(sharpened(s.small), 85),
}

#: The one-edit-at-a-time experiment: the control is unchanged.
VARIANTS = {kind: lambda a, f=f: f(Shared(a)) for kind, f in _VARIANTS.items()}


def edit(s: Shared, kind: str, quality: int, factor: float) -> np.ndarray | None:
    """`normalised`, a variant, or an augmentation."""
    if kind == "normalised":
        return normalised(s.image)
    return _VARIANTS[kind](s) if kind in _VARIANTS else _augmented(s, kind, quality, factor)


def augmented(a: np.ndarray, kind: str, quality: int, factor: float) -> np.ndarray | None:
    """qhi, qlo: compressed at quality; soft: shrunk and restored; rweb: shrunk (None if the short side gets under 256) and compressed."""
    return _augmented(Shared(a), kind, quality, factor)


def _augmented(s: Shared, kind: str, quality: int, factor: float) -> np.ndarray | None:
    if kind in ("qhi", "qlo"):
        return s.compressed(quality)
    small = scaled(s.image, factor)
    if kind == "soft":
        return jpeg_round_trip(resized(small, *s.image.shape[:2]), quality)
    return jpeg_round_trip(small, quality) if min(small.shape[:2]) >= 256 else None


def png8(image: np.ndarray) -> bytes:
    """An 8-bit gray or RGB image as a PNG file, without loss."""
    a = image if image.ndim == 3 else image[:, :, None]
    lines = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), a.astype(np.uint8).reshape(a.shape[0], -1)], axis=1)
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = a.shape[1].to_bytes(4, "big") + a.shape[0].to_bytes(4, "big") + bytes([8, {1: 0, 3: 2}[a.shape[2]], 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def png16(data: bytes) -> np.ndarray:
    """A 16-bit, non-interlaced PNG: the JVM's reader keeps only the low bytes of these."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, raw = 8, b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, interlaced = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8], body[9], body[12]
        elif kind == b"IDAT":
            raw += body
        at += 12 + n
    if depth != 16 or interlaced or colour not in (0, 2, 4, 6):
        raise ValueError("only 16-bit non-interlaced gray or RGB, with or without alpha")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step, rows = 2 * channels, np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, -1)
    out = np.zeros((h, w * step), np.int64)
    for r in range(h):
        kind, line = int(rows[r, 0]), rows[r, 1:].astype(np.int64)
        up = out[r - 1] if r else np.zeros(w * step, np.int64)
        if kind == 0:
            out[r] = line
        elif kind == 1:
            out[r] = np.cumsum(line.reshape(w, step), axis=0).ravel() & 255
        elif kind == 2:
            out[r] = (line + up) & 255
        else:  # each pixel needs the one before it: a step for each, over its bytes at once
            lines, ups, left, corner = line.reshape(w, step), up.reshape(w, step), np.zeros(step, np.int64), np.zeros(step, np.int64)
            for i in range(w):
                if kind == 3:
                    guess = (left + ups[i]) // 2
                else:
                    p = left + ups[i] - corner
                    near = np.stack([abs(p - left), abs(p - ups[i]), abs(p - corner)])
                    guess = np.choose(near.argmin(axis=0), [left, ups[i], corner])
                left = (lines[i] + guess) & 255
                corner = ups[i]
                out[r, i * step : (i + 1) * step] = left
    values = (out[:, ::2] << 8 | out[:, 1::2]).astype(np.uint16)
    return values.reshape(h, w, channels)
