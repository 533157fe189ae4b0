"""Kernels over pixels: numpy inside Arrow functions where a picture is decoded, native formulas for small grids.

Pictures come as BINARY (encoded, or raw gray with a width) and never leave the task that decodes them. A picture
that cannot be decoded gives null and no failure. Decoding needs Pillow, which is optional; raw gray needs nothing.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.text import let


def decode(content: bytes | None, raw_width: int | None = None) -> np.ndarray | None:
    """A picture as uint8 array (gray, or RGB); null for empty or broken content."""
    if not content:
        return None
    if raw_width:
        n = len(content) // raw_width
        return np.frombuffer(content[: n * raw_width], np.uint8).reshape(n, raw_width) if n else None
    try:
        from PIL import Image

        with Image.open(io.BytesIO(content)) as im:
            return np.asarray(im.convert("L" if im.mode in ("L", "1", "I;16") else "RGB"))
    except Exception:
        return None


def gray(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else np.rint(a[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    y = np.clip((np.arange(h) + 0.5) * a.shape[0] / h - 0.5, 0, a.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * a.shape[1] / w - 0.5, 0, a.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    f = a.astype(np.float64)
    return (f[y0][:, x0] * (1 - fy) * (1 - fx) + f[y1][:, x0] * fy * (1 - fx) + f[y0][:, x1] * (1 - fy) * fx + f[y1][:, x1] * fy * fx)


def lanczos_matrix(n: int, m: int, lobes: int = 3) -> np.ndarray:
    """Weights (m x n) that resample n pixels to m with an anti-aliased Lanczos kernel."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    d = (np.arange(n)[None, :] - centre[:, None]) / scale
    k = np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0.0)
    return k / k.sum(1, keepdims=True)


def cubic_matrix(n: int, m: int, a: float = -0.75) -> np.ndarray:
    """Weights (m x n) that resample n pixels to m by cubic convolution; places beyond the edge count as the edge."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((m, n))
    for k in (-1, 0, 1, 2):
        d = np.abs(at - (base + k))
        w = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a)
        np.add.at(out, (np.arange(m), np.clip(base + k, 0, n - 1)), w)
    return out


def reading_picture(a: np.ndarray, pad_share: tuple[float, float], least_pad: int, least_height: int) -> np.ndarray:
    """A crop as a recogniser gets it: its edge repeated around it, and enlarged to a least height (sizes as ``geometry.reading_size``)."""
    h, w = a.shape[:2]
    px, py = (max(least_pad, int(np.rint(n * share))) for n, share in zip((w, h), pad_share, strict=True))
    p = np.pad(a, [(py, py), (px, px)] + [(0, 0)] * (a.ndim - 2), mode="edge")
    scale = least_height / max(1, p.shape[0])
    if scale <= 1:
        return p
    hh, ww = int(np.rint(p.shape[0] * scale)), int(np.rint(p.shape[1] * scale))
    big = np.tensordot(cubic_matrix(p.shape[0], hh), p.astype(np.float64), (1, 0))
    big = np.moveaxis(np.tensordot(cubic_matrix(p.shape[1], ww), big, (1, 1)), 0, 1)
    return np.clip(np.rint(big), 0, 255).astype(np.uint8)


def dct_matrix(n: int) -> np.ndarray:
    """Unnormalised DCT-II."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2.0 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def perceptual_hash(a: np.ndarray, side: int = 8, grid: int = 32) -> int:
    """64 bits: the low frequencies of the shrunken gray picture against their median, first bit highest."""
    g = gray(a).astype(np.float64)
    small = np.clip(np.rint(lanczos_matrix(g.shape[0], grid) @ g @ lanczos_matrix(g.shape[1], grid).T), 0, 255)
    d = dct_matrix(grid)
    low = (d @ small @ d.T)[:side, :side]
    bits = (low > np.median(low)).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def laplacian_variance(g: np.ndarray) -> float:
    """Population variance of the 3 x 3 Laplacian with mirrored edges."""
    p = np.pad(g.astype(np.float64), 1, mode="reflect") if min(g.shape) > 1 else np.pad(g.astype(np.float64), 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.var())


def quality(a: np.ndarray) -> tuple[float, float, float, float]:
    """Sharpness (Laplacian variance), brightness (mean), contrast (standard deviation) and the mixed score."""
    g = gray(a)
    if g.size == 0:
        return 0.0, 0.0, 0.0, 0.0
    s, b, c = laplacian_variance(g), float(g.mean()), float(g.std())
    return s, b, c, float(quality_mix(s, b, c))


def quality_mix(s, b, c):
    unit = lambda v: np.clip(v, 0.0, 1.0)
    return 0.45 * unit(s / 1200.0) + 0.30 * unit(1.0 - np.abs(b - 145.0) / 145.0) + 0.25 * unit(c / 64.0)


def quality_score(sharpness: Column, brightness: Column, contrast: Column) -> Column:
    """The mixed score of three measures, native."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return unit(sharpness / 1200.0) * 0.45 + unit(1.0 - F.abs(brightness - 145.0) / 145.0) * 0.30 + unit(contrast / 64.0) * 0.25


def clahe(a: np.ndarray, limit: float = 2.0, tiles: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of a gray picture: clipped tile histograms, blended maps."""
    g = gray(a)
    ty, tx = tiles
    h, w = -(-g.shape[0] // ty), -(-g.shape[1] // tx)
    p = np.pad(g, ((0, h * ty - g.shape[0]), (0, w * tx - g.shape[1])), mode="reflect" if min(g.shape) > 1 else "edge") if (h * ty, w * tx) != g.shape else g
    clip = max(1, int(limit * h * w / 256))
    luts = np.zeros((ty, tx, 256))
    for i in range(ty):
        for j in range(tx):
            hist = np.bincount(p[i * h : (i + 1) * h, j * w : (j + 1) * w].ravel(), minlength=256)
            extra = int(np.maximum(hist - clip, 0).sum())
            hist = np.minimum(hist, clip) + extra // 256
            rest = extra % 256
            if rest:
                hist[:: max(1, 256 // rest)][:rest] += 1
            luts[i, j] = np.clip(np.rint(np.cumsum(hist) * 255.0 / (h * w)), 0, 255)
    y = np.clip((np.arange(g.shape[0]) + 0.5) / h - 0.5, 0, ty - 1)
    x = np.clip((np.arange(g.shape[1]) + 0.5) / w - 0.5, 0, tx - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda r, c: luts[r[:, None], c[None, :], g]
    out = at(y0, x0) * (1 - fy) * (1 - fx) + at(y1, x0) * fy * (1 - fx) + at(y0, x1) * (1 - fy) * fx + at(y1, x1) * fy * fx
    return np.rint(out).astype(np.uint8)


def denoise(a: np.ndarray, strength: float = 10.0, patch: int = 7, window: int = 21) -> np.ndarray:
    """Non-local means of a gray picture: pixels averaged by how alike their patches are."""
    g = gray(a).astype(np.float64)
    r, s = patch // 2, window // 2
    pad = np.pad(g, r + s, mode="reflect" if min(g.shape) > r + s else "edge")
    total, weight = np.zeros_like(g), np.zeros_like(g)
    h, w = g.shape
    core = pad[s : s + h + 2 * r, s : s + w + 2 * r]
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            other = pad[s + dy : s + dy + h + 2 * r, s + dx : s + dx + w + 2 * r]
            d = np.pad(((core - other) ** 2).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            mean = (d[patch:, patch:] - d[:-patch, patch:] - d[patch:, :-patch] + d[:-patch, :-patch]) / patch**2
            k = np.exp(-np.maximum(mean, 0) / strength**2)
            weight += k
            total += k * other[r : r + h, r : r + w]
    return np.rint(total / weight).astype(np.uint8)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 x 3 map of four points onto four points."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1.0).reshape(3, 3)


def homography_udf(w: int = 856, h: int = 540):
    """Four corners (arrays of two numbers, top left first and on clockwise) -> the 3 x 3 map to a picture of w x h, row by row; null if there is none."""
    goal = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)

    @F.pandas_udf("array<double>")
    def solve(corners: pd.Series) -> pd.Series:
        def one(c) -> list[float] | None:
            if c is None or len(c) != 4:
                return None
            try:
                return homography(np.array([list(p) for p in c], float), goal).ravel().tolist()
            except (ValueError, np.linalg.LinAlgError):
                return None

        return corners.map(one)

    return solve


def warp(a: np.ndarray, points: np.ndarray, w: int = 856, h: int = 540) -> np.ndarray:
    """The part of a picture within four corners, flattened to w x h (bilinear, black outside)."""
    m = np.linalg.inv(homography(points, np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)))
    yy, xx = np.mgrid[0:h, 0:w]
    q = m @ np.stack([xx.ravel(), yy.ravel(), np.ones(w * h)])
    x, y = q[0] / q[2], q[1] / q[2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    f = np.pad(a.astype(np.float64), [(1, 1), (1, 1)] + [(0, 0)] * (a.ndim - 2))
    inside = (x0 >= -1) & (y0 >= -1) & (x0 < a.shape[1]) & (y0 < a.shape[0])
    x0, y0 = np.where(inside, x0, -1) + 1, np.where(inside, y0, -1) + 1
    x1, y1 = np.minimum(x0 + 1, f.shape[1] - 1), np.minimum(y0 + 1, f.shape[0] - 1)
    if a.ndim == 3:
        fx, fy, inside = fx[:, None], fy[:, None], inside[:, None]
    v = f[y0, x0] * (1 - fx) * (1 - fy) + f[y0, x1] * fx * (1 - fy) + f[y1, x0] * (1 - fx) * fy + f[y1, x1] * fx * fy
    return np.rint(np.where(inside, v, 0)).astype(np.uint8).reshape((h, w) + a.shape[2:])


def rotate(a: np.ndarray, angle: int) -> np.ndarray:
    """Clockwise by a multiple of 90 degrees."""
    if angle % 90:
        raise ValueError("the angle must be a multiple of 90")
    return np.rot90(a, -(angle // 90))


def rotate_udf(angle: int, raw_width: int):
    """Raw gray bytes turned clockwise by a multiple of 90 degrees; null where there is no picture."""

    @F.pandas_udf("binary")
    def turn(content: pd.Series) -> pd.Series:
        pics = (decode(c, raw_width) for c in content)
        return pd.Series([None if a is None else rotate(a, angle).tobytes() for a in pics], dtype=object)

    return turn


def blur(g: np.ndarray) -> np.ndarray:
    """3 x 3 binomial mean of a gray picture with mirrored edges, rounded."""
    p = np.pad(g.astype(np.float64), 1, mode="reflect" if min(g.shape) > 1 else "edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    return np.rint((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 16).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """The threshold that parts the gray values into the two groups that lie furthest apart."""
    n = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    below, mass = n.cumsum(), (n * np.arange(256)).cumsum()
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    gap = np.zeros(256)
    gap[ok] = below[ok] * above[ok] * (mass[ok] / below[ok] - (mass[-1] - mass[ok]) / above[ok]) ** 2
    return int(gap.argmax())


def contours(g: np.ndarray, low: float = 50.0, high: float = 150.0) -> np.ndarray:
    """Thin edges: gradients that are largest across their direction and strong, or weak and joined to a strong one."""
    p = np.pad(g.astype(np.float64), 1, mode="edge")
    dx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    dy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.abs(dx) + np.abs(dy)
    q = np.pad(size, 1)
    turn = np.rint(np.arctan2(dy, dx) / (np.pi / 4)).astype(int) % 4  # 0 across, 1 falling, 2 upright, 3 rising
    peak = np.zeros(size.shape, bool)
    for k, (r, c) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead = q[1 + r : 1 + r + size.shape[0], 1 + c : 1 + c + size.shape[1]]
        behind = q[1 - r : 1 - r + size.shape[0], 1 - c : 1 - c + size.shape[1]]
        peak |= (turn == k) & (size > behind) & (size >= ahead)
    weak, on = peak & (size > low), peak & (size > high)
    while True:
        around = np.pad(on, 1)
        grown = weak & np.any([around[1 + r : 1 + r + on.shape[0], 1 + c : 1 + c + on.shape[1]] for r in (-1, 0, 1) for c in (-1, 0, 1)], axis=0)
        if (grown == on).all():
            return on
        on = grown


def closed(on: np.ndarray, length: int, axis: int) -> np.ndarray:
    """Gaps of up to ``length`` - 1 places along an axis filled: spread, then shrunk again."""
    half = length // 2
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x, length, axis=axis)
    pads = [(half, half) if k == axis else (0, 0) for k in range(2)]
    spread = view(np.pad(on, pads)).any(-1)
    return view(np.pad(spread, pads, constant_values=True)).all(-1)


def orientation_scores(a: np.ndarray) -> dict[int, float]:
    """How upright the picture looks in each of four turns.

    Text lines make the ink of rows vary more than that of columns, and edges close into longer runs along the lines
    than across them; a wide picture and no turn get a little more. The picture is looked at once: a quarter turn
    swaps rows and columns.
    """
    g = blur(gray(a))
    ink = (g <= otsu(g)).astype(float)
    edges = contours(g)
    along, across = closed(edges, 15, 1).mean(), closed(edges, 15, 0).mean()
    rows, cols = (ink * 255).mean(1).var(), (ink * 255).mean(0).var()
    share = lambda p, q: p / max(p + q, 1e-6)
    out = {}
    for angle in (0, 90, 180, 270):
        flat = angle in (0, 180)
        wide = g.shape[1] >= g.shape[0] if flat else g.shape[0] >= g.shape[1]
        r, e = (share(rows, cols), share(along, across)) if flat else (share(cols, rows), share(across, along))
        out[angle] = 0.45 * r + 0.35 * e + 0.18 * wide + 0.02 * (angle == 0)
    return out


def orientation_udf(raw_width: int | None = None):
    """content -> map of the four turns to their scores, for ``pick_orientation``; null where there is no picture."""

    @F.pandas_udf("map<int, double>")
    def scores(content: pd.Series) -> pd.Series:
        pics = (decode(c, raw_width) for c in content)
        return pd.Series([None if a is None or not a.size else orientation_scores(a) for a in pics], dtype=object)

    return scores


def pick_orientation(scores: Column, least: float = 0.12, allow_180: bool = False) -> Column:
    """The turn to apply from a map angle -> score: angle and confidence, native. No turn unless the margin is clear."""
    ranked = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e.value).alias("s"), F.when(e.key == 0, 0).when(e.key == 90, 1).when(e.key == 180, 2).otherwise(3).alias("o"), e.key.alias("k"))))
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (-best.s + second.s) / F.greatest(-best.s, F.lit(1e-6))))
    turn = (best.k.isin(90, 270) & (conf >= least)) | ((best.k == 180) & F.lit(allow_180) & (conf >= max(0.35, least)))
    return F.struct(F.when(turn, best.k).otherwise(0).alias("angle"), F.when(turn | (best.k == 0), conf).otherwise(0.0).alias("confidence"))


def hash_udf(raw_width: int | None = None):
    @F.pandas_udf("long")
    def phash(content: pd.Series) -> pd.Series:
        pics = (decode(c, raw_width) for c in content)
        return pd.Series([None if a is None else perceptual_hash(a) for a in pics], dtype="Int64")

    return phash


def quality_udf(raw_width: int | None = None):
    @F.pandas_udf("sharpness double, brightness double, contrast double, score double")
    def measure(content: pd.Series) -> pd.DataFrame:
        pics = (decode(c, raw_width) for c in content)
        return pd.DataFrame([(None,) * 4 if a is None else quality(a) for a in pics], columns=["sharpness", "brightness", "contrast", "score"])

    return measure


def enhance_udf(raw_width: int):
    """Raw gray bytes in, contrast evened and noise removed, raw gray bytes out."""

    @F.pandas_udf("binary")
    def enhance(content: pd.Series) -> pd.Series:
        pics = (decode(c, raw_width) for c in content)
        return pd.Series([None if a is None else denoise(clahe(a)).tobytes() for a in pics])

    return enhance


def grid_hash(grid: Column) -> Column:
    """64 bits of an array of 64 numbers against their median, first bit highest, native."""
    half = lambda s: (F.get(s, F.lit(31)) + F.get(s, F.lit(32))) / 2

    def spell(mid: Column) -> Column:
        bits = F.transform(grid, lambda v: F.when(v > mid, F.expr("1L")).otherwise(F.expr("0L")))
        return F.aggregate(bits, F.expr("0L"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))

    return let(let(F.array_sort(grid), half), spell)
