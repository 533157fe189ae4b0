"""Boxes and points as native column formulas. A box is a struct of doubles x1, y1, x2, y2 unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.text import let

# The size of a rectified card in pixels.
CARD_WIDTH, CARD_HEIGHT = 856, 540


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def from_array(a: Column, layout: str = "xyxy") -> Column:
    """A box from an array of four numbers; null if it has another size."""
    if layout not in ("xyxy", "xywh"):
        raise ValueError(f"unknown layout {layout}")
    v = [F.get(a, F.lit(i)).cast("double") for i in range(4)]
    return F.when(F.size(a) == 4, box(*v) if layout == "xyxy" else from_xywh(*v))


def corners(b: Column) -> Column:
    """Top left, top right, bottom right, bottom left."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(pt(b.x1, b.y1), pt(b.x2, b.y1), pt(b.x2, b.y2), pt(b.x1, b.y2))


def width(b: Column) -> Column:
    return F.greatest(F.lit(1.0), b.x2 - b.x1)


def height(b: Column) -> Column:
    return F.greatest(F.lit(1.0), b.y2 - b.y1)


def clamp(b: Column, w: Column, h: Column, least_end: float = 0.0) -> Column:
    """A box within a picture: starts within [0, size - 1], ends within [least_end, size]; an empty side gets one pixel."""

    def side(lo: Column, hi: Column, size: Column) -> tuple[Column, Column]:
        a = F.greatest(F.lit(0.0), F.least(lo, F.greatest(F.lit(0.0), size - 1.0)))
        z = F.greatest(F.lit(least_end), F.least(hi, size))
        return a, F.when(z <= a, F.least(size, a + 1.0)).otherwise(z)

    w, h = w.cast("double"), h.cast("double")
    x1, x2 = side(b.x1, b.x2, w)
    y1, y2 = side(b.y1, b.y2, h)
    return box(x1, y1, x2, y2)


def pad(b: Column, w: Column, h: Column, ratio: float, least: float = 0.0) -> Column:
    """A box grown by a share of its sides on every side, and clamped. With ``least``, by so many pixels at least."""
    dw, dh = (F.greatest(F.lit(least), (b.x2 - b.x1) * ratio), F.greatest(F.lit(least), (b.y2 - b.y1) * ratio)) if least else (width(b) * ratio, height(b) * ratio)
    return clamp(box(b.x1 - dw, b.y1 - dh, b.x2 + dw, b.y2 + dh), w, h, 1.0)


def expand(b: Column, w: Column, h: Column, inline: Column) -> Column:
    """The part of a picture to read again for a value found in box ``b``: padded by its sides, inline values wider."""
    dx = F.greatest(F.lit(4.0), width(b) * F.when(inline, 0.08).otherwise(0.05))
    dy = F.greatest(F.lit(4.0), height(b) * 0.30)
    return clamp(box(b.x1 - dx, b.y1 - dy, b.x2 + dx, b.y2 + dy), w, h)


def pixel_window(b: Column) -> Column:
    """Whole pixels of a crop: rounded half to even, not negative, one pixel at least."""
    r = lambda v: F.bround(v).cast("int")
    x1, y1 = F.greatest(F.lit(0), r(b.x1)), F.greatest(F.lit(0), r(b.y1))
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.greatest(x1 + 1, r(b.x2)).alias("x2"), F.greatest(y1 + 1, r(b.y2)).alias("y2"))


def area_xywh(w: Column, h: Column) -> Column:
    return w * h


def iou_xywh(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x, y, w, h); 0 if they are apart or have no area."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    iw = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    ih = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    inter = F.greatest(F.lit(0.0), iw) * F.greatest(F.lit(0.0), ih)
    return F.coalesce(F.when(inter > 0, F.try_divide(inter, aw * ah + bw * bh - inter)), F.lit(0.0))


def yolo(x: Column, y: Column, w: Column, h: Column, pw: Column, ph: Column) -> Column:
    """Centre and size as shares of the picture, each within [0, 1]."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return F.struct(unit((x + w / 2) / pw).alias("cx"), unit((y + h / 2) / ph).alias("cy"), unit(w / pw).alias("w"), unit(h / ph).alias("h"))


def bounds(points: Column) -> Column:
    """The box around an array of points (arrays of two numbers); null if there are fewer than two."""
    at = lambda i: F.transform(points, lambda p: F.get(p, F.lit(i)).cast("double"))
    return F.when(F.size(points) >= 2, box(F.array_min(at(0)), F.array_min(at(1)), F.array_max(at(0)), F.array_max(at(1))))


def order_points(points: Column) -> Column:
    """Four points (structs x, y) as top left, top right, bottom right, bottom left: by sum and by difference."""
    key = lambda f, sign: F.array_min(F.transform(points, lambda p, i: F.struct((f(p) * sign).alias("k"), i.alias("i"), p.alias("p")))).p
    total, delta = (lambda p: p.x + p.y), (lambda p: p.y - p.x)
    return F.array(key(total, 1), key(delta, 1), key(total, -1), key(delta, -1))


def to_card(b: Column, source: Column, w: int = CARD_WIDTH, h: int = CARD_HEIGHT) -> Column:
    """A box of the photograph in the card rectified from the upright box ``source``: the homography's closed form."""
    sx, sy = (w - 1) / (source.x2 - source.x1), (h - 1) / (source.y2 - source.y1)
    moved = box((b.x1 - source.x1) * sx, (b.y1 - source.y1) * sy, (b.x2 - source.x1) * sx, (b.y2 - source.y1) * sy)
    return let(moved, lambda m: clamp(m, F.lit(w), F.lit(h)))


def rect_matrix(source: Column, w: int = CARD_WIDTH, h: int = CARD_HEIGHT) -> Column:
    """The 3 x 3 homography from an upright box to the card, row by row."""
    sx, sy = (w - 1) / (source.x2 - source.x1), (h - 1) / (source.y2 - source.y1)
    z, one = F.lit(0.0), F.lit(1.0)
    return F.array(sx, z, -source.x1 * sx, z, sy, -source.y1 * sy, z, z, one)


def project(points: Column, matrix: Column) -> Column:
    """Points (arrays of two numbers) under a 3 x 3 map given row by row."""
    m = [F.get(matrix, F.lit(i)) for i in range(9)]
    row = lambda p, k: m[k] * F.get(p, F.lit(0)) + m[k + 1] * F.get(p, F.lit(1)) + m[k + 2]
    return F.transform(points, lambda p: F.array(row(p, 0) / row(p, 6), row(p, 3) / row(p, 6)))


def vertical_gap(upper: Column, lower: Column) -> Column:
    return lower.y1 - upper.y2


def overlap_share(a: Column, b: Column) -> Column:
    """Common width by the narrower width."""
    return F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) / F.least(width(a), width(b))


def can_merge(a: Column, b: Column) -> Column:
    """Whether two lines belong to one block: close below each other and overlapping or flush left."""
    near = vertical_gap(a, b) <= F.greatest(F.lit(18.0), F.greatest(height(a), height(b)) * 1.2)
    flush = F.abs(a.x1 - b.x1) <= F.greatest(width(a), width(b)) * 0.40
    return near & ((overlap_share(a, b) >= 0.10) | flush)


def inline_box(b: Column, line: Column, value: Column) -> Column:
    """Where in a line's box its value begins, by characters before a colon or by words, at least 4 pixels wide."""
    n_words = lambda c: F.size(F.filter(F.split(F.trim(c), " +"), lambda w: w != ""))
    by_colon = (F.instr(line, ":") - 1) / F.greatest(F.lit(1), F.length(line)) - 0.03
    by_words = F.greatest(F.lit(0), n_words(line) - n_words(value)) / F.greatest(F.lit(1), n_words(line)) - 0.02
    start = F.greatest(F.lit(0.18), F.least(F.lit(0.92), F.when(line.contains(":"), by_colon).otherwise(by_words)))
    return box(F.least(b.x2 - 4.0, b.x1 + width(b) * start), b.y1, b.x2, b.y2)


def legacy_window(x: Column, y: Column, w: Column, h: Column, pw: Column, ph: Column, margin: int = 4, least: int = 10) -> Column:
    """The old crop: whole pixels cut off, a margin on each side, within the picture; null if a side is under ``least``."""
    i = lambda v: v.cast("int")
    x1, y1 = F.greatest(F.lit(0), i(x) - margin), F.greatest(F.lit(0), i(y) - margin)
    x2, y2 = F.least(i(pw), i(x + w) + margin), F.least(i(ph), i(y + h) + margin)
    return F.when((x2 - x1 >= least) & (y2 - y1 >= least), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


# The band of a field's crop that holds its text (top, bottom), and fields that may be trimmed on the left.
BANDS = {"full_name": (0.16, 0.86), "place_of_origin": (0.16, 0.84), "place_of_residence": (0.18, 0.90), "date_of_birth": (0.10, 0.90), "id_number": (0.10, 0.92)}
TRIMMED = ("full_name", "place_of_origin", "place_of_residence")


def ratio_window(w: Column, h: Column, top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """A window of a picture by shares of its sides, in whole pixels, one at least."""
    cut = lambda size, share: F.bround(size * share).cast("int")
    y1 = F.greatest(F.lit(0), F.least(h - 1, cut(h, top)))
    x1 = F.greatest(F.lit(0), F.least(w - 1, cut(w, left)))
    y2, x2 = F.greatest(y1 + 1, F.least(h, cut(h, bottom))), F.greatest(x1 + 1, F.least(w, cut(w, right)))
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def test_windows(w: Column, h: Column, field: Column) -> Column:
    """Windows of a crop to read besides the whole: array of (name, window); the middle band, the left trim if wide."""
    one = F.lit(1.0)
    zero = F.lit(0.0)
    entry = lambda name, win: F.struct(F.lit(name).alias("name"), win.alias("window"))
    top = bottom = F.lit(None).cast("double")
    for f, (a, b) in BANDS.items():
        top, bottom = F.when(field == f, a).otherwise(top), F.when(field == f, b).otherwise(bottom)
    band = F.when(top.isNotNull(), entry("center_band", ratio_window(w, h, top, bottom, zero, one)))
    trim = F.when(field.isin(*TRIMMED) & (w >= h * 2.2), entry("left_trim", ratio_window(w, h, zero, one, F.lit(0.08), F.lit(0.98))))
    return F.filter(F.array(entry("base", ratio_window(w, h, zero, one, zero, one)), band, trim), lambda e: e.isNotNull())


def reading_size(w: Column, h: Column, pad_w: float, pad_h: float, least_pad: int, least_h: Column) -> Column:
    """Padding and scale that a recogniser's input gets: pad_x, pad_y, scale, width, height."""
    px = F.greatest(F.lit(least_pad), F.bround(w * pad_w).cast("int"))
    py = F.greatest(F.lit(least_pad), F.bround(h * pad_h).cast("int"))
    scale = F.greatest(F.lit(1.0), least_h / F.greatest(F.lit(1), h + py * 2))
    size = lambda v: F.bround(v * scale).cast("int")
    return F.struct(px.alias("pad_x"), py.alias("pad_y"), scale.alias("scale"), size(w + px * 2).alias("width"), size(h + py * 2).alias("height"))


def unmap_points(points: Column, scale: Column, pad_x: Column, pad_y: Column, w: Column, h: Column) -> Column:
    """Points of a recogniser's input back in the crop: scale and padding undone, within the picture."""
    back = lambda v, p, size: F.greatest(F.lit(0.0), F.least(v / F.greatest(scale, F.lit(1e-6)) - p, F.greatest(F.lit(0.0), size - 1.0)))
    return F.transform(points, lambda p: F.array(back(F.get(p, F.lit(0)), pad_x, w), back(F.get(p, F.lit(1)), pad_y, h)))
