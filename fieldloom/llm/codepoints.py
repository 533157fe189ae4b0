"""Texts of a batch as one array of code points, and what can be counted on it at once.

All texts of a slice are laid end to end, each closed by a line break, so that words and lines never reach from one
text into the next. Character classes are one table look-up; words, lines and segments are differences of running
counts. A text is never cut: a slice holds whole texts, and a very long one is a slice of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np

from fieldloom.functions.folding import ACCENTED, BARE

SPACE, BREAK, LETTER, NUMBER, MARK = 1, 2, 4, 8, 16
SLICE_CHARS = 1 << 18  # characters of a slice, about
# The characters that end a line.
BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"
_PLANE = 0x10000


def _class_of(c: str) -> int:
    if c in BREAKS:
        return BREAK
    if c in " \t":
        return SPACE
    k = unicodedata.category(c)
    return {"L": LETTER, "N": NUMBER, "M": MARK}.get(k[0], SPACE if k == "Zs" else 0)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and folded letter (lower case, no accent) of every character of the first plane."""
    kind = np.fromiter((_class_of(chr(i)) for i in range(_PLANE)), np.uint8, _PLANE)
    bare = dict(zip(ACCENTED, BARE, strict=True))
    low = (chr(i).lower()[0] for i in range(_PLANE))
    fold = np.fromiter((ord(bare.get(c, c)) for c in low), np.uint32, _PLANE)
    return kind, fold


@lru_cache(1)
def _spread() -> np.ndarray:
    """A 64-bit number for every 16-bit one, for hashes."""
    x = np.arange(_PLANE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers() -> list[np.ndarray]:
    return [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """The first ``n`` or more powers of the hash's base."""
    held = _powers()
    if len(held[0]) < n:
        held[0] = np.concatenate([[np.uint64(1)], np.full(2 * n, np.uint64(0xD6E8FEB86659FD93)).cumprod()])
    return held[0]


def word_hash(word: str) -> int:
    """The hash that ``Codes.word_hashes`` gives a word of letters."""
    codes = Codes([word])
    return int(codes.word_hashes[0]) if len(codes.word_hashes) else 0


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """From and to of runs of texts with about SLICE_CHARS characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def running(flags: np.ndarray) -> np.ndarray:
    """Counts before each place and after the last."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:], dtype=np.int32)
    return out


def between(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Set flags from each place of ``a`` up to that of ``b``, b left out; the stretches ascend and do not overlap."""
    if not len(a):
        return np.zeros(0, np.int64)
    pairs = np.empty(2 * len(a), np.int64)
    pairs[::2], pairs[1::2] = a, b
    sums = np.add.reduceat(np.append(flags.view(np.uint8), np.uint8(0)), pairs, dtype=np.int64)[::2]
    return np.where(a < b, sums, 0)


def edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of set flags begin, and where they end (the place after)."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    at = np.flatnonzero(padded[1:] != padded[:-1])
    return at[::2], at[1::2]


class Codes:
    """Texts as code points (``u``) with their classes (``kind``), and without marks and case as ``folded``."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, self.n)
        self.u = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)])
        kind, fold = _tables()
        self.kind = kind.take(self.u, mode="clip")
        letters = fold.take(self.u, mode="clip")
        for i in np.flatnonzero(self.u >= _PLANE):  # rare: other planes
            c = chr(self.u[i])
            self.kind[i], letters[i] = _class_of(c), ord(c.lower()[0])
        marks = (self.kind & MARK) != 0
        if marks.any():
            keep = ~marks
            self.folded, self.folded_kind = letters[keep], self.kind[keep]
            self.folded_start = self.start - running(marks)[self.start]
        else:
            self.folded, self.folded_kind, self.folded_start = letters, self.kind, self.start

    def has(self, kinds: int) -> np.ndarray:
        return (self.kind & kinds) != 0

    def folded_has(self, kinds: int) -> np.ndarray:
        return (self.folded_kind & kinds) != 0

    def one_of(self, chars: str) -> np.ndarray:
        return one_of(self.u, chars)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Set flags of each text; ``flags`` is along ``u`` or along ``folded``."""
        start = self.start if len(flags) == len(self.u) else self.folded_start
        return np.add.reduceat(flags.view(np.uint8), start[:-1], dtype=np.int64) if self.n else np.zeros(0, np.int64)

    def owner(self, at: np.ndarray, folded: bool = False) -> np.ndarray:
        """The text that each of the ascending places ``at`` belongs to."""
        start = self.folded_start if folded else self.start
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(at, start)))

    @cached_property
    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Words: runs without white space in the folded text, as places from and to."""
        return edges(~self.folded_has(SPACE | BREAK))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters in the folded text, as places from and to."""
        return edges(self.folded_has(LETTER))

    @cached_property
    def word_owner(self) -> np.ndarray:
        return self.owner(self.words[0], folded=True)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        a, b = self.words
        if not len(a):
            return np.zeros(0, np.uint64)
        sizes = b - a
        first = np.cumsum(sizes) - sizes
        letters = self.folded[self.folded_has(LETTER)]
        place = np.arange(len(letters)) - np.repeat(first, sizes)
        spread = _spread()
        value = spread.take(letters & np.uint32(0xFFFF)) + (letters >> np.uint32(16)).astype(np.uint64)
        return np.add.reduceat(value * powers(int(sizes.max())).take(place), first)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines that are not blank: from, to, first and last place with ink, and the text each belongs to."""
        ends = np.flatnonzero(self.has(BREAK))
        begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        ink = ~self.has(SPACE | BREAK)
        count, where = running(ink), np.flatnonzero(ink)
        full = count[ends] > count[begins]
        begins, ends = begins[full], ends[full]
        return begins, ends, where[count[begins]], where[count[ends] - 1], self.owner(begins)


def one_of(u: np.ndarray, chars: str) -> np.ndarray:
    """Which code points are among ``chars`` (all of the first plane)."""
    table = np.zeros(max(map(ord, chars)) + 2, bool)
    table[[ord(c) for c in chars]] = True
    return table.take(u, mode="clip")
