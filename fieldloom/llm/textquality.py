"""Problem 8: per-document text statistics and text types learned from them without labels.

Every text is read whole, in Arrow batches laid out as code points (``codepoints``), and all statistics are counted in
one pass. Each labelling function is one statistic with two thresholds, so it says low, middle or high. How often each
function says what for each kind of text is learned by expectation-maximization on how the functions agree (the
latent-class model of Dawid and Skene with a full table of outcomes for each function). A type has one kind or more:
junk, for one, is repeated, shuffled, garbled or made of symbols, and each way agrees with itself only. Kinds start
from what their name says about a few functions and nothing about the others; the posterior of a type is the sum over
its kinds. EM runs on the counts of distinct outcome vectors, of which there are at most 3 ** 12, whatever the corpus.

One statistic needs the corpus: whether neighbouring words belong together. The most frequent words of the corpus and
one class for all others make a table of fixed size, counted over all documents; a text's mean association of
neighbours is high for sentences, however they are cased, accented or wrapped, and low for shuffled words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.folding import strip_accents
from fieldloom.llm.codepoints import BREAK, LETTER, MARK, NUMBER, SPACE, Codes, between, one_of, slices, word_hash

TYPES = ("prose", "list", "table", "junk")
TOP_WORDS = 400  # words with a row of their own in the table of neighbours
CHAR_LAGS, WORD_LAGS = 12, 8  # how far back a character or a word is looked for, for repetition

# Characters of line shapes.
BULLETS = "-*•·—–▪●◦‣>+"
LINE_ENDS = ".!?…:;,)\"'”»"
# High Latin-1 letters and what follows them where bytes of another encoding were read as characters.
BYTE_HEADS = "ÂÃÄÅÆáâãïð"
BYTE_TAILS = "".join(map(chr, [*range(0x80, 0xC0), 0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0x192, 0x2C6, 0x2DC, *range(0x2013, 0x2123)]))

STATISTICS = {
    "n_words": "int", "mean_word_length": "double", "symbol_ratio": "double", "punctuated_lines": "double", "common_share": "double", "n_lines": "int",
    "list_share": "double", "table_share": "double", "short_share": "double", "digit_ratio": "double", "repetition": "double", "mixed_words": "double",
    "letter_run": "double", "garbled": "double", "sentence_ends": "double", "bond": "double",
}


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _sums(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=weight, minlength=n)


def _after(flags: np.ndarray, by: int = 1) -> np.ndarray:
    """What stands ``by`` places further on."""
    out = np.zeros_like(flags)
    out[:-by] = flags[by:]
    return out


def _gaps(space: np.ndarray) -> np.ndarray:
    """Where a run of three spaces or more begins."""
    return space & _after(space) & _after(space, 2) & ~np.concatenate([[False], space[:-1]])


def _listed(c: Codes) -> np.ndarray:
    """Lines that begin with a bullet, a box, a number or a letter of a list and go on after white space."""
    _, ends, first, _, _ = c.lines
    u = np.concatenate([c.u, np.full(8, 10, np.uint32)])
    space = one_of(u, " \t") | np.concatenate([c.has(SPACE), np.zeros(8, bool)])
    digit = (u >= 48) & (u <= 57)
    letter = ((u | 32) >= 97) & ((u | 32) <= 122)
    closes = one_of(u, ".)")
    at = first + (u[first] == ord("("))
    d1 = digit[at]
    d2 = d1 & digit[at + 1]
    d3 = d2 & digit[at + 2]
    after_number = at + d1 + d2 + d3
    numbered = d1 & closes[after_number] & space[after_number + 1]
    lettered = letter[first] & closes[first + 1] & space[first + 2]
    bullet = one_of(u, BULLETS)[first] & space[first + 1]
    inside = first + 1 + one_of(u, " xX")[first + 1]
    box = (u[first] == ord("[")) & (u[inside] == ord("]")) & space[inside + 1]
    # something other than white space follows within the line: its last ink lies behind the mark
    return (numbered | lettered | bullet | box) & (c.lines[3] > first + 1)


def _tabular(c: Codes) -> np.ndarray:
    """Lines made of cells: parted by tabs, pipes, wide gaps, tight commas or semicolons, names with values, or one object; symbols alone are no cells."""
    _, _, first, last, _ = c.lines
    space, tight = c.has(SPACE), ~c.has(SPACE | BREAK)

    def of(flags: np.ndarray) -> np.ndarray:
        """Set flags between the first and the last ink of each line, both included."""
        return between(flags, first, last + 1)

    cut = lambda x: of((c.u == ord(x)) & _after(tight))
    named = (of((c.u == ord(":")) & _after(space)) == 1) & (of(space) <= 3) & (last - first < 64)
    whole = one_of(c.u, "{[")[first] & one_of(c.u, "}],")[last]
    cells = (of(c.u == 9) > 0) | (of(c.u == ord("|")) > 1) | (of(_gaps(space)) > 0) | (cut(",") > 1) | (cut(";") > 1) | (cut("=") > 1) | named | whole
    return cells & (3 * of(c.has(LETTER | NUMBER | MARK)) >= of(tight))


def _segments(c: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, ink in segments of at most four words, and in all; segments end at separators, wide gaps and sentence ends."""
    u, space = c.folded, c.folded_has(SPACE | BREAK)
    behind, before = _after(space), np.concatenate([[True], space[:-1]])
    gap = _gaps(c.folded_has(SPACE))
    ends = c.folded_has(BREAK) | one_of(u, ";|•,=\t") | gap | (one_of(u, ":.!?") & behind) | (one_of(u, "/–—-") & behind & before)
    body = c.folded_has(LETTER | NUMBER)
    starts = body & ~np.concatenate([[False], body[:-1]])
    to = np.flatnonzero(ends)
    at = np.concatenate([[0], to[:-1] + 1])
    size = between(~space, at, to).astype(np.float64)
    owner = c.owner(to, folded=True)
    return _sums(owner, size * (between(starts, at, to) <= 4), c.n), _sums(owner, size, c.n)


def _repetition(c: Codes) -> np.ndarray:
    """The largest share of characters that equal the one so far before, or of words that equal the word so far before."""
    ink = ~c.folded_has(SPACE | BREAK)
    whole = c.per_text(ink)
    best = np.zeros(c.n)
    start, end = c.folded_start[:-1], c.folded_start[1:]
    for lag in range(1, CHAR_LAGS + 1):
        same = np.zeros(len(ink), bool)
        np.equal(c.folded[lag:], c.folded[:-lag], out=same[lag:])
        same &= ink
        best = np.maximum(best, _share(between(same, np.minimum(start + lag, end), end), whole))
    h, owner = c.word_hashes, c.word_owner
    words = np.bincount(owner, minlength=c.n)
    for lag in range(1, WORD_LAGS + 1):
        same = (h[lag:] == h[:-lag]) & (owner[lag:] == owner[:-lag])
        best = np.maximum(best, _share(np.bincount(owner[lag:][same], minlength=c.n), words))
    return best


def measure(c: Codes, common: np.ndarray) -> dict[str, np.ndarray]:
    """All statistics but ``bond`` of each text; ``common``: hashes of the common words, ascending."""
    ink = ~c.has(SPACE | BREAK)
    solid = c.per_text(ink)
    token_from, token_to = c.tokens
    token_owner = c.owner(token_from, folded=True)
    n_words = np.bincount(token_owner, minlength=c.n)
    begins, ends, _, last, line_owner = c.lines
    size = (ends - begins).astype(np.float64)
    n_lines, chars = np.bincount(line_owner, minlength=c.n), _sums(line_owner, size, c.n)
    letter, number = c.folded_has(LETTER), c.folded_has(NUMBER)
    n_alpha = np.bincount(c.word_owner, minlength=c.n)
    known = _among(c.word_hashes, common)[0]
    mixed = (letter & _after(number)) | (number & _after(letter))
    space = c.has(SPACE | BREAK)
    stop = one_of(c.u, ".!?…") & (_after(space) | (one_of(np.append(c.u[1:], 0), "\"'”)") & _after(space, 2)))
    head, tail = one_of(c.u, BYTE_HEADS), one_of(c.u, BYTE_TAILS)
    short, ink_in_segments = _segments(c)
    return {
        "n_words": n_words,
        "mean_word_length": _share(_sums(token_owner, (token_to - token_from).astype(np.float64), c.n), n_words),
        "symbol_ratio": _share(c.per_text(ink & ~c.has(LETTER | NUMBER | MARK)), solid),
        "punctuated_lines": _share(_sums(line_owner, one_of(c.u, LINE_ENDS)[last].astype(np.float64), c.n), n_lines),
        "common_share": _share(np.bincount(c.word_owner[known], minlength=c.n), n_alpha),
        "n_lines": n_lines,
        "list_share": _share(_sums(line_owner, size * _listed(c), c.n), chars),
        "table_share": _share(_sums(line_owner, size * _tabular(c), c.n), chars),
        "short_share": _share(short, ink_in_segments),
        "digit_ratio": _share(c.per_text(c.has(NUMBER)), solid),
        "repetition": _repetition(c),
        "mixed_words": _share(c.per_text(mixed), n_words),
        "letter_run": _share(c.per_text(letter), n_alpha),
        "garbled": _share(c.per_text((head & _after(tail)) | (c.u == 0xFFFD)), n_words),
        "sentence_ends": _share(c.per_text(stop), n_words),
    }


def _among(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each hash is among the ascending ``wanted``, and its place there."""
    if not len(wanted):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.searchsorted(wanted, hashes).clip(max=len(wanted) - 1)
    return wanted[at] == hashes, at


def _shown(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))


def _over(docs: DataFrame, use: Callable[[Codes], pd.DataFrame]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches (k, t): ``use`` of every slice, with the key of the rows it names by ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                out = use(Codes(texts[a:b]))
                keys = batch.column(0).take(pa.array(out.pop("row").to_numpy() + a))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(out[x].to_numpy()) for x in out]], ["k", *out])

    return run


def common_hashes(common: DataFrame) -> np.ndarray:
    """Hashes of the common words, accents and case set aside: eight bytes a word of a word list, not of the corpus."""
    words = common.select(F.lower(strip_accents(F.lower("word"))).alias("w")).filter("w is not null").distinct()
    return np.unique(np.array([word_hash(r.w) for r in words.toLocalIterator()], np.uint64))


def _measured(c: Codes, common: np.ndarray) -> pd.DataFrame:
    m = measure(c, common)
    keep = np.flatnonzero(m["n_lines"] > 0)
    return pd.DataFrame({"row": keep} | {s: m[s][keep].astype(np.int32 if t == "int" else np.float64) for s, t in STATISTICS.items() if s in m})


def statistics(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of every row whose text is not null or blank: ``key``, the five of the problem and those that votes need.

    n_words, mean_word_length, symbol_ratio (of all characters that are no white space, those that are neither letter
    nor digit), punctuated_lines (share of lines that are not blank and end in punctuation), common_share (of words of
    letters, those of ``common``, accents and case set aside). A text without words has 0 for each share of words.
    Every statistic is counted for every text, over the whole of it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_hashes(common))
    own = [f"{s} {t}" for s, t in STATISTICS.items() if s != "bond"]
    run = _over(docs, lambda c: _measured(c, shared.value))
    return _shown(docs, key, text).mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, " + ", ".join(own)).withColumnRenamed("k", key)


def neighbours(docs: DataFrame, text: str = "text", top: int = TOP_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``top`` most frequent words, ascending, and the association of each pair of word classes.

    Counted over all documents. The table has (top + 1) squared cells; only it and the top words reach the driver.
    """
    shown = _shown(docs, text, text).select(F.lit(0).alias("k"), "t")

    def words(c: Codes) -> pd.DataFrame:
        h, n = np.unique(c.word_hashes, return_counts=True)
        return pd.DataFrame({"row": np.zeros(len(h), np.int64), "h": h.view(np.int64), "n": n})

    freq = shown.mapInArrow(_over(docs, words), "k int, h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    hashes = np.sort(np.array([r.h for r in freq.orderBy(F.desc("n"), "h").limit(top).collect()], np.int64).view(np.uint64))
    size = len(hashes) + 1

    def pairs(c: Codes) -> pd.DataFrame:
        x, owner = classes(c, hashes), c.word_owner
        inside = owner[1:] == owner[:-1]
        cell, n = np.unique((x[:-1] * size + x[1:])[inside], return_counts=True)
        return pd.DataFrame({"row": np.zeros(len(cell), np.int64), "cell": cell, "n": n})

    got = shown.mapInArrow(_over(docs, pairs), "k int, cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(size * size)
    table[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    table = table.reshape(size, size)
    return hashes, strengths(table)


def strengths(table: np.ndarray) -> np.ndarray:
    """How much oftener than by chance each pair of classes stands side by side (logarithm), one more occurrence on both sides.

    A pair does not vouch for itself, so one that was seen once counts as never seen.
    """
    chance = np.outer(table.sum(1), table.sum(0)) / max(table.sum(), 1.0)
    out = np.log((np.maximum(table - 1, 0) + 1.0) / (chance + 1.0)).clip(-4, 8).astype(np.float32)
    out[0, 0] = 0.0  # two words of the class of others tell nothing
    return out


def classes(c: Codes, hashes: np.ndarray) -> np.ndarray:
    """The class of each word: 1 + its place among ``hashes``, 0 for all other words."""
    known, at = _among(c.word_hashes, hashes)
    return np.where(known, at + 1, 0)


def bonds(c: Codes, hashes: np.ndarray, pmi: np.ndarray) -> np.ndarray:
    """Mean association of neighbouring words of each text; 0 for a text with fewer than two words."""
    x, owner = classes(c, hashes), c.word_owner
    inside = owner[1:] == owner[:-1]
    at = owner[1:][inside]
    return _share(_sums(at, pmi[x[:-1], x[1:]][inside].astype(np.float64), c.n), np.bincount(at, minlength=c.n))


# A labelling function: its statistic and two thresholds; it says 0 below the first, 2 from the second on, else 1.
# Shares of the text are cut at a half ("most of the text"); the others are round values that keep well apart what
# published quality rules for web text call normal and what they discard.
FUNCTIONS: dict[str, tuple[str, float, float]] = {
    "list_lines": ("list_share", 0.2, 0.5),
    "table_lines": ("table_share", 0.2, 0.5),
    "segments": ("short_share", 0.25, 0.5),
    "symbols": ("symbol_ratio", 0.1, 0.3),
    "digits": ("digit_ratio", 0.1, 0.2),
    "common": ("common_share", 0.05, 0.2),
    "repeats": ("repetition", 0.25, 0.5),
    "mixed": ("mixed_words", 0.1, 0.3),
    "word_length": ("mean_word_length", 2.5, 10.0),
    "neighbours": ("bond", 0.5, 1.0),
    "garbled": ("garbled", 0.05, 0.2),
    "sentence_ends": ("sentence_ends", 0.01, 0.2),
}
# A kind of text: its type, and what its name says about some of the functions. What it says first defines it and
# stays at least as sure as at first, so that no two kinds change places; all else is only where learning starts.
KINDS: dict[str, tuple[str, dict[str, int]]] = {
    "sentences": ("prose", {"neighbours": 2, "list_lines": 0, "table_lines": 0, "segments": 0, "common": 2, "repeats": 0, "garbled": 0, "word_length": 1}),
    "bulleted": ("list", {"list_lines": 2, "table_lines": 0, "garbled": 0}),
    "running_list": ("list", {"segments": 2, "list_lines": 0, "table_lines": 0, "symbols": 0, "digits": 0, "mixed": 0, "garbled": 0, "word_length": 1}),
    "cells": ("table", {"table_lines": 2, "list_lines": 0, "segments": 2, "garbled": 0}),
    "repeated": ("junk", {"repeats": 2, "list_lines": 0, "table_lines": 0, "segments": 0}),
    "symbols": ("junk", {"symbols": 2, "common": 0, "table_lines": 0, "list_lines": 0}),
    "shuffled": ("junk", {"neighbours": 0, "list_lines": 0, "table_lines": 0, "segments": 0, "symbols": 0, "digits": 0, "common": 2, "mixed": 0, "word_length": 1, "garbled": 0, "repeats": 0}),
    "random": ("junk", {"mixed": 2, "common": 0, "neighbours": 0, "list_lines": 0, "table_lines": 0}),
    "encoded": ("junk", {"word_length": 2, "common": 0, "table_lines": 0, "list_lines": 0}),
    "bytes": ("junk", {"garbled": 2, "common": 0, "list_lines": 0, "table_lines": 0}),
}
OUTCOMES = 3
SURE = 0.95  # how often a kind's functions say at first what its name says
PRIOR = 0.02  # weight of a kind's first table against what it learns, as a share of all texts


def votes(stats: DataFrame) -> DataFrame:
    """``stats`` and votes: a digit for each labelling function."""
    said = [F.when(F.col(s) < lo, "0").when(F.col(s) < hi, "1").otherwise("2") for s, lo, hi in FUNCTIONS.values()]
    return stats.withColumn("votes", F.concat(*said))


def first_tables() -> np.ndarray:
    """P(outcome | kind) of each function before anything is learned: kinds x functions x outcomes."""
    out = np.full((len(KINDS), len(FUNCTIONS), OUTCOMES), 1.0 / OUTCOMES)
    for i, (_, says) in enumerate(KINDS.values()):
        for j, f in enumerate(FUNCTIONS):
            if f in says:
                out[i, j] = (1 - SURE) / (OUTCOMES - 1)
                out[i, j, says[f]] = SURE
    return out


def digits(vectors: list[str]) -> np.ndarray:
    return np.array([[int(c) for c in v] for v in vectors], np.int64).reshape(len(vectors), len(FUNCTIONS))


def posteriors(x: np.ndarray, shares: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """P(kind | vector), vectors x kinds."""
    lp = np.tile(np.log(shares), (len(x), 1))
    for j in range(x.shape[1]):
        lp += np.log(tables[:, j, :]).T[x[:, j]]
    p = np.exp(lp - lp.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(vectors: dict[str, int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the kinds and P(outcome | kind) of each function, by EM on the counts of outcome vectors.

    Both keep a prior that grows with the number of texts, so a corpus and ten copies of it are judged alike.
    """
    shares, tables = np.full(len(KINDS), 1.0 / len(KINDS)), first_tables()
    if not vectors:
        return shares, tables
    x, n = digits(list(vectors)), np.array(list(vectors.values()), np.float64)
    first, n = first_tables(), n / n.sum()
    prior = first * PRIOR
    defined = [(i, list(FUNCTIONS).index(f), says[f]) for i, (_, says) in enumerate(KINDS.values()) for f in list(says)[:1]]
    for _ in range(rounds):
        w = posteriors(x, shares, tables) * n[:, None]
        shares = (w.sum(0) + PRIOR / len(KINDS)) / (1 + PRIOR)
        seen = np.stack([[np.bincount(x[:, j], weights=w[:, i], minlength=OUTCOMES) for j in range(x.shape[1])] for i in range(len(KINDS))])
        following = (seen + prior) / (seen + prior).sum(2, keepdims=True)
        for i, j, says in defined:
            if following[i, j, says] < SURE:
                following[i, j] = first[i, j]
        still = np.abs(following - tables).max() < 1e-6
        tables = following
        if still:
            break
    return shares, tables


def by_type(kinds: np.ndarray) -> np.ndarray:
    """Posteriors of the types from those of the kinds."""
    return np.stack([kinds[:, [k == t for k, _ in KINDS.values()]].sum(1) for t in TYPES], 1)


def text_types(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, votes, posteriors (p_prose, p_list, p_table, p_junk) and the likeliest text_type of every text.

    Null, empty and blank texts give no row; rows with one key are judged each for itself; an empty table gives no row.
    """
    from fieldloom.runtime import materialize

    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((common_hashes(common), *neighbours(docs, text)))  # a word list and a table of fixed size

    def judged(c: Codes) -> pd.DataFrame:
        words, hashes, pmi = shared.value
        out = _measured(c, words)
        return out.assign(bond=bonds(c, hashes, pmi)[out["row"].to_numpy()])

    schema = f"k {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{s} {t}" for s, t in STATISTICS.items())
    voted = materialize(votes(_shown(docs, key, text).mapInArrow(_over(docs, judged), schema).withColumnRenamed("k", key)), "votes")
    vectors = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # 3 ** 12 at most
    p = by_type(posteriors(digits(list(vectors)), *fit(vectors)))
    rows = [(v, *map(float, q), TYPES[int(q.argmax())]) for v, q in zip(vectors, p, strict=True)]
    known = docs.sparkSession.createDataFrame(rows, "votes string, " + ", ".join(f"p_{t} double" for t in TYPES) + ", text_type string")
    return voted.join(F.broadcast(known), "votes")


def found(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id of documents that are likelier a list, a table or junk than prose."""
    return text_types(docs, common).filter("text_type <> 'prose'").select("doc_id")
