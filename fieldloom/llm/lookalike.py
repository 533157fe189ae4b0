"""Problem 3: one written form for values that look alike.

A value in plain form (printable ASCII and composed Vietnamese letters) is left as it is by a native regex test and
never reaches Python. The others go through: deletion of ignorable characters, compatibility normalization (NFKC),
plain spaces, and, for each word that still has a character beyond plain form, a search of its look-alike lattice:
every such character may stay or become a look-alike plain character, and Viterbi takes the path with the best
score, which adds the log-probabilities of neighbouring characters, counted over all plain words of the corpus, and
of staying in one script. A word wholly in another script stays if it, or another word of the value in that script,
has a letter that no plain one looks like.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.folding import vietnamese_letters

# Letters and marks of other scripts, each followed by the plain character that it looks like.
LOOKALIKES = {
    "cyrillic": "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԜW ҮY аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv кk",
    "cyrillic digits": "З3 б6",
    "greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa ιi κk νv οo ρp τt υu χx γy",
    "armenian": "հh սu ցg օo ոn զq յj ՕO ՍU ՏS ԼL",
    "cherokee": "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏙV ᏚS ᏟC ᏢP ᏦK ᏞL ᏴB ᎨF",
    "latin": "ÐĐ ƉĐ ðđ ɖđ ɑa ɡg ıi ɩi ʏy",
    "punctuation": "‚, ،, ٫, ∕/ ⁄/ ╱/ ‐- ‑- ‒- –- —- ―- −- ‘' ’' ‛' ′' ʼ' ʹ' “\" ”\" „\" ‟\" ″\" ǃ! ∶: ։: ․. ∗* ⁎* ‹< ›> ∼~",
}
TABLE = {pair[0]: pair[1] for line in LOOKALIKES.values() for pair in line.split()}

LETTERS = vietnamese_letters()
PLAIN = f"[ -~{LETTERS}]"
# Spark's side of the test: anything beyond plain form.
NOT_PLAIN = f"[^ -~{LETTERS}]"
_PLAIN_SET = frozenset(chr(c) for c in range(32, 127)) | frozenset(LETTERS)
# Invisible characters that are no format characters (category Cf).
_INVISIBLE = frozenset("͏ᅟᅠ឴឵ㅤﾠ") | frozenset(map(chr, range(0xFE00, 0xFE10)))
_SWITCH = 6.0  # cost of a neighbour in another script
_STAY = 3.0  # cost of a character of another script that has a plain look-alike
_UNSEEN = math.log(1e-6)


@lru_cache(maxsize=8192)
def script(c: str) -> str:
    """L for Latin, the first word of the Unicode name for other letters, '' for what belongs to no script."""
    if c in _PLAIN_SET:
        return "L" if c.isalpha() else ""
    if not unicodedata.category(c[0]).startswith("L"):
        return ""
    name = unicodedata.name(c[0], "?").split()[0]
    return "L" if name == "LATIN" else name


@lru_cache(maxsize=8192)
def ignorable(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind == "Cf" or c in _INVISIBLE or (kind == "Cc" and not c.isspace())


@lru_cache(maxsize=8192)
def alternatives(cluster: str) -> tuple[str, ...]:
    """Plain characters that a base with its marks may stand for; the first choice is the table's."""
    if cluster in TABLE:
        return (TABLE[cluster],)
    d = unicodedata.normalize("NFD", cluster)
    base, marks = d[0], d[1:]
    plain = TABLE.get(base, base if base in _PLAIN_SET else None)
    if plain is None:
        name = unicodedata.name(base, "")
        if name.startswith("LATIN LETTER SMALL CAPITAL ") and len(name.split()[-1]) == 1:
            plain = name.split()[-1].lower()
    if plain is None:
        return ()
    whole = ordered(unicodedata.normalize("NFC", plain + marks))
    return (whole,) if len(whole) == 1 and whole in _PLAIN_SET else ()


# A look-alike letter may as well be a digit of the same shape; the neighbours decide.
_ALSO = {"O": "0", "o": "0", "I": "1", "S": "5", "B": "8", "Z": "2"}


def clusters(word: str) -> list[str]:
    out: list[str] = []
    for c in word:
        if out and unicodedata.combining(c):
            out[-1] += c
        else:
            out.append(c)
    return out


# Marks that change a Vietnamese vowel's shape; they go before the tone mark.
_SHAPES = "\u0302\u0306\u031b"


def ordered(text: str) -> str:
    """Composed form with shape marks before tone marks and repeated marks once, however they were typed."""
    if not any(unicodedata.combining(c) for c in text):
        return text
    out = []
    for c in clusters(text):
        if len(c) > 1:
            d = unicodedata.normalize("NFD", c)
            marks = list(dict.fromkeys(d[1:]))
            c = unicodedata.normalize("NFC", d[0] + "".join([m for m in marks if m in _SHAPES] + [m for m in marks if m not in _SHAPES]))
        out.append(c)
    return "".join(out)


class Model:
    """Log-probabilities of neighbouring characters, case set aside."""

    def __init__(self, pairs: dict[str, int]):
        first: dict[str, int] = {}
        for k, n in pairs.items():
            first[k[0]] = first.get(k[0], 0) + n
        self.first, self.pairs = first, pairs

    def log(self, a: str, b: str) -> float:
        a, b = a.lower()[:1], b.lower()[:1]
        if a.isdigit():
            a = "9"
        if b.isdigit():
            b = "9"
        n = self.pairs.get(a + b, 0)
        return math.log((n + 0.02) / (self.first.get(a, 0) + 4.0)) if n or a in self.first else _UNSEEN


def viterbi(word: str, model: Model) -> str:
    """The best path through the word's lattice."""
    nodes = []
    for c in clusters(word):
        if c in _PLAIN_SET:
            nodes.append([(c, 0.0)])
            continue
        alt = alternatives(c)
        opts = [(a, 0.0) for a in alt] + [(_ALSO[a], -1.0) for a in alt if a in _ALSO and _ALSO[a] in _PLAIN_SET]
        nodes.append([*opts, (c, -_STAY if opts else 0.0)])
    best = [("^", "", 0.0, "")]  # last character, its script, score, text
    for opts in nodes:
        step = []
        for c, own in opts:
            s = script(c)
            top = None
            for last, before, score, text in best:
                x = score + own
                if s in ("", "L") and before in ("", "L"):
                    x += model.log(last, c)
                elif s and before and s != before:
                    x += _UNSEEN / 2 - _SWITCH
                else:
                    x += _UNSEEN / 3
                if top is None or x > top[2]:
                    top = (c, s or before, x, text + c)
            step.append(top)
        best = step
    return max(best, key=lambda x: x[2] + (model.log(x[0], "$") if x[1] in ("", "L") else _UNSEEN / 3))[3]


def plain_form(text: str, model: Model) -> str:
    """``text`` in plain form; extra plain spaces stay as they are."""
    t = "".join(c for c in text if not ignorable(c))
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", "".join(TABLE[c] if c in TABLE and not c.isalpha() else c for c in t)))
    t = ordered("".join(" " if c.isspace() else c for c in t if not ignorable(c)))
    if all(c in _PLAIN_SET for c in t):
        return t
    words = re.split("( +)", t)
    # scripts in which the value has a word with a letter that no plain one looks like: its other words in them stay too
    other = {_wholly(w) for w in words if any(not alternatives(c) for c in _letters(w))} - {""}
    return "".join(w if all(c in _PLAIN_SET for c in w) or _wholly(w) in other else viterbi(w, model) for w in words)


def _letters(w: str) -> list[str]:
    return [c for c in clusters(w) if unicodedata.category(c[0]).startswith("L")]


def _wholly(w: str) -> str:
    """The script other than Latin in which all letters of a word are; '' if there is none, or if it has digits."""
    scripts = {script(c) for c in _letters(w)}
    return next(iter(scripts)) if len(scripts) == 1 and "L" not in scripts and not any(c.isdigit() for c in w) else ""


PAIRS = "pair string, n long"


def character_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of neighbouring characters (``^`` and ``$`` at the ends, digits as 9, lower case) over all plain words.

    Rows: pair, n. There are at most (96 + 67 + 2) squared pairs, whatever the size of the corpus; each task sums
    its own before the shuffle.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = "".join("^" + v.lower().replace(" ", "$^") + "$" for v in pdf["v"])
            x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            if len(x) < 2:
                continue
            x[(x >= 48) & (x <= 57)] = 57
            keys, n = np.unique((x[:-1] << 21) | x[1:], return_counts=True)
            yield pd.DataFrame({"pair": [chr(k >> 21) + chr(k & 0x1FFFFF) for k in keys], "n": n.astype(np.int64)})

    long = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("v")).filter(F.col("v").isNotNull() & ~F.col("v").rlike(NOT_PLAIN))
    return long.mapInPandas(count, PAIRS).groupBy("pair").agg(F.sum("n").alias("n")).filter("pair not like '$%'")


def fit(df: DataFrame, columns: list[str]) -> Model:
    """The model of the corpus; the table it collects has a size bound (see ``character_pairs``)."""
    return Model({r.pair: r.n for r in character_pairs(df, columns).collect()})


def plain_udf(model: Model):
    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            if v not in known:
                if len(known) > 50_000:
                    known.clear()
                known[v] = plain_form(v, model)
            out.append(known[v])
        return pd.Series(out, dtype=object)

    return plain


def plain_column(c: Column, model: Model) -> Column:
    """``c`` in plain form; only values that are not plain already go to Python. Null stays null."""
    return F.coalesce(plain_udf(model)(F.when(c.rlike(NOT_PLAIN), c)), c)


def consistent(df: DataFrame, columns: list[str], model: Model | None = None) -> DataFrame:
    """``df`` with each of ``columns`` in its one form, runs of spaces made one and outer spaces dropped."""
    model = model or fit(df, columns)
    return df.withColumns({c: F.trim(F.regexp_replace(plain_column(F.col(c), model), " +", " ")) for c in columns})


def not_plain(df: DataFrame, key: str, columns: list[str], model: Model | None = None) -> DataFrame:
    """Values that hold a character to be replaced, joined or dropped: ``key``, field, value, plain.

    Null and blank values give no row; a value that its form leaves unchanged (a word of another script) neither.
    """
    model = model or fit(df, columns)
    long = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("e"))
    cand = long.select(key, "e.field", "e.value").filter(F.col("value").rlike(NOT_PLAIN))
    return cand.withColumn("plain", plain_udf(model)(F.col("value"))).filter("plain <> value")
