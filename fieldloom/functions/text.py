"""Text functions of document fields: Column -> Column, in native Spark.

Null counts as the empty text. A value that is used more than once in a formula is bound with ``let`` so that its
expression is built and evaluated once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.folding import ACCENTED, BARE

# Field names and the phrases printed on cards.
FIELDS = {"id": "id_number", "name": "full_name", "birth": "date_of_birth", "origin": "place_of_origin", "address": "place_of_residence", "title": "title"}
PLACES = ("place_of_origin", "place_of_residence")
LINE_FIELDS = ("full_name", *PLACES)
LABELS = {
    "full_name": ("ho va ten", "ho ten", "full name", "surname and name"),
    "place_of_origin": ("nguyen quan", "que quan", "place of origin", "origin"),
    "place_of_residence": ("noi dkhk thuong tru", "noi dk hk thuong tru", "noi thuong tru", "noi cu tru", "thuong tru", "dia chi", "place of residence", "residence", "address"),
}
HINTS = {
    "full_name": ("full", "name", "ho", "ten"),
    "place_of_origin": ("nguyen", "que", "quan", "origin", "place"),
    "place_of_residence": ("noi", "thuong", "tru", "cu", "residen", "address", "dkhk"),
}
DATE_RUN = r"(?<!\d)(\d{1,2}[\/\-.]\d{1,2}[\/\-.]\d{2,4})(?!\d)"
ID_RUN = r"(?:\d[\s\-./]?){9,14}\d"
EDGE = ":/-.,; "

WHITE = r"(?U)[\s\x1c-\x1f]+"
# Characters in these blocks are composed already.
_MAYBE_LOOSE = r"[^\x00-\u02ff\u1e00-\u1eff\u2000-\u20cf]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Composed form; only values with characters that may be decomposed go to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(_MAYBE_LOOSE), c)), c)


def collapse(c: Column) -> Column:
    """Runs of white space, no-break spaces included, made one space; none at the ends. The text must be composed."""
    return F.trim(F.regexp_replace(text(c), WHITE, " "))


def fold(c: Column) -> Column:
    """Lower case without accents; all but letters, digits, slash and colon made spaces. Ends are not trimmed."""
    x = F.translate(F.translate(F.lower(collapse(c)), "ð", " "), ACCENTED, BARE)
    return F.regexp_replace(F.regexp_replace(x, r"\p{Mn}+", ""), "[^a-z0-9/: ]+", " ")


def canonical_field(c: Column) -> Column:
    """Long name of a short field name; other names and null as they are."""
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), FIELDS.items(), F.when(F.lit(False), c)).otherwise(c)


def digits(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[^\p{Nd}]+", "")


def words(c: Column) -> Column:
    """Words of a text; none for an empty one."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def iso_date(c: Column) -> Column:
    """A date in one of five layouts as yyyy-mm-dd, null if it is none or no day of the calendar.

    Layouts: d/m/y, d-m-y, d.m.y, y-m-d and ddmmyyyy; day and month may have one digit, years have four.
    """
    day, month, year = r"(3[01]|[12]\d|0[1-9]|[1-9])", r"(1[0-2]|0[1-9]|[1-9])", r"(\d{4})"

    def parsed(x: Column) -> Column:
        orders = [(rf"^{day}{s}{month}{s}{year}$", (3, 2, 1)) for s in ("/", "-", r"\.")]
        orders += [(rf"^{year}-{month}-{day}$", (1, 2, 3)), (rf"^{day}{month}{year}$", (3, 2, 1))]
        tries = []
        for pattern, (y, m, d) in orders:
            part = lambda g, p=pattern: F.regexp_extract(x, p, g)
            iso = F.concat(F.lpad(part(y), 4, "0"), F.lit("-"), F.lpad(part(m), 2, "0"), F.lit("-"), F.lpad(part(d), 2, "0"))
            tries.append(F.when(x.rlike(pattern) & F.try_to_date(iso, "yyyy-MM-dd").isNotNull() & (part(y) != "0000"), iso))
        return F.coalesce(*tries)

    return let(collapse(c), parsed)


def field_form(c: Column, field: Column) -> Column:
    """The form in which values of a field are compared: digits, ISO date if it is one, collapsed text."""
    f = canonical_field(field)
    return F.when(f == "id_number", digits(c)).when(f == "date_of_birth", F.coalesce(iso_date(c), collapse(c))).otherwise(collapse(c))


def valid_id(c: Column) -> Column:
    return F.length(digits(c)) == 12


def valid_date(c: Column) -> Column:
    return iso_date(c).isNotNull()


def _by_field(table: dict[str, tuple], field: Column, value: Callable[[object], Column]) -> Column:
    """The entry of a small literal table; null for other fields."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*[value(e) for e in v]))]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(field, F.lit("")))


def _labels(field: Column) -> Column:
    """The field's printed labels as arrays of words, those of more words first."""
    longest_first = {k: tuple(sorted(v, key=lambda x: -len(x.split()))) for k, v in LABELS.items()}
    return _by_field(longest_first, field, lambda label: F.array(*[F.lit(w) for w in label.split()]))


def _tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, " +"), lambda w: w != "")


def _label_size(tokens: Column, field: Column) -> Column:
    """Words of the first of the field's labels that the words begin with; 0 if none."""

    def same(seen: Column, wanted: Column) -> Column:
        both = (F.length(seen) >= 3) & (F.length(wanted) >= 3)
        return (seen == wanted) | (both & (F.startswith(seen, wanted) | F.startswith(wanted, seen)))

    fits = lambda label: (F.size(tokens) >= F.size(label)) & F.forall(F.zip_with(label, F.slice(tokens, F.lit(1), F.size(label)), lambda w, t: same(t, w)), lambda ok: ok)
    hit = F.get(F.filter(_labels(field), fits), F.lit(0))
    return F.when(hit.isNull(), 0).otherwise(F.size(hit))


def label_words(c: Column, field: Column) -> Column:
    """How many words of the field's printed label the text begins with; 0 if it does not. Longer labels first.

    Words match if they are equal, or if one begins with the other and both have three characters or more.
    """
    known = F.coalesce(field.isin(*LABELS), F.lit(False))
    return F.when(known, let(_tokens(fold(c)), lambda t: _label_size(t, field))).otherwise(0)


def label_like(c: Column, field: Column) -> Column:
    """Whether a text looks like a printed label: it begins with one, or has enough of the field's hint words."""

    def judge(x: Column) -> Column:
        def with_fold(f: Column) -> Column:
            hits = F.size(F.filter(_by_field(HINTS, field, F.lit), lambda h: F.contains(f, h)))
            rule = lambda t: ((F.size(t) <= 10) & ((_label_size(t, field) > 0) | (hits >= 3))) | (F.endswith(x, F.lit(":")) & (hits >= 1)) | ((F.size(t) <= 6) & (hits >= 2))
            return let(_tokens(f), rule)

        return F.when((x == "") | ~F.coalesce(field.isin(*HINTS), F.lit(False)), False).otherwise(let(fold(x), with_fold))

    return let(collapse(c), judge)


def _after(x: Column, n: Column) -> Column:
    """The text without its first n words and the punctuation that then leads it."""
    w = F.split(x, " ")
    return F.when(F.size(w) <= n, "").otherwise(F.ltrim(F.array_join(F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0))), " "), F.lit(EDGE)))


def _split_colon(x: Column) -> tuple[Column, Column]:
    at = F.instr(x, ":")
    return F.substring(x, F.lit(1), at - 1), F.ltrim(F.trim(F.substring(x, at + 1, F.length(x))), F.lit(EDGE))


def strip_label(c: Column, field: Column, rounds: int = 4) -> Column:
    """The text without printed labels before its value, at most ``rounds`` of them.

    A part before a colon goes if it looks like a label and something follows; otherwise the words of a leading label.
    Rounds end with the first that changes nothing.
    """

    def step(x: Column) -> Column:
        left, right = _split_colon(x)
        by_words = let(label_words(x, field), lambda n: F.when(n > 0, _after(x, n)).otherwise(x))
        return F.when(x.contains(":") & label_like(left, field) & (right != ""), right).otherwise(by_words)

    def run(x: Column) -> Column:
        state = lambda v, go: F.struct(v.alias("x"), go.alias("go"))
        move = lambda s: F.when(s.go, let(step(s.x), lambda v: state(v, v != s.x))).otherwise(s)
        done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state(x, F.lit(True)), lambda s, _: move(s))
        return F.when((x == "") | ~F.coalesce(field.isin(*LABELS), F.lit(False)), x).otherwise(F.trim(done.x))

    return let(collapse(c), run)


def label_value(c: Column, field: Column) -> Column:
    """The value in a text that may begin with its label (fields read by lines only)."""

    def run(x: Column) -> Column:
        left, right = _split_colon(x)
        value = strip_label(F.when(x.contains(":") & label_like(left, field), right).otherwise(x), field)
        return F.when((x == "") | ~F.coalesce(field.isin(*LINE_FIELDS), F.lit(False)), x).otherwise(value)

    return let(collapse(c), run)


def pick_id(c: Column) -> Column:
    """The first run of twelve digits, else the longest of nine to fourteen (the first on ties); null if none.

    Digits of a run may be parted by one space, dash, dot or slash each.
    """
    runs = F.transform(F.regexp_extract_all(text(c), F.lit(ID_RUN), 0), lambda m: digits(m))

    def choose(a: Column) -> Column:
        exact = F.get(F.filter(a, lambda d: F.length(d) == 12), F.lit(0))
        longest = F.array_max(F.transform(F.filter(a, lambda d: F.length(d).between(9, 14)), lambda d: F.length(d)))
        return F.coalesce(exact, F.get(F.filter(a, lambda d: F.length(d) == longest), F.lit(0)))

    return let(runs, choose)


def pick_date(c: Column) -> Column:
    """The best date-like run: one that is a date before one that is not, then the longer, then the first; null if none."""
    runs = F.regexp_extract_all(text(c), F.lit(DATE_RUN), 1)
    rank = F.transform(runs, lambda m, i: F.struct((~valid_date(m)).cast("int").alias("a"), (-F.length(m)).alias("b"), i.alias("i"), m.alias("m")))
    return F.array_min(rank).m


def cleanup(c: Column, field: Column) -> Column:
    """The value of a field in a raw reading."""

    def run(x: Column) -> Column:
        def finish(v: Column) -> Column:
            return F.when((v == x) & label_like(x, field) & F.endswith(x, F.lit(":")), "").otherwise(F.trim(v))

        return (
            F.when(x == "", "")
            .when(field == "id_number", F.coalesce(pick_id(x), x))
            .when(field == "date_of_birth", F.coalesce(pick_date(x), x))
            .otherwise(let(label_value(x, field), finish))
        )

    return let(collapse(c), run)


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))


def digit_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{Nd}]+", ""))


def text_like(c: Column) -> Column:
    """A third or more of the characters are letters, at least one."""
    return (F.length(c) > 0) & (letters(c) >= F.greatest(F.lit(1), F.floor(F.length(c) / 3)))


def digit_heavy(c: Column, share: float = 0.45) -> Column:
    """Digits among letters and digits reach ``share``."""
    return F.coalesce(F.try_divide(digit_count(c), F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))) >= share, F.lit(False))


def digit_ratio(c: Column) -> Column:
    """Digits among all characters; 0 for the empty text."""
    return F.coalesce(F.try_divide(digit_count(c), F.length(c)), F.lit(0.0))


def repetitive(c: Column, least: int = 6) -> Column:
    """At least ``least`` words, with few distinct ones or a pair of neighbours that comes again."""

    def judge(w: Column) -> Column:
        n = F.size(w)
        pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return (n >= least) & ((F.size(F.array_distinct(w)) / n <= 0.65) | (F.size(F.array_distinct(pairs)) < n - 1))

    return F.coalesce(let(words(F.lower(c)), judge), F.lit(False))


def suspicious(c: Column, field: Column, cleaned: bool = False) -> Column:
    """Whether the cleaned value of a field can hardly be one. ``cleaned``: ``c`` is such a value already."""

    def judge(x: Column) -> Column:
        n = F.size(F.split(x, " "))
        place = (n == 1) | ((n <= 2) & ~x.contains(",") & (F.length(x) < 12)) | digit_heavy(x, 0.35) | repetitive(x) | ((F.length(x) >= 48) & (n <= 3))
        name = digit_heavy(x, 0.20) | repetitive(x, 4)
        return F.when(x == "", True).when(field.isin(*PLACES), place).when(field == "full_name", name).otherwise(False)

    return let(text(c) if cleaned else cleanup(c, field), judge)


def estimated_confidence(c: Column, field: Column, cleaned: bool = False) -> Column:
    """A confidence from the text alone, between 0 and 0.95."""
    cap = lambda v, top: F.least(v, F.lit(float(top)))
    off = lambda cond, by: F.when(cond, F.lit(-float(by))).otherwise(0.0)

    def score(x: Column) -> Column:
        n, k = F.length(x).cast("double"), F.size(F.split(x, " "))
        number = F.lit(0.45) + cap(F.length(digits(x)) / 12.0, 1) * 0.25 + F.when(valid_id(x), 0.25).otherwise(0.0)
        date = F.lit(0.45) + cap(n / 10.0, 1) * 0.10 + F.when(valid_date(x), 0.25).otherwise(0.0)
        marks = F.length(F.regexp_replace(x, r"[\p{L}\p{N}\s]+", ""))
        prose = (
            F.lit(0.45) + cap(letters(x) / n, 1) * 0.25 + cap(k / 4.0, 1) * 0.10 + cap(n / 24.0, 1) * 0.10
            - cap(digit_count(x) / n * 0.20, 0.10) - cap(marks / n * 0.20, 0.10)
            + off(label_like(x, field), 0.25) + F.when(text_like(x), 0.05).otherwise(0.0)
        )
        place = off(digit_heavy(x, 0.35), 0.35) + off(repetitive(x), 0.25) + off((F.length(x) >= 48) & (k <= 3), 0.15)
        name = off(digit_heavy(x, 0.20), 0.25) + off(repetitive(x, 4), 0.20)
        prose = prose + F.when(field.isin(*PLACES), place).when(field == "full_name", name).otherwise(0.0)
        whole = F.when(field == "id_number", number).when(field == "date_of_birth", date).otherwise(prose)
        return F.when(x == "", 0.0).otherwise(F.greatest(F.lit(0.0), cap(whole, 0.95)))

    return let(text(c) if cleaned else cleanup(c, field), score)


def calibrated_confidence(c: Column, raw: Column, field: Column, cleaned: bool = False, estimate: Column | None = None) -> Column:
    """A recogniser's confidence (any type; what is no number counts as 0) corrected by what the text looks like.

    ``estimate``: the estimated confidence of the cleaned value, where it is at hand.
    """
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw.try_cast("double"), F.lit(0.0))))

    def score(x: Column) -> Column:
        d = F.length(digits(x))
        number = F.when(valid_id(x), F.greatest(r, F.lit(0.88))).when(d >= 10, F.least(r * 0.75, F.lit(0.84))).when(d >= 8, F.least(r * 0.55, F.lit(0.72))).otherwise(r * 0.25)
        date = F.when(valid_date(x), F.greatest(r, F.lit(0.8))).when(d >= 6, F.least(r * 0.65, F.lit(0.74))).otherwise(r * 0.30)
        damp = F.when(label_like(x, field), 0.5).otherwise(1.0)
        doubt = F.when(suspicious(x, field, True), F.when(field.isin(*PLACES), 0.45).when(field == "full_name", 0.60).otherwise(1.0)).otherwise(1.0)
        prose = F.greatest(F.lit(0.0), F.least(F.lit(0.98), r * damp * doubt * 0.7 + (estimated_confidence(x, field, True) if estimate is None else estimate) * 0.3))
        return F.when(x == "", 0.0).when(field == "id_number", number).when(field == "date_of_birth", date).otherwise(prose)

    return let(text(c) if cleaned else cleanup(c, field), score)


def bucket(conf: Column, accept: float = 0.9, review: float = 0.5) -> Column:
    return F.when(conf >= accept, "accept").when(conf >= review, "review").otherwise("reject")


def metric_form(c: Column, spaces: bool = True, fold_case: bool = True) -> Column:
    """A text as error rates compare it: composed; other options are chosen when the plan is made."""
    x = text(nfc(c))
    x = collapse(x) if spaces else x
    return F.lower(x) if fold_case else x


def char_distance(a: Column, b: Column) -> Column:
    """Edit distance in characters; null counts as empty."""
    a, b = text(a), text(b)
    return F.when(a == b, 0).otherwise(F.levenshtein(a, b))


_ALPHABET_START, _ALPHABET_SIZE = 0x4E00, 20_000


@F.pandas_udf(T.IntegerType())
def _long_word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    import numpy as np

    def one(x: list[str], y: list[str]) -> int:
        ids: dict[str, int] = {}
        u, v = (np.array([ids.setdefault(w, len(ids)) for w in s], np.int64) for s in (x, y))
        row = np.arange(len(v) + 1)
        for i, t in enumerate(u, 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (v != t))
            best = np.concatenate([[i], best])
            row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
        return int(row[-1])

    return pd.Series([None if x is None else one(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance in words.

    Each distinct word of a pair stands for one character, so the native distance does the work; pairs with more
    distinct words than the alphabet has characters go to an Arrow function.
    """
    x, y = words(a), words(b)

    def run(p: Column) -> Column:
        letter = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(p.v, t) + _ALPHABET_START - 1), 4, "0")), "UTF-16BE")
        spell = lambda w: F.array_join(F.transform(w, letter), "")
        return F.levenshtein(spell(p.x), spell(p.y))

    both = F.struct(x.alias("x"), y.alias("y"), F.array_distinct(F.concat(x, y)).alias("v"))
    small = let(both, lambda p: F.when(F.size(p.v) <= _ALPHABET_SIZE, run(p)))
    big = F.size(F.array_distinct(F.concat(x, y))) > _ALPHABET_SIZE
    return F.coalesce(small, _long_word_distance(F.when(big, x), F.when(big, y)))


def rate(distance: Column, reference_size: Column, other_size: Column) -> Column:
    """Errors a unit of the reference; for an empty reference 0 if the other is empty too, else 1. May exceed 1."""
    return F.when(reference_size == 0, F.when(other_size == 0, 0.0).otherwise(1.0)).otherwise(distance / F.greatest(reference_size, F.lit(1)))


def cer(ref: Column, hyp: Column) -> Column:
    return rate(char_distance(ref, hyp), F.length(text(ref)), F.length(text(hyp)))


def wer(ref: Column, hyp: Column) -> Column:
    return rate(word_distance(ref, hyp), F.size(words(ref)), F.size(words(hyp)))


def normalized_distance(a: Column, b: Column) -> Column:
    """Edit distance by the length of the longer text; 0 for two empty ones."""
    return F.coalesce(F.try_divide(char_distance(a, b), F.greatest(F.length(text(a)), F.length(text(b)))), F.lit(0.0))


def portable_path(c: Column, root: str = "") -> Column:
    """Slashes forward, doubled ones made one, './' and the root folder off the front."""
    x = F.regexp_replace(F.regexp_replace(text(c), r"\\", "/"), r"(?<!^)/{2,}", "/")
    x = F.regexp_replace(x, r"^(?:\./)+", "")
    return F.regexp_replace(x, "^" + root.rstrip("/") + "/", "") if root else x


def resolved_path(c: Column, root: str) -> Column:
    """Absolute paths as they are, others under ``root``."""
    return F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))
