"""Problem 1: values that lost their end, from word trigrams inside texts versus at ends.

Every distinct reading is folded (case, accents and usual recogniser confusions set aside) and split into words.
For each word trigram five states are counted per field class, from specific to general: three literal words; a
context class and two words; two context classes and a word; the word alone; classes only. A context class is the word itself if a
large share of the class's readings has it (street and district markers, say) and ``*`` otherwise. A state also
stands for each beginning of its last word, because a cut falls inside words: an occurrence of ``khue`` is an
internal occurrence of ``k``, ``kh`` and ``khu`` and, at the end of a text, a terminal one of ``khue``. The final
trigram of each reading is joined with the most specific state that is common enough, and the reading is flagged
where that state is frequent inside texts but almost never terminal. An exact check follows: a reading whose last
words are, but for a few characters, a common ending of its class is whole.

All steps are SQL over aggregated counts; nothing is collected. Shuffles carry distinct readings, not rows: repeated
readings are merged with their weight first, so a hot value is one row. What is joined by class is broadcast, because a
class may hold a third of all rows: one row for each kind of field on the card, with at most 1 / keyword_share words or
1 / ending_share endings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.folding import strip_accents
from fieldloom.runtime import materialize

# Characters that recognisers put for one another in these readings, and the one that stands for both.
CONFUSED = ("nbeq5801ij$|", "uhcgsholllsl")


def fold(c, numbers: bool = False):
    """Lower case, accents off, confusable characters merged, marks and spaces reduced to one space; with ``numbers``, words of digits only are nines."""
    x = F.lower(strip_accents(c))
    if numbers:
        x = F.regexp_replace(x, r"(?:\G(?!^)|(?<![\p{L}\p{N}])(?=[0-9]+(?![\p{L}\p{N}])))[0-9]", "9")
    x = F.regexp_replace(x, "rn", "m")
    x = F.translate(x, *CONFUSED)
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


PARAMS = {
    "keyword_share": 0.08,  # share of a class's readings that makes a word a context class of its own
    "smoothing": 20.0,  # occurrences that a more general state's terminal share is worth in a more specific one
    "max_terminal_share": 0.08,  # terminal occurrences among all, at most, for a flag
    "ending_share": 0.004,  # share of a class's readings that makes two last words a common ending
}

_READINGS = """
SELECT row_id, best_source, field, coalesce(class, field_name, '') AS cls, crop, text
FROM (SELECT row_id, best_source, class, field_name, coalesce(ann_id, -row_id) AS crop,
             stack(2, 'best_text', best_text, 'text_paddle', text_paddle) AS (field, text) FROM {rows})
WHERE text IS NOT NULL
"""

# One row per distinct folded reading with its words; words of digits keep only their length. They are told before digits fold to letters.
_DISTINCT = """
SELECT cls, folded, n, words, size(words) AS k FROM (
  SELECT cls, folded, n,
         transform(split(formed, ' '), w -> CASE WHEN w RLIKE '^[0-9ols]*[0-9][0-9ols]*$' THEN repeat('9', length(w)) ELSE w END) AS words
  FROM (SELECT cls, folded, min(formed) AS formed, count(*) AS n FROM (SELECT cls, folded, crop, min(formed) AS formed FROM {folded} WHERE folded <> '' GROUP BY cls, folded, crop)
        GROUP BY cls, folded))
"""

_KEYWORDS = """
SELECT /*+ BROADCAST(t) */ w.cls, collect_set(w.word) AS keys
FROM (SELECT cls, word, sum(n) AS n FROM (SELECT cls, n, explode(array_distinct(words)) AS word FROM {texts}) GROUP BY cls, word) w
JOIN (SELECT cls, sum(n) AS total FROM {texts} GROUP BY cls) t ON t.cls = w.cls AND w.n >= {keyword_share} * t.total
GROUP BY w.cls
"""

# Contexts of the i-th word: the two words before it and their classes; '^' stands before the first word.
_MARKED = """
SELECT /*+ BROADCAST(k) */ t.cls, t.folded, t.n, t.k, t.words,
       transform(t.words, w -> CASE WHEN array_contains(k.keys, w) THEN w ELSE '*' END) AS kinds
FROM {texts} t LEFT JOIN {keywords} k ON k.cls = t.cls
"""

_STATES = """
SELECT cls, n, folded, is_last, e.lvl AS lvl, e.ctx AS ctx, e.w AS w FROM (
  SELECT cls, n, folded, i = k - 1 AS is_last, explode(array(
    named_struct('lvl', 4, 'ctx', concat_ws(' ', w2, w1), 'w', w),
    named_struct('lvl', 3, 'ctx', concat_ws(' ', c2, w1), 'w', w),
    named_struct('lvl', 2, 'ctx', concat_ws(' ', c2, c1), 'w', w),
    named_struct('lvl', 1, 'ctx', '', 'w', w),
    named_struct('lvl', 0, 'ctx', concat_ws(' ', c2, c1), 'w', CASE WHEN w LIKE '9%' THEN w ELSE '*' END))) AS e
  FROM (SELECT cls, n, folded, k, i, words[i] AS w,
               CASE WHEN i > 0 THEN words[i - 1] ELSE '^' END AS w1, CASE WHEN i > 1 THEN words[i - 2] ELSE '^' END AS w2,
               CASE WHEN i > 0 THEN kinds[i - 1] ELSE '^' END AS c1, CASE WHEN i > 1 THEN kinds[i - 2] ELSE '^' END AS c2
        FROM (SELECT *, explode(sequence(@first, k - 1)) AS i FROM {marked})))
"""

_COUNTS = """
SELECT cls, lvl, ctx, w, sum(CASE WHEN is_last THEN 0 ELSE n END) AS inside, sum(CASE WHEN is_last THEN n ELSE 0 END) AS ends
FROM {states} GROUP BY cls, lvl, ctx, w
"""

# Every beginning of a word is an internal occurrence, wherever the word itself stands; of a number, each lesser length.
_BEGINNINGS = """
SELECT cls, lvl, ctx, p AS w, sum(CASE WHEN whole THEN inside ELSE inside + ends END) AS inside, sum(CASE WHEN whole THEN ends ELSE 0 END) AS ends
FROM (SELECT cls, lvl, ctx, inside, ends, e.p AS p, e.whole AS whole FROM (
        SELECT *, explode(CASE WHEN w = '*' THEN array(named_struct('p', w, 'whole', true))
                               ELSE transform(sequence(1, length(w)), j -> named_struct('p', left(w, j), 'whole', j = length(w))) END) AS e
        FROM {counts}))
GROUP BY cls, lvl, ctx, p
"""

# How often a word of the class is a last one: what is taken for a state before anything is counted of it.
_PRIOR = "SELECT cls, sum(n) / sum(n * k) AS prior FROM {texts} GROUP BY cls"

# From the prior by way of the most general state to the most specific: each terminal share is smoothed with the one before it.
_SHARE = "prior"
for _k in range(5):
    _SHARE = f"(e{_k} + {{m}} * {_SHARE}) / (i{_k} + e{_k} + {{m}})"

_VERDICT = f"""
SELECT /*+ BROADCAST(p) */ c.cls, folded, {_SHARE} AS terminal_share
FROM (
  SELECT f.cls, f.folded,
         @levels
  FROM {{finals}} f LEFT JOIN {{begin}} b ON b.cls = f.cls AND b.lvl = f.lvl AND b.ctx = f.ctx AND b.w = f.w
  GROUP BY f.cls, f.folded) c
JOIN {{priors}} p ON p.cls = c.cls
""".replace("@levels", ", ".join(f"cast(sum(CASE WHEN b.lvl = {k} THEN b.{c}{own} ELSE 0 END) AS double) AS {c[0]}{k}" for k in range(5) for c, own in (("inside", ""), ("ends", " - f.n"))))


def truncated(rows: DataFrame, params: dict | None = None, checked: bool = True) -> DataFrame:
    """Readings of ``best_text`` and ``text_paddle`` that lost their end: row_id, best_source, field, text, terminal_share.

    Null and blank readings, and readings without a letter or digit, are never flagged; repeated rows are judged
    alike; an empty table gives an empty result; other columns of ``rows`` are ignored. A null class falls back to
    ``field_name``, then to one class of its own.
    """
    spark, p = rows.sparkSession, PARAMS | (params or {})
    need = ["row_id", "ann_id", "best_source", "class", "field_name", "best_text", "text_paddle"]
    readings = spark.sql(_READINGS, rows=rows.select(*need))
    folded = readings.withColumn("folded", fold(F.col("text")))
    texts = materialize(spark.sql(_DISTINCT, folded=folded.withColumn("formed", fold(F.col("text"), numbers=True))), "texts")  # read by four branches
    keywords = spark.sql(_KEYWORDS, texts=texts, keyword_share=p["keyword_share"])
    # Few bytes, many states: as many tasks as the session has shuffle partitions.
    spread = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "folded")
    states = spark.sql(_STATES.replace("@first", "0"), marked=spark.sql(_MARKED, texts=spread, keywords=keywords))
    finals = spark.sql(_STATES.replace("@first", "k - 1"), marked=spark.sql(_MARKED, texts=texts, keywords=keywords))
    begin = spark.sql(_BEGINNINGS, counts=spark.sql(_COUNTS, states=states))
    verdict = spark.sql(_VERDICT, finals=finals, begin=begin, priors=spark.sql(_PRIOR, texts=texts), m=p["smoothing"])
    flagged = verdict.filter(F.col("terminal_share") <= p["max_terminal_share"])
    if checked:
        flagged = _without_common_endings(flagged, texts, p)
    return folded.join(flagged, ["cls", "folded"]).select(
        "row_id", "best_source", "field", "text", "terminal_share"
    )


def _without_common_endings(flagged: DataFrame, texts: DataFrame, p: dict) -> DataFrame:
    """Drop readings whose last two words are within a small distance of a common ending, unless they are nearer to it cut short.

    An ending is common if a share of the class's readings has it, so there are at most 1 / share of them a class.
    """
    last2 = F.concat_ws(" ", F.slice("words", -2, 2))
    total = F.broadcast(texts.groupBy("cls").agg(F.sum("n").alias("total")))
    ends = (
        texts.filter("k >= 2").groupBy("cls", last2.alias("ending")).agg(F.sum("n").alias("n")).join(total, "cls")
        .filter(F.col("n") >= p["ending_share"] * F.col("total")).filter("ending rlike '[^9 ]'")
        .groupBy("cls").agg(F.collect_list("ending").alias("endings"))
    )
    tail = F.regexp_extract("folded", r"(\S+ \S+)$", 1)
    # one character short is a lost letter within the ending, or the ending cut: whichever takes fewer edits
    cut = lambda e: (F.length(tail) == F.length(e) - 1) & (F.levenshtein(tail, F.substring(e, F.lit(1), F.length(e) - 1)) < F.levenshtein(tail, e))
    near = F.exists("endings", lambda e: (e != "") & (F.levenshtein(tail, e) <= F.greatest(F.lit(1), F.floor(F.length(e) / 4))) & (F.length(tail) >= F.length(e) - 1) & ~cut(e))
    return flagged.join(F.broadcast(ends), "cls", "left").filter(~F.coalesce(near, F.lit(False))).drop("endings")


def truncation_report(rows: DataFrame, params: dict | None = None) -> DataFrame:
    """Per best_source and field: readings that are not blank, truncated ones and their share.

    A null source is a group of its own; sources without a truncated reading are listed with 0.
    """
    long = rows.sparkSession.sql(
        "SELECT best_source, stack(2, 'best_text', best_text, 'text_paddle', text_paddle) AS (field, text) FROM {rows}",
        rows=rows.select("best_source", "best_text", "text_paddle"),
    )
    all_ = long.filter(F.trim("text") != "").groupBy("best_source", "field").agg(F.count("*").alias("readings"))
    cut = truncated(rows, params).groupBy("best_source", "field").agg(F.count("*").alias("truncated"))
    j = all_.alias("a").join(cut.alias("c"), F.col("a.best_source").eqNullSafe(F.col("c.best_source")) & (F.col("a.field") == F.col("c.field")), "left")
    n = F.coalesce(F.col("truncated"), F.lit(0))
    return j.select("a.best_source", "a.field", "readings", n.alias("truncated"), (n / F.col("readings")).alias("share"))
