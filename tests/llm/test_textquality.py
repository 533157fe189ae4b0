"""Text statistics and types."""

import random

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions.folding import ACCENTED, BARE
from fieldloom.llm import textquality as Q
from fieldloom.llm.codepoints import Codes, word_hash

WORDS = "the of and was not that for is it in a reader page label night desk review error rate reading engine answer gave kept result".split()


def prose(rng):
    s = []
    for _ in range(rng.randrange(3, 12)):
        s.append(rng.choice(["The night desk gave the reader a page.", "It was not the error of the engine that kept the result.", "A review of the label is in the answer, and the rate was not.", "The reading that the desk kept was for the page."]))
    return " ".join(s)


def make(rng, n=240):
    out = []
    for i in range(n):
        kind = ["prose", "prose", "prose", "list", "table", "junk"][i % 6]
        if kind == "prose":
            t = prose(rng)
        elif kind == "list":
            t = "\n".join(f"{k}. {rng.choice(['night desk', 'page label', 'error rate'])}" for k in range(1, rng.randrange(6, 20)))
        elif kind == "table":
            t = "\n".join("| " + " | ".join(f"0.{rng.randrange(100, 999)}" for _ in range(5)) + " |" for _ in range(rng.randrange(4, 12)))
        else:
            t = rng.choice([lambda: "ha" * rng.randrange(30, 80), lambda: "".join(rng.choices("#%&*{}<>|~^", k=200)), lambda: " ".join("".join(rng.choices("bcdfgxz1234567", k=rng.randrange(4, 12))) for _ in range(40))])()
        out.append((i, t, kind))
    return out


def test_types(spark):
    data = make(random.Random(1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string").withColumns({"f": F.lit(1), "k": F.lit(2), "votes": F.lit(3), "n_words": F.lit(4)})
    common = spark.createDataFrame([("en", w) for w in WORDS[:11]] + [("en", None)], "lang string, word string")
    got = {r.doc_id: r.text_type for r in Q.text_types(docs, common).collect()}
    assert sum(got[i] == k for i, _, k in data) >= 0.97 * len(data)
    assert all((got[i] == "prose") == (k == "prose") for i, _, k in data)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "x" * 50_000), (6, "1\r\n2\r3")], "doc_id long, text string")
    common = spark.createDataFrame([], "lang string, word string")
    s = {r.doc_id: r for r in Q.statistics(docs, common).collect()}
    assert set(s) == {4, 5, 6} and s[4].n_words == 1 and s[6].n_lines == 3 and s[5].mean_word_length == 50_000
    assert set(r.doc_id for r in Q.text_types(docs, common).collect()) == {4, 5, 6}
    assert Q.found(docs.limit(0), common).count() == 0


def test_statistics_by_hand(spark):
    docs = spark.createDataFrame([(1, "The cat, and\nthe dog.\n\n")], "doc_id long, text string")
    common = spark.createDataFrame([("en", "The"), ("en", "AND")], "lang string, word string")
    r = Q.statistics(docs, common).first()
    assert (r.n_words, r.n_lines) == (5, 2)
    assert abs(r.mean_word_length - 17 / 5) < 1e-9 and abs(r.common_share - 3 / 5) < 1e-9 and abs(r.punctuated_lines - 0.5) < 1e-9 and abs(r.symbol_ratio - 2 / 17) < 1e-9


def plain(t, common):
    """The statistics again, one text at a time with patterns."""
    t = regex.sub(r"\p{Zs}", " ", regex.sub(r"\r\n?|[\u2028\u2029\x0b\x0c\x85]", "\n", t))
    f = regex.sub(r"\p{M}+", "", t.lower().translate(str.maketrans(ACCENTED, BARE)))
    lines = [x for x in t.split("\n") if x.strip(" \t")]
    toks, alpha = [w for w in regex.split(r"[ \t\n]+", f) if w], regex.findall(r"\p{L}+", f)
    solid = regex.sub(r"[ \t\n]", "", t)
    share = lambda a, b: a / b if b else 0.0
    lags = [share(sum(f[i] == f[i - k] and f[i] not in " \t\n" for i in range(k, len(f))), len(regex.sub(r"[ \t\n]", "", f))) for k in range(1, 13)]
    lags += [share(sum(alpha[i] == alpha[i - k] for i in range(k, len(alpha))), len(alpha)) for k in range(1, 9)]
    return {
        "n_words": len(toks), "mean_word_length": share(sum(map(len, toks)), len(toks)), "symbol_ratio": share(len(regex.sub(r"[\p{L}\p{N}\p{M}]", "", solid)), len(solid)),
        "punctuated_lines": share(sum(bool(regex.search(r"[.!?…:;,)\"'”»][ \t]*$", x)) for x in lines), len(lines)), "common_share": share(sum(w in common for w in alpha), len(alpha)),
        "n_lines": len(lines), "digit_ratio": share(len(regex.findall(r"\p{N}", t)), len(solid)), "repetition": max(lags),
        "mixed_words": share(len(regex.findall(r"(?<=\p{L})\p{N}|(?<=\p{N})\p{L}", f)), len(toks)), "letter_run": share(sum(map(len, alpha)), len(alpha)),
        "sentence_ends": share(len(regex.findall(r"[.!?…](?=[\"'”)]?[ \t\n])|[.!?…](?=[\"'”)]?$)", t)), len(toks)),
        "list_share": share(sum(len(x) for x in lines if regex.search(r"^[ \t]*(?:[-*•·—–▪●◦‣>+]|\(?[0-9]{1,3}[.)]|\[[ xX]?\]|[a-zA-Z][.)])[ \t]+[^ \t]", x)), sum(map(len, lines))),
    }


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=40), st.text(alphabet="aAđẹ́1. -*\n\r\t[x])(,;|=:#😀", max_size=60)), min_size=1, max_size=6))
def test_statistics_equal_plain_ones(texts):
    common = np.unique(np.array([word_hash("a"), word_hash("ad")], np.uint64))
    got = Q.measure(Codes(texts), common)
    for i, t in enumerate(texts):
        for k, v in plain(t, {"a", "ad"}).items():
            assert abs(got[k][i] - v) < 1e-9, (k, t)


def test_words_hash_alike_in_any_text():
    x = Codes(["đá Đá", "x da dá\u0323", "da"])
    assert len(set(x.word_hashes.tolist())) == 2 and x.word_owner.tolist() == [0, 0, 1, 1, 1, 2]


def test_lines_of_cells():
    cells = ["a\tb\tc", "| a | b |", "a     b     c", "a,b,c", "k=v w=x", "name: value", '{"crop": "c1", "conf": 0.91}', "a;b;c"]
    others = ["a, b, and c.", "||||::||;;;;==", "He said: that this is a longer line of text", "plain words"]
    c = Codes(cells + others)
    assert Q._tabular(c).tolist() == [True] * len(cells) + [False] * len(others)


def test_em_learns_and_decides():
    """EM is what tells kinds apart: without it a function that says the same of two kinds misleads."""
    rng = np.random.default_rng(0)
    names, f = list(Q.KINDS), list(Q.FUNCTIONS)
    truth = np.full((len(names), len(f), 3), 0.02)
    for i, (_, says) in enumerate(Q.KINDS.values()):
        for j, x in enumerate(f):
            truth[i, j, says.get(x, (i + j) % 3)] = 0.96  # what a name leaves open has its own habit too
    vectors, kinds = {}, {}
    for n in range(6000):
        i = rng.choice(len(names), p=[0.55] + [0.05] * 9)
        v = "".join(str(rng.choice(3, p=truth[i, j] / truth[i, j].sum())) for j in range(len(f)))
        vectors[v] = vectors.get(v, 0) + 1
        kinds.setdefault(v, []).append(Q.TYPES.index(Q.KINDS[names[i]][0]))
    x = Q.digits(list(vectors))

    def right(shares, tables):
        best = Q.by_type(Q.posteriors(x, shares, tables)).argmax(1)
        return sum(sum(t == b for t in kinds[v]) for v, b in zip(vectors, best, strict=True)) / 6000

    learned, first = right(*Q.fit(vectors)), right(np.full(len(names), 0.1), Q.first_tables())
    assert learned > 0.98 and learned > first + 0.01
    again = Q.fit({v: 10 * n for v, n in vectors.items()})
    assert np.allclose(again[1], Q.fit(vectors)[1], atol=1e-6)  # ten copies of a corpus are judged as one
    assert Q.fit({})[0].shape == (len(names),)


def test_em_changes_the_types(spark):
    """Switched off, EM gives other types on the made texts."""
    data = make(random.Random(3), 480)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    common = spark.createDataFrame([("en", w) for w in WORDS[:11]], "lang string, word string")
    rows = Q.text_types(docs, common).select("votes", "text_type", "p_prose").collect()
    x = Q.digits([r.votes for r in rows])
    p = Q.by_type(Q.posteriors(x, np.full(len(Q.KINDS), 1 / len(Q.KINDS)), Q.first_tables()))
    assert max(abs(q[0] - r.p_prose) for q, r in zip(p, rows, strict=True)) > 0.05


def test_repetition_has_no_bounds_of_length(spark):
    texts = ["aaaaaaa bbbbbbb ccccccc ddddddd", "ha" * 40, "ha" * 40_000, "one two three " * 5, "one two three " * 5000, "the quick brown fox jumps over some lazy dog"]
    c = Codes(texts)
    got = Q.measure(c, np.zeros(0, np.uint64))["repetition"]
    assert (got[:5] > 0.7).all() and got[5] < 0.2
