"""Truncated readings: defined results for odd rows, and cuts planted in made-up addresses."""

import random

from pyspark.sql import functions as F

from fieldloom.llm import truncation as T

SCHEMA = "row_id long, ann_id long, best_source string, class string, field_name string, best_text string, text_paddle string, n int, s string"
SYLLABLES = ["klao", "brum", "tiem", "ngach", "phoi", "quan", "reng", "soat", "trap", "vuong", "xot", "gich", "hep", "mong", "dun"]
ENDS = ["tinh Hai Le", "tinh Son Kieu", "tinh Moc Thanh", "tinh Ky Lanh"]


def address(rng):
    w = lambda: rng.choice(SYLLABLES).title()
    return f"Thon {w()} {w()}, xa {w()} {w()}, huyen {w()} {w()}, {rng.choice(ENDS)}"


def rows(n=1500, cut=40, seed=3):
    rng = random.Random(seed)
    out, planted = [], set()
    for i in range(n):
        t = address(rng)
        b = t
        if i < cut:
            b = t[: rng.randrange(12, len(t) - 7)]
            planted.add(i)
        out.append((i, i, "vietocr" if i % 2 else None, "address", None, b, t, 1, "x"))
    return out, planted


def test_planted_cuts_are_found_and_whole_values_kept(spark):
    data, planted = rows()
    got = {r.row_id for r in T.truncated(spark.createDataFrame(data, SCHEMA)).filter("field = 'best_text'").collect()}
    assert len(got & planted) >= 0.9 * len(planted)
    assert len(got - planted) <= 2


def test_marks_and_repeats(spark):
    data, _ = rows(cut=0)
    whole, half = data[0][6], data[1][6][:30]
    extra = [(9000 + k, 9000 + k, "a", "address", None, v, None, 1, "") for k, v in enumerate([whole + "...", whole + " ", half + "...", half + "…", half, half])]
    got = {r.row_id for r in T.truncated(spark.createDataFrame(data + extra, SCHEMA)).collect()}
    assert got == {9002, 9003, 9004, 9005}


def test_nulls_blanks_empty_tables_and_other_columns(spark):
    data = [(1, None, None, None, None, None, None, 0, None), (2, None, "a", "id", None, " ", "", 0, ""), (3, 5, "a", "id", None, "...", "é" * 5000, 0, "")]
    df = spark.createDataFrame(data, SCHEMA)
    assert T.truncated(df).count() == 0
    assert T.truncated(df.limit(0)).count() == 0
    clash = df.withColumns({"cls": F.lit(1), "folded": F.lit(2), "field": F.lit(3), "text": F.lit(4), "words": F.lit(5)})
    assert T.truncated(clash).columns == ["row_id", "best_source", "field", "text", "terminal_share"]
    rep = {(r.best_source, r.field): (r.readings, r.truncated) for r in T.truncation_report(df).collect()}
    assert rep == {("a", "best_text"): (1, 0), ("a", "text_paddle"): (1, 0)}


def test_report_counts_each_source(spark):
    data, planted = rows()
    rep = {(r.best_source, r.field): r.truncated for r in T.truncation_report(spark.createDataFrame(data, SCHEMA)).collect()}
    assert rep[(None, "best_text")] + rep[("vietocr", "best_text")] >= 0.9 * len(planted) and rep[("vietocr", "text_paddle")] <= 1


def test_cuts_in_ids_dates_and_just_before_the_end(spark):
    rng = random.Random(8)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    whole = {"id": lambda: digits(12), "birth": lambda: f"{rng.randrange(2, 29):02}/{rng.randrange(2, 10):02}/19{digits(2)}", "address": lambda: address(rng)}
    out, planted = [], set()
    for c, (cls, make) in enumerate(whole.items()):
        for i in range(1500):
            key, t = 10_000 * c + i, make()
            b = t
            if i < (12 if cls == "address" else 24):  # fewer of one ending than make a common ending
                b = t[: -(1 + i % {"id": 6, "birth": 3, "address": 1}[cls])]
                planted.add(key)
            out.append((key, key, "a", cls, None, b, t, 1, "x"))
    got = {r.row_id for r in T.truncated(spark.createDataFrame(out, SCHEMA)).filter("field = 'best_text'").collect()}
    for c in range(3):
        of = {k for k in planted if k // 10_000 == c}
        assert len(got & of) >= 0.9 * len(of), (c, len(got & of))
    assert len(got - planted) <= 6
    # a letter lost within a common ending is no cut
    odd = [(90_000, 90_000, "a", "address", None, "Thon Klao Brum, xa Tiem Phoi, huyen Quan Reng, tinh Moc Tanh", None, 1, "x")]
    assert not [r for r in T.truncated(spark.createDataFrame(out + odd, SCHEMA)).collect() if r.row_id == 90_000]
