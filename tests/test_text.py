"""Text functions against hand-derived values."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import text as T


def ev(spark, rows, *cols, names=("a", "b")):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names[: len(rows[0]) if isinstance(rows[0], tuple) else 1]))
    df = df.coalesce(1).withColumn("_i", F.monotonically_increasing_id())
    return [tuple(r)[:-1] if len(cols) > 1 else r[0] for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)], "_i").orderBy("_i").collect()]


def test_collapse_and_digits(spark):
    assert ev(spark, ["  a \tb \n c ", None, ""], T.collapse(F.col("a"))) == ["a b c", "", ""]
    assert ev(spark, ["01-23 a45", None], T.digits(F.col("a"))) == ["012345", ""]
    assert ev(spark, ["ế", "abc", None], T.nfc(F.col("a"))) == ["ế", "abc", None]


def test_dates(spark):
    rows = ["1/2/2020", "05.06.1999", "2020-02-1", "1122020", "31/02/2020", "1/2/20", "", None, "29-2-2024", "01012000"]
    assert ev(spark, rows, T.iso_date(F.col("a"))) == ["2020-02-01", "1999-06-05", "2020-02-01", "2020-02-11", None, None, None, None, "2024-02-29", "2000-01-01"]


def test_picks(spark):
    rows = ["a 123456 789012 b", "123456789", "1234567890", "1234567890123456", None]
    assert ev(spark, rows, T.pick_id(F.col("a"))) == ["123456789012", None, "1234567890", None, None]
    rows = ["12/3/2020 and 1-1-99", "99/99/9999 1/1/2001", "none", None]
    assert ev(spark, rows, T.pick_date(F.col("a"))) == ["12/3/2020", "1/1/2001", None, None]


def test_labels(spark):
    rows = [("Full name: ABC", "full_name"), ("Full name:", "full_name"), ("Họ và tên NGUYỄN A", "full_name"), ("x", "title"), ("Quê quán: Hà Nội: Bắc", "place_of_origin"), (None, None)]
    f = F.col("b")
    assert ev(spark, rows, T.label_like(F.col("a"), f)) == [True, True, True, False, True, False]
    assert ev(spark, rows, T.label_value(F.col("a"), f)) == ["ABC", "", "NGUYỄN A", "x", "Hà Nội: Bắc", ""]
    assert ev(spark, rows, T.cleanup(F.col("a"), f))[:2] == ["ABC", ""]
    assert ev(spark, rows, T.label_words(F.col("a"), f)) == [2, 2, 3, 0, 2, 0]


def test_strip_is_idempotent(spark):
    rows = [(t, "place_of_residence") for t in ("Nơi thường trú: Địa chỉ: số 1", "address address address x y", "a b", "noi cu tru", "dia chi / 12")]
    once = T.strip_label(F.col("a"), F.col("b"))
    assert ev(spark, rows, once) == ev(spark, rows, T.strip_label(once, F.col("b")))


def test_repetition_and_shape(spark):
    assert ev(spark, ["a b a b c d", "a b c d e f", "a b a b", ""], T.repetitive(F.col("a"))) == [True, False, False, False]
    assert ev(spark, ["12a", "abc", "", "1"], T.digit_heavy(F.col("a"))) == [True, False, False, True]
    assert ev(spark, ["ab1", "12", ""], T.text_like(F.col("a"))) == [True, False, False]


def test_confidence(spark):
    rows = [("123456789012", "id_number"), ("2020-02-01", "date_of_birth"), ("", "full_name")]
    assert [round(x, 9) for x in ev(spark, rows, T.estimated_confidence(F.col("a"), F.col("b")))] == [0.95, 0.80, 0.0]
    rows = [("123456789012", "id_number", "0.5"), ("1234567890", "id_number", "0.9"), ("", "full_name", "0.9"), ("1/1/2001", "date_of_birth", "x")]
    got = ev(spark, rows, T.calibrated_confidence(F.col("a"), F.col("c"), F.col("b")), names=("a", "b", "c"))
    assert [round(x, 9) for x in got] == [0.88, 0.675, 0.0, 0.8]


def test_rates(spark):
    rows = [("abc", "abd"), ("", "x"), ("ab", "abcdef"), ("", None)]
    assert [round(x, 6) for x in ev(spark, rows, T.cer(F.col("a"), F.col("b")))] == [0.333333, 1.0, 2.0, 0.0]
    assert ev(spark, [("a b c d", "a x c"), ("", ""), (" ", "q")], T.wer(F.col("a"), F.col("b"))) == [0.5, 0.0, 1.0]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_distance_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(" ".join(rng.choices("abcdefg", k=rng.randrange(12))), " ".join(rng.choices("abcdefg", k=rng.randrange(12)))) for _ in range(80)]
    want = [_distance(a.split(), b.split()) for a, b in rows]
    assert ev(spark, rows, T.word_distance(F.col("a"), F.col("b"))) == want
    monkeypatch.setattr(T, "_ALPHABET_SIZE", 3)
    assert ev(spark, rows, T.word_distance(F.col("a"), F.col("b"))) == want


@pytest.mark.parametrize("conf,want", [(0.9, "accept"), (0.8999, "review"), (0.5, "review"), (0.4999, "reject"), (None, "reject")])
def test_bucket(spark, conf, want):
    assert spark.range(1).select(T.bucket(F.lit(conf).cast("double"))).first()[0] == want


def test_paths(spark):
    rows = ["a\\b//c", "./x/y", "/root/z", None]
    assert ev(spark, rows, T.portable_path(F.col("a"), "/root")) == ["a/b/c", "x/y", "z", ""]
