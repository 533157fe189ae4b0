"""Look-alike forms."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import lookalike as L

MODEL = L.Model({"th": 50, "ho": 50, "on": 60, "n$": 60, "^t": 60, "ng": 40, "99": 400, "^9": 60, "9$": 60, "an": 30, "^a": 20})


@pytest.mark.parametrize(
    "text,plain",
    [
        ("Ｔｈôｎ １", "Thôn 1"), ("Thôn", "Thôn"), ("T​hôn", "Thôn"), ("Тhôn", "Thôn"), ("Th\xa0a", "Th a"), ("12О4", "1204"), ("a‐b", "a-b"), ("𝐇𝐚", "Ha"),
        ("ЦЭЙЭЗЮ ЫЭЦЭ", "ЦЭЙЭЗЮ ЫЭЦЭ"), ("á̂", "ấ"), ("é̂", "ế"), ("", ""), ("  a  b ", "  a  b "), ("Ðăng", "Đăng"), ("2⁄3", "2/3"), ("﻿", ""), ("0б-23", "06-23"), ("ЛЮ РОТ", "ЛЮ РОТ"), ("ТНОН", "THOH"), ("ЛЮ Тhôn", "ЛЮ Thôn"),
    ],
)
def test_forms(text, plain):
    assert L.plain_form(text, MODEL) == plain


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_form_is_a_fixed_point_and_has_nothing_invisible(text):
    once = L.plain_form(text, MODEL)
    assert L.plain_form(once, MODEL) == once
    assert not any(L.ignorable(c) for c in once)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="thonag 0123456789,.-ấế", max_size=30))
def test_plain_text_and_its_decomposition(text):
    text = unicodedata.normalize("NFC", text)
    assert L.plain_form(text, MODEL) == text
    assert L.plain_form(unicodedata.normalize("NFD", text), MODEL) == text


def test_table_rows(spark):
    data = [(1, "Thôn", None), (2, "Тhôn", "Th\xa0a"), (2, "Тhôn", ""), (3, None, "  "), (4, "x" * 20_000 + "​", "a  b")]
    df = spark.createDataFrame(data, "row_id long, a string, b string").withColumns({"value": F.lit(1), "plain": F.lit(2), "field": F.lit(3)})
    got = sorted((r.row_id, r.field) for r in L.not_plain(df, "row_id", ["a", "b"]).collect())
    assert got == [(2, "a"), (2, "a"), (2, "b"), (4, "a")]
    form = {(r.row_id, r.a, r.b) for r in L.consistent(df, ["a", "b"], MODEL).collect()}
    assert (2, "Thôn", "Th a") in form and (3, None, "") in form and (4, "x" * 20_000, "a b") in form
    assert L.not_plain(df.limit(0), "row_id", ["a", "b"]).count() == 0


def test_pair_counts_equal_brute_force(spark):
    df = spark.createDataFrame([("Ab 12", None), ("ab", "b​")], "a string, b string")
    got = {r.pair: r.n for r in L.character_pairs(df, ["a", "b"]).collect()}
    assert got == {"^a": 2, "ab": 2, "b$": 2, "^9": 1, "99": 1, "9$": 1}
