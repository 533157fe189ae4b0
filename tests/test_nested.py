"""Nested records: every payload layout, odd payloads, typed maps."""

import json

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import nested as N

BOX = [[0, 0], [4, 0], [4, 2], [0, 2]]
LAYOUTS = {
    "object": ("segments", [{"text": "a", "score": 0.5, "box": BOX}, {"text": " ", "score": 1}, {"text": "b", "box": None}]),
    "rec_object": ("raw", [{"rec_text": "a", "rec_score": 0.5}, {"rec_text": ""}, {"rec_text": "b", "rec_score": "x"}]),
    "columns": ("raw", {"rec_texts": ["a", None, "b"], "rec_scores": [0.5], "dt_polys": [BOX, BOX, BOX]}),
    "wrapped": ("raw", {"res": {"rec_texts": ["a", "b"], "rec_scores": [0.5, 1]}}),
    "pairs": ("raw", [["a", 0.5], ["\u3000", 0.1], ["b", None]]),
    "boxed": ("raw", [[BOX, ["a", 0.5]], [[0, 0, 1, 1], ["b", 1]]]),
    "pages": ("raw", [[[BOX, ["a", 0.5]]], [], [[BOX, ["b", 0.4]]]]),
    "deep": ("raw", [[{"res": [["a", 0.5]]}], [[["b", 1]]]]),
}


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("as_list", [False, True])
def test_layouts(name, as_list):
    key, value = LAYOUTS[name]
    reading = {"text": "a b", "confidence": 0.5, "backend": "viet", key: value}
    rows = N.rows_of(7, json.dumps({"crop_path": "x", "candidates": [None, reading] if as_list else {"v": reading, "w": None}}))
    seg = [(r["engine"], r["seg_no"], r["text"]) for r in rows if r["kind"] == "segment"]
    engine = "viet" if as_list else "v"
    assert seg == [(engine, 1, "a"), (engine, 2, "b")]
    assert [(r["engine"], r["text"]) for r in rows if r["kind"] == "reading"] == [(engine, "a b")]
    assert all(r["record_id"] == 7 for r in rows)


@pytest.mark.parametrize("payload", [None, "", "{", '{"crop_path": "x"', "nonsense"])
def test_broken_payloads_give_nothing(payload):
    assert N.rows_of(1, payload) == []


@pytest.mark.parametrize("payload,readings", [("[]", 0), ("3", 0), ("{}", 0), ('{"candidates": null}', 0), ('{"candidates": 5}', 0), ('{"candidates": {"v": "text"}}', 1), ('{"candidates": [{"raw": []}, 4]}', 2), ('{"candidates": {"v": {"raw": "x", "segments": {}}}}', 1)])
def test_odd_payloads(payload, readings):
    assert sum(r["kind"] == "reading" for r in N.rows_of(1, payload)) == readings


def test_tables_keep_parent_links(spark):
    rows = [(i, json.dumps({"crop_path": "p", "ann_id": i, "candidates": {"v": {"text": "t", LAYOUTS[k][0]: LAYOUTS[k][1]}}, "extra": {"run": {"tags": ["a", 1]}}})) for i, k in enumerate(LAYOUTS)] + [(99, None), (98, "{")]
    df = spark.createDataFrame(rows, "raw_id long, payload string").withColumns({"k": F.lit(1), "p": F.lit(2), "record_id": F.lit(3), "kind": F.lit(4)})
    t = N.tables(N.parse(df, "raw_id", "payload").cache())
    assert t["records"].count() == t["readings"].count() == len(LAYOUTS) and t["segments"].count() == 2 * len(LAYOUTS)
    assert t["segments"].join(t["readings"], ["record_id", "reading_no"], "left_anti").count() == 0
    assert sum(t[f"segments_{v}"].count() for v in N.SEGMENT_VARIANTS) == t["segments"].count()
    assert {tuple(r) for r in t["attributes"].filter("record_id = 0").collect()} == {(0, "extra.run.tags[0]", "a"), (0, "extra.run.tags[1]", "1")}
    assert N.parse(df.limit(0), "raw_id", "payload").count() == 0


def test_map_readings(spark):
    c = "map<string, struct<text: string, confidence: double, backend: string>>"
    df = spark.createDataFrame([(1, {"v": ("", None, "b"), "w": None}), (2, None), (3, {}), (1, {"v": ("x", 0.5, None)})], f"row_id long, candidates {c}")
    got = sorted((r.record_id, r.engine, r.text, r.variant) for r in N.map_readings(df).collect())
    assert got == [(1, "v", "", "text"), (1, "v", "x", "scored")]


def test_typed_and_untyped_readings_take_the_same_steps(spark):
    """Every reading is routed to one table, by the same automaton for structs and for JSON."""
    members = {"text": "x", "confidence": 0.5, "backend": "b", "needs_review": True, "raw_text": "r", "normalized_text": "n"}
    names = list(members)
    some = [{k: v for j, (k, v) in enumerate(members.items()) if i >> j & 1} for i in range(64)]
    c = "map<string, struct<text: string, confidence: double, backend: string, needs_review: boolean, raw_text: string, normalized_text: string>>"
    df = spark.createDataFrame([(i, {"v": tuple(m.get(k) for k in names)}) for i, m in enumerate(some)], f"row_id long, candidates {c}")
    typed = {r.record_id: r.variant for r in N.map_readings(df).collect()}
    untyped = {i: next(r["variant"] for r in N.rows_of(i, json.dumps({"candidates": {"v": m}})) if r["kind"] == "reading") for i, m in enumerate(some)}
    assert typed == untyped and set(typed.values()) == set(N.READING_VARIANTS)
    t = N.map_tables(df)
    assert sum(t[f"readings_{v}"].count() for v in N.READING_VARIANTS) == 64 == t["records"].count()
    assert N.found(df, spark.createDataFrame([], "raw_id long, payload string")).count() == 64


DEEP = "[" * 900 + '["a", 0.5]' + "]" * 900


@pytest.mark.parametrize("payload,segments", [
    ('{"candidates": {"v": {"raw": ' + DEEP + "}}}", ["a"]),
    ('{"candidates": {"v": {"text": ' + DEEP + ', "raw": [["b", 1]]}}}', ["b"]),
    ('{"extra": ' + DEEP + "}", []),
    ('{"candidates": {"v": {"raw": [["\\ud83d x", 0.5], ["\\ud83d\\ude00", 1]]}}, "crop_path": "\\udc00"}', ["\ufffd x", "\U0001f600"]),
    ('{"ann_id": 99999999999999999999999, "candidates": {"v": {"confidence": 1' + "0" * 390 + ', "raw": [["a", 1' + "0" * 390 + "]]}}}", ["a"]),
    ('{"ann_id": 1' + "0" * 6000 + "}", []),
    ('{"candidates": {"v": {"raw": [{"text": "a"}, {"other": 1}, 5, [null, 0.5], ["b", 0.5], "c"]}}}', ["a", "b"]),
])
def test_odd_values_fail_no_task(spark, payload, segments):
    df = spark.createDataFrame([(1, payload), (2, '{"candidates": {"v": "x"}}')], "raw_id long, payload string")
    rows = N.parse(df, "raw_id", "payload").collect()
    assert [r.text for r in sorted((r for r in rows if r.kind == "segment"), key=lambda r: r.seg_no)] == segments
    assert {r.record_id for r in rows} == {1, 2} and all(r.ann_id is None for r in rows)


@pytest.mark.parametrize("payload", ['{"candidates": {"v": {"confidence": NaN}}}', '{"candidates": {"v": "x"}, "a": -Infinity}', "[" * 2_000_000])
def test_what_is_no_json_gives_nothing(payload):
    assert N.rows_of(1, payload) == []
