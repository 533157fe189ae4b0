"""Error rates of texts as they are stored, against brute force in Python."""

import unicodedata

import pytest

from fieldloom.plans import queries

ROWS = [
    (1, "a", "name", 7, "Nguyễn Văn Đức", "Nguyen Van Duc", "Nguyễn  văn Đức", unicodedata.normalize("NFD", "Nguyễn Văn Đức")),
    (2, "b", "name", 7, "Hà Nội", "Hà Nôi", None, "Hà Nội"),
    (3, "c", "origin", 8, "日本", "日木", "", "日本"),
    (4, "d", "origin", 9, " ", "x", "x", "x"),
]
SCHEMA = "row_id long, crop_path string, class string, ann_id long, ground_truth_text string, text_vietocr string, text_paddle string, best_text string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("real"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{d}/reviewed_sample.parquet")
    return d


def expected():
    form = lambda t: " ".join(unicodedata.normalize("NFC", t or "").lower().split())
    return {(i, e): (form(t), form(g), f, a) for i, _, f, a, t, *gs in ROWS if t.strip() for e, g in zip(("vietocr", "paddleocr", "best"), gs, strict=True)}


def test_real_texts_equal_brute_force(spark, folder):
    run = lambda name: queries.QUERIES[name](spark, folder).collect()
    want = expected()
    assert {(r.row_id, r.engine): (r.chars, r.cer) for r in run("char_distance")} == {k: (distance(t, g), round(distance(t, g) / len(t), 6)) for k, (t, g, *_) in want.items()}
    assert {(r.row_id, r.engine): r.ned for r in run("ned")} == {k: round(distance(t, g) / max(len(t), len(g)), 6) for k, (t, g, *_) in want.items()}
    assert sorted((r.engine, r.truth, r.guess) for r in run("eval_errors")) == sorted((e, t, g) for (_, e), (t, g, *_) in want.items() if t != g)
    assert len(run("top_errors")) == sum(t != g for t, g, *_ in want.values())
    whole = {r.engine: r for r in run("eval_summary") if r.scope == "overall"}
    for e in ("vietocr", "paddleocr", "best"):
        of = [v for (_, x), v in want.items() if x == e]
        assert whole[e]["count"] == 3 and whole[e].exact_match_rate == round(sum(t == g for t, g, *_ in of) / 3, 6)
        assert whole[e].cer == round(sum(distance(t, g) / len(t) for t, g, *_ in of) / 3, 6)
        assert whole[e].wer == round(sum(distance(t.split(), g.split()) / len(t.split()) for t, g, *_ in of) / 3, 6)
    near = {(r.engine, r.field_name): r.share for r in run("fuzzy_le2")}
    assert near["vietocr", "name"] == 0.5 and near["best", "name"] == 1.0
    assert {(r.ann_id, r.engine): r.all_exact for r in run("record_exact")} == {(a, e): all(t == g for (_, y), (t, g, _, b) in want.items() if (y, b) == (e, a)) for (_, e), (*_, a) in want.items()}
    assert sorted((r.engine, r.pattern) for r in run("top_patterns")) == [("vietocr", "ộ>ô"), ("vietocr", "本>木")]
