"""Core operators: hand-derived cases and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import pixels as X
from fieldloom.operators import dedup, ensemble, evaluate, inference, linepick, quality, review, video
from fieldloom.sources import files, schemas


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def L(*v):
    return [F.lit(float(x)) for x in v]


def test_boxes(spark):
    b = G.box(*L(0, 0, 0.5, 0.5))
    r = one(spark, G.clamp(b, F.lit(100), F.lit(100)), G.clamp(b, F.lit(100), F.lit(100), 1.0), G.yolo(*L(160, 160, 320, 320), F.lit(640), F.lit(640)), G.iou_xywh(tuple(L(0, 0, 10, 10)), tuple(L(5, 0, 10, 10))), G.iou_xywh(tuple(L(0, 0, 1, 1)), tuple(L(5, 5, 0, 0))))
    assert r.c0.x2 == 0.5 and r.c1.x2 == 1.0 and tuple(r.c2) == (0.5, 0.5, 0.5, 0.5) and abs(r.c3 - 1 / 3) < 1e-12 and r.c4 == 0
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((10, 10), (0, 0), (10, 0), (0, 10))])
    assert [tuple(p) for p in one(spark, G.order_points(pts)).c0] == [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert one(spark, G.from_array(F.array(F.lit(1.0)))).c0 is None
    assert tuple(one(spark, G.bounds(F.array(F.array(*L(3, 4)), F.array(*L(1, 9))))).c0) == (1, 4, 3, 9)
    back = one(spark, G.unmap_points(F.array(F.array(*L(26, 32)), F.array(*L(900, -5))), F.lit(2.0), F.lit(6), F.lit(8), F.lit(100), F.lit(50))).c0
    assert back == [[7.0, 8.0], [99.0, 0.0]]
    m = one(spark, G.rect_matrix(G.box(*L(20, 30, 620, 530)))).c0
    h = X.homography(np.array([[20, 30], [620, 30], [620, 530], [20, 530]], float), np.array([[0, 0], [855, 0], [855, 539], [0, 539]], float))
    assert np.allclose(np.array(m).reshape(3, 3), h)


def test_clamp_stays_inside(spark):
    rng = random.Random(1)
    rows = [tuple(rng.uniform(-300, 900) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double").select(G.clamp(G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]), F.lit(640), F.lit(480), 1.0).alias("b")).select("b.*")
    assert df.filter("x1 < 0 or y1 < 0 or x2 > 640 or y2 > 480 or x2 <= x1 or y2 <= y1").count() == 0


def test_hash_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    hs = [base[i % 30] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for i in range(150)] + [base[0], base[0], None]
    sign = lambda v: None if v is None else v - (1 << 64) if v >= 1 << 63 else v
    df = spark.createDataFrame([(i, sign(h)) for i, h in enumerate(hs)], "id long, hash long")
    got = sorted((r.a, r.b, r.distance) for r in dedup.key_pairs(df, dedup.similar_hashes(df, 8)).collect())
    lead = {}
    for i, h in enumerate(hs):
        lead.setdefault(h, i)
    reps = [(i, h) for h, i in lead.items() if h is not None]
    want = [(min(i, j), max(i, j), bin(a ^ b).count("1")) for x, (i, a) in enumerate(reps) for j, b in reps[:x] if bin(a ^ b).count("1") <= 8]
    want = sorted(want + [(lead[h], i, 0) for i, h in enumerate(hs) if h is not None and lead[h] != i])
    assert got == want


@pytest.mark.parametrize("edges", [[(1, 1)], [(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 40)], [(5, 3), (3, 5), (9, 8), (8, 7), (2, 2)], [(i, (i * 7 + 3) % 41) for i in range(41)]])
def test_components(spark, edges):
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    got = {r.vertex: r.component for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in par}


def test_kernels():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (40, 60)).astype(np.uint8)
    assert X.perceptual_hash(a) == X.perceptual_hash(a.copy()) and -(1 << 63) <= X.perceptual_hash(a) < 1 << 63
    assert X.quality(np.zeros((0, 0), np.uint8)) == (0, 0, 0, 0) and X.quality(np.full((9, 9), 145, np.uint8))[3] == pytest.approx(0.30)
    assert (X.rotate(X.rotate(a, 90), 270) == a).all() and X.rotate(a, 90)[0, -1] == a[0, 0]
    with pytest.raises(ValueError):
        X.rotate(a, 45)
    assert X.clahe(a).shape == a.shape and X.denoise(a[:20, :20], window=7).shape == (20, 20)
    assert abs(X.denoise(np.full((12, 12), 90, np.uint8), window=5).astype(int) - 90).max() == 0
    corners = np.array([[0, 0], [59, 0], [59, 39], [0, 39]], float)
    assert (X.warp(a, corners, 60, 40) == a).all()
    lines = np.full((60, 120), 255, np.uint8)
    lines[10:14], lines[30:34] = 0, 0
    s, t = X.orientation_scores(lines), X.orientation_scores(X.rotate(lines, 90))
    assert max(s, key=s.get) == 0 and max(t, key=t.get) in (90, 270)
    assert X.decode(None) is None and X.decode(b"junk") is None and X.decode(b"\x01\x02\x03", 2).shape == (1, 2)


def test_orientation_kernels():
    g = np.array([[10] * 6 + [200] * 6] * 8, np.uint8)
    assert 10 <= X.otsu(g) < 200 and X.otsu(np.full((3, 3), 7, np.uint8)) == 0
    assert (X.blur(np.full((5, 4), 9, np.uint8)) == 9).all() and X.blur(np.full((1, 1), 9, np.uint8)).shape == (1, 1)
    e = X.contours(g)
    assert e[:, 5:7].any() and not e[:, :4].any() and not e[:, 8:].any() and (e.sum(1) <= 1).all()  # one thin line
    row = np.zeros((1, 60), bool)
    row[0, [13, 20, 40]] = True
    assert X.closed(row, 15, 1)[0].nonzero()[0].tolist() == [*range(13, 21), 40]
    brute = np.random.default_rng(3).random((9, 30)) < 0.1
    spread = np.array([[brute[r, max(0, c - 2) : c + 3].any() for c in range(30)] for r in range(9)])
    assert (X.closed(brute, 5, 1) == np.array([[spread[r, max(0, c - 2) : c + 3].all() for c in range(30)] for r in range(9)])).all()


def test_orientation_choice(spark):
    m = lambda **k: F.create_map(*[x for a, v in k.items() for x in (F.lit(int(a[1:])), F.lit(v))])
    r = one(spark, X.pick_orientation(m(_0=0.5, _90=0.6)), X.pick_orientation(m(_0=0.6, _90=0.61)), X.pick_orientation(m(_0=0.1, _180=0.9)), X.pick_orientation(m(_0=0.1, _180=0.9), allow_180=True))
    assert (r.c0.angle, round(r.c0.confidence, 6)) == (90, 0.166667) and (r.c1.angle, r.c1.confidence) == (0, 0.0) and r.c2.angle == 0 and r.c3.angle == 180


def test_ensemble(spark):
    rows = [("title", "x", "y", 0.70, 0.80), ("title", "x", "y", 0.70, 0.75), ("id", "123456789012", "12345", 0.1, 0.9), ("name", "A B", "A B", 0.2, 0.9), ("address", "", "so 1, xa B", 0.9, 0.2), ("name", None, None, None, None), (None, "x", "", 0.9, 0.1)]
    df = spark.createDataFrame(rows, "field_name string, text_vietocr string, text_paddle string, conf_vietocr double, conf_paddle double")
    got = [(r.e_engine, r.e_review) for r in ensemble.choose(df.coalesce(1)).collect()]
    assert got == [("paddleocr", False), ("paddleocr", True), ("vietocr", True), ("agree", False), ("paddleocr", True), ("vietocr", True), ("vietocr", False)]


def test_safer(spark):
    s = lambda f, b, bc, o, oc: ensemble.safer(*[F.lit(v) for v in (f, b, bc, o, oc)])
    r = one(spark, s("address", "abcdefghij", 0.50, "abc", 0.58), s("title", "", 0.9, "x", 0.1), s("title", "abcd", 0.5, "abce", 0.56), s("title", "abcd", 0.5, "", 0.9))
    assert tuple(r) == ("base", "other", "other", "base")


def test_every_choice_is_total(spark):
    texts = [None, "", "a", "Full name:", "NGUYEN VAN A", "123456789012", "a a a a a a a", "1/2/2000"]
    rows = [(f, a, b, x, y) for f in ("id", "name", "birth", "origin", "address", "title", "other", None) for a in texts for b in texts for x, y in ((0.1, 0.9), (None, 0.5))]
    df = spark.createDataFrame(rows, "field_name string, text_vietocr string, text_paddle string, conf_vietocr double, conf_paddle double")
    out = ensemble.choose(df)
    assert out.filter("e_engine is null or e_review is null or e_score is null").count() == 0
    assert ensemble.pseudo_labels(df).filter("best_source is null or review_bucket is null").count() == 0


LINES = "crop_id long, field_name string, idx int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"


def test_line_picking(spark):
    rows = [
        (1, "full_name", 0, "Họ và tên:", 0.9, 0.0, 0.0, 100.0, 20.0), (1, "full_name", 1, "NGUYỄN VĂN A", 0.9, 0.0, 25.0, 120.0, 45.0), (2, "full_name", 0, "Full name: TRẦN B", 0.8, 0.0, 0.0, 100.0, 20.0),
        (3, "place_of_origin", 0, "xã A", 0.7, 0.0, 0.0, 50.0, 10.0), (3, "place_of_origin", 1, "huyện B", 0.7, 0.0, 200.0, 50.0, 210.0), (4, "full_name", 0, None, 0.5, 0.0, 0.0, 1.0, 1.0), (5, "full_name", 0, "X Y", None, None, None, None, None),
    ]
    lines = spark.createDataFrame(rows, LINES)
    o = linepick.ordered(lines)
    assert sorted((r.crop_id, r.idx, r.line_no) for r in o.collect()) == [(1, 0, 0), (1, 1, 1), (2, 0, 0), (3, 0, 0), (3, 1, 1)]
    top = {r.crop_id: (r.value, r.kind) for r in linepick.candidates(o).filter("rank = 1").collect()}
    assert top[1][0] == "NGUYỄN VĂN A" and top[2] == ("TRẦN B", "same_line")
    assert sorted(r.value for r in linepick.blocks(o).filter("crop_id = 3").collect()) == ["huyện B", "xã A"]
    readings = spark.createDataFrame([(1, "full_name", "Họ và tên:", 0.9, "Họ và tên:\nNGUYỄN VĂN A"), (9, "full_name", "Z", 0.9, None)], "crop_id long, field_name string, text string, conf double, raw_text string")
    got = {r.crop_id: (r.new_text, r.replaced) for r in linepick.refine(lines, readings).collect()}
    assert got == {1: ("NGUYỄN VĂN A", True), 9: ("Z", False)}


def test_hypotheses(spark):
    rows = [(1, "full_name", 0, "B", 0.6, 2.0, 0.0), (1, "full_name", 1, "A long", 0.8, 1.0, 0.0), (1, "full_name", 2, " ", 0.9, 0.0, 0.0), (2, "title", 0, "Q", None, None, None)]
    h = linepick.hypotheses(spark.createDataFrame(rows, "crop_id long, field_name string, idx int, text string, score double, y double, x double"))
    got = {(r.crop_id, r.text): round(r.score, 6) for r in h.collect()}
    assert got == {(1, "A long"): 0.83, (1, "B"): 0.6, (1, "A long B"): 0.72, (2, "Q"): 0.0}
    assert {r.crop_id for r in linepick.best_hypothesis(h).collect()} == {1, 2}


def test_whole_or_part(spark):
    w = lambda a, x, b, y, goal: linepick.whole_or_part(*[F.lit(v) for v in ("full_name", a, x, b, y, goal)])
    r = one(spark, w("A B", 0.9, "", 0.9, ""), w("", 0.1, "A", 0.1, ""), w("Full name: X", 0.9, "A B", 0.1, ""), w("A C", 0.9, "A B", 0.5, "A B"), w("A B", 0.5, "A C", 0.6, ""), w("A B", 0.5, "A C", 0.5, ""))
    assert tuple(r) == ("whole", "part", "part", "part", "part", "whole")


def test_last_prediction_wins(spark):
    truth = spark.createDataFrame([("a\\b", "x", "t"), ("a/b", "x", None), ("q", "x", "t")], "crop_path string, field_name string, ground_truth_text string")
    pred = spark.createDataFrame([("a/b ", "x", 1, "old"), ("a/b", "x", 2, "new")], "crop_path string, field_name string, seq int, best_text string")
    assert sorted((r.best_text, r.ground_truth_text) for r in evaluate.match(truth, pred, "seq").collect()) == [("new", ""), ("new", "t")]


def test_rates_of_nothing(spark):
    r = spark.createDataFrame([], "field_name string, crop_path string, ground_truth_text string, text_vietocr string, text_paddle string, best_text string")
    assert evaluate.summary(evaluate.scored(r)).count() == 0 and evaluate.top_errors(evaluate.scored(r)).count() == 0


def test_average_precision_by_running_frames_only(spark):
    """Equal to brute force, and no frame that ends at the last row: its cost is a square of the rows."""
    rng = random.Random(3)
    rows = [(c, i // 7, i, rng.randrange(9), rng.random(), (i + 1) / n) for c, n in (("id", 400), ("name", 90), ("card", 1)) for i in range(n)]
    curve = spark.createDataFrame(rows, "class string, image_id long, det long, score long, precision double, recall double")
    got = evaluate.average_precision(curve)
    want = {}
    for c in ("id", "name", "card"):
        r = sorted((x for x in rows if x[0] == c), key=lambda x: (-x[3], x[1], x[2]))
        want[c] = (len(r), sum((x[5] - (r[i - 1][5] if i else 0)) * max(y[4] for y in r[i:]) for i, x in enumerate(r)))
    assert {x["class"]: (x.n, pytest.approx(x.average_precision)) for x in got.collect()} == want
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_review(spark):
    rows = [(1, "train", 0.85, "a"), (2, "train", None, "b"), (3, "train", 0.2, None), (4, "val", 0.1, "c")]
    df = spark.createDataFrame(rows, "row_id long, split string, best_conf double, source_image string")
    assert [r.row_id for r in review.select(df, review.PRESETS["train_confidence"]).collect()] == [2, 3]
    assert "ground_truth_text" in review.select(df, review.Selection()).columns


def test_issues(spark):
    images = spark.createDataFrame([(1, "train", 100, 100), (2, "val", 100, 100)], "image_id long, split string, width int, height int")
    ann = spark.createDataFrame([(1, 1, "card", -1.0, 0.0, 99.0, 99.0), (1, 2, "id", 0.0, 0.0, 5.0, 5.0), (1, 3, "name", 0.0, 0.0, 50.0, 50.0), (1, 4, "name", 0.0, 0.0, 50.0, 51.0)], "image_id long, seq int, class string, x double, y double, w double, h double")
    f = quality.issues(images, ann)
    got = sorted((r.image_id, r.kind) for r in f.collect())
    assert got == [(1, "bbox_out_of_bounds"), (1, "bbox_too_large"), (1, "bbox_too_small"), (1, "few_fields"), (1, "high_overlap"), (2, "missing_card_class"), (2, "no_annotation")]
    flagged = {r.image_id: (r.severity, r.issues) for r in quality.flagged(f).collect()}
    assert flagged[1][0] == "error" and "bbox_too_small:id:25px2" in flagged[1][1] and flagged[2][0] == "warning"


def test_sizes_with_a_height_of_zero(spark):
    size = lambda *v: quality.size_statistics(spark.createDataFrame(v, "width int, height int")).first()
    r = size((640, 0), (640, 480), (640, 640), (None, 0), (640, None))
    assert (r.height_min, r.height_max, r.aspect_min, r.aspect_max, r.aspect_mean) == (0, 640, 1.0, float("inf"), float("inf")) and math.isnan(r.aspect_std)
    r = size((0, 0), (10, 10))
    assert r.aspect_min == 1.0 and all(math.isnan(x) for x in (r.aspect_mean, r.aspect_max, r.aspect_std))
    assert size((-5, 0), (10, 10)).aspect_min == float("-inf")


def test_overlap_bands_lose_nothing(spark):
    rng = random.Random(3)
    boxes = [(1, i, "c", rng.uniform(0, 5), rng.uniform(0, 5), rng.uniform(20, 24), rng.uniform(20, 24)) for i in range(60)]
    df = spark.createDataFrame(boxes, "image_id long, seq int, class string, x double, y double, w double, h double")

    def iou(a, b):
        w = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        h = min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4])
        i = max(w, 0) * max(h, 0)
        return i / (a[5] * a[6] + b[5] * b[6] - i)

    for t in (0.6, 0.8, 0.9):
        assert {(r.seq_a, r.seq_b) for r in quality.overlaps(df, t).collect()} == {(a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and iou(a, b) > t}


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("é", None, 1), ("b", 0.5, 2)], "text string, score double, n long")
    files.write_jsonl(df, str(tmp_path / "j"), single=True)
    back = files.read_jsonl(spark, str(tmp_path / "j"), schemas.struct(text=schemas.S, score=schemas.D, n=schemas.L))
    assert sorted(map(tuple, back.collect()), key=lambda r: r[2]) == [("é", None, 1), ("b", 0.5, 2)]
    (tmp_path / "bom.jsonl").write_bytes(b'\xef\xbb\xbf{"text": "x"}\n\n{"text": "y"}\n')
    assert [r.text for r in files.read_jsonl(spark, str(tmp_path / "bom.jsonl"), schemas.struct(text=schemas.S)).filter("text is not null").collect()] == ["x", "y"]
    doc = '{"images": [{"id": 3, "file_name": "a.jpg", "width": 4, "height": 5}], "annotations": [{"id": 1, "image_id": 3, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 2, "name": "id"}]}'
    (tmp_path / "c.json").write_text(doc)
    t = files.read_coco(spark, {"train": str(tmp_path / "c.json"), "val": str(tmp_path / "c.json")})
    assert t["images"].count() == 2 and t["categories"].count() == 1 and t["annotations"].first().bbox == [1, 2, 3, 4]
    s = spark.createDataFrame([("e", "per_field", "a", 1, 0.1, 0.1, 0.0), ("e", "overall", "*", 1, 0.1, 0.1, 0.0)], "engine string, scope string, field_name string, count long, cer double, wer double, exact_match_rate double")
    files.write_summary_csv(s, str(tmp_path / "csv"))
    assert [r.field_name for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()] == ["*", "a"]
    assert files.markdown_table(s).startswith("| engine |") and "nc: 2" in files.yolo_config(["a", "b"], "/d")


def test_numbers_without_a_global_sort(spark):
    df = spark.createDataFrame([(i * 977,) for i in range(500)], "id long")
    got = sorted((r.id, r.no) for r in files.number(df, "id", "no", 1000).collect())
    assert got == [(i * 977, i) for i in range(500)]


def test_inference_hook(spark):
    class Fake:
        def predict(self, image, field):
            if image[0, 0] == 9:
                raise RuntimeError("bad")
            return {"text": f"T{image[0, 0]}", "prob": "0.5"}

    rows = [(1, "title", bytearray(b"\x01\x02")), (2, "title", None), (3, "title", bytearray(b"\x09\x09"))]
    out = inference.recognise(spark.createDataFrame(rows, "crop_id long, field_name string, content binary"), Fake, "fake", 2)
    got = {r.crop_id: (r.text, r.score, r.error) for r in out.collect()}
    assert got[1] == ("T1", 0.5, None) and got[2][0] == "" and "no picture" in got[2][2] and "bad" in got[3][2]
    assert inference.parse_prediction(("x", "q")) == ("x", None) and inference.parse_prediction(None) == ("", None)
    done = inference.finish(out, F.lit("title")).filter("crop_id = 1").first()
    assert done.clean == "T1" and 0 < done.conf < 1


def test_video(spark):
    names = spark.createDataFrame([("Hanoi",), ("Hue",), (None,)], "name string")
    v = spark.createDataFrame([("hanoj",), ("Huee",), ("nowhere",), (None,)], "value string")
    assert {(r.value, r.name) for r in video.nearest_name(v, names, 2).collect()} == {("hanoj", "Hanoi"), ("Huee", "Hue")}
    b = spark.createDataFrame([(1, 1, "c", 0.0, 0.0, 10.0, 10.0, 0.9), (2, 1, "c", 1.0, 0.0, 10.0, 10.0, 0.1), (3, 1, "c", 90.0, 0.0, 10.0, 10.0, 0.5)], "box_id long, image_id long, class string, x double, y double, w double, h double, score double")
    assert sorted((r.n, round(r.x, 6)) for r in video.fuse(b).collect()) == [(1, 90.0), (2, 0.1)]
    r = spark.createDataFrame([("k", "f", "a", 0.9), ("k", "f", "b", 0.5), ("k", "f", "b", 0.4), ("m", "f", "a", 0.1), ("m", "f", "b", 0.2)], "clip string, field string, text string, score double")
    assert {(x.clip, x.text) for x in video.vote(r).collect()} == {("k", "b"), ("m", "b")}


def test_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    from fieldloom.streaming import reviews

    t = datetime(2024, 1, 1)
    rows = [(i, t + timedelta(minutes=7 * i), i % 3, "k", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    src = reviews.read_stream(spark, str(tmp_path / "in"), df.schema, 1)
    reviews.run_available(reviews.counts(src), str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() > 0 and out.agg(F.sum("n")).first()[0] <= 60
    q = reviews.running_best(reviews.read_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("update").format("memory").queryName("best").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert {(r.user_id, r.n, r.best) for r in spark.sql("select user_id, max(n) n, max(best) best from best group by user_id").collect()} == {(k, 20, 57.0 + k) for k in range(3)}
