"""Rectification, manifest, documents and runs with two recognisers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import pixels as X
from fieldloom.operators import cards, inference, quality
from fieldloom.sources import files


def picture(w=120, h=80):
    return np.add.outer(np.arange(h), 2 * np.arange(w)).astype(np.uint8)


def test_rectified_pictures():
    a = picture()
    corners = [[119, 79], [0, 0], [119, 0], [0, 79]]
    assert (cards.rectify_polygon(a, corners, 120, 80) == a).all()
    assert (cards.rectify_box(a, [0, 0, 120, 80], 120, 80) == a).all()
    assert cards.rectify_box(a, [500, 500, 600, 600], 30, 20).shape == (20, 30)  # an empty part: the whole picture
    with pytest.raises(ValueError):
        cards.rectify_polygon(a, corners[:3])


def test_rectify_function_is_total(spark):
    raw = bytes(picture().tobytes())
    rows = [(1, raw, [[0.0, 0.0], [119.0, 0.0], [119.0, 79.0], [0.0, 79.0]], None), (2, raw, None, [10.0, 10.0, 60.0, 40.0]), (3, raw, None, None), (4, None, None, None), (5, b"", None, None), (6, raw, [[1.0, 1.0]] * 4, None), (7, raw, [[1.0, 1.0]], None)]
    df = spark.createDataFrame(rows, "id long, content binary, polygon array<array<double>>, box array<double>")
    got = {r.id: r.r for r in df.select("id", cards.rectify_udf(120, 60, 40)("content", "polygon", "box").alias("r")).collect()}
    assert [got[i].method for i in range(1, 8)] == ["polygon_warp", "bbox_crop", "none", "none", "none", "none", "none"]
    assert [None if got[i].content is None else len(got[i].content) for i in range(1, 8)] == [2400, 2400, 9600, None, None, None, None]
    assert all(got[i].error for i in (4, 5, 6, 7)) and not any(got[i].error for i in (1, 2, 3))


def test_box_rectification_equals_the_solved_map(spark):
    df = spark.createDataFrame([(1, 640, 480, 100.0, 50.0, 500.0, 300.0), (2, 640, 480, -9.0, -9.0, 700.0, 500.0), (3, 640, 480, None, None, None, None)], "id int, width int, height int, x1 double, y1 double, x2 double, y2 double")
    df = df.withColumn("card", F.when(F.col("x1").isNotNull(), G.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])))
    got = {r.id: r.rectification for r in cards.prepared(df, ratio=0.05).collect()}
    assert tuple(got[1].box) == (80.0, 37.5, 520.0, 312.5) and tuple(got[2].box) == (0.0, 0.0, 640.0, 480.0)
    for i in (1, 2):
        src = np.array([list(p) for p in got[i].corners])
        m = X.homography(src, np.array([[0, 0], [855, 0], [855, 539], [0, 539]], float))
        assert np.allclose(np.array(got[i].matrix).reshape(3, 3), m)
    assert (got[3].method, got[3].confidence, got[3].fallback, got[3].matrix) == ("none", 0.0, False, None) and got[1].method == "bbox_crop" and got[1].fallback


def test_manifest(spark):
    images = spark.createDataFrame([(1, "train", "a.b.jpg", 640, 640), (2, "val", "c.png", 640, 640), (3, "val", "gone.jpg", 640, 640)], "image_id long, split string, file_name string, width int, height int").withColumn("score", F.lit(7))
    ann = [(1, 10, "card", 100.0, 100.0, 400.0, 250.0), (1, 11, "card", 0.0, 0.0, 10.0, 10.0), (1, 12, "name", 200.0, 150.0, 100.0, 30.0), (1, 13, "name", 200.0, 150.0, 2.0, 2.0), (2, 20, "name", 5.0, 5.0, 50.0, 20.0), (3, 30, "name", 5.0, 5.0, 50.0, 20.0), (2, 21, "logo", 5.0, 5.0, 50.0, 20.0)]
    a = spark.createDataFrame(ann, "image_id long, id long, class string, x double, y double, w double, h double")
    index = spark.createDataFrame([("a.b.jpg", ".\\p\\a.b.jpg"), ("c.png", "p/c.png")], "file_name string, path string")
    rows = {r.annotation_id: r for r in cards.manifest(images.drop("score"), a, index, ["name"], quality_score=spark.createDataFrame([(2, 0.5)], "image_id long, score double")).collect()}
    assert set(rows) == {12, 20}  # too small, no picture, no wanted field
    assert rows[12].crop_path == "crops/name/a.b_12.jpg" and rows[12].image_path == "p/a.b.jpg" and rows[12].rectification_method == "bbox_crop" and rows[12].image_quality_score is None
    assert rows[20].rectification_method == "none" and rows[20].image_quality_score == 0.5 and rows[20].bbox == rows[20].source_bbox
    x1 = (200 - 4 - 80) * 855 / 440
    assert abs(rows[12].bbox[0] - x1) < 0.01
    assert cards.manifest(images, a, index, ["name"], rectify=False).filter("rectification_method <> 'none'").count() == 0
    assert cards.manifest(images.limit(0), a.limit(0), index, ["name"]).count() == 0


def test_annotation_documents(spark, tmp_path):
    images = spark.createDataFrame([(7, "b.jpg", 10, 20), (3, 'q"é.jpg', 10, 20), (9, "x.jpg", 1, 1)], "id long, file_name string, width int, height int")
    a = spark.createDataFrame([(70, 7, 1, [1.0, 2.0, 3.0, 4.0]), (30, 3, 0, [0.5, 0.0, 1.0, 1.0]), (71, 9, 0, [0.0, 0.0, 1.0, 1.0])], "id long, image_id long, category_id int, bbox array<double>")
    cats = spark.createDataFrame([(0, "card"), (1, "name")], "id int, name string")
    root = str(tmp_path)
    files.write_coco(images, a, cats, f"{root}/val.json", spark.createDataFrame([(7,), (3,)], "image_id long"), description="d", version="2")
    part = next(p for p in (tmp_path / "val.json").iterdir() if p.name.endswith(".txt"))
    doc = json.loads(part.read_text(encoding="utf-8"))
    assert doc["info"] == {"description": "d", "version": "2"} and doc["licenses"] == [] and [i["file_name"] for i in doc["images"]] == ['q"é.jpg', "b.jpg"]
    assert [(x["id"], x["image_id"], x["category_id"]) for x in doc["annotations"]] == [(0, 0, 0), (1, 1, 1)]
    found = files.find_documents(spark, root)
    assert found == {"val": f"{root}/val.json"}
    t = files.read_coco(spark, found)
    assert t["images"].count() == 2 and t["annotations"].count() == 2 and t["categories"].count() == 2
    files.write_coco(images.limit(0), a.limit(0), cats, f"{root}/test.json")
    assert json.loads(next(p for p in (tmp_path / "test.json").iterdir() if p.name.endswith(".txt")).read_text())["images"] == []
    assert files.first_existing(spark, None, [f"{root}/no", f"{root}/val.json"]) == f"{root}/val.json" and files.first_existing(spark, "given", []) == "given"


def test_label_files(spark, tmp_path):
    files.write_label_files(spark.createDataFrame([("val", "p/a.jpg", "0 1 2"), ("val", "b.png", "")], "split string, file_name string, label string"), str(tmp_path))
    assert {p.name: p.read_text() for p in (tmp_path / "val").iterdir()} == {"a.txt": "0 1 2", "b.txt": ""}


def recognisers():
    """Two loaders, made here so that they travel to the workers by value."""

    class Lines:
        def predict(self, image, field):
            if image[0, 0] == 9:
                raise RuntimeError("broken")
            return [{"text": "Full name:", "score": 0.9, "box": [[0, 0], [60, 0], [60, 14], [0, 14]]}, {"text": "TRAN VAN B", "score": 0.9, "box": [[0, 18], [60, 18], [60, 34], [0, 34]]}]

    class Words:
        def predict(self, image, field):
            if image[0, 0] == 9:
                raise RuntimeError("broken")
            return ("TRAN VAN B", 0.97) if image.shape[0] < 40 else {"text": "Full name:", "prob": 0.3}

    return lambda: Words(), lambda: Lines()


@pytest.fixture(scope="module")
def crops(spark):
    fill = lambda v: bytes(np.full((40, 64), v, np.uint8).tobytes())
    return spark.createDataFrame([(1, "name", fill(1)), (2, "name", fill(9)), (3, "name", None)], "crop_id long, field_name string, content binary")


def test_two_recognisers(spark, crops):
    got = {r.crop_id: r for r in inference.both(crops, recognisers()[0], recognisers()[0], 64).collect()}
    assert got[3].engine == "ensemble" and got[3].reason == "empty_image" and got[3].needs_review and got[3].text == ""
    assert got[2].needs_review and len(got[2].errors) == 2 and "broken" in got[2].errors[0]
    assert got[1].engine in ("agree", "vietocr", "paddleocr") and not got[1].errors


def test_hybrid_reads_the_part_where_the_value_stands(spark, crops):
    got = {r.crop_id: r for r in inference.hybrid(crops, *recognisers(), 64).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].paddle == "TRAN VAN B" and got[1].viet == "TRAN VAN B" and got[1].part == "part"
    assert got[2].part == "whole" and got[3].part == "whole"


def test_adapters():
    import numpy as np

    class Client:
        made = 0

        def __init__(self, lang="vi"):
            Client.made += 1
            if Client.made == 1:
                raise RuntimeError("broken cache")
            self.lang = lang

        def predict(self, image, return_prob=False):
            return (f"{self.lang} {image.shape}", 0.5) if return_prob else "x"

    a = inference.Adapter("vietocr", Client, options={"lang": "en", "show_log": False}, asked={"return_prob": True, "other": 1}, repair=lambda e: "cache" in str(e))
    assert a.predict(np.zeros((20, 100), np.uint8), "id") == ("en (64, 256)", 0.5) and a.predict(np.zeros((90, 100), np.uint8), None)[0] == "en (108, 112)" and Client.made == 2
    Client.made = 0
    with pytest.raises(RuntimeError):
        inference.Adapter("vietocr", Client).predict(np.zeros((9, 9), np.uint8), None)
    assert inference.pick_device("auto", False) == "cpu" and inference.pick_device("cuda:0", True) == "gpu" and inference.pick_device("CPU", True) == "cpu"
    for wanted, there in (("gpu", False), ("tpu", True)):
        with pytest.raises((RuntimeError, ValueError)):
            inference.pick_device(wanted, there)
    ramp = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (5, 1))
    assert (X.reading_picture(ramp, (0.1, 0.1), 1, 1)[1:-1, 2:-2] == ramp).all() and abs(X.cubic_matrix(7, 19).sum(1) - 1).max() < 1e-12


def test_statistics_document(spark):
    images = spark.createDataFrame([(1, "train", 10, 20), (2, "val", 10, 20)], "image_id long, split string, width int, height int")
    a = spark.createDataFrame([(1, 1, "id", 0.0, 0.0, 2.0, 3.0)], "image_id long, seq int, class string, x double, y double, w double, h double")
    doc = quality.statistics_document(quality.dataset_statistics(images, a, spark.createDataFrame([(1, 100.0)], "image_id long, mean double")))
    assert doc["total"] == {"images": 2.0, "annotations": 1.0} and doc["boxes"]["empty"] == 1 and doc["class"]["id"]["mean_area"] == 6 and doc["split"]["val"]["images"] == 1
    json.dumps(doc)


def test_command_line(spark, tmp_path):
    from fieldloom.__main__ import main

    read = lambda name: [json.loads(x) for p in (tmp_path / name).iterdir() if p.name.startswith("part") and not p.name.endswith(".crc") for x in p.read_text(encoding="utf-8").splitlines() if x]
    rows = [{"crop_path": f"c/{i}.jpg", "field_name": "name", "split": "val", "ann_id": i, "text_vietocr": "A B", "conf_vietocr": 0.9, "text_paddle": "A C", "conf_paddle": 0.2, "best_text": "A B", "best_conf": i / 4, "ground_truth_text": "A B"} for i in range(4)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    at = lambda n: str(tmp_path / n)
    main(["evaluate", "--input", at("in.jsonl"), "--output", at("e")], spark)
    doc = json.loads("\n".join(p.read_text() for p in (tmp_path / "e" / "summary.json").iterdir() if p.name.startswith("part")))
    assert doc["best"]["overall"]["exact_match_rate"] == 1.0 and doc["paddleocr"]["per_field"]["name"]["cer"] == 1 / 3
    main(["queue", "--candidates", at("no"), at("in.jsonl"), "--output", at("q"), "--preset", "val_medium", "--limit", "2"], spark)
    assert [r["ann_id"] for r in read("q")] == [0, 1]
    main(["labels", "--input", at("in.jsonl"), "--output", at("l")], spark)
    assert {r["best_source"] for r in read("l")} == {"vietocr"} and len(read("l")) == 4
    (tmp_path / "data" / "val").mkdir(parents=True)
    (tmp_path / "data" / "val" / "a.jpg").write_bytes(b"x")
    coco = {"images": [{"id": 5, "file_name": "a.jpg", "width": 640, "height": 640}], "annotations": [{"id": 1, "image_id": 5, "category_id": 2, "bbox": [10, 10, 90, 30]}], "categories": [{"id": 2, "name": "name"}]}
    (tmp_path / "data" / "val" / "_annotations.coco.json").write_text(json.dumps(coco))
    main(["manifest", "--root", at("data"), "--output", at("m")], spark)
    assert [(r["crop_path"], r["rectification_method"]) for r in read("m")] == [("crops/name/a_1.jpg", "none")]
    main(["statistics", "--root", at("data"), "--output", at("s")], spark)
    assert json.loads("\n".join(p.read_text() for p in (tmp_path / "s").iterdir() if p.name.startswith("part")))["total"]["images"] == 1
    with pytest.raises(SystemExit):
        main(["queue", "--preset", "nothing", "--output", "x"], spark)


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from fieldloom import runtime

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, default=None: default)

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())
