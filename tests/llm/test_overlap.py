"""Cross-split overlaps against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import lookalike, overlap

SCHEMA = "row_id long, split string, crop_path string, ground_truth_text string, best_source string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edit(rng, t, k):
    t = list(t)
    for _ in range(k):
        i = rng.randrange(len(t) + 1)
        op = rng.randrange(3)
        if op == 0:
            t.insert(i, rng.choice("abcdxyz"))
        elif i < len(t):
            t[i : i + 1] = [] if op == 1 else [rng.choice("abcdxyz")]
    return "".join(t)


def make(rng, n=140):
    base = ["".join(rng.choices("abcde", k=rng.randrange(18, 70))) for _ in range(20)] + ["".join(rng.choices("ab", k=400))]
    rows = []
    for i in range(n):
        t = edit(rng, rng.choice(base), rng.randrange(9))
        if i % 10 == 0:
            t = " ".join(t[j : j + 7] for j in range(0, len(t), 7)).upper() + ","
        split = rng.choice(["train", "train", "val", "valid", "test", None])
        rows.append((i, split, f"a/{rng.choice('xyz')}\\f{rng.randrange(60)}.jpg", t, "s"))
    rows += [(900, "train", None, None, None), (901, "test", "", "", None), (902, "test", "q/", " ", "s"), (903, "train", "b/same.jpg", "short", "s"), (904, "val", "c\\same.jpg", "short", "s"), (905, "val", "c\\same.jpg", "short", "s")]
    return rows


def brute(rows):
    bare = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    name = lambda p: (p or "").replace("\\", "/").rstrip("/").split("/")[-1]
    out = set()
    for i, s, p, t, _ in rows:
        for j, s2, p2, t2, _ in rows:
            if s != "train" or s2 not in ("val", "valid", "test"):
                continue
            a, b = bare(t), bare(t2)
            near = min(len(a), len(b)) >= 20 and distance(a, b) <= max(len(a), len(b)) // 10
            if (name(p) and name(p) == name(p2)) or near:
                out.add((min(i, j), max(i, j)))
    return out


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = make(random.Random(seed))
        got = [tuple(r) for r in overlap.found(spark.createDataFrame(rows, SCHEMA)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_small_shards_and_slices_change_nothing(spark, monkeypatch):
    rows = make(random.Random(5), 90)
    monkeypatch.setattr(overlap, "SHARD_TEXTS", 3)
    monkeypatch.setattr(overlap, "SHARD_WINDOWS", 5)
    monkeypatch.setattr(overlap, "SLICE_TEXTS", 4)
    monkeypatch.setattr(overlap, "FEW_TEXTS", 3)
    assert {tuple(r) for r in overlap.found(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_work_grows_with_the_names_and_near_texts_only(spark, monkeypatch):
    """Each name passes one automaton, and texts that share a piece in its place but not their letters are no candidates."""
    seen = []
    monkeypatch.setattr(overlap, "SHARD_NAMES", 10)
    monkeypatch.setattr(overlap, "_passed", lambda *_: seen.append(1))
    names = lambda a, b: spark.createDataFrame([(f"{i}.jpg",) for i in range(a, b)], "file string")
    assert sorted(r.file for r in overlap.shared_files(names(0, 80), names(60, 120)).collect()) == sorted(f"{i}.jpg" for i in range(60, 80)) and not seen
    monkeypatch.undo()
    made, passed = [], overlap._passed
    monkeypatch.setattr(overlap, "_passed", lambda *a: made.append(passed(*a)) or made[-1])
    t = "duonghoasen" + "abcdefghij" + "tinhhaile"
    texts = lambda *v: spark.createDataFrame([(x,) for x in v], "text string")
    train = texts(t, t[:11] + "klmnopqrst" + t[21:], t[:5] + "x" + t[6:], t[1:], t + "zz", "0" + t)
    got = overlap.similar_texts(train, texts(t))
    assert {r.text_t for r in got.collect()} == {t, t[:5] + "x" + t[6:], t[1:], t + "zz", "0" + t}
    assert made[0].count() == 5


def test_windows_fit_and_are_disjoint():
    cells = np.random.default_rng(0).integers(0, 9, 1 << overlap.SKETCH_BITS)
    for n in [*range(20, 300), 1000, 5000]:
        w = overlap.windows("ab" * (n // 2) + "c" * (n % 2), cells)
        assert len(w) == overlap.edits(n) + 1 and all(b - a >= overlap.WINDOW for a, b in zip(w, w[1:])) and w[0] >= 0 and w[-1] + overlap.WINDOW <= n


def test_empty_report_and_coverage(spark):
    rows = make(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"side": F.lit(1), "text": F.lit(2), "file": F.lit(3), "n": F.lit(4)})
    assert overlap.found(df.limit(0)).count() == 0
    rep = overlap.report(df).collect()
    assert sum(r.pairs for r in rep) == len(brute(rows)) and sum(r.records for r in rep) == sum(r[1] in ("val", "valid", "test") for r in rows)
    cov = overlap.coverage(df).collect()
    assert sorted(r.row_id for r in cov) == sorted(r[0] for r in rows if r[1] in ("val", "valid", "test"))  # every evaluation record, once
    assert all(0 <= r.covered <= r.chars for r in cov) and any(r.covered for r in cov)


def test_file_names_are_found_whole(spark):
    """The automaton's hits count only from end to end: no name within another."""
    names = lambda *v: spark.createDataFrame([(x,) for x in v], "file string")
    got = overlap.shared_files(names("a.jpg", "xa.jpg", "b.png", None, "é.jpg", "a.jpg"), names("a.jpg", "xa.jpg.bak", "b.pn", "é.jpg", None)).collect()
    assert sorted(r.file for r in got) == ["a.jpg", "é.jpg"]
    assert overlap.shared_files(names(), names("a")).count() == 0


def test_bare_form(spark):
    df = spark.createDataFrame([("Số 1, ĐƯỜNG-x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(overlap.bare(F.col("t"))).collect()] == ["so1duongx", "", None]
    assert lookalike.LETTERS


def covered_by_brute(rows, size):
    bare = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    train, out = [bare(t) for _, s, _, t, _ in rows if s == "train"], {}
    for i, s, _, t, _ in rows:
        e = bare(t)
        if s in ("val", "valid", "test"):
            at = {k for j in range(len(e) - size + 1) if any(e[j : j + size] in x for x in train) for k in range(j, j + size)}
            if at:
                out[i] = (len(e), len(at))
    return out


def test_coverage_equals_brute_force_over_all_training_texts(spark, monkeypatch):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=90))
    rows = make(rng, 60) + [(800, "train", None, long, "s"), (801, "train", None, "qwertyuiop", "s")]
    # within a longer text; in parts of two texts; twice; too far from any text as a whole; nothing shared
    rows += [(810, "val", None, long[30:55], "s"), (811, "test", None, long[:22] + "0123456789" + "qwertyuiop" + "98765432101234", "s"), (812, "val", None, long[30:55], "s"), (813, "test", None, "7" * 30, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = covered_by_brute(rows, overlap.WINDOW)
    assert want[810] == want[812] == (25, 25) and want[811] == (56, 32) and 813 not in want
    got = {r.row_id: (r.chars, r.covered, r.share) for r in overlap.coverage(df).collect()}
    assert {k: v[:2] for k, v in got.items() if v[1]} == want and got[813][1:] == (0, 0.0)
    assert all(abs(v[2] - (v[1] / v[0] if v[0] else 0)) < 1e-12 for v in got.values())
    monkeypatch.setattr(overlap, "SHARD_WINDOWS", 40)
    monkeypatch.setattr(overlap, "SLICE_TEXTS", 9)
    got = {}
    for r in overlap.intervals(df, overlap.MIN_CHARS).collect():
        n, c = got.get(r.row_id, (r.chars, 0))
        got[r.row_id] = (n, c + r.b - r.a)
    assert got == covered_by_brute(rows, overlap.MIN_CHARS)
