"""Group splits."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import groupsplit as G

SCHEMA = "row_id long, split string, source_image string, crop_path string"


def united(edges):
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in edges:
        par[find(a)] = find(b)
    return {v: find(v) for v in par}


@pytest.mark.parametrize("edges", [
    [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)],
    [(random.Random(4).randrange(50), random.Random(i).randrange(50)) for i in range(60)], [(i, i + 1) for i in range(0, 20, 2)] + [(1, 2), (19, 0)],
])
def test_components_equal_union_find(spark, edges):
    got = {r.vertex: r.component for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = united(edges)
    assert got.keys() == want.keys()
    pairs = {(got[v], want[v]) for v in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_nothing(spark):
    assert G.components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


def test_coins_contract_stars(spark):
    """A star is contracted by tosses, in few rounds, whatever its size; each round's heads stay."""
    for n in (1, 2, 2000):
        live = G._simple(spark.createDataFrame([(0, i) for i in range(1, n + 1)], "a long, b long"))
        mates = G._mates(live, 0).collect()
        assert mates and not {r.v for r in mates} & {r.head for r in mates}
        assert len({r.v for r in mates}) == len(mates)
    stars = G._simple(spark.createDataFrame([(3 * i, 3 * i + j) for i in range(300) for j in (1, 2)], "a long, b long"))
    won = [r.head % 3 == 0 for r in G._mates(stars, 0).dropDuplicates(["head"]).collect()]
    assert 170 <= sum(won) <= 230 and len(won) == 300  # the hub wins two of three tosses, not all


ROWS = [
    (1, "train", "x/IMG00000001.jpg", "c/a.jpg"), (2, "valid", "img00000001_blur_jpg.rf.ab.jpg", "c/b.jpg"), (3, "val", "b\\img00000002.png", None), (4, "val", None, "q/img00000002_9.jpg"),
    (5, None, "img00000001.jpg", None), (6, "test", None, None), (7, "train", "odd.jpg", None), (8, "test", "z/ODD.JPG", None), (9, "train", "img00000001.jpg", ""), (10, "test", "img000000017.jpg", None),
]


def test_torn_groups(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({"a": F.lit(1), "key": F.lit(2), "component": F.lit(3), "name": F.lit(4)})
    got = {(r.group_id, r.row_id) for r in G.torn(df).collect()}
    assert got == {(1, 1), (1, 2), (1, 9), (7, 7), (7, 8)}
    assert G.torn(df.limit(0)).count() == 0


def test_assignment_keeps_groups_and_shares(spark):
    rng = random.Random(2)
    rows = [(i, "train", f"img{0 if i % 3 == 0 else rng.randrange(400):08d}.jpg", None) for i in range(3000)]
    t = spark.createDataFrame([("train", 0.7), ("val", 0.15), ("test", 0.15), ("none", 0.0), ("null", None)], "split string, share double")
    out = G.assign(spark.createDataFrame(rows, SCHEMA), t).collect()
    assert len(out) == 3000
    where, n = {}, {}
    for r in out:
        assert where.setdefault(r.component, r.new_split) == r.new_split
        n[r.new_split] = n.get(r.new_split, 0) + 1
    assert {k: round(v / 3000, 2) for k, v in n.items()} == {"train": 0.7, "val": 0.15, "test": 0.15}
    assert G.assign(spark.createDataFrame([], SCHEMA), t).count() == 0
