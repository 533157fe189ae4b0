"""Tokenizer encoding against the library, and packing."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import bpe, packing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    with open(bpe.DEFAULT_VOCABULARY, encoding="utf-8") as f:
        return t, bpe.PairIndexEncoder(f.read())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aAbB '\n\t1ế<|endoftext|>", max_size=60)), max_size=5))
def test_ids_equal_the_library(both, texts):
    t, mine = both
    assert mine.encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_table(spark, both):
    long = "Thôn " * 30_000 + "a" * 5000
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, "x <|endoftext|>"), (5, "x <|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(1), "t": F.lit(2), "ids": F.lit(3), "n": F.lit(4)})
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.token_ids(df).collect())
    want = sorted((k, both[0].encode(v or "", add_special_tokens=False).ids) for k, v in rows)
    assert got == want
    assert sorted((r.doc_id, r.n) for r in bpe.token_counts(df).collect()) == [(k, len(v)) for k, v in want]
    assert bpe.token_ids(df.limit(0)).count() == 0


def check(packed, counts, capacity):
    used, seen = {}, {}
    for r in packed:
        used.setdefault(r.container_id, []).append((r.place, r.n_tokens))
        seen.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens, r.piece_no))
    for parts in used.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and parts[-1][0] + parts[-1][1] <= capacity
    assert sorted(used) == list(range(len(used)))
    for k, n in counts:
        parts = sorted(seen.get(k, []))
        assert sum(p[1] for p in parts) == (n or 0) and (len(parts) == 1 or n is None or n == 0 or n > capacity)
        assert all(a + m == b for (a, m, _), (b, _, _) in zip(parts, parts[1:]))
    return len(used)


def test_packing_is_tight_and_whole(spark):
    rng = random.Random(1)
    counts = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 300), 64])) for i in range(800)] + [(9000, 0), (9001, None), (9002, 64), (9003, 65), (9004, 640)]
    df = spark.createDataFrame(counts, "doc_id long, n int").withColumns({"rank": F.lit(1), "cell": F.lit(2), "place": F.lit(3)})
    packed = packing.pack(df, capacity=64, group=8).collect()
    n = check(packed, counts, 64)
    least = -(-sum(c or 0 for _, c in counts) // 64)
    assert n <= least * 1.03 + 1
    loads = {}
    for r in packed:
        loads[r.step_group] = loads.get(r.step_group, 0) + r.n_tokens
    assert max(loads.values()) - min(loads.values()) <= 3 * 64
    assert packing.pack(df.limit(0), capacity=64).count() == 0
    assert packing.report(packing.pack(df.limit(0))).first().containers == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 1000), max_size=20))
def test_plan_holds_every_item(h):
    patterns = packing.plan(h, 50)
    held = {}
    for p in patterns:
        assert sum(p.sizes) + p.gap == 50 and p.gap >= 0 and p.n > 0
        for s in p.sizes:
            held[s] = held.get(s, 0) + p.n
    assert held == h
    assert len(packing.plan({k: v * 10**9 for k, v in h.items()}, 50)) <= 200


def test_tiers_change_the_packing():
    """With one tier it is best-fit decreasing; each further tier packs windows of its own size first."""
    rng = random.Random(5)
    h = {rng.randrange(1, rng.choice([150, 400, 900, 2049])): rng.randrange(1, 40) for _ in range(600)}
    shape = {levels: sorted((p.n, tuple(sorted(p.sizes))) for p in packing.plan(h, 2048, levels)) for levels in (1, 2, 3, 4)}
    assert len({str(v) for v in shape.values()}) == 4
    least = -(-sum(s * n for s, n in h.items()) // 2048)
    assert all(sum(n for n, _ in v) <= least * 1.02 + 1 for v in shape.values())


def test_windows_keep_to_their_tier_and_gaps_are_filled_from_shorter_ones():
    capacity = 64
    h = {60: 3, 40: 2, 30: 5, 17: 4, 9: 8, 4: 2, 3: 5}
    for p in packing.plan(h, capacity, 3):
        low, top = packing.tiers(capacity, 3)[p.tier]
        own = [s for s in p.sizes if low <= s <= top]
        assert own and all(s <= top for s in p.sizes)  # nothing longer than the tier that opened it
    longest = [p for p in packing.plan(h, capacity, 3) if p.tier == 0]
    assert sum(p.n for p in longest) == 5 and all(any(s <= 32 for s in p.sizes) for p in longest)


def test_plan_refuses_sizes_beyond_the_capacity():
    with pytest.raises(ValueError):
        packing.plan({51: 1}, 50)
