"""Problem 7: filling containers of fixed capacity with documents, sized in tokens.

Sizes are whole numbers up to the capacity, so a corpus of any length has at most ``capacity`` sizes. Their histogram
is packed, not the documents. Documents are routed to tiers of context sizes: the capacity, its half, its quarter and
so on, each to the shortest window that holds it. Tiers are packed from long to short. A tier's documents go into
windows of the tier's own size, best fit first; as many windows as the capacity holds make a container, and the gap
of its windows together is filled from shorter tiers, the longest document that fits first. What is left of the
shorter tiers is packed when its turn comes. The result is a list of patterns (which sizes a container holds) with
multiplicities, whose length depends on the capacity only. Documents are then dealt to the slots of the patterns by
their rank among documents of their size. Containers are ordered by fill and dealt to step groups in a snake, so that
groups have nearly the same number of tokens.

Only a document longer than the capacity is cut: into whole containers and one rest, which is packed like any other.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.runtime import materialize

CAPACITY = 2048
CELL_ROWS = 100_000  # documents of one size that are ranked in one task, about


@dataclass
class Pattern:
    """``n`` containers alike: runs of (size, times) in order of placement, free tokens and the tier that opened them."""

    n: int
    gap: int
    tier: int
    runs: list[tuple[int, int]] = field(default_factory=list)

    @property
    def sizes(self) -> list[int]:
        return [s for s, k in self.runs for _ in range(k)]


def tiers(capacity: int, levels: int = 4) -> list[tuple[int, int]]:
    """Context-size tiers from long to short as (least, most) sizes; each is half of the one before."""
    out, top = [], capacity
    for i in range(levels):
        low = 0 if i == levels - 1 else top // 2
        if top > low:
            out.append((low + 1, top))
        top = low
    return out


def _windows(left: dict[int, int], low: int, top: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The tier's documents in windows of ``top``: (how many alike, runs of sizes); takes them out of ``left``.

    Best-fit decreasing: each size, from long to short, goes into the fullest windows that hold it.
    """
    by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    gaps: list[int] = []

    def put(n: int, gap: int, runs: list[tuple[int, int]]) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            bisect.insort(gaps, gap)
        by_gap[gap].append((n, runs))

    for s in range(top, low - 1, -1):
        count = left.pop(s, 0)
        while count:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):
                each = top // s
                full, rest = divmod(count, each)
                if full:
                    put(full, top - each * s, [(s, each)])
                if rest:
                    put(1, top - rest * s, [(s, rest)])
                break
            gap = gaps[at]
            n, runs = by_gap[gap].pop()
            used = min(n, count)
            if used < n:
                by_gap[gap].append((n - used, runs))
            elif not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            put(used, gap - s, [*runs, (s, 1)])
            count -= used
    return [w for gap in gaps for w in by_gap[gap]]


def _fill(p: Pattern, left: dict[int, int], sizes: list[int]) -> list[Pattern]:
    """``p`` with its gap filled from ``left``, the longest size that fits first; parted where a size runs out.

    ``sizes``: those of ``left`` in ascending order.
    """
    done = []
    while p.n:
        at = bisect.bisect_right(sizes, p.gap) - 1
        if at < 0:
            return [*done, p]
        s = sizes[at]
        each = min(p.gap // s, max(1, left[s] // p.n))
        n = min(p.n, left[s] // each)
        if n < p.n:
            p, rest = Pattern(n, p.gap, p.tier, p.runs), Pattern(p.n - n, p.gap, p.tier, p.runs)
        else:
            rest = None
        left[s] -= n * each
        if not left[s]:
            del left[s]
            sizes.pop(at)
        p = Pattern(n, p.gap - each * s, p.tier, [*p.runs, (s, each)])
        if rest:
            done += _fill(p, left, sizes)
            p = rest
    return done


def plan(histogram: dict[int, int], capacity: int = CAPACITY, levels: int = 4) -> list[Pattern]:
    """Patterns for all items of the histogram (size -> count), each size between 1 and ``capacity``."""
    if any(not 1 <= s <= capacity for s in histogram):
        raise ValueError("sizes must lie between 1 and the capacity")
    left = {s: n for s, n in histogram.items() if n}
    out: list[Pattern] = []
    for tier, (low, top) in enumerate(tiers(capacity, levels)):
        each = capacity // top
        opened: list[Pattern] = []
        over: list[list[tuple[int, int]]] = []  # windows that no container of like ones takes
        for n, runs in _windows(left, low, top):
            full, rest = divmod(n, each)
            if full:
                opened.append(Pattern(full, capacity - each * sum(s * k for s, k in runs), tier, [(s, k * each) for s, k in runs]))
            over += [runs] * rest
        for i in range(0, len(over), each):
            runs = [r for w in over[i : i + each] for r in w]
            opened.append(Pattern(1, capacity - sum(s * k for s, k in runs), tier, runs))
        sizes = sorted(left)
        for p in sorted(opened, key=lambda p: p.gap):
            out += _fill(p, left, sizes)
    return out


def pieces(counts: DataFrame, key: str, capacity: int) -> DataFrame:
    """key, piece_no, first_token, n_tokens: one piece a document, more if it alone exceeds the capacity."""
    n = F.col("n")
    return (
        counts.filter("n > 0")
        .select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int")), lambda i: F.struct((i * capacity).alias("first_token"), F.least(F.lit(capacity), n - i * capacity).alias("n_tokens")))).alias("piece_no", "p"))
        .select(key, "piece_no", F.col("p.first_token").cast("int").alias("first_token"), F.col("p.n_tokens").cast("int").alias("n_tokens"))
    )


def pack(counts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, levels: int = 4, group: int = 32) -> DataFrame:
    """Containers of all documents of ``counts`` (columns ``key`` and n, the number of tokens).

    Rows: key, piece_no, first_token, n_tokens, container_id, place (token offset in the container), tier (that the
    size is routed to), opened_by (the tier whose windows the container holds), step_group. Null and 0 sizes are left out; repeated keys are packed each; an empty table gives no row.
    """
    spark = counts.sparkSession
    items = materialize(pieces(counts, key, capacity), "pieces")
    # At most ``capacity`` rows come to the driver.
    histogram = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    patterns = sorted(plan(histogram, capacity, levels), key=lambda p: (p.gap, p.tier, p.runs))
    total = sum(p.n for p in patterns)
    groups = max(1, -(-total // group))
    slots, used, base = [], {}, 0
    for i, p in enumerate(patterns):
        place = 0
        for s, k in p.runs:
            first = used.get(s, 0)
            slots.append((s, first, k, base, place, p.tier))
            used[s] = first + p.n * k
            place += s * k
        base += p.n
    # One row for each run of each pattern: as the patterns, bounded by the capacity.
    table = np.array(sorted(slots) or [(0, 0, 1, 0, 0, 0)], np.int64)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("container_id long, place int, opened_by int")
    def slot(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        """The slot of the document of this rank among those of its size."""
        t, s, r = shared.value, size.to_numpy(np.int64), rank.to_numpy(np.int64)
        keys = np.rec.fromarrays([t[:, 0], t[:, 1]])
        at = np.searchsorted(keys, np.rec.fromarrays([s, r], dtype=keys.dtype), side="right") - 1
        row, over = t[at], r - t[at, 1]
        return pd.DataFrame({"container_id": row[:, 3] + over // row[:, 2], "place": (row[:, 4] + over % row[:, 2] * s).astype(np.int32), "opened_by": row[:, 5].astype(np.int32)})

    # As many cells for a size as its count asks for, so that a hot size is ranked in many tasks.
    cells = F.lit(1)
    for s, n in sorted(histogram.items()):
        if n > CELL_ROWS:
            cells = F.when(F.col("n_tokens") == s, -(-n // CELL_ROWS)).otherwise(cells)
    items = items.withColumn("cell", F.pmod(F.xxhash64(key, "piece_no"), cells).cast("int"))
    per = items.groupBy("n_tokens", "cell").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n_tokens").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("n_tokens", "cell", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "cell").orderBy(key, "piece_no")) - 1
    ranked = items.withColumn("r", rank).join(per, ["n_tokens", "cell"]).withColumn("slot", slot(F.col("n_tokens"), F.col("r") + F.col("before")))
    tier = F.lit(len(tiers(capacity, levels)) - 1)
    for i, (low, _) in reversed(list(enumerate(tiers(capacity, levels)))):
        tier = F.when(F.col("n_tokens") >= low, i).otherwise(tier)
    container = F.col("slot.container_id")
    lap, at = F.floor(container / groups), F.pmod(container, F.lit(groups))
    snake = F.when(lap % 2 == 0, at).otherwise(groups - 1 - at)
    return ranked.select(
        key, "piece_no", "first_token", "n_tokens", container.alias("container_id"), F.col("slot.place").alias("place"), tier.alias("tier"), F.col("slot.opened_by").alias("opened_by"), snake.alias("step_group")
    )


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, containers, least (the number that no packing can go below), fill, fullest."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("k"))
    one = per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.count("*").alias("containers"), F.max("used").alias("fullest"))
    return one.select("pieces", "tokens", "containers", F.ceil(F.col("tokens") / capacity).alias("least"), F.try_divide(F.col("tokens"), F.col("containers") * capacity).alias("fill"), "fullest")
