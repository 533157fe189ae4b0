"""Problem 5: splits that keep related records together.

Records that share an entity are joined in a graph, whose components are found by random-mate contraction: in each
round every vertex tosses a coin of many sides (a hash of its id and the round, weighted by its degree), and a vertex
that beats all its neighbours is a head. Every other vertex whose best neighbour is a head is collapsed into it;
edges move along and vanish when both ends have become one. The winner among all vertices of a component is always a
head, so every component shrinks in every round, a lone edge vanishes at once, and since a hub beats its d leaves
with chance d / (d + 1), a star, however hot, mostly goes in one round. A map of each round is written to the shared
folder, and the maps are unwound from the first to the last when no edge is left. All of it is joins and
aggregates; the driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.runtime import discard, materialize

MAX_ROUNDS = 200
UNWIND = 4  # maps that are unwound in one plan


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Components of an undirected graph: vertex, component (a vertex of it), for all vertices that have an edge.

    ``edges`` has columns a and b of one type; loops, repeated and reversed edges are allowed, nulls are left out.
    An empty table gives an empty result. Raises if edges are left after ``max_rounds`` (about 100 rounds halve the
    chance of 10 ** 9 edges).
    """
    e = edges.select("a", "b").filter("a is not null and b is not null")
    vertices = materialize(e.select("a").unionByName(e.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "vertex"), "vertices")
    live = materialize(_simple(e), "edges")
    maps: list[DataFrame] = []
    for k in range(max_rounds):
        if live.isEmpty():
            break
        step = materialize(_mates(live, k), "mates")
        s = step.select(F.col("v").alias("x"), F.col("head").alias("y"))
        moved = (
            live.join(s, F.col("a") == F.col("x"), "left").select(F.coalesce("y", "a").alias("a"), "b")
            .join(s, F.col("b") == F.col("x"), "left").select("a", F.coalesce("y", "b").alias("b"))
        )
        following = materialize(_simple(moved), "edges")
        discard(live)
        live = following
        maps.append(step)
    if not live.isEmpty():
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    discard(live)
    out = vertices.withColumn("component", F.col("vertex"))
    for k, step in enumerate(maps):  # each map's heads may be collapsed in later rounds
        s = step.select(F.col("v").alias("x"), F.col("head").alias("y"))
        out = out.join(s, F.col("component") == F.col("x"), "left").select("vertex", F.coalesce("y", "component").alias("component"))
        if k % UNWIND == UNWIND - 1 and k < len(maps) - 1:
            out = materialize(out, "unwound")
    return out


def _simple(e: DataFrame) -> DataFrame:
    """Each edge once, smaller end first, without loops."""
    return e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mates(live: DataFrame, k: int) -> DataFrame:
    """Contractions of round ``k``: v goes into head. No head is contracted itself.

    Draws are exponential with the squared degree as rate, so the least is an unfair coin's winner. The joins are
    with one row a vertex; a hot vertex's edges are what adaptive execution splits.
    """
    both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    u = (F.pmod(F.xxhash64("a", F.lit(k)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    drawn = both.groupBy("a").agg(F.count("*").alias("d")).select(F.col("a").alias("v"), F.struct((-F.log(u) / (F.col("d") * F.col("d"))).alias("draw"), F.col("a").alias("v")).alias("own"))
    best = both.join(drawn.withColumnRenamed("v", "n"), F.col("b") == F.col("n")).groupBy("a").agg(F.min("own").alias("best"))
    met = best.join(drawn, F.col("a") == F.col("v")).select("v", "own", "best")
    heads = met.filter("own < best").select(F.col("v").alias("head"))
    return met.filter("own > best").select("v", F.col("best.v").alias("goal")).join(heads, F.col("goal") == F.col("head")).select("v", "head")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]+)[/\\]*$", 1)


def photograph(source: Column, crop: Column) -> Column:
    """Series letters and eight-digit number of the photograph or clip, lower case; null if there is none."""
    name = F.lower(base_name(F.coalesce(source, crop)))
    key = F.regexp_extract(name, r"^(\p{L}+[0-9]{8})(?![0-9])", 1)
    return F.when(key != "", key)


def memberships(rows: DataFrame) -> DataFrame:
    """row_id, split (valid as val), name: the file name that stands for the row, whole; key: its photograph's name."""
    split = F.when(F.col("split") == "valid", "val").otherwise(F.col("split"))
    name = F.lower(base_name(F.coalesce("source_image", "crop_path")))
    return rows.select("row_id", split.alias("split"), F.when(name != "", name).alias("name"), photograph(F.col("source_image"), F.col("crop_path")).alias("key"))


def groups(rows: DataFrame) -> DataFrame:
    """row_id, split, component: rows with the same component show the same photograph or clip.

    The graph's vertices are distinct names, not rows: a name is joined to its photograph, so a hot photograph is a
    star of few vertices. A name without series and number is a component of its own, by its whole name; a row
    without any name is one by its row_id.
    """
    m = materialize(memberships(rows), "memberships")
    edges = m.filter("name is not null").select(F.concat(F.lit("n:"), "name").alias("a"), F.concat(F.lit("k:"), F.coalesce("key", "name")).alias("b")).distinct()
    comp = components(edges)
    at = F.coalesce(F.concat(F.lit("n:"), "name"), F.concat(F.lit("r:"), F.col("row_id").cast("string")))
    return m.withColumn("at", at).join(comp, F.col("at") == F.col("vertex"), "left").select("row_id", "split", F.coalesce("component", "at").alias("component"))


def torn(rows: DataFrame) -> DataFrame:
    """Rows with a split whose group lies in more than one: group_id (its smallest row_id), row_id."""
    g = groups(rows).filter("split is not null")
    per = g.groupBy("component").agg(F.min("row_id").alias("group_id"), F.min("split").alias("s0"), F.max("split").alias("s1")).filter("s0 <> s1")
    return g.join(per, "component").select("group_id", "row_id")


def assign(rows: DataFrame, targets: DataFrame, cells: int = 1024) -> DataFrame:
    """A new split for every row, near the target shares, one for each component: row_id, component, new_split.

    Components are laid out from heavy to light along the line of all rows, and each goes to the split in whose
    target stretch its middle lies; stretches go from the largest target to the smallest, so a hot component sits in
    the largest. Positions are cumulative weights: sums over ``cells`` cells of (power of two of the weight, hash),
    then within a cell, so no window has all components. An empty table gives an empty result; a split with a share
    of 0 or null gets no rows.
    """
    g = materialize(groups(rows), "groups")
    comp = g.groupBy("component").agg(F.count("*").alias("w"))
    size = -F.floor(F.log2("w")).cast("int")
    comp = materialize(comp.withColumn("size", size).withColumn("cell", F.pmod(F.xxhash64("component"), F.lit(cells)).cast("int")), "components")
    # Cells are at most 63 powers of two times ``cells``, whatever the number of components.
    per = comp.groupBy("size", "cell").agg(F.sum("w").alias("cw"))
    before = F.coalesce(F.sum("cw").over(Window.orderBy("size", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("size", "cell", before.alias("at"), F.sum("cw").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("w").over(Window.partitionBy("size", "cell").orderBy(F.desc("w"), "component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = comp.withColumn("inside", inside).join(per, ["size", "cell"]).select("component", ((F.col("at") + F.col("inside") + F.col("w") / 2) / F.col("total")).alias("middle"))
    t = targets.filter("share > 0").select(F.col("split").alias("new_split"), "share")
    order = Window.orderBy(F.desc("share"), "new_split")
    t = t.withColumn("hi", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("share").over(Window.partitionBy()))
    stretch = t.groupBy().agg(F.array_sort(F.collect_list(F.struct("hi", "new_split"))).alias("s"))  # one row: the wanted splits
    pick = F.coalesce(F.element_at(F.filter("s", lambda x: F.col("middle") < x.hi), 1), F.element_at("s", -1)).new_split
    chosen = laid.join(F.broadcast(stretch)).select("component", pick.alias("new_split"))
    return g.join(chosen, "component").select("row_id", "component", "new_split")
