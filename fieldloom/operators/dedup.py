"""Duplicate pictures: hashes within a Hamming distance, names of augmented copies, clusters, leaks between splits."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.runtime import discard, materialize


# Fixed value: the ending of an augmented copy's name. Endings in capitals and .png copies are met with too.
AUGMENTED = r"_(?:jpg|jpeg|png|JPG|JPEG|PNG)\.rf\.[A-Za-z0-9]+\.(?:jpg|jpeg|png)$"


def _bands(most: int, n: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """Bands of a hash as (low bit, width, radius): of two hashes within ``most`` bits one band differs in at most its radius."""
    out = []
    for i in range(n):
        lo, hi = bits * i // n, bits * (i + 1) // n
        out.append((lo, hi - lo, (most + 1) * (i + 1) // n - (most + 1) * i // n - 1))
    return out


def plan_bands(most: int, rows: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """The bands with the least expected work for so many hashes: probes that are shuffled and pairs that are compared.

    Few wide bands are probed with all values within their radius; many narrow ones need one probe each. A probe
    counts as eight comparisons. At most 4,096 probes a hash are considered, so plans stay small.
    """
    best = None
    for n in range(1, most + 2):
        bands = _bands(most, n, bits)
        probes = [sum(comb(w, j) for j in range(r + 1)) for _, w, r in bands]
        if sum(probes) > 4096:
            continue
        work = sum(8.0 * rows * p + rows * rows * p / 2.0**w for p, (_, w, _) in zip(probes, bands, strict=True))
        if best is None or work < best[0]:
            best = (work, bands)
    return best[1]


def similar_hashes(df: DataFrame, most: int, key: str = "id", value: str = "hash", bits: int = 64) -> DataFrame:
    """Pairs (ha < hb) of distinct hashes that differ in at most ``most`` bits, with the distance; none is missed.

    The bits are cut into bands of which one must be nearly equal in both, so pairs meet in an equi-join on (band,
    value of it); one side is joined under every value within the band's radius. Equal hashes are one row of the join.
    A pair that meets in several bands is given by the first.
    """
    u = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("h")).distinct()
    bands = plan_bands(most, u.count(), bits)
    part = lambda h, b: F.shiftrightunsigned(h, b[0]).bitwiseAND(F.lit((1 << b[1]) - 1).cast("long"))
    masks = lambda b: [sum(1 << i for i in c) for j in range(b[2] + 1) for c in combinations(range(b[1]), j)]
    plain = F.array(*[F.struct(F.lit(i).alias("band"), part(F.col("h"), b).alias("v")) for i, b in enumerate(bands)])
    flips = df.sparkSession.createDataFrame([(i, m) for i, b in enumerate(bands) for m in masks(b)], "band int, m long")  # at most 4,096 rows
    a = u.select(F.col("h").alias("ha"), F.explode(plain).alias("e")).select("ha", "e.band", "e.v")
    b = u.select(F.col("h").alias("hb"), F.explode(plain).alias("e")).select("hb", "e.band", F.col("e.v").alias("w"))
    b = b.join(F.broadcast(flips), "band").select("hb", "band", F.col("w").bitwiseXOR(F.col("m")).alias("v"))
    near = lambda i, x: F.bit_count(part(F.col("ha"), x).bitwiseXOR(part(F.col("hb"), x))) <= x[2]
    first = F.coalesce(*[F.when(near(i, x), i) for i, x in enumerate(bands)])
    dist = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return a.join(b, ["band", "v"]).filter(F.col("ha") < F.col("hb")).filter(dist <= most).filter(F.col("band") == first).select("ha", "hb", dist.alias("distance"))


def _leads(df: DataFrame, key: str, value: str) -> DataFrame:
    """h, lead (the smallest key with this hash), n: one row a distinct hash."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("h")).agg(F.min(key).alias("lead"), F.count("*").alias("n"))


def key_pairs(df: DataFrame, close: DataFrame, key: str = "id", value: str = "hash") -> DataFrame:
    """a, b, distance: pairs of the representatives of close hashes, and each copy with its representative (distance 0).

    The representative of equal hashes is the smallest key; n copies make n - 1 rows, not all their pairs.
    """
    lead = materialize(_leads(df, key, value), "leads")
    l, r = lead.select(F.col("h").alias("ha"), F.col("lead").alias("k1")), lead.select(F.col("h").alias("hb"), F.col("lead").alias("k2"))
    near = close.join(l, "ha").join(r, "hb").select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"), "distance")
    d = df.select(F.col(key).alias("b"), F.col(value).alias("h"))
    same = d.join(lead.filter("n > 1"), "h").filter("b <> lead").select(F.col("lead").alias("a"), "b", F.lit(0).alias("distance"))
    return near.unionByName(same)


def clusters(df: DataFrame, most: int, key: str = "id", value: str = "hash") -> DataFrame:
    """vertex and component (the smallest vertex of its cluster) of all keys that have an equal or a close hash.

    Equal hashes are one vertex of the graph, so n copies cost n rows of membership and not their pairs.
    """
    d = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("vertex"), F.col(value).alias("h"))
    lead = materialize(_leads(df, key, value), "leads")
    close = similar_hashes(df, most, key, value)
    l, r = lead.select(F.col("h").alias("ha"), F.col("lead").alias("a")), lead.select(F.col("h").alias("hb"), F.col("lead").alias("b"))
    comp = components(close.join(l, "ha").join(r, "hb").select("a", "b")).withColumnRenamed("vertex", "lead")
    where = lead.join(comp, "lead", "left").filter("component is not null or n > 1").select("h", F.coalesce("component", "lead").alias("component"))
    return d.join(where, "h").select("vertex", "component")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """vertex and component (the smallest vertex) of an undirected graph with columns a and b.

    Large-star and small-star rounds: each vertex links its larger neighbours, then its smaller ones, to the smallest
    vertex around it, until nothing changes. Rounds grow with the logarithm of the graph; each writes its edges.
    """
    live = materialize(edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(live.filter("u = v")).distinct()
        down = large.filter("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        following = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        moved = following.join(live, ["u", "v"], "left_anti").isEmpty() and live.filter("u <> v").join(following, ["u", "v"], "left_anti").isEmpty()
        discard(live)
        live = following
        if moved:
            break
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    loops = edges.filter("a = b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    stars = live.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.unionByName(live.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).unionByName(
        loops.join(live.select("u").unionByName(live.select(F.col("v").alias("u"))), "u", "left_anti").select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    ).distinct()


def augmented_base(file_name: Column) -> Column:
    """The name of the picture that an augmented copy was made from."""
    return F.regexp_replace(file_name, AUGMENTED, "")


def name_clusters(images: DataFrame) -> DataFrame:
    """base_name, size, splits (how many distinct), first (smallest image_id); members stay in the input, keyed by base."""
    return images.groupBy(augmented_base(F.col("file_name")).alias("base_name")).agg(F.count("*").alias("size"), F.count_distinct("split").alias("splits"), F.min("image_id").alias("first"))


def leaking(clusters: DataFrame) -> DataFrame:
    return clusters.filter("splits > 1")


def size_histogram(clusters: DataFrame) -> DataFrame:
    """size, clusters, images."""
    return clusters.groupBy("size").agg(F.count("*").alias("clusters"), F.sum("size").alias("images"))


def numbered(clusters: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Clusters with cluster_id from 0 by falling size, then first member.

    Numbers are sums over cells (a size and a range of first members) and ranks within a cell, because most clusters
    may have one size.
    """
    c = clusters.withColumn("cell", F.floor(F.col("first") / width))
    per = c.groupBy("size", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size"), "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("size", "cell").orderBy("first", "base_name")) - 1
    per = per.select("size", "cell", before.alias("before"))
    return c.withColumn("r", rank).join(per, ["size", "cell"]).withColumn("cluster_id", F.col("r") + F.col("before")).drop("r", "before", "cell")
