"""Problem 4: the same or nearly the same records in training and evaluation splits.

Two records overlap if their crop has the same file name, or if their truths, in the form of problem 3 and with
letter case, accents, punctuation and spacing set aside, have at least ``min_chars`` characters and differ in at most
one per ten of the longer one.

Both sides work on distinct passages. A text of n characters with at most K edits keeps at least one of K + 1 disjoint
pieces unchanged, so every evaluation text is cut into K + 1 pieces, each around a window where its letters are rarest
in the training texts, by a count sketch of fixed size. Windows are chosen once; the pieces are the patterns of
Aho-Corasick automata, sharded by the length of their text and then by
hash, so that an automaton has a bounded number of texts, and every training text passes through the shards of lengths
that can match it, in slices large enough for the work of an automaton to be worth its building. A hit near its own
place (``scan`` in ``similar_texts``) makes a candidate, which the edit distance decides at once, before any shuffle.
No candidate is capped. File names are patterns whole; a name can only match in the shard of its own hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.folding import strip_accents
from fieldloom.llm import lookalike
from fieldloom.runtime import materialize

MIN_CHARS = 20
WINDOW = 6  # K + 1 windows of this length fit into every text of MIN_CHARS or more
SKETCH_BITS = 18
SHARD_TEXTS = 40_000  # evaluation texts of an automaton, about
SHARD_WINDOWS = 100_000  # windows of an automaton of coverage, about
SLICE_TEXTS = 50_000  # training texts of a slice, at most about
SHARD_NAMES = 20_000  # file names of an automaton and those that pass through it, together, about
FEW_TEXTS = 2_000  # texts that are worth a slice of their own while there are fewer slices than tasks
BLOCK_TEXTS = 1_000  # training texts whose hits are judged together
BLOCK_ENTRIES = 200_000  # and places of hits judged at once, about
_RATIO = 1.25  # lengths of one shard differ at most by this factor


def bare(c: Column) -> Column:
    """Letters and digits in lower case without accents."""
    return F.regexp_replace(F.lower(strip_accents(F.lower(c))), r"[^\p{L}\p{N}]+", "")


def edits(n: int) -> int:
    """The most edits that a text of ``n`` characters can have with any text it overlaps."""
    k = 0
    while (n + k + 1) // 10 >= k + 1:
        k += 1
    return k


def file_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]+)[/\\]*$", 1)


def _bare_rows(rows: DataFrame, model: lookalike.Model | None = None) -> DataFrame:
    """Rows with a split: row_id, side ('train' or the evaluation split, valid as val), best_source, file, t (bare text of any length)."""
    model = model or lookalike.fit(rows, ["ground_truth_text"])
    side = F.when(F.col("split") == "valid", "val").otherwise(F.col("split"))
    text = bare(lookalike.plain_column(F.col("ground_truth_text"), model))
    file = file_name(F.col("crop_path"))
    return (
        rows.filter(F.col("split").isin("train", "val", "valid", "test"))
        .select("row_id", side.alias("side"), "best_source", F.when(file != "", file).alias("file"), text.alias("t"))
    )


def records(rows: DataFrame, model: lookalike.Model | None = None) -> DataFrame:
    """Rows with a split: row_id, side, best_source, file, bare text.

    Files and texts that cannot overlap (null, empty or too short) are null.
    """
    return _bare_rows(rows, model).select("row_id", "side", "best_source", "file", F.when(F.length("t") >= MIN_CHARS, F.col("t")).alias("text"))


def _codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = np.zeros(len(x) - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(1_000_003) + x[i : len(x) - WINDOW + 1 + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(texts: DataFrame) -> np.ndarray:
    """Windows of all texts counted in 2 ** SKETCH_BITS cells, whatever the number of texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                np.add.at(cells, _codes(t), 1)
        at = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": at.astype(np.int64), "n": cells[at]})

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    got = texts.select("text").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def windows(text: str, cells: np.ndarray) -> list[int]:
    """Starts of K + 1 disjoint windows, the rarest letters first choice: each lies behind the one before it and ends within its own of K + 1 equal parts."""
    n, parts = len(text), edits(len(text)) + 1
    cost, out, free = cells[_codes(text)], [], 0
    for i in range(1, parts + 1):  # no part of a text of MIN_CHARS or more is shorter than a window
        last = n * i // parts - WINDOW
        out.append(free + int(np.argmin(cost[free : last + 1])))
        free = out[-1] + WINDOW
    return out


def _bags(texts: list[str]) -> np.ndarray:
    """How often each text has the characters of each of 37 classes by code point; the difference of two texts takes edits of its own."""
    out = np.zeros((len(texts), 37), np.int16)
    for row, t in zip(out, texts, strict=True):
        x = np.frombuffer(t.encode("utf-32-le"), np.uint32) % 37
        row[:] = np.minimum(np.bincount(x, minlength=37), 8191)  # beyond, differences only shrink
    return out


def _bucket(n: Column) -> Column:
    return F.floor(F.log(n.cast("double") / MIN_CHARS) / float(np.log(_RATIO))).cast("int")


CANDIDATE = T.StructType([T.StructField("text_e", T.StringType()), T.StructField("text_t", T.StringType())])


def _passed(patterns: DataFrame, texts: DataFrame, per_shard: int, scan: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """``scan(patterns of a shard, slice of texts)`` for every shard and every slice of the same ``bucket``.

    Both frames have columns bucket and p or t. Each shard goes to each slice of its bucket, so there are as few of both
    as bounds and busy tasks allow, and in a proportion that copies as few patterns and texts as can be.
    """
    spark = patterns.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = lambda df, name: df.groupBy("bucket").agg(F.count("*").alias(name))
    busy = F.least(F.ceil(F.col("nt") / FEW_TEXTS), F.lit(tasks))
    slices = F.greatest(F.ceil(F.col("nt") / SLICE_TEXTS), F.least(busy, F.ceil(F.sqrt(busy * F.col("nt") / F.col("np")))))
    shards = F.greatest(F.ceil(F.col("np") / per_shard), F.ceil(busy / F.col("slices")))
    plan = size(patterns, "np").join(size(texts, "nt"), "bucket").withColumn("slices", slices.cast("int")).withColumn("shards", shards.cast("int"))
    plan = F.broadcast(plan.select("bucket", "shards", "slices"))  # as many rows as lengths have powers of the ratio
    key = ["bucket", "shard", "slice"]
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = patterns.join(plan, "bucket").withColumn("shard", F.pmod(F.xxhash64("p"), "shards").cast("int")).withColumn("slice", each("slices")).drop("shards", "slices")
    b = texts.join(plan, "bucket").withColumn("slice", F.pmod(F.xxhash64("t"), "slices").cast("int")).withColumn("shard", each("shards")).drop("shards", "slices")
    # Small rows, long work: as many tasks as the session has shuffle partitions, not as few as their bytes would ask for.
    a, b = a.repartition(tasks, *key), b.repartition(tasks, *key)
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(scan, schema)


def similar_texts(train: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of distinct texts (text_t of ``train``, text_e of ``held``, both with a column text) that overlap."""
    shared = train.sparkSession.sparkContext.broadcast(sketch(train))  # of fixed size

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def chosen(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: windows(t, shared.value))

    a = held.select(F.col("text").alias("p"), _bucket(F.length("text")).alias("bucket"), chosen("text").alias("starts"))
    a = materialize(a, "windows")
    n = F.length("text")
    lo, hi = F.ceil(n * 0.9).cast("int"), F.floor(n * 10 / 9 + 1).cast("int")
    b = train.select(F.col("text").alias("t"), F.explode(F.sequence(_bucket(F.greatest(lo, F.lit(MIN_CHARS))), _bucket(hi))).alias("bucket"))

    def scan(patterns: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        """A text of at most K edits keeps a piece, of which j go before, so that j edits at most lie before it and the rest behind.

        Charge each edit to one piece: edits minus pieces, summed from the left, begins at 0, ends below 0 and never
        falls by more than 1, so where it first is -1, the piece is unchanged and as many edits as pieces lie before it.
        """
        import ahocorasick

        held_texts, auto, where = patterns["p"].tolist(), ahocorasick.Automaton(), []
        for i, (t, starts) in enumerate(zip(held_texts, patterns["starts"], strict=True)):
            cuts = [0, *map(int, starts[1:]), len(t)]
            for j in range(len(cuts) - 1):
                w = t[cuts[j] : cuts[j + 1]]
                at = auto.get(w, None)
                if at is None:
                    at = len(where)
                    auto.add_word(w, at)
                    where.append([])
                where[at].append((i, cuts[j], j, len(w)))
        if not where or not len(texts):
            return pd.DataFrame({"text_e": [], "text_t": []}, dtype=object)
        auto.make_automaton()
        several = np.array([len(x) for x in where], np.int64)
        begins = np.cumsum(several) - several
        owner, place, before, long = np.array([y for x in where for y in x], np.int32).T.copy()
        del where
        size, bags = np.array([len(t) for t in held_texts], np.int32), _bags(held_texts)
        scanned = texts["t"].tolist()
        left, right = [], []
        for lo in range(0, len(scanned), BLOCK_TEXTS):
            block = scanned[lo : lo + BLOCK_TEXTS]
            hits = np.array([(k, end, at) for k, t in enumerate(block) for end, at in auto.iter(t)], np.int64).reshape(-1, 3)
            length, own, got = np.array([len(t) for t in block], np.int32), _bags(block), []
            entries = np.cumsum(several[hits[:, 2]])
            for part in np.split(hits, np.flatnonzero(np.diff(entries // BLOCK_ENTRIES)) + 1):
                k, end, at = part.T
                n = several[at]
                e = np.repeat(begins[at] - np.cumsum(n) + n, n) + np.arange(n.sum())  # the entries of all hits, one after the other
                k, shift, i, j = np.repeat(k, n), np.repeat(end, n) + 1 - long[e] - place[e], owner[e], before[e]
                more = length[k] - size[i]
                most = np.maximum(length[k], size[i]) // 10
                near = (np.abs(shift) <= j) & (np.abs(shift - more) <= most - j)
                k, i, more, most = k[near], i[near], more[near], most[near]
                # an edit changes two counts of letters by one, or one where it changes the length
                alike = np.abs(own[k] - bags[i]).sum(axis=1, dtype=np.int32) <= 2 * most - np.abs(more)
                got.append(k[alike] * len(held_texts) + i[alike])
            for x in np.unique(np.concatenate(got)).tolist():
                k, i = divmod(x, len(held_texts))
                left.append(held_texts[i])
                right.append(block[k])
        return pd.DataFrame({"text_e": left, "text_t": right}, dtype=object)

    pairs = _passed(a, b, SHARD_TEXTS, scan, CANDIDATE)
    most = F.floor(F.greatest(F.length("text_e"), F.length("text_t")) / 10).cast("int")
    # the bounded distance looks at a band of the table only and is -1 beyond the bound
    return pairs.withColumn("most", most).filter((F.col("text_e") == F.col("text_t")) | (F.expr("levenshtein(text_e, text_t, most)") >= 0)).drop("most")


def _found_whole(patterns: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """Texts that are a pattern from end to end."""
    import ahocorasick

    if not len(patterns) or not len(texts):
        return pd.DataFrame({"file": []}, dtype=object)
    auto = ahocorasick.Automaton()
    for p in patterns["p"]:
        auto.add_word(p, len(p))
    auto.make_automaton()
    return pd.DataFrame({"file": [t for t in texts["t"] if any(end + 1 == n == len(t) for end, n in auto.iter(t))]}, dtype=object)


def shared_files(train: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct file names (column file) of ``held`` that stand among those of ``train``: patterns and texts are whole names.

    Equal names have equal hashes, so that each name goes to one automaton, however many there are.
    """
    distinct = lambda df, c: materialize(df.filter("file is not null").select(F.col("file").alias(c)).distinct(), "names")
    a, b = distinct(held, "p"), distinct(train, "t")
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, -(-(a.count() + b.count()) // SHARD_NAMES))
    sharded = lambda df, c: df.withColumn("shard", F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")).repartition(tasks, "shard").groupBy("shard")
    return sharded(a, "p").cogroup(sharded(b, "t")).applyInPandas(_found_whole, "file string")


def _distinct(rec: DataFrame) -> DataFrame:
    return materialize(rec.filter("text is not null").select("text").distinct(), "distinct")


def overlaps(rows: DataFrame, model: lookalike.Model | None = None) -> DataFrame:
    """All overlapping pairs: train_id, held_id, held_side, by_file, by_text; each pair once.

    Null splits take part in nothing; null, blank and short truths overlap by file name only; rows delivered twice
    make a pair each; an empty table gives none. A hot file name or text gives as many pairs as it has.
    """
    rec = materialize(records(rows, model), "records")
    train, held = rec.filter("side = 'train'"), rec.filter("side <> 'train'")
    by_file = (
        train.join(shared_files(train, held), "file").select(F.col("row_id").alias("train_id"), "file", F.col("text").alias("text_t"))
        .join(held.filter("file is not null").select(F.col("row_id").alias("held_id"), F.col("side").alias("held_side"), "file", F.col("text").alias("text_e")), "file")
    )
    texts = materialize(similar_texts(_distinct(train), _distinct(held)), "texts")
    by_text = (
        texts.join(train.select(F.col("row_id").alias("train_id"), F.col("text").alias("text_t"), F.col("file").alias("file_t")), "text_t")
        .join(held.select(F.col("row_id").alias("held_id"), F.col("side").alias("held_side"), F.col("text").alias("text_e"), F.col("file").alias("file_e")), "text_e")
        .filter("file_t is null or file_e is null or file_t <> file_e")
    )
    same = by_file.join(texts.withColumn("by_text", F.lit(True)), ["text_e", "text_t"], "left")
    cols = ["train_id", "held_id", "held_side"]
    return same.select(*cols, F.lit(True).alias("by_file"), F.coalesce("by_text", F.lit(False)).alias("by_text")).unionByName(
        by_text.select(*cols, F.lit(False).alias("by_file"), F.lit(True).alias("by_text"))
    )


def found(rows: DataFrame) -> DataFrame:
    """Pairs of row ids, smaller first."""
    return overlaps(rows).select(F.least("train_id", "held_id").alias("row_id_a"), F.greatest("train_id", "held_id").alias("row_id_b"))


def report(rows: DataFrame) -> DataFrame:
    """Per evaluation split and best_source: records, records that overlap by file, by text and at all, and pairs."""
    by = ["held_side", "best_source"]
    held = rows.filter(F.col("split").isin("val", "valid", "test")).select(
        F.col("row_id").alias("held_id"), F.when(F.col("split") == "valid", "val").otherwise(F.col("split")).alias("held_side"), F.coalesce("best_source", F.lit("")).alias("best_source")
    )
    per = overlaps(rows).groupBy("held_id").agg(F.count("*").alias("pairs"), F.max(F.col("by_file").cast("int")).alias("f"), F.max(F.col("by_text").cast("int")).alias("t"))
    return (
        held.join(per, "held_id", "left").groupBy(*by)
        .agg(F.count("*").alias("records"), F.coalesce(F.sum("f"), F.lit(0)).alias("by_file"), F.coalesce(F.sum("t"), F.lit(0)).alias("by_text"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    )


def _seen_windows(patterns: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    import ahocorasick

    if not len(patterns) or not len(texts):
        return pd.DataFrame({"w": []}, dtype=object)
    auto = ahocorasick.Automaton()
    for w in patterns["p"]:
        auto.add_word(w, w)
    auto.make_automaton()
    return pd.DataFrame({"w": list({w for t in texts["t"] for _, w in auto.iter(t)})}, dtype=object)


def matched_windows(train: DataFrame, held: DataFrame, size: int) -> DataFrame:
    """Distinct windows (column w) of ``size`` characters that stand in a text of ``train`` and in one of ``held``.

    The windows of the evaluation texts are the patterns of automata, each of a bounded number of patterns; every
    training text passes through all of them.
    """
    starts, zero = F.sequence(F.lit(1), F.length("text") - size + 1), F.lit(0).alias("bucket")
    a = held.filter(F.length("text") >= size).select(zero, F.explode(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(size)))).alias("p")).distinct()
    b = train.filter(F.length("text") >= size).select(zero, F.col("text").alias("t"))
    return _passed(materialize(a, "windows"), b, SHARD_WINDOWS, _seen_windows, "w string").distinct()


def intervals(rows: DataFrame, size: int = WINDOW, model: lookalike.Model | None = None) -> DataFrame:
    """Stretches of evaluation texts that stand in training texts: row_id, chars, a, b (from a up to b, b left out).

    A run of ``size`` or more characters that an evaluation text shares with a training text is the union of its
    windows of ``size``, so the windows that stand in any training text, merged where they overlap or touch, are
    all such runs, merged. No pair has to be alike as a whole: a text that stands in parts of several training
    texts, or inside a longer one, has its stretches too. Texts of ``size`` or more bare characters take part, on
    both sides; a repeated text gives its stretches for each of its rows.
    """
    rec = materialize(_bare_rows(rows, model).filter(F.length("t") >= size).select("row_id", "side", F.col("t").alias("text")), "bare")
    train, held = (materialize(rec.filter(c).select("text").distinct(), "distinct") for c in ("side = 'train'", "side <> 'train'"))
    hit = matched_windows(train, held, size)
    starts = F.transform(F.sequence(F.lit(1), F.length("text") - size + 1), lambda i: F.struct((i - 1).alias("a"), F.substring(F.col("text"), i, F.lit(size)).alias("w")))
    at = held.select("text", F.explode(starts).alias("s")).select("text", "s.a", "s.w").join(hit, "w")
    per = at.groupBy("text").agg(F.sort_array(F.collect_list("a")).alias("at"))  # as many as the text has characters
    # a stretch begins where the start before is more than ``size`` back and ends after the last start before the next
    far = lambda x, i: (i == 0) | (x - F.col("at")[F.greatest(i - 1, F.lit(0))] > size)
    last = lambda x, i: (i == F.size("at") - 1) | (F.col("at")[F.least(i + 1, F.size("at") - 1)] - x > size)
    spans = per.select("text", F.explode(F.arrays_zip(F.filter("at", far).alias("a"), F.transform(F.filter("at", last), lambda x: x + size).alias("b"))).alias("s"))
    return rec.filter("side <> 'train'").select("row_id", "text").join(spans, "text").select("row_id", F.length("text").alias("chars"), "s.a", "s.b")


def coverage(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """How much of each evaluation record's text stands in training texts: row_id, side, chars, covered, share.

    ``covered`` counts the characters in runs of ``size`` or more shared with any training text: the automata's hits,
    merged. Every evaluation record has a row; one without such a run has 0, a null or blank truth 0 of 0 characters
    and the share 0.
    """
    model = lookalike.fit(rows, ["ground_truth_text"])
    per = intervals(rows, size, model).groupBy("row_id").agg(F.sum(F.col("b") - F.col("a")).cast("int").alias("covered"))
    held = _bare_rows(rows, model).filter("side <> 'train'").select("row_id", "side", F.coalesce(F.length("t"), F.lit(0)).alias("chars"))
    covered = F.coalesce("covered", F.lit(0))
    return held.join(per, "row_id", "left").select("row_id", "side", "chars", covered.alias("covered"), F.coalesce(F.try_divide(covered, F.col("chars")), F.lit(0.0)).alias("share"))
