"""Review queues over labelled crops: selection, order, counters, edits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text as T


@dataclass(frozen=True)
class Selection:
    """What a queue takes: splits, buckets, a half-open range of confidence (missing counts as 0), order and limit."""

    splits: tuple[str, ...] = ()
    buckets: tuple[str, ...] = ()
    needs_review: bool = False
    min_conf: float | None = None
    max_conf: float | None = None
    sort: str = "none"  # none, best_conf_asc, best_conf_desc or source_image
    limit: int | None = None


PRESETS = {
    "custom": Selection(splits=("val",)),
    "test_deep": Selection(splits=("test",), sort="source_image"),
    "val_medium": Selection(splits=("val",), max_conf=0.85, sort="best_conf_asc"),
    "train_confidence": Selection(splits=("train",), max_conf=0.85, sort="best_conf_asc"),
}


def bucket_range(b: str) -> Column:
    """A bucket as a range of best_conf, which the scan can use."""
    c = F.col("best_conf")
    return {"accept": c >= 0.9, "review": (c >= 0.5) & (c < 0.9)}.get(b, F.coalesce(c < 0.5, F.lit(True)))


def select(rows: DataFrame, s: Selection, order: str = "row_id") -> DataFrame:
    """The rows of a queue, in order; ``order`` breaks ties as the order of arrival. The limit is a top-k, no full sort."""
    conf = F.coalesce("best_conf", F.lit(0.0))
    out = rows
    if s.splits:
        out = out.filter(F.col("split").isin(*s.splits))
    if s.buckets:
        out = out.filter(F.col("review_bucket").isin(*s.buckets))
    if s.needs_review:
        out = out.filter(F.coalesce("needs_review", F.lit(False)))
    if s.min_conf is not None:
        out = out.filter(conf >= s.min_conf)
    if s.max_conf is not None:
        out = out.filter(conf < s.max_conf)
    if "ground_truth_text" not in out.columns:
        out = out.withColumn("ground_truth_text", F.lit(""))
    keys = {"none": [], "best_conf_asc": [conf], "best_conf_desc": [conf.desc()], "source_image": [F.coalesce("source_image", F.lit("")), F.coalesce("ann_id", F.lit(0))]}[s.sort]
    if keys or s.limit is not None:
        out = out.orderBy(*keys, order)
    return out if s.limit is None else out.limit(s.limit)


def by_status(rows: DataFrame, status: str, field: str | None = None) -> DataFrame:
    """Rows of a field (all if null) that are all, pending, done, reject or review."""
    done = T.collapse(F.col("ground_truth_text")) != ""
    cond = {"all": F.lit(True), "pending": ~done, "done": done, "reject": F.col("review_bucket") == "reject", "review": F.col("review_bucket") == "review"}[status]
    return rows.filter(cond if field is None else cond & (F.col("class") == field))


def summary(rows: DataFrame) -> DataFrame:
    """Rows by split and by bucket: kind, value ('missing' for null), n."""
    g = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.lit("missing")).alias("value")) for k in ("split", "review_bucket")])).alias("e"))
    return g.groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))


def progress(rows: DataFrame) -> DataFrame:
    """Per field: rows, rows with a truth, rows without, rows of each bucket, percent done with one decimal."""
    done = (T.collapse(F.col("ground_truth_text")) != "").cast("int")
    n = lambda b: F.count_if(F.col("review_bucket") == b).alias(b)
    g = rows.groupBy(F.coalesce("class", "field_name", F.lit("unknown")).alias("field")).agg(F.count("*").alias("total"), F.sum(done).alias("done"), n("accept"), n("review"), n("reject"))
    return g.select("field", "total", "done", (F.col("total") - F.col("done")).alias("remaining"), "accept", "review", "reject", F.round(F.col("done") * 100.0 / F.col("total"), 1).alias("percent"))


def upsert(rows: DataFrame, edits: DataFrame, order: str = "row_id", latest: str = "edit_no") -> DataFrame:
    """Rows with edited truths (columns ann_id, crop_path, truth): the latest edit, trimmed, goes to the first row of its key.

    Blank edits are refused. Rows without an edit stay as they are.
    """
    key = ["ann_id", "crop_path"]
    e = edits.filter(F.trim("truth") != "").groupBy(*key).agg(F.max_by(F.trim("truth"), latest).alias("truth"))
    firsts = rows.groupBy(*key).agg(F.min(order).alias("o")).join(e, key).select(F.col("o").alias(order), "truth")
    return rows.join(firsts, order, "left").withColumn("ground_truth_text", F.coalesce("truth", "ground_truth_text")).drop("truth")


def accepted(rows: DataFrame, picks: DataFrame, order: str = "row_id") -> DataFrame:
    """Edits for ``upsert`` from picks (ann_id, crop_path, engine, edit_no): the text that the picked engine read.

    engine is vietocr, paddleocr or best; the first row of a key gives the text. Picks of other engines, of rows that
    are not there or of blank readings make no edit.
    """
    key, texts = ["ann_id", "crop_path"], ["text_vietocr", "text_paddle", "best_text"]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*texts), order).alias("t"))
    read = F.when(F.col("engine") == "vietocr", F.col("t.text_vietocr")).when(F.col("engine") == "paddleocr", F.col("t.text_paddle")).when(F.col("engine") == "best", F.col("t.best_text"))
    return picks.join(first, key).select(*key, read.alias("truth"), "edit_no").filter(F.trim("truth") != "")


def complete(rows: DataFrame) -> DataFrame:
    """Records of older producers with what they lack: candidates from flat columns, best_source, field_name."""
    f = lambda t, c, b: F.struct(F.col(t).alias("text"), F.col(c).alias("confidence"), F.lit(b).alias("backend"))
    made = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("vietocr").alias("key"), f("text_vietocr", "conf_vietocr", "vietocr").alias("value")),
        F.struct(F.lit("paddleocr").alias("key"), f("text_paddle", "conf_paddle", "paddleocr").alias("value")),
    ), lambda e: F.coalesce(e.value.text, F.lit("")) != ""))
    same = (F.col("text_vietocr") == F.col("text_paddle")) & (F.col("text_vietocr") != "")
    source = F.when(same, "agree").when(F.coalesce(F.col("best_text") == F.col("text_paddle"), F.lit(False)), "paddleocr").otherwise("vietocr")
    return rows.withColumns({"flat_candidates": made, "best_source": F.coalesce("best_source", source), "field_name": T.canonical_field(F.coalesce("field_name", "class"))})


def hints(rows: DataFrame) -> DataFrame:
    """row_id and the distinct texts of a row's readings, in order, without blank ones."""
    a = F.array("best_text", "text_vietocr", "text_paddle")
    return rows.select("row_id", F.array_distinct(F.filter(a, lambda t: F.coalesce(T.collapse(t), F.lit("")) != "")).alias("hints"))


def export(rows: DataFrame) -> DataFrame:
    """Rows with a truth."""
    return rows.filter(T.collapse(F.col("ground_truth_text")) != "")


def budget(rows: DataFrame, splits: list[str], n: int, order: str) -> DataFrame:
    """The first ``n`` rows over splits in the given order: one limit for all, a top-k."""
    rank = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))
    return rows.filter(F.col("split").isin(splits)).orderBy(rank, order).limit(n)


def latest_delivery(rows: DataFrame, key: str = "ann_id") -> DataFrame:
    """One row for each key: the last delivered; rows without a key each by themselves.

    The last row ids are an aggregate, combined before the shuffle, so a hot key is no group of its own in a task.
    """
    last = rows.groupBy(F.coalesce(F.col(key), -F.col("row_id")).alias("_k")).agg(F.max("row_id").alias("_last"))
    return rows.join(last, F.col("row_id") == F.col("_last"), "left_semi")
