"""Annotation quality: rule checks, overlaps, distributions and statistics.

images: split, image_id, width, height (and file_name); annotations: image_id, seq, class, x, y, w, h. ``image_id`` is
unique over splits (see ``sources.files.union_rekeyed``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import geometry as G
from fieldloom.runtime import numbered

FIELD_CLASSES = ("id", "name", "birth", "origin", "address", "title")


def enrich(annotations: DataFrame, images: DataFrame, categories: DataFrame, on: str | list[str] = "image_id") -> DataFrame:
    """Annotations with class and picture, which meet by ``on``; an unknown category is '?'. The category table is small by its nature."""
    a = annotations.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("class")), "category_id", "left")
    return a.withColumn("class", F.coalesce("class", F.lit("?"))).join(images, on)


def per_image(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """image_id, split and counts: boxes, field boxes, cards, smallest area. Pictures without boxes have 0 and null."""
    a = annotations.groupBy("image_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("class").isin(*FIELD_CLASSES)).alias("fields"), F.count_if(F.col("class") == "card").alias("cards"), F.min(F.col("w") * F.col("h")).alias("least_area")
    )
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return images.join(a, "image_id", "left").select("image_id", "split", z("n"), z("fields"), z("cards"), "least_area")


def overlaps(annotations: DataFrame, least: float = 0.9, inclusive: bool = False) -> DataFrame:
    """Pairs of boxes of one class in one picture whose intersection over union exceeds ``least``, or reaches it if ``inclusive``.

    The join is on picture and class. Of two boxes whose areas differ by more than that share none can pass, so the
    bands of areas narrow a crowded picture: boxes meet only in equal or neighbouring bands.
    """
    band = F.floor(F.log(F.greatest(F.col("w") * F.col("h"), F.lit(1e-9))) / -math.log(least)).cast("long") if 0 < least < 1 else F.lit(0)
    b = annotations.filter("w > 0 and h > 0").withColumn("band", band)
    left = b.select("image_id", "class", F.col("seq").alias("seq_a"), *[F.col(c).alias(f"{c}a") for c in "xywh"], "band")
    right = b.select("image_id", "class", F.col("seq").alias("seq_b"), *[F.col(c).alias(f"{c}b") for c in "xywh"], F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    iou = G.iou_xywh(tuple(F.col(f"{c}a") for c in "xywh"), tuple(F.col(f"{c}b") for c in "xywh"))
    return left.join(right, ["image_id", "class", "band"]).filter("seq_a < seq_b").withColumn("iou", iou).filter(F.col("iou") >= least if inclusive else F.col("iou") > least).select("image_id", "class", "seq_a", "seq_b", "iou")


def issues(images: DataFrame, annotations: DataFrame, min_area: float = 100.0, max_share: float = 0.95, min_fields: int = 4, least_iou: float = 0.9) -> DataFrame:
    """A row an issue: split, image_id, kind, class, detail (number), severity (error or warning).

    Picture rules: no_annotation, missing_card_class, few_fields. Box rules: bbox_too_small, bbox_too_large,
    bbox_out_of_bounds (errors), high_overlap. Numbers stay typed; ``label`` writes them out.
    """
    c = per_image(images, annotations)
    rule = lambda cond, kind, detail=None: F.when(cond, F.struct(F.lit(kind).alias("kind"), (F.lit(None) if detail is None else detail).cast("double").alias("detail")))
    none = F.lit(None).cast("string")
    picture = c.select("split", "image_id", F.explode(F.filter(F.array(
        rule(F.col("n") == 0, "no_annotation"), rule(F.col("cards") == 0, "missing_card_class"),
        rule((F.col("cards") > 0) & (F.col("fields") < min_fields), "few_fields", F.col("fields")),
    ), lambda x: x.isNotNull())).alias("i")).select("split", "image_id", "i.kind", none.alias("class"), "i.detail", F.lit("warning").alias("severity"))
    area, whole = F.col("w") * F.col("h"), F.col("width") * F.col("height")
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height"))
    boxes = annotations.join(images.select("image_id", "split", "width", "height"), "image_id")
    boxes = boxes.select("split", "image_id", "class", F.explode(F.filter(F.array(
        rule(area < min_area, "bbox_too_small", area), rule(area > whole * max_share, "bbox_too_large", area / whole * 100), rule(out, "bbox_out_of_bounds"),
    ), lambda x: x.isNotNull())).alias("i")).select("split", "image_id", "i.kind", "class", "i.detail", F.lit("error").alias("severity"))
    over = overlaps(annotations, least_iou).join(images.select("image_id", "split"), "image_id")
    over = over.select("split", "image_id", F.lit("high_overlap").alias("kind"), "class", F.col("iou").alias("detail"), F.lit("warning").alias("severity"))
    return picture.unionByName(boxes).unionByName(over)


def label() -> Column:
    """An issue as text, with numbers rounded half to even."""
    whole = lambda suffix: F.concat(F.bround("detail").cast("long").cast("string"), F.lit(suffix))
    tail = (
        F.when(F.col("kind") == "few_fields", whole("")).when(F.col("kind") == "bbox_too_small", whole("px2")).when(F.col("kind") == "bbox_too_large", whole("%"))
        .when(F.col("kind") == "high_overlap", F.concat(F.lit("IoU="), F.format_number(F.bround("detail", 2), 2)))
    )
    return F.concat_ws(":", "kind", "class", tail)


def flagged(found: DataFrame) -> DataFrame:
    """Pictures with issues: split, image_id, severity (the worst), issues (sorted texts)."""
    return found.groupBy("split", "image_id").agg(F.min("severity").alias("severity"), F.array_sort(F.collect_list(label())).alias("issues"))


def gate(images: DataFrame, found: DataFrame, annotations: DataFrame, most: float = 0.05, least_class: int = 100) -> DataFrame:
    """One row: pictures, flagged, errors, share, passes; and whether every class has enough boxes."""
    f = found.groupBy("image_id").agg(F.min("severity").alias("s")).agg(F.count("*").alias("flagged"), F.count_if(F.col("s") == "error").alias("errors"))
    n = images.agg(F.count("*").alias("images"))
    k = annotations.groupBy("class").count().agg(F.coalesce(F.min("count") >= least_class, F.lit(False)).alias("classes_ok"))
    share = F.coalesce(F.try_divide("flagged", "images"), F.lit(0.0))
    return n.crossJoin(f).crossJoin(k).select("images", "flagged", "errors", share.alias("share"), (share < most).alias("passes"), "classes_ok")


def largest(annotations: DataFrame, cls: str = "card") -> DataFrame:
    """The largest box of a class in each picture; the first on ties."""
    return annotations.filter(F.col("class") == cls).groupBy("image_id").agg(F.max_by(F.struct("seq", "x", "y", "w", "h"), F.struct((F.col("w") * F.col("h")).alias("a"), (-F.col("seq")).alias("s"))).alias("b")).select("image_id", "b.*")


def cooccurrence(annotations: DataFrame) -> DataFrame:
    """How many pictures have both of two classes, each class with itself included.

    A picture's classes are few, so each task pairs them within the picture; no join is needed.
    """
    per = annotations.groupBy("image_id").agg(F.collect_set("class").alias("s"))
    return per.select(F.explode("s").alias("class_a"), "s").select("class_a", F.explode("s").alias("class_b")).groupBy("class_a", "class_b").agg(F.count("*").alias("n"))


def box_statistics(annotations: DataFrame) -> DataFrame:
    """Per class: boxes, mean and deviation of area, mean sides and centres."""
    area = F.col("w") * F.col("h")
    return annotations.groupBy("class").agg(
        F.count("*").alias("n"), F.avg(area).alias("mean_area"), F.stddev_pop(area).alias("std_area"), F.avg("w").alias("mean_w"), F.avg("h").alias("mean_h"),
        F.avg(F.col("x") + F.col("w") / 2).alias("mean_cx"), F.avg(F.col("y") + F.col("h") / 2).alias("mean_cy"),
    )


def counts(df: DataFrame, *by: str, missing: str = "missing") -> DataFrame:
    """Rows by one column or several; nulls of text columns count as ``missing``."""
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return df.groupBy(*[F.coalesce(F.col(c), F.lit(missing)).alias(c) if c in text else F.col(c) for c in by]).agg(F.count("*").alias("n"))


def issue_counts(found: DataFrame) -> DataFrame:
    """kind, how often it was found, and in how many pictures."""
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))


def boxes_a_picture(per: DataFrame) -> DataFrame:
    """One row over ``per_image``: mean, deviation, least and most boxes, and pictures without any."""
    n = F.col("n")
    return per.agg(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(n == 0).alias("empty"))


def split_shares(per: DataFrame) -> DataFrame:
    """Per split: pictures, boxes and the share of all pictures."""
    g = per.groupBy("split").agg(F.count("*").alias("images"), F.sum("n").alias("boxes"))
    return g.withColumn("share", F.col("images") / F.sum("images").over(Window.partitionBy()))  # a row a split


def dataset_statistics(images: DataFrame, annotations: DataFrame, brightness: DataFrame) -> DataFrame:
    """All statistics of a data set as rows (metric, key, value), each counted in one pass over its table.

    brightness: image_id, mean (and std, the contrast, where it is measured).
    """
    per = per_image(images, annotations)
    rows = lambda df, metric, key, names: df.select(F.explode(F.array(*[F.struct(F.lit(f"{metric}_{n}".rstrip("_")).alias("metric"), key.alias("key"), F.col(c).cast("double").alias("value")) for n, c in names.items()])).alias("r")).select("r.*")
    none = F.lit("")
    same = lambda df: {c: c for c in df.columns}
    totals = per.agg(F.count("*").alias("images"), F.sum("n").alias("annotations"))
    sizes, boxes, bright = size_statistics(images), boxes_a_picture(per), brightness.agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"), F.count("*").alias("sample"))
    of_class = box_statistics(annotations)
    out = rows(totals, "total", none, same(totals)).unionByName(rows(sizes, "size", none, same(sizes))).unionByName(rows(boxes, "boxes", none, same(boxes)))
    out = out.unionByName(rows(bright, "brightness", none, same(bright))).unionByName(rows(split_shares(per), "split", F.col("split"), {"images": "images"}))
    return out.unionByName(rows(of_class, "class", F.col("class"), {c: c for c in of_class.columns if c != "class"}))


def statistics_document(stats: DataFrame) -> dict:
    """``dataset_statistics`` as one nested document; as many values as there are classes and splits."""
    out: dict = {}
    for r in stats.orderBy("metric", "key").collect():
        part, _, name = r.metric.partition("_")
        at = out.setdefault(part, {})
        (at.setdefault(r.key, {}) if r.key else at)[name] = r.value
    return out


def size_statistics(images: DataFrame) -> DataFrame:
    """One row: mean, deviation, least and most of width, height and aspect.

    An aspect over a height of 0 is that of numbers with a decimal point: infinite with the sign of the width, or no number at 0 by 0.
    """
    w, h = F.col("width"), F.col("height")
    aspect = F.when(h == 0, F.when(w == 0, float("nan")).when(w.isNotNull(), F.signum(w) * float("inf"))).otherwise(w / h)
    out = []
    for name, c in (("width", F.col("width")), ("height", F.col("height")), ("aspect", aspect)):
        out += [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    return images.agg(*out)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins from ``low`` to ``high``; the last bin has its upper end; values outside are left out."""
    c = F.col(column)
    at = F.least(F.lit(bins - 1), F.floor((c - low) / ((high - low) / bins))).cast("int")
    return df.filter((c >= low) & (c <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def systematic(df: DataFrame, order: str, step: int) -> DataFrame:
    """Every ``step``-th row in order, from the first."""
    from fieldloom.sources.files import number

    return number(df, order, "_no").filter(F.col("_no") % step == 0).drop("_no")


def difficulty(images: DataFrame, annotations: DataFrame, brightness: DataFrame) -> DataFrame:
    """image_id and difficulty: few fields, small boxes and odd brightness, each scaled to [0, 1] over all pictures.

    brightness: image_id, mean (of 255); a picture without counts as 0.5 off. A feature that never varies is 0.5.
    """
    c = per_image(images, annotations).join(brightness.select("image_id", "mean"), "image_id", "left")
    one = F.lit(1.0)
    f = c.select(
        "image_id", (one / F.greatest("fields", F.lit(1))).alias("f1"), (one / F.greatest(F.coalesce("least_area", one), one)).alias("f2"), F.coalesce(F.abs(F.col("mean") - 140) / 140, F.lit(0.5)).alias("f3")
    )
    ends = f.agg(*[g(k).alias(f"{k}_{n}") for k in ("f1", "f2", "f3") for n, g in (("lo", F.min), ("hi", F.max))])  # one row
    scaled = lambda k: F.when(F.col(f"{k}_hi") == F.col(f"{k}_lo"), 0.5).otherwise((F.col(k) - F.col(f"{k}_lo")) / (F.col(f"{k}_hi") - F.col(f"{k}_lo")))
    return f.crossJoin(F.broadcast(ends)).select("image_id", (scaled("f1") * 0.5 + scaled("f2") * 0.3 + scaled("f3") * 0.2).alias("difficulty"))


def stratified_split(clusters: DataFrame, difficulty_: DataFrame, cycle: int = 20, train: int = 14, val: int = 3) -> DataFrame:
    """Clusters to splits by their place in order of mean difficulty: of each ``cycle`` the first go to train, then val, then test.

    clusters: cluster_id, image_id; ties go by cluster_id. Places are numbered over ranges of the order, so no task
    orders all clusters, alike as they may be.
    """
    d = clusters.join(difficulty_, "image_id", "left").groupBy("cluster_id").agg(F.round(F.avg(F.coalesce("difficulty", F.lit(0.5))), 9).alias("difficulty"))
    at = F.pmod(F.col("no"), F.lit(cycle))
    return numbered(d, "no", "difficulty", "cluster_id").select("cluster_id", "difficulty", F.when(at < train, "train").when(at < train + val, "val").otherwise("test").alias("split"))
