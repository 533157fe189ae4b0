"""Error rates of recognisers against reviewed truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import text as T
from fieldloom.runtime import in_order

ENGINES = {"vietocr": "text_vietocr", "paddleocr": "text_paddle", "best": "best_text"}


def _first(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that exist and are not empty."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns], F.lit(""))


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """Path (slashes forward) and field by which truth and predictions meet, with the names of older producers."""
    path = F.trim(F.regexp_replace(_first(df, ["crop_path", "path", "id"]), r"\\", "/"))
    return path, F.trim(_first(df, ["field_name", "class"]))


def match(truth: DataFrame, predictions: DataFrame, order: str) -> DataFrame:
    """Predictions with the truth of the same key. The last prediction by ``order`` wins; each truth row gives a row."""
    tp, tf = row_key(truth)
    pp, pf = row_key(predictions)
    value = _first(truth, ["ground_truth_text", "text", "transcript"])
    t = truth.select(tp.alias("k_path"), tf.alias("k_field"), value.alias("ground_truth_text"))
    whole = F.struct(*[F.col(c) for c in predictions.columns if c != "ground_truth_text"])
    p = predictions.select(pp.alias("k_path"), pf.alias("k_field"), whole.alias("p"), F.col(order).alias("o")).groupBy("k_path", "k_field").agg(F.max_by("p", "o").alias("p"))
    return t.join(p, ["k_path", "k_field"]).select("k_path", "k_field", "p.*", "ground_truth_text")


def scored(rows: DataFrame, engines: dict[str, str] | None = None, spaces: bool = True, fold_case: bool = True) -> DataFrame:
    """A row an engine and row with truth: engine, field, both forms, cer, wer, exact. Blank truths are left out."""
    engines = engines or ENGINES
    long = rows.select(
        F.coalesce("field_name", F.lit("unknown")).alias("field_name"), "crop_path", "ground_truth_text",
        F.explode(F.array(*[F.struct(F.lit(k).alias("engine"), F.col(v).alias("prediction_text")) for k, v in engines.items()])).alias("e"),
    ).select("*", "e.*").drop("e")
    form = lambda c: T.metric_form(F.col(c), spaces, fold_case)
    long = long.filter(T.collapse(F.col("ground_truth_text")) != "")
    long = long.withColumn("truth", form("ground_truth_text")).withColumn("guess", form("prediction_text"))
    return long.withColumns({"cer": T.cer(F.col("truth"), F.col("guess")), "wer": T.wer(F.col("truth"), F.col("guess")), "exact": (F.col("truth") == F.col("guess")).cast("int")})


def summary(s: DataFrame) -> DataFrame:
    """Means of row rates for each engine, overall (field '*') and by field, in one pass."""
    g = s.groupingSets([["engine"], ["engine", "field_name"]], "engine", "field_name").agg(
        F.grouping("field_name").alias("all"), F.count("*").alias("count"), F.avg("cer").alias("cer"), F.avg("wer").alias("wer"), F.avg("exact").alias("exact_match_rate")
    )
    whole = F.col("all") == 1
    return g.select("engine", F.when(whole, "overall").otherwise("per_field").alias("scope"), F.when(whole, "*").otherwise(F.col("field_name")).alias("field_name"), "count", "cer", "wer", "exact_match_rate")


def errors(s: DataFrame) -> DataFrame:
    return s.filter("exact = 0").select("engine", "field_name", "crop_path", "ground_truth_text", "prediction_text", "truth", "guess", "cer", "wer")


def top_errors(s: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` worst readings of each engine; ties by field, path and texts."""
    w = Window.partitionBy("engine").orderBy(F.desc("cer"), F.desc("wer"), "field_name", "crop_path", "truth", "guess")
    return errors(s).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def record_exact(s: DataFrame, record: str) -> DataFrame:
    """Records all of whose fields an engine read right: record, engine, fields, all_exact."""
    return s.groupBy(record, "engine").agg(F.count("*").alias("fields"), F.every(F.col("exact") == 1).alias("all_exact"))


def fuzzy(s: DataFrame, most: int = 2) -> DataFrame:
    """Share of readings within ``most`` edits of the truth, by engine and field."""
    near = (F.col("truth") == F.col("guess")) | (F.levenshtein("truth", "guess", most) >= 0)
    return s.groupBy("engine", "field_name").agg(F.count("*").alias("count"), F.avg(near.cast("int")).alias("share"))


def patterns(s: DataFrame, n: int = 10) -> DataFrame:
    """The commonest single replacements of an engine: pairs of equal length that differ in one place."""
    t, g = F.split("truth", ""), F.split("guess", "")
    diff = F.filter(F.arrays_zip(t.alias("t"), g.alias("g")), lambda p: p.t != p.g)
    one = s.filter("exact = 0 and length(truth) = length(guess)").withColumn("d", diff).filter(F.size("d") == 1)
    per = one.groupBy("engine", F.concat(F.col("d")[0].t, F.lit(">"), F.col("d")[0].g).alias("pattern")).agg(F.count("*").alias("n"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("n"), "pattern"))).filter(F.col("rank") <= n)


def pr_curve(detections: DataFrame, truths: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Precision and recall of detections in order of score, by class.

    detections: image_id, class, x, y, w, h, score; truths: image_id, class, seq, x, y, w, h. Each detection takes
    its best truth of the image and class; of several that take the same truth the best score counts.
    """
    from fieldloom.functions.geometry import iou_xywh

    d = detections.withColumn("det", F.monotonically_increasing_id()) if "det" not in detections.columns else detections
    t = truths.select("image_id", "class", "seq", *[F.col(c).alias(f"t{c}") for c in "xywh"])
    iou = iou_xywh(tuple(F.col(c) for c in "xywh"), tuple(F.col(f"t{c}") for c in "xywh"))
    hit = d.join(t, ["image_id", "class"]).withColumn("iou", iou).filter(F.col("iou") >= least_iou)
    best = hit.groupBy("image_id", "class", "det").agg(F.max("score").alias("score"), F.max_by("seq", F.struct("iou", (-F.col("seq")).alias("s"))).alias("seq"))
    right = best.groupBy("image_id", "class", "seq").agg(F.max_by("det", F.struct("score", (-F.col("det")).alias("s"))).alias("det")).select("image_id", "class", "det", F.lit(1).alias("tp"))
    total = truths.groupBy("class").agg(F.count("*").alias("total"))
    all_ = d.join(right, ["image_id", "class", "det"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    # Running counts over all of a class: within ranges of the global order, plus what the ranges before hold of it.
    o = in_order(all_, F.col("class"), F.desc("score"), F.col("image_id"), F.col("det"))
    per = o.groupBy("_part", "class").agg(F.sum("tp").alias("ctp"), F.count("*").alias("cn"))  # at most a row a partition and class
    past = Window.partitionBy("class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_part", "class", F.coalesce(F.sum("ctp").over(past), F.lit(0)).alias("btp"), F.coalesce(F.sum("cn").over(past), F.lit(0)).alias("bn"))
    w = Window.partitionBy("_part", "class").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = o.withColumns({"itp": F.sum("tp").over(w), "i": F.count("*").over(w)}).join(F.broadcast(per), ["_part", "class"])
    out = out.withColumns({"tp": F.col("itp") + F.col("btp"), "n": F.col("i") + F.col("bn")})
    return out.join(F.broadcast(total), "class").select("class", "image_id", "det", "score", (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("total")).alias("recall"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Per class: detections and the area under the stepwise precision-recall curve, each step at the best precision from there on.

    The best precision from a place on is a maximum over later ranges of the order, then within a range. Both run backwards:
    Spark goes through all of a frame that ends at the last row anew for each row, but carries on one that begins at the first.
    """
    o = in_order(curve, F.col("class"), F.desc("score"), F.col("image_id"), F.col("det"))
    per = o.groupBy("_part", "class").agg(F.max("precision").alias("top"), F.max("recall").alias("reached"))
    past = lambda *order: Window.partitionBy("class").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_part", "class", F.max("top").over(past(F.desc("_part"))).alias("later"), F.coalesce(F.max("reached").over(past("_part")), F.lit(0.0)).alias("earlier"))
    back = Window.partitionBy("_part", "class").orderBy(F.desc("_at"))
    d = o.withColumns({"best": F.max("precision").over(back.rowsBetween(Window.unboundedPreceding, 0)), "from": F.lead("recall").over(back)}).join(F.broadcast(per), ["_part", "class"])
    step = F.col("recall") - F.coalesce("from", "earlier")
    return d.groupBy("class").agg(F.count("*").alias("n"), F.sum(step * F.greatest("best", "later")).alias("average_precision"))
