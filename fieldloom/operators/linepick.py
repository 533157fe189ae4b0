"""Picking a field's value from text lines with boxes, as windows and aggregates over exploded lines.

lines: crop_id, field_name (long), idx, text, confidence, x1, y1, x2, y2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import geometry as G
from fieldloom.functions import text as T
from fieldloom.runtime import materialize

BOX = ("x1", "y1", "x2", "y2")
# What a way of finding a value adds to its score.
BONUS = {"same_line": 0.06, "below_label": 0.04, "block": 0.02}


def _box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in BOX])


def ordered(lines: DataFrame) -> DataFrame:
    """Lines in reading order (line_no from 0): by the middle of their height, then from the left. Lines without text or box are left out."""
    d = lines.withColumn("text", T.collapse(F.col("text"))).filter((F.col("text") != "") & F.col("x1").isNotNull())
    d = d.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "is_label": T.label_like(F.col("text"), F.col("field_name"))})
    w = Window.partitionBy("crop_id").orderBy((F.col("y1") + F.col("y2")) / 2, "x1", "idx")
    return d.withColumn("line_no", F.row_number().over(w) - 1)


def score(text: Column, raw: Column, conf: Column, field: Column, kind: Column, pieces: Column, estimate: Column) -> Column:
    """How likely a text is the value: calibrated and estimated confidence, and small terms for how it was found."""
    base = T.calibrated_confidence(text, conf, field, True, estimate) * 0.55 + estimate * 0.45
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    d = T.digit_ratio(text)
    many = add(field.isin(*T.PLACES) & (pieces > 1), 0.04) - add((field == "full_name") & (pieces > 1), 0.04)
    bonus = sum((add(kind == k, v) for k, v in BONUS.items()), F.lit(0.0))
    total = base - add(T.label_like(raw, field), 0.25) + add(F.size(T.words(text)) >= 2, 0.03) + many - add(d > 0.30, F.least(F.lit(0.18), d * 0.30)) + bonus
    return F.when(text == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.99), total)))


def _scored(*found: DataFrame) -> DataFrame:
    """Finds (crop_id, field_name, kind, raw, conf, pieces, box, seq) made scored candidates; those without a value drop out.

    All ways of finding a value are put together first, so that clean-up and scores are planned and run once.
    """
    d = found[0]
    for other in found[1:]:
        d = d.unionByName(other)
    f = F.col("field_name")
    d = d.withColumn("value", T.cleanup(F.col("raw"), f)).filter("value <> ''").withColumn("estimate", T.estimated_confidence(F.col("value"), f, True))
    s = score(F.col("value"), F.col("raw"), F.col("conf"), f, F.col("kind"), F.col("pieces"), F.col("estimate"))
    return d.select("crop_id", "field_name", "kind", "value", "raw", s.alias("score"), "pieces", *[F.col(f"box.{c}").alias(c) for c in BOX], "seq")


def _valued(o: DataFrame) -> DataFrame:
    """Lines with ``inline``, what follows the label in them."""
    return o if "inline" in o.columns else o.withColumn("inline", T.label_value(F.col("text"), F.col("field_name")))


def _same_line(o: DataFrame) -> DataFrame:
    d = _valued(o).filter((F.col("inline") != "") & (F.col("inline") != F.col("text")) & (F.col("text").contains(":") | F.col("is_label")))
    return d.select("crop_id", "field_name", F.lit("same_line").alias("kind"), F.col("inline").alias("raw"), F.col("confidence").alias("conf"), F.lit(1).alias("pieces"), G.inline_box(_box(), F.col("text"), F.col("inline")).alias("box"), F.col("line_no").alias("seq"))


def same_line(o: DataFrame) -> DataFrame:
    """Values that follow their label in one line."""
    return _scored(_same_line(o))


def _below_label(o: DataFrame) -> DataFrame:
    w = Window.partitionBy("crop_id").orderBy("line_no")
    line = F.struct("text", "confidence", "is_label", _box().alias("box"))
    d = _valued(o).withColumns({"n1": F.lead(line, 1).over(w), "n2": F.lead(line, 2).over(w)}).filter("is_label")
    ok = lambda prev, nxt: F.coalesce(~nxt.is_label & G.can_merge(prev, nxt.box), F.lit(False))
    d = d.withColumn("use1", ok(_box(), F.col("n1"))).withColumn("use2", F.col("use1") & ok(F.col("n1.box"), F.col("n2")))
    d = d.withColumn("has", (F.col("inline") != "") & (F.col("inline") != F.col("text")))
    part = lambda cond, t, c, b: F.when(cond, F.struct(t.alias("t"), c.alias("c"), b.alias("b")))
    parts = F.filter(F.array(
        part(F.col("has"), F.col("inline"), F.col("confidence"), G.inline_box(_box(), F.col("text"), F.col("inline"))),
        part(F.col("use1"), F.col("n1.text"), F.col("n1.confidence"), F.col("n1.box")), part(F.col("use2"), F.col("n2.text"), F.col("n2.confidence"), F.col("n2.box")),
    ), lambda p: p.isNotNull())
    d = d.withColumn("parts", parts).filter(F.size("parts") > 0)
    side = lambda f, c: f(F.transform("parts", lambda p: p.b[c]))
    box = F.struct(side(F.array_min, "x1").alias("x1"), side(F.array_min, "y1").alias("y1"), side(F.array_max, "x2").alias("x2"), side(F.array_max, "y2").alias("y2"))
    conf = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p.c) / F.size("parts")
    return d.select("crop_id", "field_name", F.lit("below_label").alias("kind"), F.array_join(F.transform("parts", lambda p: p.t), " ").alias("raw"), conf.alias("conf"), F.size("parts").alias("pieces"), box.alias("box"), (F.col("line_no") + 1000).alias("seq"))


def below_label(o: DataFrame) -> DataFrame:
    """Values in up to two lines below a label, with what follows the label itself in front."""
    return _scored(_below_label(o))


def _blocks(o: DataFrame) -> DataFrame:
    w = Window.partitionBy("crop_id").orderBy("line_no")
    prev = F.lag(F.struct("is_label", _box().alias("box"))).over(w)
    d = o.withColumn("prev", prev).withColumn("new", (F.col("prev").isNull() | F.col("prev.is_label") | ~G.can_merge(F.col("prev.box"), _box())).cast("int"))
    d = d.withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("is_label"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s.text), " ")
    g = d.groupBy("crop_id", "field_name", "block").agg(
        text.alias("raw"), F.avg("confidence").alias("conf"), F.count("*").cast("int").alias("pieces"),
        F.struct(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).alias("box"), (F.min("line_no") + 2000).alias("seq"),
    )
    return g.drop("block").withColumn("kind", F.lit("block"))


def blocks(o: DataFrame) -> DataFrame:
    """Runs of lines that are no labels and belong together: a new block after a label or a line that does not join."""
    return _scored(_blocks(o))


def candidates(o: DataFrame) -> DataFrame:
    """All candidates of a crop, one for each value (the best score, the first on ties), ranked by score and length."""
    o = _valued(o)
    every = _scored(_same_line(o), _below_label(o), _blocks(o))
    w = Window.partitionBy("crop_id", "value")
    one = every.withColumns({"n": F.row_number().over(w.orderBy(F.desc("score"), "seq")), "first": F.min("seq").over(w)}).filter("n = 1").drop("n")
    rank = F.row_number().over(Window.partitionBy("crop_id").orderBy(F.desc("score"), F.desc(F.length("value")), "first"))
    return one.withColumn("rank", rank)


def refine(lines: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings (crop_id, field_name, text, conf, raw_text) with the best candidate's value where it should replace theirs.

    Adds new_text, new_conf, replaced and the candidate's kind and box. A candidate replaces an empty reading, a label,
    a weak reading, or one that it clearly beats in score or length.
    """
    lined = materialize(_valued(ordered(lines.filter(F.col("field_name").isin(*T.LINE_FIELDS)))), "ordered")  # read by three branches
    top = candidates(lined).filter("rank = 1")
    c = top.select("crop_id", "kind", "value", F.col("score").alias("c"), *BOX)
    r = readings.join(c, "crop_id", "left").withColumn("base", T.collapse(F.col("text"))).withColumn("b", F.coalesce("conf", F.lit(0.0)))
    f = F.col("field_name")
    heavy = F.exists(F.split(T.text(F.col("raw_text")), "\n"), lambda x: (F.trim(x) != "") & T.label_like(x, f))
    take = (
        (F.col("base") == "") | (T.label_like(F.col("base"), f) & ~T.label_like(F.col("value"), f)) | (heavy & (F.col("c") >= F.col("b") - 0.02)) | (F.col("c") >= F.col("b") + 0.03)
        | ((F.length("value") > F.length("base") + 6) & (F.col("c") >= F.col("b") - 0.02)) | ((F.col("b") < 0.55) & (F.col("c") >= F.col("b") - 0.05))
    )
    r = r.withColumn("replaced", F.coalesce(F.col("value").isNotNull() & take, F.lit(False)))
    return r.withColumns({"new_text": F.when(F.col("replaced"), F.col("value")).otherwise(F.col("text")), "new_conf": F.when(F.col("replaced"), F.col("c")).otherwise(F.col("conf"))}).drop("base", "b", "c", "value")


def whole_or_part(field: Column, whole: Column, whole_conf: Column, part: Column, part_conf: Column, wanted: Column) -> Column:
    """'whole' or 'part': which reading to keep of a crop and of the part where the value was found."""
    from fieldloom.operators.ensemble import ladder

    w, p = T.collapse(whole), T.collapse(part)
    lw, lp = T.label_like(w, field), T.label_like(p, field)
    goal, fw, fp = T.field_form(wanted, field), T.field_form(w, field), T.field_form(p, field)
    longer = (F.length(p) > F.length(w) + 6) & (part_conf >= whole_conf - 0.03)
    return ladder(
        (p == "", "whole"), (w == "", "part"), (lw & ~lp, "part"), (lp & ~lw, "whole"), ((goal != "") & (fp == goal) & (fw != goal), "part"),
        (part_conf > whole_conf + 0.05, "part"), (longer, "part"), (whole_conf >= part_conf, "whole"), otherwise="part",
    )


def hypotheses(segments: DataFrame) -> DataFrame:
    """crop_id, field_name, text, score: what a crop's segments may read as.

    segments: crop_id, field_name, idx, text, score, y (middle), x (left). Each segment, all of them in reading order,
    each pair of neighbours, and for fields read by lines the longest; the best score for each text.
    """
    y, x = F.coalesce("y", F.lit(1e9)), F.coalesce("x", F.lit(1e9))
    s = segments.withColumn("text", T.collapse(F.col("text"))).filter("text <> ''").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("crop_id").orderBy(y, x, "idx")
    s = s.withColumns({"nt": F.lead("text").over(w), "ns": F.lead("score").over(w), "no": F.row_number().over(w), "k": F.count("*").over(Window.partitionBy("crop_id"))})
    cols = ["crop_id", "field_name", "text", "score", "ord"]
    single = s.select("crop_id", "field_name", "text", "score", F.col("no").alias("ord"))
    pair = s.filter("nt is not null").select("crop_id", "field_name", F.concat_ws(" ", "text", "nt").alias("text"), ((F.col("score") + F.col("ns")) / 2 + 0.02).alias("score"), (F.col("no") + 20_000).alias("ord"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda v: v.text), " ")
    full = s.filter("k > 1").groupBy("crop_id", "field_name").agg(line.alias("text"), (F.avg("score") + 0.02).alias("score")).withColumn("ord", F.lit(10_000)).select(*cols)
    longest = s.filter(F.col("field_name").isin(*T.LINE_FIELDS)).groupBy("crop_id", "field_name").agg(F.max_by(F.struct("text", (F.col("score") + 0.03).alias("score")), F.struct(F.length("text").alias("n"), "score", (-F.col("no")).alias("o"))).alias("m")).select("crop_id", "field_name", "m.text", "m.score", F.lit(30_000).alias("ord"))
    every = single.select(*cols).unionByName(full).unionByName(pair.select(*cols)).unionByName(longest)
    return every.groupBy("crop_id", "field_name", "text").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))


def best_hypothesis(h: DataFrame) -> DataFrame:
    """crop_id, text, score: the hypothesis with the best calibrated score, then the longer value, then the first."""
    d = h.withColumn("value", T.cleanup(F.col("text"), F.col("field_name")))
    d = d.withColumn("s", T.calibrated_confidence(F.col("value"), F.col("score"), F.col("field_name"), True)).filter("value <> ''")
    return d.groupBy("crop_id").agg(F.max_by(F.struct("value", "s"), F.struct("s", F.length("value").alias("n"), (-F.col("ord")).alias("o"))).alias("m")).select("crop_id", F.col("m.value").alias("text"), F.col("m.s").alias("score"))


def joined_text(segments: DataFrame) -> DataFrame:
    """crop_id and all texts in reading order, a line each; segments without a box come last."""
    y, x = F.coalesce("y", F.lit(1e9)), F.coalesce("x", F.lit(1e9))
    return segments.groupBy("crop_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(y.alias("y"), x.alias("x"), "idx", "text"))), lambda s: s.text), "\n").alias("text"))
