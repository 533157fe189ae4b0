"""Frames of clips: sampling, choice of frames, votes over frames, fusion of boxes; gazetteer match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.operators.dedup import components
from fieldloom.operators.quality import overlaps


def step_of(seconds: Column) -> Column:
    """Take every n-th frame of a clip of this length."""
    return F.when(seconds < 1, 1).when(seconds < 3, 3).when(seconds <= 10, 5).otherwise(10)


def sample_frames(frames: DataFrame) -> DataFrame:
    """Frames (clip, ts, frame) thinned by the length of their clip, from the first on."""
    per = Window.partitionBy("clip")
    length = F.max("ts").over(per).cast("timestamp").cast("double") - F.min("ts").over(per).cast("timestamp").cast("double")
    no = F.row_number().over(per.orderBy("ts", "frame")) - 1
    return frames.withColumns({"step": step_of(length), "no": no}).filter(F.col("no") % F.col("step") == 0).drop("no")


def top_frames(frames: DataFrame, n: int = 5, least: float | None = None) -> DataFrame:
    """The ``n`` best frames of each clip by score; earlier frames first on ties."""
    d = frames if least is None else frames.filter(F.col("score") >= least)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("score"), "frame"))).filter(F.col("rank") <= n)


def vote(readings: DataFrame, least: int = 2) -> DataFrame:
    """clip, field, text, votes: the text most frames read, if ``least`` do, else the one with the best score."""
    per = readings.groupBy("clip", "field", "text").agg(F.count("*").alias("votes"), F.max("score").alias("best"))
    key = F.struct(F.when(F.col("votes") >= least, F.col("votes")).otherwise(0).alias("v"), F.col("best"), F.col("text"))
    return per.groupBy("clip", "field").agg(F.max_by(F.struct("text", "votes"), key).alias("m")).select("clip", "field", "m.text", "m.votes")


def fuse(boxes: DataFrame, least_iou: float = 0.55) -> DataFrame:
    """Boxes of one picture and class that overlap made one, weighted by score: image_id, class, n, score, x, y, w, h.

    boxes: box_id, image_id, class, x, y, w, h, score. Overlapping boxes form components; they meet in bands of
    areas, so a crowded picture is not paired with itself as a whole.
    """
    edges = overlaps(boxes.withColumn("seq", F.col("box_id")), least_iou, inclusive=True).select(F.col("seq_a").alias("a"), F.col("seq_b").alias("b"))
    comp = components(edges)
    d = boxes.join(comp, F.col("box_id") == F.col("vertex"), "left").withColumn("group", F.coalesce("component", "box_id"))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("score")), F.sum("score")).alias(c)
    return d.groupBy("image_id", "class", "group").agg(F.count("*").alias("n"), F.max("score").alias("score"), *[mean(c) for c in "xywh"]).drop("group")


def nearest_name(values: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """value, name, distance: the nearest name within ``most`` edits, the first in order on ties.

    values: value; names: name. Names and values meet by length and by one of ``most`` + 1 pieces of the name, so the
    join is an equi-join on pieces; names too short to cut meet by length alone, in an equi-join on lengths.
    """
    n = most + 1
    v = values.filter("value is not null").select(F.lower("value").alias("v"), "value").distinct()
    m = names.filter("name is not null").select(F.lower("name").alias("m"), "name").distinct()
    size = F.floor(F.length("m") / n)
    piece = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(F.col("m"), (i * size + 1).cast("int"), size.cast("int")))
    cut = m.filter(F.length("m") >= n).select("m", "name", F.explode(F.array_distinct(piece)).alias("k"))
    sizes = cut.select(F.length("k").alias("len")).distinct()
    grams = v.crossJoin(F.broadcast(sizes.groupBy().agg(F.collect_list("len").alias("lens"))))  # as many as names have thirds
    at = lambda l: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("v") - l + 1)), lambda i: F.substring(F.col("v"), i, l))
    grams = grams.select("v", "value", F.explode(F.array_distinct(F.flatten(F.transform("lens", at)))).alias("k"))
    short = m.filter(F.length("m") < n).withColumn("len", F.explode(F.sequence(F.lit(0), F.length("m") + most)))
    pairs = grams.join(cut, "k").select("v", "value", "m", "name").unionByName(v.join(short, F.length("v") == F.col("len")).select("v", "value", "m", "name")).distinct()
    d = pairs.withColumn("distance", F.levenshtein("v", "m", most)).filter("distance >= 0")
    return d.groupBy("value").agg(F.min(F.struct("distance", "name")).alias("b")).select("value", "b.name", "b.distance")
