"""Views of the test tables in the shapes that operators take, each stated in DataFrame terms and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldloom.runtime import table

# First word of a part's type -> class of an annotation.
CLASS_OF = {"STANDARD": "id", "SMALL": "name", "LARGE": "birth", "ECONOMY": "origin", "MEDIUM": "address", "PROMO": "card"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles and floats rounded, and no negative zero, so that results compare by value."""
    return df.select(*[(F.round(F.col(f.name), digits) + 0.0).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Boxes: order lines as annotations of their order's picture; a line's place in its order is its seq."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    kind = F.split(F.col("p_type"), " ")[0]
    cls = F.coalesce(*[F.when(kind == k, v) for k, v in CLASS_OF.items()], F.lit("?"))
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*cols))
    return li.withColumn("seq", seq).join(p.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("image_id"), "seq", cls.alias("class"), (F.col("l_quantity") * 12 - 15).alias("x"), (F.col("l_discount") * 4000).alias("y"),
        (F.col("l_extendedprice") / 200).alias("w"), (F.col("l_extendedprice") / 300 + F.col("l_tax") * 500).alias("h"),
    )


def split_of(key: Column) -> Column:
    m = F.pmod(key, F.lit(20))
    return F.when(m < 14, "train").when(m < 17, "val").otherwise("test")


def images(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("image_id"), split_of(F.col("o_orderkey")).alias("split"), F.lit(640).alias("width"), F.lit(640).alias("height"), F.format_string("img%08d.jpg", "o_orderkey").alias("file_name"))


def brightness(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.filter(F.col("o_orderkey") % 5 != 0).select(F.col("o_orderkey").alias("image_id"), F.pmod(F.col("o_orderkey") * 7, F.lit(256)).cast("double").alias("mean"))


SQL = """
    annotations AS (
      SELECT l.l_orderkey AS image_id, l.seq,
             CASE split_part(p.p_type, ' ', 1) WHEN 'STANDARD' THEN 'id' WHEN 'SMALL' THEN 'name' WHEN 'LARGE' THEN 'birth' WHEN 'ECONOMY' THEN 'origin' WHEN 'MEDIUM' THEN 'address' WHEN 'PROMO' THEN 'card' ELSE '?' END AS class,
             l.l_quantity * 12 - 15 AS x, l.l_discount * 4000 AS y, l.l_extendedprice / 200 AS w, l.l_extendedprice / 300 + l.l_tax * 500 AS h
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq FROM lineitem) l
      JOIN part p ON p.p_partkey = l.l_partkey),
    images0 AS (
      SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 20 < 14 THEN 'train' WHEN o_orderkey % 20 < 17 THEN 'val' ELSE 'test' END AS split, 640 AS width, 640 AS height, printf('img%08d.jpg', o_orderkey) AS file_name
      FROM orders),
    per AS (
      SELECT i.image_id, i.split, count(a.seq) AS n, count(a.seq) FILTER (a.class IN ('id', 'name', 'birth', 'origin', 'address', 'title')) AS fields, count(a.seq) FILTER (a.class = 'card') AS cards, min(a.w * a.h) AS least_area
      FROM images0 i LEFT JOIN annotations a ON a.image_id = i.image_id GROUP BY i.image_id, i.split)
"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed rows with texts as they are stored: row_id, crop_path, field_name, ann_id, ground_truth_text, three engines' texts."""
    return table(spark, d, "reviewed_sample").select("row_id", "crop_path", F.col("class").alias("field_name"), "ann_id", "ground_truth_text", "text_vietocr", "text_paddle", "best_text")


def sql_form(c: str) -> str:
    """Composed, white space collapsed: as error rates and clean-up see a text."""
    return f"trim(regexp_replace(nfc_normalize(coalesce({c}, '')), '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g'))"


# DuckDB counts edits in bytes, so each distinct character of a pair stands for one code below 128, and each distinct word too.
_SPELL = "array_to_string(list_transform({items}, lambda x: chr(list_position({letters}, x)::INT)), '')"
READINGS_SQL = f"""
    readings AS (
      SELECT row_id, crop_path, class AS field_name, ann_id, {', '.join(f'lower({sql_form(c)}) AS {k}' for k, c in (('t', 'ground_truth_text'), ('v', 'text_vietocr'), ('p', 'text_paddle'), ('b', 'best_text')))} FROM reviewed_sample),
    long0 AS (
      SELECT row_id, crop_path, field_name, t, 'vietocr' AS engine, v AS g FROM readings WHERE t <> '' UNION ALL
      SELECT row_id, crop_path, field_name, t, 'paddleocr', p FROM readings WHERE t <> '' UNION ALL
      SELECT row_id, crop_path, field_name, t, 'best', b FROM readings WHERE t <> ''),
    words0 AS (
      SELECT *, list_filter(string_split(t, ' '), lambda x: x <> '') AS tw, list_filter(string_split(g, ' '), lambda x: x <> '') AS gw,
             list_transform(range(1, length(t) + 1), lambda i: t[i]) AS tc, list_transform(range(1, length(g) + 1), lambda i: g[i]) AS gc FROM long0),
    coded AS (SELECT *, list_distinct(list_concat(tw, gw)) AS vocab, list_distinct(list_concat(tc, gc)) AS letters FROM words0),
    counted AS (
      SELECT *, levenshtein({_SPELL.format(items='tc', letters='letters')}, {_SPELL.format(items='gc', letters='letters')}) AS chars,
             levenshtein({_SPELL.format(items='tw', letters='vocab')}, {_SPELL.format(items='gw', letters='vocab')}) AS wrong_words FROM coded),
    scored AS (
      SELECT row_id, crop_path, field_name, engine, t, g, tc, gc, chars, chars::DOUBLE / len(tc) AS cer, wrong_words::DOUBLE / len(tw) AS wer, CASE WHEN t = g THEN 1 ELSE 0 END AS exact FROM counted)
"""


def grids(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 grids of 64 numbers."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("grid"))


def clips(spark: SparkSession, d: str) -> DataFrame:
    """Frames: a user's events of a day as a clip."""
    e = table(spark, d, "events")
    return e.select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("clip"), F.col("event_id").alias("frame"), "ts", F.col("event_type").alias("text"), F.col("value").alias("score"))


CLIPS_SQL = "clips AS (SELECT user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS clip, event_id AS frame, ts, event_type AS text, value AS score FROM events)"


# The labels printed before a field's value.
PRINTED = {"full_name": "Họ và tên:", "place_of_origin": "Quê quán:", "place_of_residence": "Nơi thường trú:"}


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Text lines of crops: annotations in fours as a crop, each with its box and latest reading, and a printed label.

    The label stands in front of the first line in odd crops and on a line of its own above it in even ones.
    """
    m = table(spark, d, "crop_manifest").filter(F.size("bbox") == 4)
    box = [F.get("bbox", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    read = table(spark, d, "reviewed_sample").groupBy("ann_id").agg(F.max_by(F.struct("best_text", "best_conf"), "row_id").alias("m"))
    j = m.select("annotation_id", *box).distinct().join(read, F.col("annotation_id") == F.col("ann_id"))
    crop = F.floor(F.col("annotation_id") / 4)
    field = F.get(F.array(*[F.lit(f) for f in (*PRINTED, "title")]), (crop % 4).cast("int"))
    idx = F.row_number().over(Window.partitionBy(crop).orderBy("annotation_id", "x1", "y1", "x2", "y2"))
    out = j.select(crop.alias("crop_id"), field.alias("field_name"), idx.alias("idx"), F.col("m.best_text").alias("text"), F.col("m.best_conf").alias("confidence"), "x1", "y1", "x2", "y2")
    label = F.coalesce(*[F.when(F.col("field_name") == k, v) for k, v in PRINTED.items()])
    first, odd = F.col("idx") == 1, F.col("crop_id") % 2 == 1
    above = out.filter(first & ~odd & label.isNotNull()).withColumns({"idx": F.lit(0), "text": label, "y2": F.col("y1") - 5, "y1": F.col("y1") - 25})
    return out.withColumn("text", F.when(first & odd & label.isNotNull(), F.concat_ws(" ", label, "text")).otherwise(F.col("text"))).unionByName(above)
