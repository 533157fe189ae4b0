"""Cards cut out of photographs: rectification, its description, and the manifest of field crops.

What a rectification is (method, quality, matrix) follows from boxes alone and is a native formula; pixels are touched
only where a picture is made, in an Arrow function that never lets them leave the task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import geometry as G
from fieldloom.functions import pixels as X
from fieldloom.functions import text as T
from fieldloom.operators import quality

# How sure each way of rectifying is, and its grade.
CONFIDENCE = {"polygon_warp": 0.95, "bbox_crop": 0.4, "none": 0.0}
GRADE = {"polygon_warp": "good", "bbox_crop": "degraded"}


def box_rectification(b: Column, w: Column, h: Column, ratio: float = 0.05) -> Column:
    """What cutting out box ``b`` does: method, grade, confidence, fallback, box (padded), corners, matrix; null without a box."""

    def made(source: Column) -> Column:
        return F.struct(
            F.lit("bbox_crop").alias("method"), F.lit(GRADE["bbox_crop"]).alias("grade"), F.lit(CONFIDENCE["bbox_crop"]).alias("confidence"), F.lit(True).alias("fallback"),
            source.alias("box"), G.corners(source).alias("corners"), G.rect_matrix(source).alias("matrix"),
        )

    return F.when(b.isNotNull(), T.let(G.pad(b, w, h, ratio, 1.0), made))


def prepared(df: DataFrame, card: str = "card", w: str = "width", h: str = "height", ratio: float = 0.02) -> DataFrame:
    """``df`` with ``rectification``: that of the card's box, or method 'none' (confidence 0, no fallback) where there is none."""
    r = box_rectification(F.col(card), F.col(w), F.col(h), ratio)
    field = lambda name, other: F.coalesce(r[name], other).alias(name)
    whole = F.struct(
        field("method", F.lit("none")), F.coalesce(r.grade, F.lit(None).cast("string")).alias("grade"), field("confidence", F.lit(CONFIDENCE["none"])), field("fallback", F.lit(False)),
        r.box.alias("box"), r.corners.alias("corners"), r.matrix.alias("matrix"),
    )
    return df.withColumn("rectification", whole)


def rectify_polygon(a: np.ndarray, points: Sequence[Sequence[float]], w: int = G.CARD_WIDTH, h: int = G.CARD_HEIGHT) -> np.ndarray:
    """The card within four corners given in any order, flattened."""
    p = np.asarray(points, np.float64)
    if p.shape != (4, 2):
        raise ValueError("four points are needed")
    total, delta = p.sum(1), p[:, 1] - p[:, 0]
    return X.warp(a, p[[total.argmin(), delta.argmin(), total.argmax(), delta.argmax()]], w, h)


def rectify_box(a: np.ndarray, box: Sequence[float], w: int = G.CARD_WIDTH, h: int = G.CARD_HEIGHT) -> np.ndarray:
    """The part of a picture within a box (x1, y1, x2, y2), brought to w x h; the whole picture if the part is empty."""
    x1, y1, x2, y2 = (int(np.rint(v)) for v in box)
    part = a[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)]
    return np.rint(X.resize(part if part.size else a, h, w)).astype(np.uint8)


def rectify_udf(raw_width: int | None = None, w: int = G.CARD_WIDTH, h: int = G.CARD_HEIGHT, enhance: bool = False):
    """(content, polygon, box) -> struct of raw gray bytes (w x h), method and an error text.

    Four corners win over a box; with neither the picture is kept as it is. No picture, or corners that span no
    area, give null bytes and the reason, never a failed task.
    """

    @F.pandas_udf("content binary, method string, error string")
    def rectify(content: pd.Series, polygon: pd.Series, box: pd.Series) -> pd.DataFrame:
        rows = []
        for c, p, b in zip(content, polygon, box, strict=True):
            a = X.decode(c, raw_width)
            if a is None:
                rows.append((None, "none", "no picture"))
                continue
            a = X.gray(a)
            try:
                if p is not None:
                    out, method = rectify_polygon(a, [list(q) for q in p], w, h), "polygon_warp"
                elif b is not None:
                    out, method = rectify_box(a, list(b), w, h), "bbox_crop"
                else:
                    out, method = a, "none"
            except (ValueError, np.linalg.LinAlgError) as e:
                rows.append((None, "none", str(e)))
                continue
            rows.append(((X.denoise(X.clahe(out)) if enhance else out).tobytes(), method, None))
        return pd.DataFrame(rows, columns=["content", "method", "error"])

    return rectify


def manifest(
    images: DataFrame, annotations: DataFrame, index: DataFrame, fields: Sequence[str], folder: str = "crops", ratio: float = 0.04, card_ratio: float = 0.05,
    least: int = 12, rectify: bool = True, quality_score: DataFrame | None = None,
) -> DataFrame:
    """The manifest: a row for each annotation of a wanted field whose crop is large enough.

    images: image_id, split, file_name, width, height; annotations: image_id, id, class, x, y, w, h; index: file_name,
    path. Images without a path give no crop. Crops are cut from the card (the largest box of class card) rectified by
    its padded box, or from the picture itself where it has none. quality_score: image_id, score (optional).
    """
    pictures = images.join(index.select("file_name", "path"), "file_name")
    own = annotations.filter(F.col("class").isin(*fields))
    if rectify:
        card = quality.largest(annotations.withColumn("seq", F.col("id"))).select("image_id", G.from_xywh(*[F.col(c) for c in "xywh"]).alias("card"))
        pictures = pictures.join(card, "image_id", "left")
    else:
        pictures = pictures.withColumn("card", F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double>"))
    pictures = prepared(pictures, ratio=card_ratio)
    if quality_score is None:
        pictures = pictures.withColumn("score", F.lit(None).cast("double"))
    else:
        pictures = pictures.join(quality_score.select("image_id", "score"), "image_id", "left")
    d = own.join(pictures, "image_id").withColumn("source", G.pad(G.from_xywh(*[F.col(c) for c in "xywh"]), F.col("width"), F.col("height"), ratio))
    on_card = G.to_card(F.col("source"), F.col("rectification.box"))
    d = d.withColumn("cut", F.when(F.col("rectification.box").isNotNull(), on_card).otherwise(G.clamp(F.col("source"), F.col("width"), F.col("height"))))
    side = lambda lo, hi: F.bround(F.col(f"cut.{hi}") - F.col(f"cut.{lo}")).cast("int")
    d = d.filter((side("x1", "x2") >= least) & (side("y1", "y2") >= least))
    stem = F.regexp_replace("file_name", r"\.[^./\\]*$", "")
    flat = lambda b: F.array(*[F.col(f"{b}.{c}").cast("float") for c in ("x1", "y1", "x2", "y2")])
    return d.select(
        F.concat(F.lit(folder.rstrip("/") + "/"), F.col("class"), F.lit("/"), stem, F.lit("_"), F.col("id").cast("string"), F.lit(".jpg")).alias("crop_path"), T.portable_path(F.col("path")).alias("image_path"),
        F.col("class").alias("field_name"), "image_id", F.col("image_id").alias("source_image_id"), flat("cut").alias("bbox"), flat("source").alias("source_bbox"), "split", F.col("id").alias("annotation_id"),
        F.col("rectification.method").alias("rectification_method"), F.col("score").alias("image_quality_score"),
    )
