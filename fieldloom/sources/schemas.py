"""Schemas of the record formats, stated once; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


IMAGE = struct(id=L, file_name=S, width=I, height=I)
ANNOTATION = struct(id=L, image_id=L, category_id=I, bbox=T.ArrayType(D))
CATEGORY = struct(id=I, name=S)
COCO = struct(images=T.ArrayType(IMAGE), annotations=T.ArrayType(ANNOTATION), categories=T.ArrayType(CATEGORY))
MANIFEST = struct(
    crop_path=S, image_path=S, field_name=S, image_id=L, source_image_id=L, bbox=T.ArrayType(T.FloatType()), source_bbox=T.ArrayType(T.FloatType()),
    split=S, annotation_id=L, rectification_method=S, image_quality_score=D,
)
LEGACY_MANIFEST = T.StructType([T.StructField(k, v) for k, v in (("path", S), ("class", S), ("split", S), ("source_image", S), ("ann_id", L), ("bbox", T.ArrayType(I)), ("width", I), ("height", I))])
SEGMENT = struct(text=S, score=D, box=T.ArrayType(T.ArrayType(D)))
CANDIDATE = struct(text=S, confidence=D, backend=S, needs_review=B, raw_text=S, normalized_text=S)
PSEUDO_LABEL = struct(
    crop_path=S, field_name=S, image_path=S, image_id=L, split=S, annotation_id=L, ground_truth_text=S, text_vietocr=S, conf_vietocr=D, text_paddle=S,
    text_paddleocr=S, conf_paddle=D, conf_paddleocr=D, best_text=S, best_conf=D, best_engine=S, best_source=S, needs_review=B, review_bucket=S,
)
REVIEWED = T.StructType(
    [T.StructField(k, v) for k, v in (
        ("crop_path", S), ("field_name", S), ("class", S), ("split", S), ("source_image", S), ("ann_id", L), ("text_vietocr", S), ("conf_vietocr", D),
        ("text_paddle", S), ("conf_paddle", D), ("best_text", S), ("best_conf", D), ("best_source", S), ("best_normalized_text", S), ("review_bucket", S),
        ("needs_review", B), ("ground_truth_text", S), ("candidates", T.MapType(S, CANDIDATE)),
    )]
)
