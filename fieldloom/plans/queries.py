"""Queries of the core operators over the test tables, and the SQL that they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import geometry as G
from fieldloom.functions import pixels as X
from fieldloom.functions import text as T
from fieldloom.operators import cards, dedup, ensemble, evaluate, inference, linepick, nested, quality, review, routing, video
from fieldloom.plans import adapters as A
from fieldloom.plans import choice_sql as C
from fieldloom.plans.label_sql import CONFIDENCE_CTES, LABEL_CTES, picked_date, picked_id
from fieldloom.runtime import materialize, shared_dir, table
from fieldloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _fives(df: DataFrame, *cols: str) -> DataFrame:
    """Columns rounded to five places, off the borders where both engines' sums may fall apart."""
    return A.rounded(df.withColumns({c: F.col(c) + 1e-8 for c in cols}), 5)


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(table(spark, d, "reviewed_sample"), table(spark, d, "reviewed_raw"))


@query()
def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return nested.tables(nested.parse(table(spark, d, "reviewed_raw"), "raw_id", "payload"))["segments"]


@query()
def p2_attributes(spark: SparkSession, d: str) -> DataFrame:
    return nested.tables(nested.parse(table(spark, d, "reviewed_raw"), "raw_id", "payload"))["attributes"]


_VARIANT = """
    e AS (SELECT row_id, unnest(map_entries(candidates)) AS e FROM reviewed_sample),
    v AS (SELECT row_id AS record_id, e.key AS engine, e.value AS r, CASE WHEN e.value.text IS NULL THEN CASE WHEN e.value.confidence IS NULL THEN 'void' ELSE 'silent' END WHEN e.value.confidence IS NULL THEN 'text'
      WHEN e.value.raw_text IS NOT NULL OR e.value.normalized_text IS NOT NULL THEN 'formed' ELSE 'scored' END AS variant FROM e WHERE e.value IS NOT NULL)
"""


@query(f"WITH {_VARIANT} SELECT record_id, engine, variant FROM v")
def p2_variants(spark: SparkSession, d: str) -> DataFrame:
    return nested.map_readings(table(spark, d, "reviewed_sample")).select("record_id", "engine", "variant")


@query(f"WITH {_VARIANT} SELECT record_id, engine, r.text AS text, r.confidence AS confidence, r.backend AS backend, r.needs_review AS needs_review, r.raw_text AS raw_text, r.normalized_text AS normalized_text FROM v WHERE variant = 'formed'")
def p2_readings_formed(spark: SparkSession, d: str) -> DataFrame:
    return nested.map_tables(table(spark, d, "reviewed_sample"))["readings_formed"].drop("reading_no")


@query("SELECT row_id AS record_id, CASE WHEN candidates IS NULL THEN 'none' WHEN cardinality(candidates) = 0 THEN 'empty' ELSE 'map' END AS shape, coalesce(cardinality(candidates), -1)::INT AS entries FROM reviewed_sample")
def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.map_tables(table(spark, d, "reviewed_sample"))["records"]


@query("""
    SELECT row_id AS record_id, e.key AS engine, e.value.text AS text, e.value.confidence AS confidence, e.value.backend AS backend,
           e.value.needs_review AS needs_review, e.value.raw_text AS raw_text, e.value.normalized_text AS normalized_text
    FROM (SELECT row_id, unnest(map_entries(candidates)) AS e FROM reviewed_sample) WHERE e.value IS NOT NULL
""")
def p2_readings(spark: SparkSession, d: str) -> DataFrame:
    return nested.map_readings(table(spark, d, "reviewed_sample")).drop("reading_no", "variant")


# ---- evaluation of the texts as they are stored: accents and all other characters count


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.scored(A.readings(spark, d))


def _forms(spark: SparkSession, d: str) -> DataFrame:
    """row_id, engine, t, g: the forms that error rates compare, for rows with truth."""
    r = A.readings(spark, d)
    r = r.select("row_id", T.metric_form(F.col("ground_truth_text")).alias("t"), *[T.metric_form(F.col(v)).alias(k) for k, v in evaluate.ENGINES.items()]).filter("t <> ''")
    return r.select("row_id", "t", F.explode(F.create_map(*[x for k in evaluate.ENGINES for x in (F.lit(k), F.col(k))])).alias("engine", "g"))


@query(f"""
    WITH {A.READINGS_SQL}
    SELECT engine, CASE WHEN grouping(field_name) = 1 THEN 'overall' ELSE 'per_field' END AS scope, CASE WHEN grouping(field_name) = 1 THEN '*' ELSE field_name END AS field_name,
           count(*) AS count, round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer, round(avg(exact), 6) AS exact_match_rate
    FROM scored GROUP BY GROUPING SETS ((engine), (engine, field_name))
""")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(evaluate.summary(_scored(spark, d)))


@query(f"WITH {A.READINGS_SQL} SELECT engine, row_id, chars, round(cer, 6) AS cer FROM scored")
def char_distance(spark: SparkSession, d: str) -> DataFrame:
    t, g = F.col("t"), F.col("g")
    return A.rounded(_forms(spark, d).select("engine", "row_id", T.char_distance(t, g).cast("long").alias("chars"), T.cer(t, g).alias("cer")))


@query(f"WITH {A.READINGS_SQL} SELECT engine, field_name, crop_path, t AS truth, g AS guess, round(cer, 6) AS cer, round(wer, 6) AS wer FROM scored WHERE exact = 0")
def eval_errors(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(evaluate.errors(_scored(spark, d)).drop("ground_truth_text", "prediction_text"))


@query(f"""
    WITH {A.READINGS_SQL}
    SELECT engine, rank, truth, guess, round(cer, 6) AS cer FROM (
      SELECT engine, t AS truth, g AS guess, cer, row_number() OVER (PARTITION BY engine ORDER BY cer DESC, wer DESC, field_name, crop_path, t, g) AS rank FROM scored WHERE exact = 0) WHERE rank <= 20
""")
def top_errors(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(evaluate.top_errors(_scored(spark, d)).select("engine", "rank", "truth", "guess", "cer"))


@query(f"WITH {A.READINGS_SQL} SELECT engine, field_name, count(*) AS count, round(avg(CASE WHEN chars <= 2 THEN 1 ELSE 0 END), 6) AS share FROM scored GROUP BY engine, field_name")
def fuzzy_le2(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(evaluate.fuzzy(_scored(spark, d)))


@query(f"""
    WITH {A.READINGS_SQL}
    SELECT engine, ann_id, count(*) AS fields, bool_and(exact = 1) AS all_exact FROM scored JOIN (SELECT row_id, ann_id FROM readings) r USING (row_id) GROUP BY engine, ann_id
""")
def record_exact(spark: SparkSession, d: str) -> DataFrame:
    r = A.readings(spark, d)
    s = evaluate.scored(r.withColumn("crop_path", F.col("ann_id").cast("string"))).withColumn("ann_id", F.col("crop_path").cast("long"))
    return evaluate.record_exact(s, "ann_id")


@query(f"WITH {A.READINGS_SQL} SELECT row_id, engine, round(chars::DOUBLE / greatest(len(tc), len(gc)), 6) AS ned FROM scored")
def ned(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(_forms(spark, d).select("row_id", "engine", T.normalized_distance(F.col("t"), F.col("g")).alias("ned")))


@query(f"""
    WITH {A.READINGS_SQL},
    d AS (SELECT engine, list_filter(list_transform(range(1, len(tc) + 1), lambda i: tc[i] || '>' || gc[i]), lambda x: x[1] <> x[3]) AS d FROM scored WHERE exact = 0 AND len(tc) = len(gc)),
    c AS (SELECT engine, d[1] AS pattern, count(*) AS n FROM d WHERE len(d) = 1 GROUP BY engine, d[1])
    SELECT * FROM (SELECT engine, pattern, n, row_number() OVER (PARTITION BY engine ORDER BY n DESC, pattern) AS rank FROM c) WHERE rank <= 10
""")
def top_patterns(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.patterns(_scored(spark, d))


@query("""
    WITH t AS (SELECT row_id, trim(replace(crop_path, '\\', '/')) AS k_path, coalesce(nullif(field_name, ''), class) AS k_field, ground_truth_text FROM reviewed_sample),
    p AS (SELECT trim(replace(crop_path, '\\', '/')) AS k_path, coalesce(nullif(field_name, ''), '') AS k_field, arg_max(annotation_id, annotation_id) AS annotation_id FROM crop_manifest GROUP BY 1, 2)
    SELECT t.k_path, t.k_field, p.annotation_id, coalesce(nullif(t.ground_truth_text, ''), '') AS ground_truth_text FROM t JOIN p ON p.k_path = t.k_path AND p.k_field = t.k_field
""")
def gt_pred_join(spark: SparkSession, d: str) -> DataFrame:
    pred = table(spark, d, "crop_manifest").select("crop_path", "field_name", "annotation_id")
    return evaluate.match(table(spark, d, "reviewed_sample"), pred, "annotation_id").select("k_path", "k_field", "annotation_id", "ground_truth_text")


_CURVE = f"""
    WITH {A.SQL},
    t AS (SELECT image_id, class, seq, x, y, w, h FROM annotations WHERE seq % 3 <> 0),
    dt AS (SELECT image_id, class, seq AS det, x + 2 AS x, y + 1 AS y, w, h, round(w * 20000)::BIGINT AS score FROM annotations),
    hit AS (
      SELECT d.image_id, d.class, d.det, d.score, t.seq,
             greatest(0, least(d.x + d.w, t.x + t.w) - greatest(d.x, t.x)) * greatest(0, least(d.y + d.h, t.y + t.h) - greatest(d.y, t.y)) AS i, d.w * d.h + t.w * t.h AS s
      FROM dt d JOIN t ON t.image_id = d.image_id AND t.class = d.class),
    best AS (SELECT *, row_number() OVER (PARTITION BY image_id, class, det ORDER BY i / (s - i) DESC, seq) AS r FROM hit WHERE i > 0 AND i / (s - i) >= 0.5),
    rightly AS (SELECT image_id, class, det, row_number() OVER (PARTITION BY image_id, class, seq ORDER BY score DESC, det) AS r FROM best WHERE r = 1),
    tot AS (SELECT class, count(*) AS total FROM t GROUP BY class),
    c AS (SELECT d.*, CASE WHEN r.r = 1 THEN 1 ELSE 0 END AS tp FROM dt d LEFT JOIN rightly r ON r.image_id = d.image_id AND r.class = d.class AND r.det = d.det),
    cu AS (SELECT class, image_id, det, score, sum(tp) OVER w / count(*) OVER w AS precision, sum(tp) OVER w / total AS recall FROM c JOIN tot USING (class) WINDOW w AS (PARTITION BY class ORDER BY score DESC, image_id, det ROWS UNBOUNDED PRECEDING))
"""


@query(f"{_CURVE} SELECT class, image_id, det, score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM cu")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    a = A.annotations(spark, d)
    det = a.select("image_id", "class", F.col("seq").alias("det"), (F.col("x") + 2).alias("x"), (F.col("y") + 1).alias("y"), "w", "h", F.round(F.col("w") * 20000).cast("long").alias("score"))
    return A.rounded(evaluate.pr_curve(det, a.filter("seq % 3 <> 0")))


@query(f"""
    {_CURVE}, st AS (
      SELECT *, recall - coalesce(lag(recall) OVER w, 0) AS step, max(precision) OVER (PARTITION BY class ORDER BY score DESC, image_id, det ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best
      FROM cu WINDOW w AS (PARTITION BY class ORDER BY score DESC, image_id, det))
    SELECT class, count(*) AS n, round(sum(step * best) + 1e-8, 5) AS average_precision FROM st GROUP BY class
""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    a = A.annotations(spark, d)
    det = a.select("image_id", "class", F.col("seq").alias("det"), (F.col("x") + 2).alias("x"), (F.col("y") + 1).alias("y"), "w", "h", F.round(F.col("w") * 20000).cast("long").alias("score"))
    return _fives(evaluate.average_precision(evaluate.pr_curve(det, a.filter("seq % 3 <> 0"))), "average_precision")


# ---- review


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviewed_sample")


def _preset(name: str, where: str, limit: int | None = None, order: str = ""):
    sql = f"SELECT row_id, round(best_conf, 6) AS best_conf FROM reviewed_sample WHERE {where} {order}" + (f" LIMIT {limit}" if limit else "")

    def run(spark: SparkSession, d: str) -> DataFrame:
        import dataclasses

        s = dataclasses.replace(review.PRESETS[name], limit=limit)
        return A.rounded(review.select(_sample(spark, d), s).select("row_id", "best_conf"))

    run.__name__ = f"review_preset_{name}"
    query(sql)(run)


_preset("custom", "split = 'val'")
_preset("test_deep", "split = 'test'")
_preset("val_medium", "split = 'val' AND coalesce(best_conf, 0) < 0.85", 50, "ORDER BY coalesce(best_conf, 0), row_id")
_preset("train_confidence", "split = 'train' AND coalesce(best_conf, 0) < 0.85")


@query("SELECT row_id, CASE WHEN best_conf >= 0.9 THEN 'accept' WHEN best_conf >= 0.5 THEN 'review' ELSE 'reject' END AS bucket FROM reviewed_sample")
def bucketize(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).select("row_id", T.bucket(F.col("best_conf")).alias("bucket"))


@query("SELECT row_id FROM reviewed_sample WHERE best_conf >= 0.5 AND best_conf < 0.9")
def bucket_filter(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).filter(review.bucket_range("review")).select("row_id")


@query("""
    SELECT 'split' AS kind, coalesce(split, 'missing') AS value, count(*) AS n FROM reviewed_sample GROUP BY 2
    UNION ALL SELECT 'review_bucket', coalesce(review_bucket, 'missing'), count(*) FROM reviewed_sample GROUP BY 2
""")
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.summary(_sample(spark, d))


_DONE = r"regexp_replace(coalesce(ground_truth_text, ''), '[\s\p{Z}\x1c-\x1f\x85]', '', 'g') <> ''"


@query(f"""
    SELECT field, total, done, total - done AS remaining, accept, review, reject, round(done * 100.0 / total, 1) AS percent FROM (
      SELECT class AS field, count(*) AS total, count(*) FILTER ({_DONE}) AS done, count(*) FILTER (review_bucket = 'accept') AS accept,
             count(*) FILTER (review_bucket = 'review') AS review, count(*) FILTER (review_bucket = 'reject') AS reject FROM reviewed_sample GROUP BY class)
""")
def review_progress(spark: SparkSession, d: str) -> DataFrame:
    return review.progress(_sample(spark, d))


@query(f"SELECT row_id FROM reviewed_sample WHERE NOT ({_DONE}) AND class = 'name'")
def review_status_filter(spark: SparkSession, d: str) -> DataFrame:
    return review.by_status(_sample(spark, d), "pending", "name").select("row_id")


@query(f"SELECT row_id, ground_truth_text FROM reviewed_sample WHERE {_DONE}")
def review_export(spark: SparkSession, d: str) -> DataFrame:
    return review.export(_sample(spark, d)).select("row_id", "ground_truth_text")


@query("""
    WITH e AS (SELECT ann_id, crop_path, arg_max('edit ' || row_id, row_id) AS truth FROM reviewed_sample WHERE row_id % 7 = 0 AND row_id % 14 <> 0 GROUP BY ann_id, crop_path),
    f AS (SELECT ann_id, crop_path, min(row_id) AS row_id FROM reviewed_sample GROUP BY ann_id, crop_path)
    SELECT r.row_id, coalesce(e.truth, r.ground_truth_text) AS ground_truth_text FROM reviewed_sample r
    LEFT JOIN f ON f.row_id = r.row_id LEFT JOIN e ON e.ann_id = f.ann_id AND e.crop_path = f.crop_path
""")
def review_upsert(spark: SparkSession, d: str) -> DataFrame:
    r = _sample(spark, d)
    text = F.when(F.col("row_id") % 14 == 0, "  ").otherwise(F.concat(F.lit(" edit "), F.col("row_id").cast("string")))  # every second edit is blank
    edits = r.filter("row_id % 7 = 0").select("ann_id", "crop_path", text.alias("truth"), F.col("row_id").alias("edit_no"))
    return review.upsert(r, edits).select("row_id", "ground_truth_text")


@query("""
    SELECT row_id, (CASE WHEN coalesce(text_vietocr, '') <> '' THEN 1 ELSE 0 END) + (CASE WHEN coalesce(text_paddle, '') <> '' THEN 1 ELSE 0 END) AS n_candidates, best_source,
           CASE coalesce(field_name, class) WHEN 'id' THEN 'id_number' WHEN 'name' THEN 'full_name' WHEN 'birth' THEN 'date_of_birth' WHEN 'origin' THEN 'place_of_origin' WHEN 'address' THEN 'place_of_residence' ELSE coalesce(field_name, class) END AS field_name
    FROM reviewed_sample
""")
def review_normalize(spark: SparkSession, d: str) -> DataFrame:
    return review.complete(_sample(spark, d)).select("row_id", F.size("flat_candidates").alias("n_candidates"), "best_source", "field_name")


@query(r"""
    SELECT row_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: l[i]), '|') AS hints FROM (
      SELECT row_id, [x.v FOR x IN list_sort(list_transform(list_distinct(a), lambda t: {'i': list_position(a, t), 'v': t}))] AS l FROM (
        SELECT row_id, list_filter([best_text, text_vietocr, text_paddle], lambda t: t IS NOT NULL AND regexp_replace(t, '[\s\p{Z}\x1c-\x1f\x85]', '', 'g') <> '') AS a FROM reviewed_sample))
""")
def review_hints(spark: SparkSession, d: str) -> DataFrame:
    return review.hints(_sample(spark, d)).select("row_id", F.array_join("hints", "|").alias("hints"))


@query("SELECT row_id, split FROM reviewed_sample WHERE split IN ('test', 'val') ORDER BY CASE split WHEN 'test' THEN 1 ELSE 2 END, row_id LIMIT 500")
def crop_limit(spark: SparkSession, d: str) -> DataFrame:
    return review.budget(_sample(spark, d), ["test", "val"], 500, "row_id").select("row_id", "split")


@query("SELECT crop_path, annotation_id FROM crop_manifest WHERE field_name IN ('id', 'name') ORDER BY annotation_id, crop_path LIMIT 100")
def manifest_filter_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crop_manifest").filter(F.col("field_name").isin("id", "name")).orderBy("annotation_id", "crop_path").limit(100).select("crop_path", "annotation_id")


@query("SELECT ann_id, max(row_id) AS row_id FROM reviewed_sample GROUP BY ann_id")
def latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    return review.latest_delivery(_sample(spark, d)).select("ann_id", "row_id")


@query("SELECT coalesce(field_name, 'missing') AS field_name, coalesce(split, 'missing') AS split, count(*) AS n FROM crop_manifest GROUP BY 1, 2")
def crop_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.counts(table(spark, d, "crop_manifest"), "field_name", "split")


@query("""
    SELECT row_id, regexp_replace(regexp_replace(regexp_replace(replace(crop_path, '\\', '/'), '([^/])/{2,}', '\\1/', 'g'), '^(\\./)+', ''), '^/mnt/store/ocr/', '') AS path,
           CASE WHEN starts_with(crop_path, '/') THEN crop_path ELSE '/mnt/store/ocr/' || crop_path END AS resolved FROM reviewed_sample
""")
def portable_path(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("crop_path")
    return _sample(spark, d).select("row_id", T.portable_path(c, "/mnt/store/ocr").alias("path"), T.resolved_path(c, "/mnt/store/ocr").alias("resolved"))


@query("SELECT regexp_extract(replace(crop_path, '\\', '/'), '([^/]+)$', 1) AS file_name, min(replace(crop_path, '\\', '/')) AS path FROM crop_manifest WHERE lower(crop_path) SIMILAR TO '.*\\.(jpg|jpeg|png)' GROUP BY 1")
def image_index_first(spark: SparkSession, d: str) -> DataFrame:
    return files.picture_index(table(spark, d, "crop_manifest"), "crop_path")


# ---- annotation quality


def _ann(spark: SparkSession, d: str) -> DataFrame:
    return A.annotations(spark, d)


def _img(spark: SparkSession, d: str) -> DataFrame:
    return A.images(spark, d)


@query(f"WITH {A.SQL} SELECT image_id, split, n, fields, cards, round(least_area + 1e-7, 4) AS least_area FROM per")
def annotation_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(quality.per_image(_img(spark, d), _ann(spark, d)).withColumn("least_area", F.col("least_area") + 1e-7), 4)


@query(f"WITH {A.SQL} SELECT a.image_id, a.seq, a.class, i.split, i.file_name FROM annotations a JOIN images0 i ON i.image_id = a.image_id")
def annotation_enrich(spark: SparkSession, d: str) -> DataFrame:
    names = list(A.CLASS_OF.values())
    cats = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    a = _ann(spark, d).withColumn("category_id", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("class")).cast("int") - 1).drop("class")
    return quality.enrich(a, _img(spark, d), cats).select("image_id", "seq", "class", "split", "file_name")


_IOU = """
    pairs AS (
      SELECT a.image_id, a.class, a.seq AS seq_a, b.seq AS seq_b,
             greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s
      FROM annotations a JOIN annotations b ON a.image_id = b.image_id AND a.class = b.class AND a.seq < b.seq),
    over0 AS (SELECT image_id, class, seq_a, seq_b, i / (s - i) AS iou FROM pairs WHERE i > 0 AND i / (s - i) > 0.6)
"""


@query(f"WITH {A.SQL}, {_IOU} SELECT image_id, class, seq_a, seq_b, round(iou, 6) AS iou FROM over0")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(quality.overlaps(_ann(spark, d), 0.6))


_ISSUES = f"""
    {A.SQL}, {_IOU},
    boxes AS (SELECT i.split, a.*, a.w * a.h AS area FROM annotations a JOIN images0 i ON i.image_id = a.image_id),
    issues AS (
      SELECT split, image_id, 'no_annotation' AS kind, NULL AS class, NULL::DOUBLE AS detail, 'warning' AS severity FROM per WHERE n = 0 UNION ALL
      SELECT split, image_id, 'missing_card_class', NULL, NULL, 'warning' FROM per WHERE cards = 0 UNION ALL
      SELECT split, image_id, 'few_fields', NULL, fields, 'warning' FROM per WHERE cards > 0 AND fields < 4 UNION ALL
      SELECT split, image_id, 'bbox_too_small', class, area, 'error' FROM boxes WHERE area < 100 UNION ALL
      SELECT split, image_id, 'bbox_too_large', class, area / 409600 * 100, 'error' FROM boxes WHERE area > 409600 * 0.95 UNION ALL
      SELECT split, image_id, 'bbox_out_of_bounds', class, NULL, 'error' FROM boxes WHERE x < 0 OR y < 0 OR x + w > 640 OR y + h > 640 UNION ALL
      SELECT i.split, o.image_id, 'high_overlap', class, iou, 'warning' FROM over0 o JOIN images0 i ON i.image_id = o.image_id)
"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.issues(_img(spark, d), _ann(spark, d), least_iou=0.6)


@query(f"WITH {_ISSUES} SELECT split, image_id, kind, class, round(detail, 4) AS detail, severity FROM issues")
def annotation_issues(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(_issues(spark, d), 4)


@query(f"WITH {_ISSUES} SELECT kind, count(*) AS n, count(DISTINCT image_id) AS images FROM issues GROUP BY kind")
def issue_histogram(spark: SparkSession, d: str) -> DataFrame:
    return quality.issue_counts(_issues(spark, d))


@query(f"WITH {_ISSUES} SELECT split, image_id, min(severity) AS severity, count(*) AS n FROM issues GROUP BY split, image_id")
def flagged_images(spark: SparkSession, d: str) -> DataFrame:
    return quality.flagged(_issues(spark, d)).select("split", "image_id", "severity", F.size("issues").cast("long").alias("n"))


@query(f"""
    WITH {_ISSUES}, f AS (SELECT image_id, min(severity) AS s FROM issues GROUP BY image_id)
    SELECT (SELECT count(*) FROM images0) AS images, count(*) AS flagged, count(*) FILTER (s = 'error') AS errors, round(count(*) / (SELECT count(*) FROM images0), 6) AS share,
           count(*) / (SELECT count(*) FROM images0) < 0.05 AS passes, (SELECT min(n) >= 100 FROM (SELECT count(*) AS n FROM annotations GROUP BY class)) AS classes_ok FROM f
""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(quality.gate(_img(spark, d), _issues(spark, d), _ann(spark, d)))


@query(f"WITH {A.SQL} SELECT class, count(*) AS n FROM annotations GROUP BY class")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return quality.counts(_ann(spark, d), "class")


@query(f"WITH {A.SQL} SELECT image_id, seq, round(w, 6) AS w, round(h, 6) AS h FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, seq) AS r FROM annotations WHERE class = 'card') WHERE r = 1")
def largest_box(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(quality.largest(_ann(spark, d)).select("image_id", "seq", "w", "h"))


@query(f"WITH {A.SQL}, s AS (SELECT DISTINCT image_id, class FROM annotations) SELECT a.class AS class_a, b.class AS class_b, count(*) AS n FROM s a JOIN s b ON a.image_id = b.image_id GROUP BY 1, 2")
def class_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return quality.cooccurrence(_ann(spark, d))


@query(f"""
    WITH {A.SQL} SELECT class, count(*) AS n, round(avg(w * h), 4) AS mean_area, round(stddev_pop(w * h), 4) AS std_area, round(avg(w), 4) AS mean_w, round(avg(h), 4) AS mean_h,
           round(avg(x + w / 2), 4) AS mean_cx, round(avg(y + h / 2), 4) AS mean_cy FROM annotations GROUP BY class
""")
def bbox_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(quality.box_statistics(_ann(spark, d)), 4)


@query("""
    SELECT round(avg(width), 6) AS width_mean, round(stddev_pop(width), 6) AS width_std, min(width) AS width_min, max(width) AS width_max, round(avg(height), 6) AS height_mean, round(stddev_pop(height), 6) AS height_std,
           min(height) AS height_min, max(height) AS height_max, round(avg(width / height), 6) AS aspect_mean, round(stddev_pop(width / height), 6) AS aspect_std, round(min(width / height), 6) AS aspect_min, round(max(width / height), 6) AS aspect_max FROM images
""")
def image_size_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(quality.size_statistics(table(spark, d, "images")))


@query(f"WITH {A.SQL} SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS least, max(n) AS most, count(*) FILTER (n = 0) AS empty FROM per")
def annotations_per_image(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(quality.boxes_a_picture(quality.per_image(_img(spark, d), _ann(spark, d))))


@query("""
    WITH b AS (SELECT o_orderkey AS image_id, ((o_orderkey * 7) % 256)::DOUBLE AS mean FROM orders WHERE o_orderkey % 5 <> 0),
    s AS (SELECT *, row_number() OVER (ORDER BY image_id) - 1 AS n FROM b)
    SELECT count(*) AS n, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS std FROM s WHERE n % 5 = 0
""")
def systematic_sample_stats(spark: SparkSession, d: str) -> DataFrame:
    s = quality.systematic(A.brightness(spark, d), "image_id", 5)
    return A.rounded(s.agg(F.count("*").alias("n"), F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std")))


@query("SELECT least(39, floor((best_conf - 0) / (1.0::DOUBLE / 40)))::INT AS bin, count(*) AS n FROM reviewed_sample WHERE best_conf BETWEEN 0 AND 1 GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return quality.histogram(_sample(spark, d), "best_conf", 0.0, 1.0, 40)


@query(f"WITH {A.SQL} SELECT split, count(*) AS images, sum(n)::BIGINT AS boxes, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM per GROUP BY split")
def split_report(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(quality.split_shares(quality.per_image(_img(spark, d), _ann(spark, d))))


@query("SELECT coalesce(split, 'missing') AS split, count(*) AS n FROM images GROUP BY 1")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.counts(table(spark, d, "images"), "split")


_DIFF = f"""
    {A.SQL}, b AS (SELECT o_orderkey AS image_id, ((o_orderkey * 7) % 256)::DOUBLE AS mean FROM orders WHERE o_orderkey % 5 <> 0),
    f AS (SELECT p.image_id, 1.0::DOUBLE / greatest(fields, 1) AS f1, 1.0::DOUBLE / greatest(coalesce(least_area, 1), 1) AS f2, coalesce(abs(mean - 140) / 140, 0.5) AS f3 FROM per p LEFT JOIN b ON b.image_id = p.image_id),
    e AS (SELECT min(f1) AS a1, max(f1) AS b1, min(f2) AS a2, max(f2) AS b2, min(f3) AS a3, max(f3) AS b3 FROM f),
    diff AS (SELECT image_id, (f1 - a1) / (b1 - a1) * 0.5 + (f2 - a2) / (b2 - a2) * 0.3 + (f3 - a3) / (b3 - a3) * 0.2 AS difficulty FROM f, e)
"""


@query(f"WITH {_DIFF} SELECT image_id, round(difficulty, 6) AS difficulty FROM diff")
def difficulty_score(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(quality.difficulty(_img(spark, d), _ann(spark, d), A.brightness(spark, d)))


@query(f"""
    WITH {_DIFF}, c AS (SELECT o_orderkey // 3 AS cluster_id, round(avg(coalesce(difficulty, 0.5)), 9) AS difficulty FROM orders LEFT JOIN diff ON diff.image_id = o_orderkey GROUP BY 1),
    r AS (SELECT cluster_id, (row_number() OVER (ORDER BY difficulty, cluster_id) - 1) % 20 AS k FROM c)
    SELECT cluster_id, CASE WHEN k < 14 THEN 'train' WHEN k < 17 THEN 'val' ELSE 'test' END AS split FROM r
""")
def cluster_split(spark: SparkSession, d: str) -> DataFrame:
    clusters = _img(spark, d).select(F.floor(F.col("image_id") / 3).alias("cluster_id"), "image_id")
    return quality.stratified_split(clusters, quality.difficulty(_img(spark, d), _ann(spark, d), A.brightness(spark, d))).select("cluster_id", "split")


# ---- data sets


@query("""
    WITH i AS (SELECT DISTINCT image_id, split FROM images), t AS (SELECT split, max(image_id) + 1 AS span FROM i GROUP BY split),
    o AS (SELECT split, coalesce(sum(span) OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'valid' THEN 3 ELSE 4 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM t WHERE split IS NOT NULL)
    SELECT i.split, i.image_id, (i.image_id + o.offs)::BIGINT AS new_id FROM i JOIN o ON o.split = i.split
""")
def union_rekey(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "images").select(F.col("image_id").alias("id"), "split").distinct()
    return files.union_rekeyed(i, ["train", "val", "valid", "test"]).select("split", F.col("id").alias("image_id"), "new_id")


@query(f"""
    WITH {A.SQL}, k AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS new_image FROM images0 WHERE split = 'val'),
    a AS (SELECT a.image_id * 100 + seq AS old_id, new_image FROM annotations a JOIN k ON k.image_id = a.image_id)
    SELECT old_id, new_image AS image_id, row_number() OVER (ORDER BY old_id) - 1 AS id FROM a
""")
def coco_reindex(spark: SparkSession, d: str) -> DataFrame:
    images = _img(spark, d).withColumnRenamed("image_id", "id")
    anns = _ann(spark, d).select((F.col("image_id") * 100 + F.col("seq")).alias("id"), "image_id").withColumn("old_id", F.col("id"))
    keep = images.filter("split = 'val'").select(F.col("id").alias("image_id"))
    return files.reindex(images, anns, keep)[1].select("old_id", "image_id", "id")


@query(f"""
    WITH {A.SQL},
    l AS (SELECT a.*, list_position(['id', 'name', 'birth', 'origin', 'address'], class) - 1 AS k FROM annotations a WHERE class IN ('id', 'name', 'birth', 'origin', 'address')),
    q AS (SELECT image_id, seq, k, greatest(0, least(1, (x + w / 2) / 640)) + 1e-10::DOUBLE AS cx, greatest(0, least(1, (y + h / 2) / 640)) + 1e-10::DOUBLE AS cy, greatest(0, least(1, w / 640)) + 1e-10::DOUBLE AS bw, greatest(0, least(1, h / 640)) + 1e-10::DOUBLE AS bh FROM l),
    t AS (SELECT image_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', k, cx, cy, bw, bh), chr(10) ORDER BY seq) AS label FROM q GROUP BY image_id)
    SELECT i.image_id, coalesce(t.label, '') AS label FROM images0 i LEFT JOIN t ON t.image_id = i.image_id
""")
def yolo_labels(spark: SparkSession, d: str) -> DataFrame:
    return files.yolo_labels(_img(spark, d), _ann(spark, d), ["id", "name", "birth", "origin", "address"])


@query(f"WITH {A.SQL} SELECT image_id, seq, round(greatest(0, least(1, (x + w / 2) / 640)) + 1e-8, 6) AS cx, round(greatest(0, least(1, (y + h / 2) / 640)) + 1e-8, 6) AS cy, round(greatest(0, least(1, w / 640)) + 1e-8, 6) AS w, round(greatest(0, least(1, h / 640)) + 1e-8, 6) AS h FROM annotations")
def yolo_boxes(spark: SparkSession, d: str) -> DataFrame:
    y = G.yolo(*[F.col(c) for c in "xywh"], F.lit(640), F.lit(640))
    return A.rounded(_ann(spark, d).withColumn("q", y).select("image_id", "seq", *[(F.col(f"q.{c}") + 1e-8).alias(c) for c in ("cx", "cy", "w", "h")]))


@query(f"WITH {A.SQL} SELECT split, count(*) AS n_images, count(*) FILTER (n > 0) AS n_labels, count(*) = count(*) FILTER (n > 0) AS ok FROM per GROUP BY split")
def yolo_verify(spark: SparkSession, d: str) -> DataFrame:
    return files.yolo_verify(_img(spark, d), quality.per_image(_img(spark, d), _ann(spark, d)).filter("n > 0"))


def _clamped(x1: str, y1: str, x2: str, y2: str, w: str, h: str, least: int) -> dict[str, str]:
    """SQL of a box within a picture, by side."""
    lo = lambda a, n: f"greatest(0, least({a}, {n} - 1))"
    hi = lambda a, z, n: f"CASE WHEN greatest({least}, least({z}, {n})) <= {lo(a, n)} THEN least({n}, {lo(a, n)} + 1) ELSE greatest({least}, least({z}, {n})) END"
    return {"x1": lo(x1, w), "y1": lo(y1, h), "x2": hi(x1, x2, w), "y2": hi(y1, y2, h)}


def _padded(p: str, ratio: float, least: int | None) -> dict[str, str]:
    """SQL of the box {p}x1 and so on grown by a share of its sides in a picture of 640 x 640."""
    grow = (lambda a, z: f"greatest({least}, ({z} - {a}) * {ratio}::DOUBLE)") if least else (lambda a, z: f"greatest(1, {z} - {a}) * {ratio}::DOUBLE")
    dx, dy = grow(f"{p}x1", f"{p}x2"), grow(f"{p}y1", f"{p}y2")
    return _clamped(f"{p}x1 - {dx}", f"{p}y1 - {dy}", f"{p}x2 + {dx}", f"{p}y2 + {dy}", "640", "640", 1)


def _named(sides: dict[str, str], prefix: str) -> str:
    return ", ".join(f"({v})::DOUBLE AS {prefix}{k}" for k, v in sides.items())


_CARDS = f"""
    {A.SQL},
    lc AS (SELECT image_id, arg_max({{'x': x, 'y': y, 'w': w, 'h': h}}, {{'a': w * h, 's': -seq}}) AS b FROM annotations WHERE class = 'card' GROUP BY image_id),
    cb AS (SELECT image_id, b.x::DOUBLE AS x1, b.y::DOUBLE AS y1, (b.x + b.w)::DOUBLE AS x2, (b.y + b.h)::DOUBLE AS y2 FROM lc),
    cp AS (SELECT i.image_id, i.split, i.file_name, cb.image_id IS NOT NULL AS has, {_named(_padded('cb.', 0.05, 1), 'c')} FROM images0 i LEFT JOIN cb ON cb.image_id = i.image_id),
    rm AS (SELECT *, 855 / (cx2 - cx1) AS sx, 539 / (cy2 - cy1) AS sy FROM cp)
"""


@query(f"""
    WITH {_CARDS},
    s0 AS (SELECT image_id, seq, class, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM annotations WHERE class IN ('id', 'name', 'birth', 'origin', 'address')),
    s AS (SELECT image_id, seq, class, {_named(_padded('', 0.04, None), 's')} FROM s0),
    j AS (SELECT s.*, rm.split, rm.file_name, rm.has, (sx1 - cx1) * sx AS px1, (sy1 - cy1) * sy AS py1, (sx2 - cx1) * sx AS px2, (sy2 - cy1) * sy AS py2 FROM s JOIN rm ON rm.image_id = s.image_id WHERE s.image_id % 7 <> 0),
    m AS (SELECT *, {_named(_clamped('px1', 'py1', 'px2', 'py2', '856', '540', 0), 'm')} FROM j),
    k AS (SELECT * EXCLUDE (mx1, my1, mx2, my2), CASE WHEN has THEN mx1 ELSE sx1 END AS mx1, CASE WHEN has THEN my1 ELSE sy1 END AS my1, CASE WHEN has THEN mx2 ELSE sx2 END AS mx2, CASE WHEN has THEN my2 ELSE sy2 END AS my2 FROM m)
    SELECT 'crops/' || class || '/' || regexp_replace(file_name, '\\.[^./]*$', '') || '_' || (image_id * 100 + seq) || '.jpg' AS crop_path, 'pictures/' || file_name AS image_path, class AS field_name, image_id, image_id AS source_image_id,
           round(mx1::FLOAT::DOUBLE + 1e-7, 2) AS x1, round(my1::FLOAT::DOUBLE + 1e-7, 2) AS y1, round(mx2::FLOAT::DOUBLE + 1e-7, 2) AS x2, round(my2::FLOAT::DOUBLE + 1e-7, 2) AS y2, round(sx1::FLOAT::DOUBLE + 1e-7, 2) AS source_x1, round(sy2::FLOAT::DOUBLE + 1e-7, 2) AS source_y2,
           split, image_id * 100 + seq AS annotation_id, CASE WHEN has THEN 'bbox_crop' ELSE 'none' END AS rectification_method
    FROM k WHERE round_even(mx2 - mx1, 0) >= 12 AND round_even(my2 - my1, 0) >= 12
""")
def crop_manifest(spark: SparkSession, d: str) -> DataFrame:
    i = _img(spark, d)
    index = i.filter("image_id % 7 <> 0").select("file_name", F.concat(F.lit("./pictures//"), "file_name").alias("path"))  # some pictures are missing
    a = _ann(spark, d).withColumn("id", F.col("image_id") * 100 + F.col("seq"))
    m = cards.manifest(i, a, index, ["id", "name", "birth", "origin", "address"])
    at = lambda c, k, name: (F.get(c, F.lit(k)).cast("double") + 1e-7).alias(name)
    sides = [at("bbox", k, n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return A.rounded(m.select("crop_path", "image_path", "field_name", "image_id", "source_image_id", *sides, at("source_bbox", 0, "source_x1"), at("source_bbox", 3, "source_y2"), "split", "annotation_id", "rectification_method"), 2)


@query(f"""
    WITH {_CARDS}
    SELECT image_id, CASE WHEN has THEN 'bbox_crop' ELSE 'none' END AS method, CASE WHEN has THEN 'degraded' END AS grade, (CASE WHEN has THEN 0.4 ELSE 0 END)::DOUBLE AS confidence, has AS fallback,
           round(CASE WHEN has THEN cx1 END + 7e-7, 4) AS x1, round(CASE WHEN has THEN cy2 END + 7e-7, 4) AS y2, round(CASE WHEN has THEN sx END + 7e-9, 6) AS m0, round(CASE WHEN has THEN -cx1 * sx END + 7e-7, 4) AS m2, round(CASE WHEN has THEN sy END + 7e-9, 6) AS m4, round(CASE WHEN has THEN -cy1 * sy END + 7e-7, 4) AS m5
    FROM rm
""")
def rectify_meta(spark: SparkSession, d: str) -> DataFrame:
    card = quality.largest(_ann(spark, d)).select("image_id", G.from_xywh(*[F.col(c) for c in "xywh"]).alias("card"))
    r, m = F.col("rectification"), lambda k: F.get("rectification.matrix", F.lit(k))
    p = cards.prepared(_img(spark, d).join(card, "image_id", "left"), ratio=0.05)
    return A.rounded(p.select(
        "image_id", r.method.alias("method"), r.grade.alias("grade"), r.confidence.alias("confidence"), r.fallback.alias("fallback"), F.round(r.box.x1 + 7e-7, 4).alias("x1"), F.round(r.box.y2 + 7e-7, 4).alias("y2"),
        (m(0) + 7e-9).alias("m0"), F.round(m(2) + 7e-7, 4).alias("m2"), (m(4) + 7e-9).alias("m4"), F.round(m(5) + 7e-7, 4).alias("m5"),
    ))


@query(f"WITH {A.SQL} SELECT 'image' AS kind, i.image_id, file_name AS name, width::DOUBLE AS x FROM images0 i WHERE split = 'val' UNION ALL SELECT 'annotation', a.image_id, class, round(a.x, 4) FROM annotations a JOIN images0 i ON i.image_id = a.image_id WHERE split = 'val'")
def coco_explode(spark: SparkSession, d: str) -> DataFrame:
    """Written as an annotation document, found, read and made flat again."""
    import uuid

    names = [*A.CLASS_OF.values(), "?"]
    root = f"{shared_dir(spark)}/fieldloom/coco-{uuid.uuid4().hex}"
    images = _img(spark, d).filter("split = 'val'").select(F.col("image_id").alias("id"), "file_name", "width", "height")
    a = _ann(spark, d).join(images.select(F.col("id").alias("image_id")), "image_id").select(
        (F.col("image_id") * 100 + F.col("seq")).alias("id"), "image_id", (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("class")) - 1).cast("int").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox")
    )
    files.write_coco(images, a, spark.createDataFrame(list(enumerate(names)), "id int, name string"), f"{root}/val.json", description="round trip", version="1")
    t = files.read_coco(spark, files.find_documents(spark, root))
    i = t["images"].select("id", F.regexp_extract("file_name", r"(\d+)", 1).cast("long").alias("image_id"), "file_name", "width")
    cats = F.broadcast(t["categories"].select(F.col("id").alias("category_id"), "name"))
    boxes = t["annotations"].join(i.select(F.col("id").alias("link"), F.col("image_id").alias("own")), F.col("image_id") == F.col("link")).join(cats, "category_id")
    return A.rounded(i.select(F.lit("image").alias("kind"), "image_id", F.col("file_name").alias("name"), F.col("width").cast("double").alias("x")).unionByName(
        boxes.select(F.lit("annotation").alias("kind"), F.col("own").alias("image_id"), "name", F.get("bbox", F.lit(0)).alias("x"))), 4)


_RATES = f"""
    WITH {A.READINGS_SQL} SELECT engine, CASE WHEN grouping(field_name) = 1 THEN 'overall' ELSE 'per_field' END AS scope, CASE WHEN grouping(field_name) = 1 THEN '*' ELSE field_name END AS field_name,
           count(*) AS count, round(avg(cer), 6) AS cer, round(avg(exact), 6) AS exact_match_rate FROM scored GROUP BY GROUPING SETS ((engine), (engine, field_name))
"""


@query(_RATES)
def summary_json(spark: SparkSession, d: str) -> DataFrame:
    """Rates written as a nested document and read again."""
    import uuid

    path = f"{shared_dir(spark)}/fieldloom/summary-{uuid.uuid4().hex}"
    files.write_json(spark, files.summary_document(evaluate.summary(_scored(spark, d))), path)
    rates = "struct<count: bigint, cer: double, exact_match_rate: double>"
    kept = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, struct<overall: {rates}, per_field: map<string, {rates}>>>")).alias("engine", "v"))
    every = F.map_concat(F.create_map(F.lit("*"), F.col("v.overall")), F.col("v.per_field"))
    out = kept.select("engine", F.explode(every).alias("field_name", "r"))
    return A.rounded(out.select("engine", F.when(F.col("field_name") == "*", "overall").otherwise("per_field").alias("scope"), "field_name", "r.*"))


@query(_RATES)
def summary_csv(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/fieldloom/csv-{uuid.uuid4().hex}"
    files.write_summary_csv(evaluate.summary(_scored(spark, d)), path)
    kept = spark.read.option("header", "true").schema("engine string, scope string, field_name string, count long, cer double, wer double, exact_match_rate double").csv(path)
    return A.rounded(kept.drop("wer"))


# ---- duplicates

_NAMES = r"""
    c AS (SELECT regexp_replace(file_name, '_(jpg|jpeg|png|JPG|JPEG|PNG)\.rf\.[A-Za-z0-9]+\.(jpg|jpeg|png)$', '') AS base_name, count(*) AS size, count(DISTINCT split) AS splits, min(image_id) AS first FROM images GROUP BY 1)
"""


@query(f"WITH {_NAMES} SELECT * FROM c")
def basename_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dedup.name_clusters(table(spark, d, "images"))


@query(f"WITH {_NAMES} SELECT base_name, splits FROM c WHERE splits > 1")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    return dedup.leaking(dedup.name_clusters(table(spark, d, "images"))).select("base_name", "splits")


@query(f"WITH {_NAMES} SELECT size, count(*) AS clusters, sum(size)::BIGINT AS images FROM c GROUP BY size")
def cluster_size_hist(spark: SparkSession, d: str) -> DataFrame:
    return dedup.size_histogram(dedup.name_clusters(table(spark, d, "images")))


@query(f"WITH {_NAMES} SELECT base_name, row_number() OVER (ORDER BY size DESC, first, base_name) - 1 AS cluster_id FROM c")
def cluster_ids(spark: SparkSession, d: str) -> DataFrame:
    return dedup.numbered(dedup.name_clusters(table(spark, d, "images"))).select("base_name", "cluster_id")


_HASH = """
    g AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT id, e, (list_sort(e)[32] + list_sort(e)[33]) / 2 AS mid FROM g),
    b AS (SELECT id, array_to_string(list_transform(e, lambda v: CASE WHEN v > mid THEN '1' ELSE '0' END), '') AS bits FROM m)
"""


@query(f"WITH {_HASH} SELECT id, bits FROM b")
def bit_hash(spark: SparkSession, d: str) -> DataFrame:
    return A.grids(spark, d).select("id", F.lpad(F.bin(X.grid_hash(F.col("grid"))), 64, "0").alias("bits"))


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(A.grids(spark, d).select("id", X.grid_hash(F.col("grid")).alias("hash")), "hashes")


_PAIRS = f"""{_HASH}, g0 AS (SELECT bits, min(id) AS id FROM b GROUP BY bits),
    p AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, hamming(a.bits, b.bits) AS distance FROM g0 a JOIN g0 b ON a.bits < b.bits WHERE hamming(a.bits, b.bits) <= 20
      UNION ALL SELECT g0.id, b.id, 0 FROM b JOIN g0 ON g0.bits = b.bits AND g0.id <> b.id)"""


@query(f"WITH {_PAIRS} SELECT a, b, distance FROM p")
def phash_pairs(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    return dedup.key_pairs(h, dedup.similar_hashes(h, 20))


@query(f"""
    WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r AS (SELECT a AS v, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
    SELECT v AS vertex, min(c) AS component FROM r GROUP BY v
""")
def phash_components(spark: SparkSession, d: str) -> DataFrame:
    return dedup.clusters(_hashes(spark, d), 20)


# ---- geometry over crop boxes


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """annotation_id, b: boxes of the manifest as doubles; one row for each distinct crop box."""
    m = table(spark, d, "crop_manifest")
    return m.select("annotation_id", G.from_array(F.transform("bbox", lambda v: F.round(v.cast("double"), 3))).alias("b")).filter("b is not null").distinct()


_BOXES = "bx AS (SELECT DISTINCT annotation_id, round(bbox[1]::DOUBLE, 3) AS x1, round(bbox[2]::DOUBLE, 3) AS y1, round(bbox[3]::DOUBLE, 3) AS x2, round(bbox[4]::DOUBLE, 3) AS y2 FROM crop_manifest WHERE bbox IS NOT NULL AND len(bbox) = 4)"


def _clamp_sql(x1: str, y1: str, x2: str, y2: str, w: int, h: int, least: float) -> str:
    side = lambda a, z, n: (f"greatest(0, least({a}, {n - 1}))", f"CASE WHEN greatest({least}, least({z}, {n})) <= greatest(0, least({a}, {n - 1})) THEN least({n}, greatest(0, least({a}, {n - 1})) + 1) ELSE greatest({least}, least({z}, {n})) END")
    (a, c), (b, e) = side(x1, x2, w), side(y1, y2, h)
    return ", ".join(f"round(({v})::DOUBLE + 1e-7, 4) AS {n}" for v, n in ((a, "x1"), (b, "y1"), (c, "x2"), (e, "y2")))


def _box_query(name: str, sql_cols: str, make):
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = _boxes(spark, d).withColumn("r", make(F.col("b")))
        return A.rounded(r.select("annotation_id", *[(F.col(f"r.{c}") + 1e-7).alias(c) for c in ("x1", "y1", "x2", "y2")]), 4)

    run.__name__ = name
    query(f"WITH {_BOXES} SELECT annotation_id, {sql_cols} FROM bx")(run)


_box_query("box_clamp", _clamp_sql("x1 - 200", "y1 - 200", "x2 - 200", "y2 - 200", 200, 150, 0), lambda b: G.clamp(G.box(b.x1 - 200, b.y1 - 200, b.x2 - 200, b.y2 - 200), F.lit(200), F.lit(150)))
_box_query("box_clamp_min1", _clamp_sql("x1 - 200", "y1 - 200", "x2 - 200", "y2 - 200", 200, 150, 1), lambda b: G.clamp(G.box(b.x1 - 200, b.y1 - 200, b.x2 - 200, b.y2 - 200), F.lit(200), F.lit(150), 1.0))
_P = "greatest(1, x2 - x1) * 0.1", "greatest(1, y2 - y1) * 0.1"
_box_query("box_pad", _clamp_sql(f"x1 - {_P[0]}", f"y1 - {_P[1]}", f"x2 + {_P[0]}", f"y2 + {_P[1]}", 640, 640, 1), lambda b: G.pad(b, F.lit(640), F.lit(640), 0.1))
_M = "greatest(1, (x2 - x1) * 0.05)", "greatest(1, (y2 - y1) * 0.05)"
_box_query("box_pad_min", _clamp_sql(f"x1 - {_M[0]}", f"y1 - {_M[1]}", f"x2 + {_M[0]}", f"y2 + {_M[1]}", 640, 640, 1), lambda b: G.pad(b, F.lit(640), F.lit(640), 0.05, 1.0))
_E = "greatest(4, greatest(1, x2 - x1) * 0.08)", "greatest(4, greatest(1, y2 - y1) * 0.30)"
_box_query("expand_box", _clamp_sql(f"x1 - {_E[0]}", f"y1 - {_E[1]}", f"x2 + {_E[0]}", f"y2 + {_E[1]}", 640, 640, 0), lambda b: G.expand(b, F.lit(640), F.lit(640), F.lit(True)))
_SX, _SY = "(855.0::DOUBLE / 600)", "(539.0::DOUBLE / 500)"
_box_query("box_project", _clamp_sql(f"(x1 - 20) * {_SX}", f"(y1 - 30) * {_SY}", f"(x2 - 20) * {_SX}", f"(y2 - 30) * {_SY}", 856, 540, 0), lambda b: G.to_card(b, G.box(F.lit(20), F.lit(30), F.lit(620), F.lit(530))))


@query(f"WITH {_BOXES} SELECT annotation_id, greatest(0, round_even(x1, 0))::INT AS x1, greatest(0, round_even(y1, 0))::INT AS y1, greatest(greatest(0, round_even(x1, 0)) + 1, round_even(x2, 0))::INT AS x2, greatest(greatest(0, round_even(y1, 0)) + 1, round_even(y2, 0))::INT AS y2 FROM bx")
def crop_window(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).withColumn("r", G.pixel_window(F.col("b"))).select("annotation_id", "r.*")


@query(f"WITH {_BOXES} SELECT annotation_id, round(x2 - x1, 4) AS w, round(y2 - y1, 4) AS h, round((x2 - x1) * (y2 - y1), 3) AS area FROM bx")
def box_area(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    return _boxes(spark, d).select("annotation_id", (F.round(b.x2 - b.x1, 4) + 0.0).alias("w"), (F.round(b.y2 - b.y1, 4) + 0.0).alias("h"), (F.round(G.area_xywh(b.x2 - b.x1, b.y2 - b.y1), 3) + 0.0).alias("area"))


@query(f"WITH {_BOXES}, p AS (SELECT annotation_id, unnest([{{'i': 0, 'x': x1, 'y': y1}}, {{'i': 1, 'x': x2, 'y': y1}}, {{'i': 2, 'x': x2, 'y': y2}}, {{'i': 3, 'x': x1, 'y': y2}}]) AS p FROM bx) SELECT annotation_id, p.i AS i, p.x AS x, p.y AS y FROM p")
def box_corners(spark: SparkSession, d: str) -> DataFrame:
    shuffled = F.transform(G.corners(F.col("b")), lambda p: p)
    order = G.order_points(F.array(shuffled[2], shuffled[0], shuffled[3], shuffled[1]))
    return _boxes(spark, d).select("annotation_id", F.posexplode(order).alias("i", "p")).select("annotation_id", "i", "p.x", "p.y")


@query(f"""
    WITH {_BOXES}, o AS (SELECT *, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM bx WINDOW w AS (PARTITION BY annotation_id // 10 ORDER BY y1, x1, annotation_id))
    SELECT annotation_id, round(y1 - py2, 4) AS gap, round(greatest(0, least(px2, x2) - greatest(px1, x1)) / least(greatest(1, px2 - px1), greatest(1, x2 - x1)), 4) AS overlap,
           y1 - py2 <= greatest(18, 1.2::DOUBLE * greatest(greatest(1, py2 - py1), greatest(1, y2 - y1))) AND (greatest(0, least(px2, x2) - greatest(px1, x1)) / least(greatest(1, px2 - px1), greatest(1, x2 - x1)) >= 0.1
             OR abs(px1 - x1) <= greatest(greatest(1, px2 - px1), greatest(1, x2 - x1)) * 0.4::DOUBLE) AS merges
    FROM o WHERE px1 IS NOT NULL
""")
def box_merge(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.floor(F.col("annotation_id") / 10)).orderBy("b.y1", "b.x1", "annotation_id")
    p = _boxes(spark, d).withColumn("p", F.lag("b").over(w)).filter("p is not null")
    a, b = F.col("p"), F.col("b")
    return A.rounded(p.select("annotation_id", G.vertical_gap(a, b).alias("gap"), G.overlap_share(a, b).alias("overlap"), G.can_merge(a, b).alias("merges")), 4)


@query(f"""
    WITH {A.SQL}, l AS (SELECT image_id, seq, greatest(0, trunc(x)::INT - 4) AS x1, greatest(0, trunc(y)::INT - 4) AS y1, least(640, trunc(x + w)::INT + 4) AS x2, least(640, trunc(y + h)::INT + 4) AS y2 FROM annotations)
    SELECT image_id, seq, x1, y1, x2, y2 FROM l WHERE x2 - x1 >= 10 AND y2 - y1 >= 10
""")
def legacy_crop_box(spark: SparkSession, d: str) -> DataFrame:
    win = G.legacy_window(*[F.col(c) for c in "xywh"], F.lit(640), F.lit(640))
    return _ann(spark, d).withColumn("r", win).filter("r is not null").select("image_id", "seq", "r.*")


@query("""
    WITH c AS (SELECT annotation_id, field_name, round_even(bbox[3] - bbox[1], 0)::INT + 1 AS w, round_even(bbox[4] - bbox[2], 0)::INT + 1 AS h FROM (SELECT DISTINCT annotation_id, field_name, list_transform(bbox, lambda v: round(v::DOUBLE, 3)) AS bbox FROM crop_manifest WHERE bbox IS NOT NULL)),
    p AS (SELECT *, greatest(6, round_even(w * 0.08::DOUBLE, 0)::INT) AS px, greatest(6, round_even(h * 0.12::DOUBLE, 0)::INT) AS py FROM c)
    SELECT annotation_id, px AS pad_x, py AS pad_y, round(greatest(1.0::DOUBLE, CASE WHEN field_name IN ('id', 'birth') THEN 96.0 ELSE 128.0 END / greatest(1, h + 2 * py)), 6) AS scale FROM p
""")
def ocr_prep_dims(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "crop_manifest").filter("bbox is not null").select("annotation_id", "field_name", F.transform("bbox", lambda v: F.round(v.cast("double"), 3)).alias("bbox")).distinct()
    side = lambda a, b: F.bround(F.get("bbox", F.lit(b)) - F.get("bbox", F.lit(a))).cast("int") + 1
    least = F.when(F.col("field_name").isin("id", "birth"), 96.0).otherwise(128.0)
    return A.rounded(m.select("annotation_id", G.reading_size(side(0, 2), side(1, 3), 0.08, 0.12, 6, least).alias("r")).select("annotation_id", "r.pad_x", "r.pad_y", "r.scale"))


@query("""
    WITH c AS (SELECT DISTINCT annotation_id, CASE field_name WHEN 'id' THEN 'id_number' WHEN 'name' THEN 'full_name' WHEN 'birth' THEN 'date_of_birth' WHEN 'origin' THEN 'place_of_origin' WHEN 'address' THEN 'place_of_residence' ELSE field_name END AS f,
             round_even(round(bbox[3]::DOUBLE, 3) - round(bbox[1]::DOUBLE, 3), 0)::INT + 1 AS w, round_even(round(bbox[4]::DOUBLE, 3) - round(bbox[2]::DOUBLE, 3), 0)::INT + 1 AS h FROM crop_manifest WHERE bbox IS NOT NULL),
    v AS (
      SELECT annotation_id, 'base' AS name, w, h, 0.0::DOUBLE AS t, 1.0::DOUBLE AS b, 0.0::DOUBLE AS l, 1.0::DOUBLE AS r FROM c UNION ALL
      SELECT annotation_id, 'center_band', w, h, CASE f WHEN 'full_name' THEN 0.16 WHEN 'place_of_origin' THEN 0.16 WHEN 'place_of_residence' THEN 0.18 ELSE 0.10 END, CASE f WHEN 'full_name' THEN 0.86 WHEN 'place_of_origin' THEN 0.84 WHEN 'place_of_residence' THEN 0.90 WHEN 'date_of_birth' THEN 0.90 ELSE 0.92 END, 0.0, 1.0
        FROM c WHERE f IN ('full_name', 'place_of_origin', 'place_of_residence', 'date_of_birth', 'id_number') UNION ALL
      SELECT annotation_id, 'left_trim', w, h, 0.0, 1.0, 0.08, 0.98 FROM c WHERE f IN ('full_name', 'place_of_origin', 'place_of_residence') AND w >= h * 2.2::DOUBLE),
    s AS (SELECT annotation_id, name, w, h, greatest(0, least(h - 1, round_even(h * t, 0)::INT)) AS y1, greatest(0, least(w - 1, round_even(w * l, 0)::INT)) AS x1, round_even(h * b, 0)::INT AS yb, round_even(w * r, 0)::INT AS xr FROM v)
    SELECT annotation_id, name, x1, y1, greatest(x1 + 1, least(w, xr)) AS x2, greatest(y1 + 1, least(h, yb)) AS y2 FROM s
""")
def tta_variants(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "crop_manifest").filter("bbox is not null")
    side = lambda a, b: F.bround(F.round(F.get("bbox", F.lit(b)).cast("double"), 3) - F.round(F.get("bbox", F.lit(a)).cast("double"), 3)).cast("int") + 1
    c = m.select("annotation_id", T.canonical_field(F.col("field_name")).alias("f"), side(0, 2).alias("w"), side(1, 3).alias("h")).distinct()
    return c.select("annotation_id", F.explode(G.test_windows(F.col("w"), F.col("h"), F.col("f"))).alias("v")).select("annotation_id", "v.name", "v.window.*")


# ---- text functions


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """row_id, f (long field name), t: the best reading."""
    return _sample(spark, d).select("row_id", T.canonical_field(F.col("class")).alias("f"), F.col("best_text").alias("t"), F.col("best_conf").alias("c"))


_F = "CASE class WHEN 'id' THEN 'id_number' WHEN 'name' THEN 'full_name' WHEN 'birth' THEN 'date_of_birth' WHEN 'origin' THEN 'place_of_origin' WHEN 'address' THEN 'place_of_residence' ELSE class END"
_COLLAPSE = r"trim(regexp_replace(coalesce(best_text, ''), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g'))"
_TEXTS = f"tx AS (SELECT row_id, {_F} AS f, best_text, {_COLLAPSE} AS t, best_conf AS c FROM reviewed_sample)"


@query(f"SELECT row_id, {_F} AS field FROM reviewed_sample")
def canonical_field(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).select("row_id", T.canonical_field(F.col("class")).alias("field"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.nfc(F.col("text")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g')) AS text FROM documents")
def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))


@query(f"WITH {_TEXTS} SELECT row_id, regexp_replace(strip_accents(replace(lower(t), 'đ', 'd')), '[^a-z0-9/: ]+', ' ', 'g') AS folded FROM tx")
def ascii_fold(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("row_id", T.fold(F.col("t")).alias("folded"))


@query(f"WITH {_TEXTS} SELECT row_id, regexp_replace(t, '[^0-9]', '', 'g') AS digits, length(regexp_replace(t, '[^0-9]', '', 'g')) = 12 AS valid FROM tx")
def digits_only(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("row_id", T.digits(F.col("t")).alias("digits"), T.valid_id(F.col("t")).alias("valid"))


_ISO = r"""
    coalesce(
      CASE WHEN regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(t, '%d/%m/%Y') END, CASE WHEN regexp_matches(t, '^\d{1,2}-\d{1,2}-\d{4}$') THEN try_strptime(t, '%d-%m-%Y') END,
      CASE WHEN regexp_matches(t, '^\d{1,2}\.\d{1,2}\.\d{4}$') THEN try_strptime(t, '%d.%m.%Y') END, CASE WHEN regexp_matches(t, '^\d{4}-\d{1,2}-\d{1,2}$') THEN try_strptime(t, '%Y-%m-%d') END,
      CASE WHEN regexp_matches(t, '^\d{8}$') THEN try_strptime(t, '%d%m%Y') END)
"""


@query(f"WITH {_TEXTS}, i AS (SELECT row_id, strftime({_ISO}, '%Y-%m-%d') AS iso FROM tx WHERE f = 'date_of_birth') SELECT row_id, iso, iso IS NOT NULL AS valid FROM i")
def normalize_date(spark: SparkSession, d: str) -> DataFrame:
    x = _texts(spark, d).filter("f = 'date_of_birth'")
    return x.select("row_id", T.iso_date(F.col("t")).alias("iso"), T.valid_date(F.col("t")).alias("valid"))


@query(f"WITH {_TEXTS} SELECT row_id, CASE f WHEN 'id_number' THEN regexp_replace(t, '[^0-9]', '', 'g') WHEN 'date_of_birth' THEN coalesce(strftime({_ISO}, '%Y-%m-%d'), t) ELSE t END AS form FROM tx")
def normalize_field(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("row_id", T.field_form(F.col("t"), F.col("f")).alias("form"))


@query(f"SELECT row_id, {picked_id("coalesce(best_text, '') || ' ' || coalesce(text_paddle, '')")} AS id, {picked_date("coalesce(best_text, '') || ' ' || coalesce(text_paddle, '')")} AS date FROM reviewed_sample")
def pick_id(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat_ws(" ", T.text(F.col("best_text")), T.text(F.col("text_paddle")))
    return _sample(spark, d).select("row_id", T.pick_id(both).alias("id"), T.pick_date(both).alias("date"))


@query(f"""
    WITH {_TEXTS} SELECT row_id, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) AS digits,
      length(t) > 0 AND length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= greatest(1, length(t) // 3) AS text_like,
      coalesce(length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')), 0) >= 0.45, false) AS digit_heavy FROM tx
""")
def char_profile(spark: SparkSession, d: str) -> DataFrame:
    x = _texts(spark, d).withColumn("t", T.collapse(F.col("t")))
    t = F.col("t")
    return x.select("row_id", T.letters(t).alias("letters"), T.digit_count(t).alias("digits"), T.text_like(t).alias("text_like"), T.digit_heavy(t).alias("digit_heavy"))


@query(f"""
    WITH {_TEXTS}, w AS (SELECT row_id, list_filter(string_split(lower(t), ' '), lambda x: x <> '') AS w FROM tx),
    p AS (SELECT row_id, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM w)
    SELECT row_id, len(w) >= 6 AND (len(list_distinct(w))::DOUBLE / greatest(len(w), 1) <= 0.65 OR len(list_distinct(b)) < len(w) - 1) AS repetitive FROM p
""")
def repetitive(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("row_id", T.repetitive(F.col("t")).alias("repetitive"))


@query("SELECT row_id, translate(coalesce(best_text, ''), 'OoBlIS', '008115') AS fixed FROM reviewed_sample")
def digit_autocorrect(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).select("row_id", ensemble.autocorrect_digits(F.col("best_text")).alias("fixed"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Readings with a printed label in front, by row."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("Họ và tên: ", "Quê quán ", "Nơi thường trú: ", "Full name ", "")]), (F.col("row_id") % 5 + 1).cast("int"))
    return _texts(spark, d).withColumn("t", F.concat(label, F.col("t")))


@query(C.LABEL_TEXT)
def label_text(spark: SparkSession, d: str) -> DataFrame:
    t, f = F.col("t"), F.col("f")
    return _labelled(spark, d).select("row_id", T.label_words(t, f).alias("label_words"), T.label_like(t, f).alias("label_like"), T.strip_label(t, f).alias("stripped"), T.label_value(t, f).alias("value"), T.cleanup(t, f).alias("clean"))


@query(C.CONFIDENCE)
def text_confidence(spark: SparkSession, d: str) -> DataFrame:
    v, f = F.col("v"), F.col("f")
    x = _labelled(spark, d).withColumn("v", T.cleanup(F.col("t"), f)).withColumn("e", T.estimated_confidence(v, f, True))
    x = x.select("row_id", T.suspicious(v, f, True).alias("suspicious"), (F.col("e") + 1e-8).alias("estimated"), (T.calibrated_confidence(v, F.col("c"), f, True, F.col("e")) + 1e-8).alias("calibrated"))
    return A.rounded(x, 5)


# ---- choice between recognisers


@query(C.PSEUDO)
def pseudo_labels(spark: SparkSession, d: str) -> DataFrame:
    return _fives(ensemble.pseudo_labels(_sample(spark, d)), "conf_vietocr", "conf_paddle", "best_conf")


@query(r"""
    WITH r AS (SELECT row_id, coalesce(text_vietocr, '') AS a, coalesce(text_paddle, '') AS b, coalesce(conf_vietocr, 0) AS v, coalesce(conf_paddle, 0) AS p FROM reviewed_sample WHERE class = 'title'),
    n AS (SELECT *, trim(regexp_replace(a, '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g')) AS x, trim(regexp_replace(b, '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g')) AS y FROM r),
    e AS (SELECT *, CASE WHEN x <> '' AND x = y THEN 'agree' WHEN p > v THEN 'paddleocr' ELSE 'vietocr' END AS engine FROM n)
    SELECT row_id, engine, round(CASE engine WHEN 'agree' THEN greatest(v, p) WHEN 'paddleocr' THEN p ELSE v END, 6) AS score,
           CASE WHEN engine = 'agree' THEN false ELSE (CASE engine WHEN 'paddleocr' THEN p ELSE v END) < 0.5 OR (CASE engine WHEN 'paddleocr' THEN y ELSE x END) = '' OR (x <> y AND abs(v - p) < 0.08) END AS review FROM e
""")
def ensemble_title(spark: SparkSession, d: str) -> DataFrame:
    e = ensemble.choose(_sample(spark, d).filter("class = 'title'").withColumn("field_name", F.lit("title")).withColumns({c: T.nfc(F.col(c)) for c in ("text_vietocr", "text_paddle")}))
    nfd_free = e.select("row_id", F.col("e_engine").alias("engine"), F.col("e_score").alias("score"), F.col("e_review").alias("review"))
    return A.rounded(nfd_free)


@query(C.PICK)
def ensemble_pick(spark: SparkSession, d: str) -> DataFrame:
    e = ensemble.choose(_sample(spark, d).withColumn("field_name", F.col("class")))
    margin = F.round(F.col("e_margin") + 1e-8, 5).alias("margin")
    return A.rounded(e.select("row_id", F.col("e_engine").alias("engine"), F.col("e_reason").alias("reason"), margin, F.col("e_score").alias("score"), F.col("e_review").alias("review"), F.col("e_candidates")["paddleocr"].form.alias("other")))


@query(C.SAFER)
def safer_pick(spark: SparkSession, d: str) -> DataFrame:
    r = _sample(spark, d)
    return r.select("row_id", ensemble.safer(F.col("class"), F.col("text_paddle"), F.col("conf_paddle"), F.col("best_text"), F.col("best_conf")).alias("pick"))


@query(C.VALID)
def validate_fields(spark: SparkSession, d: str) -> DataFrame:
    v = ensemble.flag_fields(_sample(spark, d).select("row_id", F.col("class").alias("field_name"), F.coalesce(F.nullif("ground_truth_text", F.lit("")), "best_text").alias("value")), last_year=2025, prefixes=[f"{i:03d}" for i in range(1, 97)])
    return v.select("row_id", F.array_join("reasons", ",").alias("reasons"))


# ---- line picking


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return A.lines(spark, d)


@query(C.READING_ORDER)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return linepick.ordered(_lines(spark, d)).select("crop_id", "idx", "line_no", "text", "is_label")


@query(C.BLOCKS)
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _fives(linepick.blocks(linepick.ordered(_lines(spark, d))).select("crop_id", "value", "score", "pieces", "seq"), "score")


@query(C.CANDIDATES)
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    return _fives(linepick.candidates(materialize(linepick.ordered(_lines(spark, d)), "ordered")).select("crop_id", "rank", "kind", "value", "score"), "score")


@query(C.LINE_PICK)
def line_pick(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    joined = linepick.joined_text(lines.select("crop_id", "idx", "text", ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.col("x1").alias("x")))
    r = lines.groupBy("crop_id", "field_name").agg(F.avg("confidence").alias("conf")).join(joined, "crop_id").withColumn("raw_text", F.col("text")).withColumn("text", F.regexp_replace("text", "\n", " "))
    return _fives(linepick.refine(lines, r).select("crop_id", "new_text", "new_conf", "replaced", "kind"), "new_conf")


@query(C.BEST_HYPOTHESIS)
def best_hypothesis(spark: SparkSession, d: str) -> DataFrame:
    s = _lines(spark, d).select("crop_id", "field_name", "idx", "text", F.col("confidence").alias("score"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.col("x1").alias("x"))
    return _fives(linepick.best_hypothesis(linepick.hypotheses(s)), "score")


# ---- pixels, clips, names


_Q = "sharp AS (SELECT vec_id AS id, e, list_avg(e) AS b, list_stddev_pop(e) AS s FROM (SELECT vec_id, list_transform(embedding, lambda v: floor(least(255, greatest(0, v::DOUBLE * 300 + 128)))) AS e FROM embeddings))"


@query(f"""
    WITH {_Q}, m AS (SELECT *, list_transform(range(64), lambda i: [i // 8, i % 8]) AS ij FROM sharp),
    l AS (SELECT id, b, s, list_transform(ij, lambda p: e[abs(p[1] - 1) * 8 + p[2] + 1] + e[(7 - abs(6 - p[1])) * 8 + p[2] + 1] + e[p[1] * 8 + abs(p[2] - 1) + 1] + e[p[1] * 8 + (7 - abs(6 - p[2])) + 1] - 4 * e[p[1] * 8 + p[2] + 1]) AS lap FROM m),
    v AS (SELECT *, list_var_pop(lap) AS sharpness FROM l)
    SELECT id, round(sharpness + 1e-5, 2) AS sharpness, round(b, 4) AS brightness, round(s, 4) AS contrast, round(0.45::DOUBLE * least(1, sharpness / 1200) + 0.30::DOUBLE * least(1, greatest(0, 1 - abs(b - 145) / 145)) + 0.25::DOUBLE * least(1, greatest(0, s / 64)), 4) AS score FROM v
""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    g = A.grids(spark, d).withColumn("e", F.transform("grid", lambda v: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v * 300 + 128)))))
    pixels = F.unhex(F.array_join(F.transform("e", lambda v: F.lpad(F.hex(v.cast("int")), 2, "0")), ""))
    q = g.select("id", X.quality_udf(8)(pixels).alias("q")).select("id", "q.*")
    return A.rounded(q.select("id", F.round(F.col("sharpness") + 1e-5, 2).alias("sharpness"), "brightness", "contrast", "score"), 4)


def _numbers(rows) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in map(float, r)) + "]" for r in rows) + "]"


_PIXELS = "px AS (SELECT vec_id AS id, list_transform(embedding, lambda v: greatest(0, least(255, round_even(v::DOUBLE * 300 + 128, 0)))) AS e FROM embeddings)"
_ROW = "list_transform({rows}, lambda a: list_transform({cols}, lambda b: list_inner_product(a, b)))"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Grids as raw gray pictures of 8 x 8: id, content."""
    e = F.transform("grid", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.bround(v * 300 + 128).cast("int"))))
    return A.grids(spark, d).select("id", F.unhex(F.array_join(F.transform(e, lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("content"))


@query(f"""
    WITH {_PIXELS}, k AS (SELECT {_numbers(X.lanczos_matrix(8, 32))} AS k, {_numbers(X.dct_matrix(32)[:8])} AS d),
    c AS (SELECT id, k, d, list_transform(range(8), lambda c: list_transform(range(8), lambda r: e[r * 8 + c + 1]::DOUBLE)) AS cols FROM px, k),
    a AS (SELECT *, {_ROW.format(rows='k', cols='cols')} AS a FROM c),
    m AS (SELECT id, d, list_transform(a, lambda row: list_transform(k, lambda q: greatest(0::DOUBLE, least(255::DOUBLE, round_even(list_inner_product(row, q), 0))))) AS small FROM a),
    n AS (SELECT id, d, list_transform(range(32), lambda c: list_transform(small, lambda r: r[c + 1])) AS cols FROM m),
    b AS (SELECT id, d, {_ROW.format(rows='d', cols='cols')} AS b FROM n),
    l AS (SELECT id, flatten({_ROW.format(rows='b', cols='d')}) AS low FROM b),
    t AS (SELECT *, (list_sort(low)[32] + list_sort(low)[33]) / 2 AS mid FROM l)
    SELECT id, array_to_string(list_transform(low, lambda v: CASE WHEN v > mid THEN '1' ELSE '0' END), '') AS bits FROM t
""")
def dct_hash(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("id", F.lpad(F.bin(X.hash_udf(8)("content")), 64, "0").alias("bits"))


_BILINEAR = """list_transform(range(16), lambda n: round_even(
      e[((n // 4) * 7 // 3) * 8 + (n % 4) * 7 // 3 + 1] * (1 - {fy}) * (1 - {fx}) + e[least(7, (n // 4) * 7 // 3 + 1) * 8 + (n % 4) * 7 // 3 + 1] * {fy} * (1 - {fx})
      + e[((n // 4) * 7 // 3) * 8 + least(7, (n % 4) * 7 // 3 + 1) + 1] * (1 - {fy}) * {fx} + e[least(7, (n // 4) * 7 // 3 + 1) * 8 + least(7, (n % 4) * 7 // 3 + 1) + 1] * {fy} * {fx} + 1e-7, 0))""".format(
    fy="(((n // 4) * 7 % 3) / 3)", fx="(((n % 4) * 7 % 3) / 3)"
)


@query(f"""
    WITH {_PIXELS}, w AS (
      SELECT id, CASE id % 3 WHEN 0 THEN 'polygon_warp' WHEN 1 THEN 'bbox_crop' ELSE 'none' END AS method,
             CASE id % 3 WHEN 0 THEN {_BILINEAR} WHEN 1 THEN list_transform(range(16), lambda n: round_even((e[(n // 4) * 16 + (n % 4) * 2 + 1] + e[(n // 4) * 16 + (n % 4) * 2 + 2] + e[(n // 4) * 16 + (n % 4) * 2 + 9] + e[(n // 4) * 16 + (n % 4) * 2 + 10]) / 4, 0)) ELSE e END AS v
      FROM px)
    SELECT id, method, array_to_string(list_transform(v, lambda x: printf('%02X', x::INT)), '') AS content FROM w
""")
def rectified_pixels(spark: SparkSession, d: str) -> DataFrame:
    p = _pixels(spark, d)
    ring = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((7.0, 0.0), (0.0, 7.0), (7.0, 7.0), (0.0, 0.0))])
    r = cards.rectify_udf(8, 4, 4)("content", F.when(F.col("id") % 3 == 0, ring), F.when(F.col("id") % 3 == 1, F.array(*[F.lit(v) for v in (0.0, 0.0, 8.0, 8.0)])))
    return p.select("id", r.alias("r")).select("id", "r.method", F.hex("r.content").alias("content"))


@query(f"WITH {_PIXELS} SELECT id, array_to_string(list_transform(range(64), lambda n: printf('%02X', e[(7 - n % 8) * 8 + n // 8 + 1]::INT)), '') AS content FROM px")
def rotate90(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("id", F.hex(X.rotate_udf(90, 8)("content")).alias("content"))


@query()
def orientation_of_pixels(spark: SparkSession, d: str) -> DataFrame:
    o = X.pick_orientation(X.orientation_udf(8)("content"))
    return A.rounded(_pixels(spark, d).select("id", o.alias("o")).select("id", "o.angle", "o.confidence"))


@query(C.JOINED)
def joined_text(spark: SparkSession, d: str) -> DataFrame:
    return linepick.joined_text(_lines(spark, d).select("crop_id", "idx", "text", ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.col("x1").alias("x")))


@query(C.FINISHED)
def finished_readings(spark: SparkSession, d: str) -> DataFrame:
    r = _sample(spark, d).filter("conf_vietocr is not null").select("row_id", F.col("class").alias("name"), F.coalesce("text_vietocr", F.lit("")).alias("text"), F.col("conf_vietocr").alias("score"))
    out = inference.finish(r, F.col("name")).select("row_id", "clean", "conf", "form", "needs_review")
    return _fives(out, "conf")


@query("""
    WITH p AS (SELECT ann_id, crop_path, row_id AS edit_no, CASE row_id % 4 WHEN 0 THEN 'vietocr' WHEN 1 THEN 'paddleocr' WHEN 2 THEN 'best' ELSE 'other' END AS engine FROM reviewed_sample WHERE row_id % 5 = 0),
    f AS (SELECT ann_id, crop_path, min(row_id) AS row_id, arg_min({'v': text_vietocr, 'p': text_paddle, 'b': best_text}, row_id) AS t FROM reviewed_sample GROUP BY ann_id, crop_path),
    e AS (SELECT p.ann_id, p.crop_path, edit_no, trim(CASE engine WHEN 'vietocr' THEN t.v WHEN 'paddleocr' THEN t.p WHEN 'best' THEN t.b END) AS truth FROM p JOIN f ON f.ann_id = p.ann_id AND f.crop_path = p.crop_path),
    l AS (SELECT ann_id, crop_path, arg_max(truth, edit_no) AS truth FROM e WHERE truth <> '' GROUP BY ann_id, crop_path)
    SELECT r.row_id, coalesce(l.truth, r.ground_truth_text) AS ground_truth_text FROM reviewed_sample r LEFT JOIN f ON f.row_id = r.row_id LEFT JOIN l ON l.ann_id = f.ann_id AND l.crop_path = f.crop_path
""")
def review_accept(spark: SparkSession, d: str) -> DataFrame:
    r = _sample(spark, d)
    engine = F.element_at(F.array(*[F.lit(e) for e in ("vietocr", "paddleocr", "best", "other")]), (F.col("row_id") % 4 + 1).cast("int"))
    picks = r.filter("row_id % 5 = 0").select("ann_id", "crop_path", F.col("row_id").alias("edit_no"), engine.alias("engine"))
    return review.upsert(r, review.accepted(r, picks)).select("row_id", "ground_truth_text")


@query("""
    WITH s AS (SELECT row_id, conf_vietocr AS a, conf_paddle AS b FROM reviewed_sample WHERE conf_vietocr IS NOT NULL AND conf_paddle IS NOT NULL)
    SELECT row_id, CASE WHEN b > a AND least(1, greatest(0, (b - a) / greatest(b, 1e-6))) >= 0.12 THEN 90 ELSE 0 END AS angle,
           round(CASE WHEN b > a AND (b - a) / greatest(b, 1e-6) < 0.12 THEN 0 ELSE least(1, greatest(0, abs(a - b) / greatest(a, b, 1e-6))) END, 6) AS confidence FROM s
""")
def orientation_pick(spark: SparkSession, d: str) -> DataFrame:
    r = _sample(spark, d).filter("conf_vietocr is not null and conf_paddle is not null")
    scores = F.create_map(F.lit(0), F.col("conf_vietocr"), F.lit(90), F.col("conf_paddle"))
    return A.rounded(r.select("row_id", X.pick_orientation(scores).alias("o")).select("row_id", "o.angle", "o.confidence"))


@query(f"""
    WITH {A.CLIPS_SQL}, n AS (SELECT clip, frame, epoch(max(ts) OVER (PARTITION BY clip)) - epoch(min(ts) OVER (PARTITION BY clip)) AS len, row_number() OVER (PARTITION BY clip ORDER BY ts, frame) - 1 AS no FROM clips),
    s AS (SELECT *, CASE WHEN len < 1 THEN 1 WHEN len < 3 THEN 3 WHEN len <= 10 THEN 5 ELSE 10 END AS step FROM n)
    SELECT clip, frame, step FROM s WHERE no % step = 0
""")
def frame_sample(spark: SparkSession, d: str) -> DataFrame:
    return video.sample_frames(A.clips(spark, d)).select("clip", "frame", "step")


@query(f"WITH {A.CLIPS_SQL} SELECT clip, frame, rank FROM (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY score DESC, frame) AS rank FROM clips) WHERE rank <= 3")
def topk_frames(spark: SparkSession, d: str) -> DataFrame:
    return video.top_frames(A.clips(spark, d), 3).select("clip", "frame", "rank")


@query(f"""
    WITH {A.CLIPS_SQL}, p AS (SELECT clip, text, count(*) AS votes, max(score) AS best FROM clips GROUP BY clip, text),
    r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY CASE WHEN votes >= 2 THEN votes ELSE 0 END DESC, best DESC, text DESC) AS k FROM p)
    SELECT clip, text, votes FROM r WHERE k = 1
""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return video.vote(A.clips(spark, d).withColumn("field", F.lit("x"))).select("clip", "text", "votes")


@query(f"""
    WITH RECURSIVE {A.SQL}, b AS (SELECT *, image_id * 1000 + seq AS box_id, (seq % 10 + 1)::DOUBLE / 10 AS score FROM annotations),
    q AS (SELECT a.box_id AS a, b.box_id AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s
      FROM b a JOIN b ON a.image_id = b.image_id AND a.class = b.class AND a.seq < b.seq),
    p AS (SELECT a, b FROM q WHERE i > 0 AND i / (s - i) >= 0.55::DOUBLE), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r AS (SELECT a AS v, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v), m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
    SELECT image_id, class, count(*) AS n, round(max(score) + 1e-8, 5) AS score, {', '.join(f'round(sum({c} * score) / sum(score) + 1e-8, 5) AS {c}' for c in 'xywh')}
    FROM b LEFT JOIN m ON m.v = b.box_id GROUP BY image_id, class, coalesce(m.c, box_id)
""")
def box_fusion(spark: SparkSession, d: str) -> DataFrame:
    b = _ann(spark, d).withColumn("box_id", F.col("image_id") * 1000 + F.col("seq")).withColumn("score", (F.col("seq") % 10 + 1) / 10)
    return _fives(video.fuse(b), "score", *"xywh")


@query("""
    WITH v AS (SELECT DISTINCT replace(n_name, 'N', 'M') || CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE '' END AS value FROM nation),
    p AS (SELECT value, n_name AS name, levenshtein(lower(value), lower(n_name)) AS distance FROM v, nation)
    SELECT value, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY distance, name) AS r FROM p WHERE distance <= 3) WHERE r = 1
""")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    v = n.select(F.concat(F.translate("n_name", "N", "M"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise("")).alias("value"))
    return video.nearest_name(v, n.select(F.col("n_name").alias("name")), 3).select("value", "name", F.col("distance").cast("long").alias("distance"))


@query("""
    WITH r AS (SELECT row_id, coalesce(best_conf, 0) AS c, coalesce(needs_review, false) AS retried, coalesce(text_vietocr <> text_paddle, false) AS differ FROM reviewed_sample)
    SELECT row_id, CASE WHEN c >= 0.8 THEN CASE WHEN differ THEN 'check' ELSE 'take' END WHEN c >= 0.5 THEN 'check' WHEN retried THEN 'drop' ELSE 'again' END AS route,
           array_to_string(list_filter([CASE WHEN c < 0.8 AND c >= 0.5 THEN 'low_confidence' END, CASE WHEN c < 0.5 THEN 'very_low_confidence' END, CASE WHEN differ THEN 'engines_differ' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r
""")
def confidence_route(spark: SparkSession, d: str) -> DataFrame:
    r = routing.reading_route(F.col("best_conf"), F.col("needs_review"), F.col("text_vietocr") != F.col("text_paddle"))
    return _sample(spark, d).select("row_id", r.alias("r")).select("row_id", "r.route", F.array_join("r.reasons", ",").alias("reasons"))


@query("""
    WITH r AS (SELECT row_id, coalesce(conf_vietocr, 0) AS card, row_id % 5 AS corners, coalesce(abs(conf_vietocr - conf_paddle), 0) AS turn, row_id % 7 AS fields FROM reviewed_sample),
    g AS (SELECT *, CASE WHEN corners >= 4 THEN 'good' WHEN corners = 3 THEN 'estimated' ELSE 'degraded' END AS grade FROM r)
    SELECT row_id, CASE WHEN card < 0.3 THEN 'no_card_detected' WHEN fields = 0 AND grade = 'degraded' THEN 'partial_result' END AS stop, grade, turn >= 0.12 AS turned,
           CASE WHEN fields >= 4 THEN 'none' WHEN fields >= 1 THEN 'template_for_missing' WHEN grade = 'degraded' THEN 'none' ELSE 'template_for_all' END AS template,
           array_to_string(list_filter([CASE WHEN card >= 0.3 AND card < 0.5 THEN 'weak_card' END, CASE WHEN grade = 'estimated' THEN 'estimated_corner' END, CASE WHEN grade = 'degraded' THEN 'degraded_rectification' END,
             CASE WHEN turn < 0.12 THEN 'unclear_turn' END, CASE WHEN fields < 4 THEN 'few_fields' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g
""")
def recovery_route(spark: SparkSession, d: str) -> DataFrame:
    r = routing.picture_route(F.col("conf_vietocr"), F.col("row_id") % 5, F.abs(F.col("conf_vietocr") - F.col("conf_paddle")), F.col("row_id") % 7)
    return _sample(spark, d).select("row_id", r.alias("r")).select("row_id", "r.stop", "r.grade", "r.turned", "r.template", F.array_join("r.reasons", ",").alias("reasons"))


@query(f"WITH {A.SQL} SELECT image_id, count(DISTINCT class) FILTER (class <> 'card') >= 2 AS front FROM annotations GROUP BY image_id")
def side_rule(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct(F.when(F.col("class") != "card", F.col("class")))
    return _ann(spark, d).groupBy("image_id").agg((n >= 2).alias("front"))


# ---- streams (batch runs of the same plans)


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    from fieldloom.streaming import reviews

    return A.rounded(reviews.counts(table(spark, d, "events")), 4)


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    from fieldloom.streaming import reviews

    return reviews.sessions(table(spark, d, "events"))


# ---- label and confidence rules on texts that count as cleaned


def _ready(spark: SparkSession, d: str) -> DataFrame:
    """row_id, f, t, c: readings with a label in front of some, white space collapsed."""
    return _labelled(spark, d).withColumn("t", T.nfc(T.collapse(F.col("t"))))


_READY = f"""
    tx AS (
      SELECT row_id, f, t, c, strftime({_ISO}, '%Y-%m-%d') AS iso FROM (
        SELECT row_id, {_F} AS f, best_conf AS c,
               nfc_normalize(trim(regexp_replace(['Họ và tên: ', 'Quê quán ', 'Nơi thường trú: ', 'Full name ', ''][(row_id % 5 + 1)::INT] || coalesce(best_text, ''), '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g'))) AS t FROM reviewed_sample))
"""


@query(f"WITH {_READY}, {LABEL_CTES} SELECT row_id, label_words, label_like FROM lb")
def label_like(spark: SparkSession, d: str) -> DataFrame:
    t, f = F.col("t"), F.col("f")
    return _ready(spark, d).select("row_id", T.label_words(t, f).alias("label_words"), T.label_like(t, f).alias("label_like"))


@query(f"WITH {_READY}, {LABEL_CTES}, {CONFIDENCE_CTES} SELECT row_id, suspicious, round(estimated + 1e-8, 5) AS estimated, round(calibrated + 1e-8, 5) AS calibrated FROM ca")
def calibrate_conf(spark: SparkSession, d: str) -> DataFrame:
    t, f = F.col("t"), F.col("f")
    return A.rounded(_ready(spark, d).select("row_id", T.suspicious(t, f, True).alias("suspicious"), (T.estimated_confidence(t, f, True) + 1e-8).alias("estimated"), (T.calibrated_confidence(t, F.col("c"), f, True) + 1e-8).alias("calibrated")), 5)


_SIDE = """
    side_{k} AS (
      WITH tx AS (SELECT row_id, {f} AS f, trim(regexp_replace(nfc_normalize(coalesce(text_{e}, '')), '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g')) AS t, conf_{e} AS c, NULL AS iso FROM reviewed_sample WHERE class IN ('name', 'origin', 'address')),
      {label}, {conf} SELECT row_id, f, t AS form, coalesce(c, 0) AS s, suspicious AS bad FROM sp)
"""
_SIDES = ", ".join(_SIDE.format(k=k, e=e, f=_F, label=LABEL_CTES, conf=CONFIDENCE_CTES) for k, e in (("v", "vietocr"), ("p", "paddle")))


@query(f"""
    WITH {_SIDES},
    j AS (SELECT a.row_id, a.f, a.form AS vt, b.form AS pt, a.s AS v, b.s AS p, a.bad AS vb, b.bad AS pb FROM side_v a JOIN side_p b ON a.row_id = b.row_id),
    w AS (
      SELECT *, CASE WHEN vt <> '' AND vt = pt THEN 'agree'
        WHEN f = 'full_name' THEN CASE WHEN vt <> '' AND pt = '' THEN 'vietocr' WHEN pt <> '' AND vt = '' THEN 'paddleocr' WHEN pb AND NOT vb THEN 'vietocr' WHEN vb AND NOT pb THEN 'paddleocr'
          WHEN v >= p - 0.08 THEN 'vietocr' WHEN length(vt) >= length(pt) AND v >= p - 0.12 THEN 'vietocr' WHEN p > v + 0.08 THEN 'paddleocr' ELSE 'vietocr' END
        ELSE CASE WHEN pt <> '' AND vt = '' THEN 'paddleocr' WHEN vt <> '' AND pt = '' THEN 'vietocr' WHEN vb AND NOT pb THEN 'paddleocr' WHEN pb AND NOT vb THEN 'vietocr'
          WHEN p >= v - 0.12 THEN 'paddleocr' WHEN v > p + 0.35 THEN 'vietocr' ELSE 'paddleocr' END END AS engine FROM j)
    SELECT row_id, engine, CASE WHEN engine = 'agree' THEN false ELSE
      (CASE engine WHEN 'vietocr' THEN v < 0.5 OR vt = '' OR vb ELSE p < 0.5 OR pt = '' OR pb END) OR (vt <> pt AND abs(v - p) < 0.08) END AS review FROM w
""")
def ensemble_text_fields(spark: SparkSession, d: str) -> DataFrame:
    r = _sample(spark, d).filter(F.col("class").isin("name", "origin", "address")).withColumn("field_name", F.col("class"))
    r = r.withColumns({c: T.collapse(T.nfc(F.col(c))) for c in ("text_vietocr", "text_paddle")})
    e = ensemble.choose(ensemble.features(r, cleaned=True))
    return e.select("row_id", F.col("e_engine").alias("engine"), F.col("e_review").alias("review"))


# ---- further geometry, lines and files


@query(f"WITH {_BOXES} SELECT annotation_id, round(x1 + 1e-7, 4) AS x1, round(y1 + 1e-7, 4) AS y1, round(x1 + (x2 - x1) + 1e-7, 4) AS x2, round(y1 + (y2 - y1) + 1e-7, 4) AS y2 FROM bx")
def box_convert(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    again = G.from_array(F.array(b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1), "xywh")
    return A.rounded(_boxes(spark, d).select("annotation_id", again.alias("r")).select("annotation_id", *[(F.col(f"r.{c}") + 1e-7).alias(c) for c in ("x1", "y1", "x2", "y2")]), 4)


@query(f"WITH {_BOXES} SELECT annotation_id, x1, y1, x2, y2 FROM bx")
def polygon_aabb(spark: SparkSession, d: str) -> DataFrame:
    ring = F.transform(G.corners(F.col("b")), lambda p: F.array(p.x, p.y))
    return A.rounded(_boxes(spark, d).select("annotation_id", G.bounds(F.reverse(ring)).alias("r")).select("annotation_id", "r.*"))


@query(f"WITH {_BOXES} SELECT annotation_id, i, round(CASE i WHEN 0 THEN 855 / (x2 - x1) WHEN 2 THEN -x1 * 855 / (x2 - x1) WHEN 4 THEN 539 / (y2 - y1) WHEN 5 THEN -y1 * 539 / (y2 - y1) WHEN 8 THEN 1 ELSE 0 END + 1e-7, 4) AS v FROM bx, (SELECT unnest(range(9)) AS i) WHERE x2 > x1 AND y2 > y1")
def homography_rect(spark: SparkSession, d: str) -> DataFrame:
    m = _boxes(spark, d).filter("b.x2 > b.x1 and b.y2 > b.y1").select("annotation_id", F.posexplode(G.rect_matrix(F.col("b"))).alias("i", "v"))
    return A.rounded(m.select("annotation_id", F.col("i").cast("long").alias("i"), (F.col("v") + 1e-7).alias("v")), 4)


@query(f"""
    WITH {_BOXES}, q AS (SELECT DISTINCT annotation_id, x1, y1, x2, y2 FROM bx WHERE x2 > x1 + 4 AND y2 > y1 + 4), c AS (SELECT unnest(range(5)) AS i)
    SELECT annotation_id, x1, y1, i, CASE i WHEN 1 THEN 855.0::DOUBLE WHEN 2 THEN 855 ELSE 0 END AS u, CASE i WHEN 2 THEN 539.0::DOUBLE WHEN 3 THEN 539 ELSE 0 END AS v FROM q, c WHERE i < 4
    UNION ALL SELECT annotation_id, x1, y1, 4, 427.5, 269.5 FROM q
""")
def homography_points(spark: SparkSession, d: str) -> DataFrame:
    """A skewed card's corners, in any order, under its own map: the corners of the picture; diagonals meet where diagonals meet."""
    b = F.col("b")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    skewed = F.array(pt(b.x2 + 1, b.y2 + 2), pt(b.x1, b.y1), pt(b.x1 - 1, b.y2), pt(b.x2, b.y1 + 1))
    q = _boxes(spark, d).filter("b.x2 > b.x1 + 4 and b.y2 > b.y1 + 4").withColumn("p", F.transform(G.order_points(skewed), lambda p: F.array(p.x, p.y)))
    x, y = (lambda i: F.get(F.get("p", F.lit(i)), F.lit(0))), (lambda i: F.get(F.get("p", F.lit(i)), F.lit(1)))
    t = ((x(1) - x(0)) * (y(3) - y(1)) - (y(1) - y(0)) * (x(3) - x(1))) / ((x(2) - x(0)) * (y(3) - y(1)) - (y(2) - y(0)) * (x(3) - x(1)))
    middle = F.array(x(0) + t * (x(2) - x(0)), y(0) + t * (y(2) - y(0)))
    q = q.withColumn("m", X.homography_udf()("p")).withColumn("to", G.project(F.concat("p", F.array(middle)), F.col("m")))
    out = q.select("annotation_id", "b.x1", "b.y1", F.posexplode("to").alias("i", "t"))
    return A.rounded(out.select("annotation_id", "x1", "y1", F.col("i").cast("long").alias("i"), F.round(F.col("t")[0], 3).alias("u"), F.round(F.col("t")[1], 3).alias("v")), 3)


@query(f"""
    WITH {_BOXES}, u AS (SELECT *, greatest(0, least(639, x1 / 1.5 - 6)) AS ux, greatest(0, least(639, y1 / 1.5 - 8)) AS uy FROM bx)
    SELECT annotation_id, round(ux + 1e-7, 4) AS x, round(uy + 1e-7, 4) AS y FROM u
""")
def unmap_points(spark: SparkSession, d: str) -> DataFrame:
    p = G.unmap_points(F.array(F.array(F.col("b.x1"), F.col("b.y1"))), F.lit(1.5), F.lit(6), F.lit(8), F.lit(640), F.lit(640))
    return A.rounded(_boxes(spark, d).select("annotation_id", p[0].alias("p")).select("annotation_id", (F.col("p")[0] + 1e-7).alias("x"), (F.col("p")[1] + 1e-7).alias("y")), 4)


@query("SELECT row_id, crop_path, class, ann_id, best_text, round(best_conf, 6) AS best_conf, needs_review FROM reviewed_sample")
def sink_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    cols = ["row_id", "crop_path", "class", "ann_id", "best_text", "best_conf", "needs_review"]
    r = _sample(spark, d).select(*cols)
    path = f"{shared_dir(spark)}/fieldloom/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(r, path)
    return A.rounded(files.read_jsonl(spark, path, r.schema))


@query(C.BELOW_LABEL)
def below_label(spark: SparkSession, d: str) -> DataFrame:
    return _fives(linepick.below_label(linepick.ordered(_lines(spark, d))).select("crop_id", "value", "score", "pieces"), "score")


@query(C.SAME_LINE)
def same_line(spark: SparkSession, d: str) -> DataFrame:
    return _fives(linepick.same_line(linepick.ordered(_lines(spark, d))).select("crop_id", "value", "score", "x1"), "score", "x1")


@query(C.HYPOTHESES)
def ocr_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    s = _lines(spark, d).select("crop_id", "field_name", "idx", "text", F.col("confidence").alias("score"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.col("x1").alias("x"))
    return _fives(linepick.hypotheses(s).drop("ord"), "score")


@query(C.PART)
def subcrop_pick(spark: SparkSession, d: str) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    pick = linepick.whole_or_part(T.canonical_field(F.col("class")), F.col("text_vietocr"), z("conf_vietocr"), F.col("text_paddle"), z("conf_paddle"), F.col("best_text"))
    return _sample(spark, d).select("row_id", pick.alias("pick"))


@query("""
    SELECT image_id, count(*) AS deliveries, max(epoch(uploaded_at) - epoch(captured_at)) > 86400 AS late FROM images GROUP BY image_id
""")
def image_deliveries(spark: SparkSession, d: str) -> DataFrame:
    late = F.max(F.col("uploaded_at").cast("timestamp").cast("double") - F.col("captured_at").cast("timestamp").cast("double")) > 86400
    return table(spark, d, "images").groupBy("image_id").agg(F.count("*").alias("deliveries"), late.alias("late"))


@query(f"""
    WITH {A.SQL}, br AS (SELECT ((o_orderkey * 7) % 256)::DOUBLE AS mean FROM orders WHERE o_orderkey % 5 <> 0), ar AS (SELECT class, w * h AS a, w, h, x + w / 2 AS cx, y + h / 2 AS cy FROM annotations),
    st AS (
      SELECT 'total_images' AS metric, '' AS key, count(*)::DOUBLE AS value FROM per UNION ALL SELECT 'total_annotations', '', sum(n) FROM per UNION ALL
      SELECT 'boxes_mean', '', avg(n) FROM per UNION ALL SELECT 'boxes_std', '', stddev_pop(n) FROM per UNION ALL SELECT 'boxes_least', '', min(n) FROM per UNION ALL SELECT 'boxes_most', '', max(n) FROM per UNION ALL
      SELECT 'boxes_empty', '', count(*) FILTER (n = 0) FROM per UNION ALL
      SELECT 'brightness_mean', '', avg(mean) FROM br UNION ALL SELECT 'brightness_std', '', stddev_pop(mean) FROM br UNION ALL SELECT 'brightness_sample', '', count(*) FROM br UNION ALL
      SELECT 'split_images', split, count(*) FROM per GROUP BY split UNION ALL
      {' UNION ALL '.join(f"SELECT 'class_{n}', class, {e} FROM ar GROUP BY class" for n, e in (('n', 'count(*)'), ('mean_area', 'avg(a)'), ('std_area', 'stddev_pop(a)'), ('mean_w', 'avg(w)'), ('mean_h', 'avg(h)'), ('mean_cx', 'avg(cx)'), ('mean_cy', 'avg(cy)')))} UNION ALL
      {' UNION ALL '.join(f"SELECT 'size_{n}_{k}', '', {v} FROM images0" for n, c in (('width', 'width'), ('height', 'height'), ('aspect', 'width / height')) for k, v in (('mean', f'avg({c})'), ('std', f'stddev_pop({c})'), ('min', f'min({c})'), ('max', f'max({c})')))})
    SELECT metric, key, round(value, 3) AS value FROM st
""")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.rounded(quality.dataset_statistics(_img(spark, d), _ann(spark, d), A.brightness(spark, d)), 3)