"""Queries of the text problems over the test tables, and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import bpe, groupsplit, lookalike, overlap, packing, textquality, truncation
from fieldloom.runtime import table

LOOKALIKE_FIELDS = ["best_normalized_text", "ground_truth_text", "text_vietocr"]


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviewed_sample")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_sample(spark, d)).select("row_id", "field")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(_sample(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.not_plain(_sample(spark, d), "row_id", LOOKALIKE_FIELDS).select("row_id", "field")


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent(_sample(spark, d).select("row_id", *LOOKALIKE_FIELDS), LOOKALIKE_FIELDS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(_sample(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_sample(spark, d))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.coverage(_sample(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.torn(_sample(spark, d))


def p5_assign(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.assign(_sample(spark, d), table(spark, d, "split_targets"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(_documents(spark, d))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.token_counts(_documents(spark, d)))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p7_pack(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return textquality.found(_documents(spark, d), table(spark, d, "common_words"))


def p8_types(spark: SparkSession, d: str) -> DataFrame:
    cols = ["doc_id", "n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share", "p_prose", "p_list", "p_table", "p_junk", "text_type"]
    return textquality.text_types(_documents(spark, d), table(spark, d, "common_words")).select(*cols)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_report, p3_found, p3_consistent, p4_found, p4_report, p4_coverage, p5_found, p5_assign, p6_ids, p7_pack, p7_report, p8_found, p8_types)
}

ORACLE: dict[str, str] = {
    "p5_found": r"""
        WITH m AS (
          SELECT row_id, CASE WHEN split = 'valid' THEN 'val' ELSE split END AS split,
                 lower(regexp_extract(coalesce(source_image, crop_path), '([^/\\]+)[/\\]*$', 1)) AS name
          FROM reviewed_sample WHERE split IS NOT NULL),
        k AS (SELECT row_id, split, coalesce(nullif(regexp_extract(name, '^([a-z]+[0-9]{8})(?:[^0-9]|$)', 1), ''), name) AS key FROM m),
        g AS (SELECT key, min(row_id) AS group_id FROM k GROUP BY key HAVING count(DISTINCT split) > 1)
        SELECT g.group_id, k.row_id FROM k JOIN g ON g.key = k.key
    """,
}


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    s = textquality.statistics(_documents(spark, d), table(spark, d, "common_words"))
    shares = ["mean_word_length", "symbol_ratio", "punctuated_lines", "common_share"]
    return s.select("doc_id", "n_words", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in shares])


QUERIES["p8_statistics"] = p8_statistics
ORACLE["p8_statistics"] = r"""
    WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?|[\x{2028}\x{2029}\x{0b}\x{0c}\x{85}]', chr(10), 'g'), '\p{Zs}', ' ', 'g') AS t FROM documents),
    f AS (SELECT doc_id, t, strip_accents(replace(replace(lower(t), 'đ', 'd'), 'ð', 'd')) AS f FROM d WHERE regexp_matches(t, '[^\s\p{Z}]')),
    b AS (SELECT list(DISTINCT strip_accents(replace(lower(word), 'đ', 'd'))) AS bag FROM common_words),
    p AS (
      SELECT doc_id, t, list_filter(string_split_regex(f, '\s+'), lambda x: x <> '') AS toks, regexp_extract_all(f, '\p{L}+') AS alpha,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]')) AS lines FROM f)
    SELECT doc_id, len(toks)::INT AS n_words, round(list_sum(list_transform(toks, lambda x: length(x)))::DOUBLE / len(toks) + 1e-8, 6) AS mean_word_length,
           round(length(regexp_replace(t, '[\s\p{Z}\p{L}\p{N}\p{M}]', '', 'g'))::DOUBLE / length(regexp_replace(t, '[\s\p{Z}]', '', 'g')) + 1e-8, 6) AS symbol_ratio,
           round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…:;,)"''”»]\s*$')))::DOUBLE / len(lines) + 1e-8, 6) AS punctuated_lines,
           round(coalesce(len(list_filter(alpha, lambda x: list_contains(bag, x)))::DOUBLE / nullif(len(alpha), 0), 0) + 1e-8, 6) AS common_share
    FROM p, b
"""
