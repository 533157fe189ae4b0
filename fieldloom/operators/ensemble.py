"""Choice between two recognisers' readings of a crop, as column formulas.

Inputs are columns of one row: field (long name), texts and confidences of both readings. Every choice is a ladder of
cases over features that are computed once (forms, doubts, scores); a ladder gives the winner's name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text as T

VIET, PADDLE = "vietocr", "paddleocr"


# Differences of confidence that decide, and the confidence under which a reading is weak.
@dataclass(frozen=True)
class Margins:
    close: float = 0.08  # closer readings with different texts need a review
    long_default: float = 0.12
    long_clear: float = 0.35
    long_step: float = 0.20
    name_bias: float = 0.08
    name_length: float = 0.12
    weak: float = 0.5


def ladder(*cases: tuple[Column, str], otherwise: str) -> Column:
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def features(df: DataFrame, field: str = "field_name", viet: str = "text_vietocr", paddle: str = "text_paddle", viet_conf: str = "conf_vietocr", paddle_conf: str = "conf_paddle", cleaned: bool = False) -> DataFrame:
    """``df`` with f (long field name), and for both readings: form (v_form, p_form), score (v, p), doubt (v_bad, p_bad)."""
    f = T.canonical_field(F.col(field))
    out = df.withColumn("f", f)
    for k, t, c in (("v", viet, viet_conf), ("p", paddle, paddle_conf)):
        out = out.withColumns({f"{k}_form": T.field_form(F.col(t), F.col("f")), k: F.coalesce(F.col(c), F.lit(0.0)), f"{k}_bad": F.coalesce(T.suspicious(F.col(t), F.col("f"), cleaned), F.lit(False))})
    return out


def _verdict(engine: str, reason: str) -> Column:
    return F.struct(F.lit(engine).alias("engine"), F.lit(reason).alias("reason"))


def _first(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    out = F
    for cond, value in cases:
        out = out.when(cond, value)
    return out.otherwise(otherwise)


def long_text_winner(m: Margins) -> Column:
    """Engine and reason for a place: texts that are there, then those beyond doubt, then by a bias for the second engine."""
    has_v, has_p = F.col("v_form") != "", F.col("p_form") != ""
    default = _verdict(PADDLE, "paddle_long_text_default")
    return _first(
        (has_p & ~has_v, _verdict(PADDLE, "long_text_nonempty")), (has_v & ~has_p, _verdict(VIET, "long_text_nonempty")),
        (F.col("v_bad") & ~F.col("p_bad"), _verdict(PADDLE, "viet_suspicious_long_text")), (F.col("p_bad") & ~F.col("v_bad"), _verdict(VIET, "paddle_suspicious_long_text")),
        (F.col("p") >= F.col("v") - m.long_default, default), (F.col("v") > F.col("p") + max(m.close + m.long_step, m.long_clear), _verdict(VIET, "viet_long_text_confidence")), otherwise=default,
    )


def name_winner(m: Margins) -> Column:
    """Engine and reason for a name: as for a place, with a bias for the first engine."""
    has_v, has_p = F.col("v_form") != "", F.col("p_form") != ""
    longer = (F.length("v_form") >= F.length("p_form")) & (F.col("v") >= F.col("p") - m.name_length)
    bias = _verdict(VIET, "viet_name_bias")
    return _first(
        (has_v & ~has_p, _verdict(VIET, "name_nonempty")), (has_p & ~has_v, _verdict(PADDLE, "name_nonempty")),
        (F.col("p_bad") & ~F.col("v_bad"), _verdict(VIET, "paddle_suspicious_name")), (F.col("v_bad") & ~F.col("p_bad"), _verdict(PADDLE, "viet_suspicious_name")),
        (F.col("v") >= F.col("p") - m.name_bias, bias), (longer, _verdict(VIET, "viet_name_length_bias")), (F.col("p") > F.col("v") + m.close, _verdict(PADDLE, "paddle_name_confidence")), otherwise=bias,
    )


def pattern_winner() -> Column:
    ok = lambda c: F.when(F.col("f") == "id_number", T.valid_id(F.col(c))).otherwise(T.valid_date(F.col(c)))
    v, p = ok("v_form"), ok("p_form")
    return _first((v & ~p, _verdict(VIET, "pattern_match")), (p & ~v, _verdict(PADDLE, "pattern_match")), (F.col("p") > F.col("v"), _verdict(PADDLE, "higher_confidence")), otherwise=_verdict(VIET, "higher_confidence"))


def choose(df: DataFrame, m: Margins | None = None, viet: str = "text_vietocr", paddle: str = "text_paddle") -> DataFrame:
    """``df`` with e_engine (agree, vietocr or paddleocr), e_reason, e_margin, e_text, e_form, e_score, e_review and e_candidates.

    Equal non-empty forms agree: the better score, no review. Otherwise the field decides how. A reading that is weak,
    empty, doubtful, or close to a different one needs a review. e_candidates holds both readings by engine.
    """
    m = m or Margins()
    out = features(df, viet=viet, paddle=paddle) if "v_form" not in df.columns else df
    same = (F.col("v_form") != "") & (F.col("v_form") == F.col("p_form"))
    by_score = _first((F.col("p") > F.col("v"), _verdict(PADDLE, "higher_confidence")), otherwise=_verdict(VIET, "higher_confidence"))
    winner = (
        F.when(same, _verdict("agree", "same_text")).when(F.col("f").isin("id_number", "date_of_birth"), pattern_winner()).when(F.col("f").isin(*T.PLACES), long_text_winner(m))
        .when(F.col("f") == "full_name", name_winner(m)).otherwise(by_score)
    )
    out = out.withColumn("e", winner).withColumns({"e_engine": F.col("e.engine"), "e_reason": F.col("e.reason"), "e_margin": F.abs(F.col("v") - F.col("p"))}).drop("e")
    from_p = F.when(same, F.col("p") > F.col("v")).otherwise(F.col("e_engine") == PADDLE)
    pick = lambda a, b: F.when(from_p, F.col(b)).otherwise(F.col(a))
    out = out.withColumns({"e_text": pick(viet, paddle), "e_form": pick("v_form", "p_form"), "e_score": pick("v", "p")})
    side = lambda text, k: F.struct(F.col(text).alias("text"), F.col(k).alias("score"), F.col(f"{k}_form").alias("form"))
    out = out.withColumn("e_candidates", F.create_map(F.lit(VIET), side(viet, "v"), F.lit(PADDLE), side(paddle, "p")))
    close = (F.col("v_form") != F.col("p_form")) & (F.col("e_margin") < m.close)
    weak = (F.col("e_score") < m.weak) | (F.col("e_form") == "") | pick("v_bad", "p_bad") | close
    return out.withColumn("e_review", F.when(same, False).otherwise(weak))


def safer(field: Column, base: Column, base_conf: Column, other: Column, other_conf: Column) -> Column:
    """'base' or 'other': a second reading replaces the first only if it is no worse.

    Empty readings lose; then doubtful ones; then a much shorter one without a clear gain; places may win by a little
    more score or by more text; all else needs 0.05 more.
    """
    f = T.canonical_field(field)
    b, o = F.coalesce(base_conf, F.lit(0.0)), F.coalesce(other_conf, F.lit(0.0))
    nb, no = F.length(F.trim(T.text(base))), F.length(F.trim(T.text(other)))
    bad_b, bad_o = T.suspicious(base, f), T.suspicious(other, f)
    part = lambda share: F.greatest(F.lit(4), F.bround(nb * share).cast("int"))
    place = F.coalesce(f.isin(*T.PLACES), F.lit(False))
    return ladder(
        (no == 0, "base"), (nb == 0, "other"), (bad_b & ~bad_o, "other"), (bad_o & ~bad_b, "base"),
        ((no < part(0.60)) & (o < b + 0.10), "base"),
        (place & (((o > b + 0.06) & (no >= part(0.70))) | ((no > nb + 6) & (o >= b - 0.02))), "other"),
        (place, "base"), (o > b + 0.05, "other"), otherwise="base",
    )


def pseudo_labels(candidates: DataFrame, m: Margins | None = None) -> DataFrame:
    """Label rows from crops with both readings: cleaned texts, calibrated scores, the choice, bucket and review flag."""
    d = candidates.withColumn("f", T.canonical_field(F.col("field_name")))
    for t, c in (("text_vietocr", "conf_vietocr"), ("text_paddle", "conf_paddle")):
        d = d.withColumns({t: T.cleanup(F.col(t), F.col("f"))}).withColumn(c, T.calibrated_confidence(F.col(t), F.col(c), F.col("f"), True))
    d = choose(features(d.drop("f"), cleaned=True), m)
    keep = [c for c in ("row_id", "crop_path", "field_name", "split", "ann_id", "ground_truth_text") if c in d.columns]
    return d.select(
        *keep, "text_vietocr", "conf_vietocr", "text_paddle", "conf_paddle", F.col("e_text").alias("best_text"), F.col("e_score").alias("best_conf"),
        F.col("e_engine").alias("best_source"), F.col("e_form").alias("best_normalized_text"), F.col("e_review").alias("needs_review"), T.bucket(F.col("e_score")).alias("review_bucket"),
    )


def flag_fields(df: DataFrame, first_year: int = 1900, last_year: int | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Rows with reasons: hard (the value cannot be one) and soft (it is unlikely), from the reviewed or best value.

    Years of birth before ``first_year`` or after ``last_year`` (the current one if none is given) are unlikely, and so
    are numbers of the right length that begin with none of ``prefixes`` (three digits each), where these are given.
    """
    latest = F.year(F.current_date()) if last_year is None else F.lit(last_year)
    f, x = T.canonical_field(F.col("field_name")), T.collapse(F.col("value"))
    iso = T.iso_date(x)
    year = F.substring(iso, 1, 4).cast("int")
    reason = lambda cond, name: F.when(cond, F.lit(name))
    rules = F.array(
        reason(x == "", "empty"), reason((f == "id_number") & ~T.valid_id(x), "id_not_12_digits"),
        reason((f == "id_number") & T.valid_id(x) & ~F.substring(T.digits(x), 1, 3).isin(prefixes or []) & F.lit(prefixes is not None), "unknown_prefix"), reason((f == "date_of_birth") & iso.isNull(), "no_date"),
        reason((f == "date_of_birth") & ((year < first_year) | (year > latest)), "year_out_of_range"), reason((f == "full_name") & x.rlike(r"\p{Nd}"), "digits_in_name"),
        reason((f == "full_name") & (F.size(T.words(x)) < 2), "single_name"),
    )
    return df.withColumn("reasons", F.filter(rules, lambda r: r.isNotNull()))


def autocorrect_digits(c: Column) -> Column:
    """Letters that recognisers put for digits, put right."""
    return F.translate(T.text(c), "OoBlIS", "008115")
