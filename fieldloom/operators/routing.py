"""What to do next with a reading or a picture: routes with reasons, as column formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _reasons(**conditions: Column) -> Column:
    """Names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]), lambda r: r.isNotNull())


def reading_route(conf: Column, retried: Column, conflict: Column, accept: float = 0.8, least: float = 0.5) -> Column:
    """take, check, again or drop, with reasons, from a confidence (null counts as 0).

    Below ``least`` a reading is read again once and then dropped; whatever is not simply taken needs a review.
    """
    c = F.coalesce(conf, F.lit(0.0))
    retried, conflict = F.coalesce(retried, F.lit(False)), F.coalesce(conflict, F.lit(False))
    route = F.when(c >= accept, F.when(conflict, "check").otherwise("take")).when(c >= least, "check").when(retried, "drop").otherwise("again")
    return F.struct(route.alias("route"), _reasons(low_confidence=(c < accept) & (c >= least), very_low_confidence=c < least, engines_differ=conflict).alias("reasons"))


def picture_route(card: Column, corners: Column, turn: Column, fields: Column) -> Column:
    """How a picture is processed on: stop, rectification, turn, missing fields, and reasons for a review.

    card: confidence of the card's detection; corners: how many were found; turn: confidence of the orientation;
    fields: how many of the six fields were found. Nulls count as 0.
    """
    card, turn = (F.coalesce(c, F.lit(0.0)) for c in (card, turn))
    corners, fields = (F.coalesce(c, F.lit(0)) for c in (corners, fields))
    grade = F.when(corners >= 4, "good").when(corners == 3, "estimated").otherwise("degraded")
    stop = F.when(card < 0.3, "no_card_detected").when((fields == 0) & (grade == "degraded"), "partial_result")
    missing = F.when(fields >= 4, "none").when(fields >= 1, "template_for_missing").when(grade == "degraded", "none").otherwise("template_for_all")
    reasons = _reasons(weak_card=(card >= 0.3) & (card < 0.5), estimated_corner=grade == "estimated", degraded_rectification=grade == "degraded", unclear_turn=turn < 0.12, few_fields=fields < 4)
    return F.struct(stop.alias("stop"), grade.alias("grade"), (turn >= 0.12).alias("turned"), missing.alias("template"), reasons.alias("reasons"))
