"""Problem 2: nested records into flat tables with parent and child keys.

JSON payloads come in many layouts. A bottom-up tree automaton gives every node of a parsed payload a state: leaves
by their type, arrays and objects by the states of their children. The state of a node is its structural variant: it
tells a text segment from a box, a column layout from a row layout, one reading from a list of readings, at any depth
of nesting. Nodes are routed by state to typed rows, all of which keep the keys of their supertypes:

* records:    record_id, variant, crop_path, field_name, class, split, ann_id
* readings:   record_id, reading_no, engine, variant, text, confidence, backend, needs_review, normalized_text
              (supertype of all reading variants)
* readings_<variant>: the supertype's keys and what readings of this variant have
* segments:   record_id, reading_no, engine, seg_no, variant, text, score (supertype of all segment variants)
* segments_<variant>: the supertype's keys and what the variant alone has (a polygon, a flat box, a column index)
* attributes: record_id, path, value: every leaf of members that no other table takes

The payload is parsed once, in one Arrow-batched pass without a shuffle; the tables are projections of its output.
Typed maps (``candidates`` of reviewed_sample) need no parsing: the same automaton runs over their structs as a native
expression, one step for each member in turn, and routes each reading to the table of its variant. The walk over a payload
uses no recursion, so depth does not matter as far as the JSON parser goes; deeper payloads count as incomplete.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Member names of the layouts.
BOX_LISTS = ("rec_polys", "dt_polys", "polys", "rec_boxes", "dt_boxes", "boxes", "bboxes")
BOX_NAMES = ("box", "dt_poly", "dt_box", "poly", "bbox")
READING_MEMBERS = frozenset({"confidence", "backend", "needs_review", "normalized_text", "raw_text", "segments", "raw"})
RECORD_MEMBERS = ("crop_path", "field_name", "class", "split", "ann_id")
SEGMENT_VARIANTS = ("object", "rec_object", "columns", "pair", "boxed_pair")

# States of the automaton.
NULL, BOOL, NUM, STR = "null", "bool", "num", "str"
EMPTY, POINT, SHAPE, STRINGS, PAIR, BOXED = "empty", "point", "shape", "strings", "pair", "boxed_pair"
OBJECT, REC, COLUMNS, WRAPPED, SEGMENTS = "object", "rec_object", "columns", "wrapped", "segments"
READING, READINGS, RECORD, OTHER = "reading", "readings", "record", "other"
_SEGMENT_STATES = frozenset({PAIR, BOXED, OBJECT, REC, COLUMNS, WRAPPED, SEGMENTS, EMPTY})


def _array_state(kids: list[str]) -> str:
    if not kids:
        return EMPTY
    found = set(kids)
    if len(kids) == 2 and kids[0] in (STR, NULL) and kids[1] in (NUM, NULL) and STR in found:
        return PAIR
    if len(kids) == 2 and kids[0] in (POINT, SHAPE, NULL, EMPTY) and kids[1] == PAIR:
        return BOXED
    if found == {NUM}:
        return POINT
    if found <= {POINT, NULL} and POINT in found:
        return SHAPE
    if found <= {STR, NULL} and STR in found:
        return STRINGS
    if READING in found:
        return READINGS
    if found & (_SEGMENT_STATES - {EMPTY}):
        return SEGMENTS  # elements of other states are routed one by one, to no table of segments
    return EMPTY if found <= {EMPTY, NULL} else OTHER


def _object_state(kids: dict[str, str]) -> str:
    if "candidates" in kids or "crop_path" in kids:
        return RECORD
    if "rec_texts" in kids:
        return COLUMNS
    if "rec_text" in kids:
        return REC
    if "res" in kids and kids["res"] in _SEGMENT_STATES:
        return WRAPPED
    if READING_MEMBERS & kids.keys():
        return READING
    if "text" in kids:
        return OBJECT
    return OTHER


# States of a reading, and the steps between them: (state, member, state of the member's value) -> state. The member is
# taken by what it is for; a step that is not listed leaves the state as it is.
VOID, SILENT, TEXT, SCORED, FORMED = "void", "silent", "text", "scored", "formed"
READING_VARIANTS = (VOID, SILENT, TEXT, SCORED, FORMED)
STEPS = {
    (VOID, "text", STR): TEXT, (VOID, "confidence", NUM): SILENT,
    (SILENT, "text", STR): SCORED, (TEXT, "confidence", NUM): SCORED,
    (SCORED, "raw_text", STR): FORMED, (SCORED, "normalized_text", STR): FORMED,
}
READING_ORDER = ("text", "confidence", "raw_text", "normalized_text")
# What the table of a variant has beside the keys.
VARIANT_MEMBERS = {
    VOID: ["backend", "needs_review"], SILENT: ["confidence", "backend", "needs_review"], TEXT: ["text", "backend", "needs_review"],
    SCORED: ["text", "confidence", "backend", "needs_review"], FORMED: ["text", "confidence", "backend", "needs_review", "raw_text", "normalized_text"],
}


def reading_variant(states: dict[str, str]) -> str:
    """The state that the automaton reaches over a reading's members."""
    at = VOID
    for member in READING_ORDER:
        at = STEPS.get((at, member, states.get(member, NULL)), at)
    return at


def _leaf(x: Any) -> str | None:
    if x is None:
        return NULL
    if isinstance(x, bool):
        return BOOL
    if isinstance(x, (int, float)):
        return NUM
    return STR if isinstance(x, str) else None


def classify(x: Any) -> tuple[str, Any]:
    """The state of ``x`` and, for arrays and objects, the (state, kids) trees of its children; bottom-up, without recursion."""
    work, done = [(x, False)], []
    while work:
        node, ready = work.pop()
        state = _leaf(node)
        if state:
            done.append((state, None))
        elif not ready:
            work.append((node, True))
            work.extend((v, False) for v in reversed(node if isinstance(node, list) else list(node.values())))
        else:
            at = len(done) - len(node)
            kids = done[at:]
            del done[at:]
            if isinstance(node, list):
                done.append((_array_state([k[0] for k in kids]), kids))
            else:
                named = dict(zip(node, kids, strict=True))
                done.append((_object_state({k: v[0] for k, v in named.items()}), named))
    return done[0]


def _number(x: Any) -> float | None:
    if isinstance(x, bool) or x is None:
        return None
    try:
        return float(x)
    except (TypeError, ValueError, OverflowError):
        return None


_ALONE = re.compile("[\ud800-\udfff]")  # halves of a pair, which no text can hold


def _text(x: Any) -> str | None:
    """A string as it is, other values as JSON; null if they are nested too deeply to be written."""
    if x is None or isinstance(x, str):
        return x
    try:
        return json.dumps(x, ensure_ascii=False)
    except RecursionError:
        return None


def _load(payload: str) -> Any:
    """The value of a complete JSON text; ValueError or RecursionError if it is none (NaN and infinities are none)."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    return json.loads(payload, parse_constant=refuse, parse_int=lambda d: int(d) if len(d) < 400 else float(d))


def _shape(x: Any) -> list[list[float]] | None:
    """A polygon as points; a flat box x1, y1, x2, y2 as its two corners; None if it is neither."""
    if not isinstance(x, list) or not x:
        return None
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in x):
        pts = list(zip(x[::2], x[1::2], strict=False))
    else:
        pts = [v for v in x if isinstance(v, list) and len(v) >= 2 and all(isinstance(n, (int, float)) for n in v[:2])]
    try:
        return [[float(p[0]), float(p[1])] for p in pts] or None
    except OverflowError:
        return None


def segments(x: Any, tree: tuple[str, Any]) -> Iterator[tuple[str, str | None, float | None, list | None, int | None]]:
    """Text segments below ``x`` in order: variant, text, score, box, column index."""
    work = [(x, tree)]
    while work:
        x, (state, kids) = work.pop()
        if state == PAIR:
            yield PAIR, x[0], _number(x[1]), None, None
        elif state == BOXED:
            yield BOXED, x[1][0], _number(x[1][1]), _shape(x[0]), None
        elif state == OBJECT:
            yield OBJECT, _text(x.get("text")), _number(x.get("score")), _shape(next((x[b] for b in BOX_NAMES if x.get(b)), None)), None
        elif state == REC:
            yield REC, _text(x.get("rec_text")), _number(x.get("rec_score")), _shape(next((x[b] for b in BOX_NAMES if x.get(b)), None)), None
        elif state == COLUMNS:
            texts = x["rec_texts"] if isinstance(x["rec_texts"], list) else []
            scores = x.get("rec_scores") if isinstance(x.get("rec_scores"), list) else []
            boxes = next((x[b] for b in BOX_LISTS if isinstance(x.get(b), list) and x[b]), [])
            for i, t in enumerate(texts):
                yield COLUMNS, _text(t), _number(scores[i]) if i < len(scores) else None, _shape(boxes[i]) if i < len(boxes) else None, i
        elif state == WRAPPED:
            work.append((x["res"], kids["res"]))
        elif state in (SEGMENTS, READINGS):
            work.extend(reversed(list(zip(x, kids, strict=True))))
        elif state == READING and "text" in x and not READING_MEMBERS - {"confidence"} & x.keys():
            yield OBJECT, _text(x["text"]), _number(x.get("confidence")), None, None


def leaves(x: Any, path: str) -> Iterator[tuple[str, str | None]]:
    """Paths and values of all leaves below ``x``, in order; a path is put together at its leaf only."""
    work: list[tuple[Any, Any]] = [(x, (None, path))]
    while work:
        x, at = work.pop()
        if isinstance(x, dict) and x:
            work.extend((v, (at, f".{k}")) for k, v in reversed(x.items()))
        elif isinstance(x, list) and x:
            work.extend((v, (at, f"[{i}]")) for i, v in reversed(list(enumerate(x))))
        else:
            parts = []
            while at:
                at, part = at
                parts.append(part)
            yield "".join(reversed(parts)), _text(x)


ROW = (
    "record_id bigint, kind string, variant string, reading_no int, engine string, seg_no int, text string, score double, "
    "box array<array<double>>, col_no int, backend string, needs_review boolean, raw_text string, normalized_text string, layout string, crop_path string, "
    "field_name string, class string, split string, ann_id bigint, path string, value string"
)
_FIELDS = [f.split()[0] for f in ROW.split(", ")]


def _readings(c: Any, tree: tuple[str, Any]) -> Iterator[tuple[str | None, Any, tuple[str, Any]]]:
    """Engine readings that are not null: engine as written, value, tree."""
    if isinstance(c, dict):
        for k, v in c.items():
            if v is not None:
                yield k, v, tree[1][k]
    elif isinstance(c, list):
        for v, t in zip(c, tree[1], strict=True):
            if v is not None:
                yield _text(v.get("backend")) if isinstance(v, dict) else None, v, t


def rows_of(record_id: int, payload: str | None) -> list[dict]:
    """All typed rows of one payload; none if it is null or no complete JSON."""
    if payload is None:
        return []
    try:
        x = _load(payload)
    except (ValueError, RecursionError):
        return []
    out: list[dict] = []
    state, kids = classify(x)
    rec = x if isinstance(x, dict) else {}
    ann = rec.get("ann_id")
    cand = rec.get("candidates")
    shape = "none" if cand is None else "map" if isinstance(cand, dict) else "list" if isinstance(cand, list) else "other"
    head = {k: _text(rec.get(k)) for k in RECORD_MEMBERS if k != "ann_id"}
    out.append({"kind": "record", "variant": f"{state}/{shape}", "ann_id": ann if isinstance(ann, int) and not isinstance(ann, bool) and -(2**63) <= ann < 2**63 else None} | head)
    for k, v in rec.items():
        if k not in RECORD_MEMBERS and k != "candidates":
            out += [{"kind": "attribute", "path": p, "value": s} for p, s in leaves(v, k)]
    if cand is not None:
        for no, (engine, r, tree) in enumerate(_readings(cand, kids["candidates"])):
            own = r if isinstance(r, dict) else {"text": r}
            under = next((k for k in ("segments", "raw") if own.get(k)), next((k for k in ("segments", "raw") if k in own), None))
            here = tree[1][under][0] if under and isinstance(r, dict) else "none"
            review = own.get("needs_review")
            states = {k: v[0] for k, v in tree[1].items()} if isinstance(r, dict) else {"text": tree[0]}
            # what is no string but stands where a text belongs is written as one
            variant = reading_variant({k: STR if k.endswith("text") and v != NULL else v for k, v in states.items()})
            out.append({
                "kind": "reading", "variant": variant, "layout": f"{under or 'none'}/{here}", "reading_no": no, "engine": engine, "text": _text(own.get("text")), "score": _number(own.get("confidence")),
                "backend": _text(own.get("backend")), "needs_review": review if isinstance(review, bool) else None, "raw_text": _text(own.get("raw_text")), "normalized_text": _text(own.get("normalized_text")),
            })
            n = 0
            if under and isinstance(r, dict):
                for variant, text, score, box, col in segments(own[under], tree[1][under]):
                    if text is not None and text.strip():
                        n += 1
                        out.append({"kind": "segment", "variant": variant, "reading_no": no, "engine": engine, "seg_no": n, "text": text, "score": score, "box": box, "col_no": col})
    for row in out:
        for k, v in row.items():
            if isinstance(v, str) and not v.isascii():
                row[k] = _ALONE.sub("\ufffd", v)
        row["record_id"] = record_id
    return out


def parse(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Typed rows of every payload (see ``ROW``), in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for k, p in zip(pdf["k"], pdf["p"], strict=True) for r in rows_of(k, p)]
            yield pd.DataFrame({f: pd.Series([r.get(f) for r in rows], dtype=object) for f in _FIELDS})

    return df.select(F.col(key).alias("k"), F.col(payload).alias("p")).mapInPandas(run, ROW)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The flat tables over parsed rows; materialize ``parsed`` first where several are written.

    Null and broken payloads give no row in any table. Payloads delivered twice give rows for each record_id.
    """
    kind = lambda k: parsed.filter(F.col("kind") == k)
    seg = kind("segment")
    out = {
        "records": kind("record").select("record_id", "variant", "crop_path", "field_name", "class", "split", "ann_id"),
        "readings": kind("reading").select("record_id", "reading_no", "engine", "variant", "layout", "text", F.col("score").alias("confidence"), "backend", "needs_review", "raw_text", "normalized_text"),
        "segments": seg.select("record_id", "reading_no", "engine", "seg_no", "variant", "text", "score"),
        "attributes": kind("attribute").select("record_id", "path", "value"),
    }
    for v in SEGMENT_VARIANTS:
        own = [] if v == "pair" else ["box"]
        out[f"segments_{v}"] = seg.filter(F.col("variant") == v).select("record_id", "reading_no", "seg_no", "text", "score", *own, *(["col_no"] if v == "columns" else []))
    return out | _reading_tables(out["readings"])


def _reading_tables(readings: DataFrame) -> dict[str, DataFrame]:
    keys = ["record_id", "reading_no", "engine"]
    return {f"readings_{v}": readings.filter(F.col("variant") == v).select(*keys, *own) for v, own in VARIANT_MEMBERS.items()}


def _variant(r: str, members: list[tuple[str, str]]) -> Column:
    """The state of a typed struct: the automaton's steps as a native expression, from member to member.

    ``members`` are the struct's own, with their states where they are not null.
    """
    known, at = dict(members), F.lit(VOID)
    for member in READING_ORDER:
        if member in known:
            step = F.lit(None).cast("string")
            for (here, name, kind), there in STEPS.items():
                if name == member and kind == known[member]:
                    step = F.when(at == here, there).otherwise(step)
            at = F.when(F.col(f"{r}.{member}").isNotNull(), F.coalesce(step, at)).otherwise(at)
    return at


def map_tables(df: DataFrame, key: str = "row_id", column: str = "candidates") -> dict[str, DataFrame]:
    """The flat tables of a typed map column: records, readings and readings_<variant>, linked by record_id.

    Null entries give no reading; a null or empty map none either, but its record has a row (shape none or empty).
    """
    shape = F.when(F.col(column).isNull(), "none").when(F.size(column) == 0, "empty").otherwise("map")
    readings = map_readings(df, key, column)
    return {"records": df.select(F.col(key).alias("record_id"), shape.alias("shape"), F.coalesce(F.size(column), F.lit(-1)).alias("entries")), "readings": readings} | _reading_tables(readings)


def map_readings(df: DataFrame, key: str = "row_id", column: str = "candidates") -> DataFrame:
    """Readings of a typed map column: record_id, reading_no, engine, variant and the reading's members.

    Null entries give no row; a null or empty map none either. The variant is the automaton's state.
    """
    e = df.select(F.col(key).alias("record_id"), F.posexplode(column).alias("reading_no", "engine", "r")).filter("r is not null")
    types = {"string": STR, "boolean": BOOL}
    members = [(f.name, types.get(f.dataType.simpleString(), NUM)) for f in e.schema["r"].dataType]
    return e.select("record_id", "reading_no", "engine", _variant("r", members).alias("variant"), *[F.col(f"r.{m}").alias(m) for m, _ in members])


def found(sample: DataFrame, raw: DataFrame) -> DataFrame:
    """All readings and segments of both tables: origin, record_id, engine, seg_no.

    Readings are those that the automaton has routed to the table of a variant, for both tables alike.
    """
    routed = map_readings(sample).filter(F.col("variant").isin(*READING_VARIANTS))
    a = routed.select(F.lit("reviewed_sample").alias("origin"), "record_id", "engine", F.lit(0).alias("seg_no"))
    b = parse(raw, "raw_id", "payload").filter("kind in ('reading', 'segment')")
    return a.unionByName(b.select(F.lit("reviewed_raw").alias("origin"), "record_id", "engine", F.coalesce("seg_no", F.lit(0)).alias("seg_no")))
