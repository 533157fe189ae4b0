"""The hook by which recognisers run: any object with ``predict(image, field)``, loaded once a worker.

On it stand the runs with two recognisers: ``both`` chooses between their readings, ``hybrid`` finds the value among
one recogniser's lines and has the other read the part of the picture where it stands.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from fieldloom.functions import geometry as G
from fieldloom.functions import pixels
from fieldloom.functions import text as T
from fieldloom.operators import ensemble, linepick, nested
from fieldloom.runtime import materialize

READING = "crop_id long, text string, score double, engine string, error string"
LINE = "crop_id long, field_name string, idx int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"
NO_PICTURE = "no picture"
LEAST_PART = (24, 12)  # sides of the smallest part of a picture that is worth reading again


class Recogniser(Protocol):
    def predict(self, image: Any, field: str | None) -> Any: ...


_LOADED: dict[str, Any] = {}

# What each kind of recogniser gets around a crop (shares of its sides, least pixels) and the least height
# of its picture, for fields of digits and for others.
PICTURES = {ensemble.PADDLE: ((0.08, 0.12), 6, (96, 128)), ensemble.VIET: ((0.06, 0.10), 4, (64, 80))}
DIGIT_FIELDS = ("id_number", "date_of_birth")


def pick_device(wanted: str, gpu_there: bool) -> str:
    """cpu or gpu for auto, cpu, gpu or a name with cuda; raises where a wanted gpu is not there."""
    kind = wanted.strip().lower()
    if kind == "cpu" or (kind == "auto" and not gpu_there):
        return "cpu"
    if kind != "auto" and kind != "gpu" and not kind.startswith("cuda"):
        raise ValueError(f"unknown device {wanted}")
    if not gpu_there:
        raise RuntimeError(f"{wanted} is wanted but no gpu is there")
    return "gpu"


def fitting(call: Callable, options: dict[str, Any]) -> dict[str, Any]:
    """Those of the options that ``call`` takes by name; all where its signature is open or cannot be read."""
    try:
        params = inspect.signature(call).parameters
    except (TypeError, ValueError):
        return dict(options)
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in params.values()):
        return dict(options)
    return {k: v for k, v in options.items() if k in params}


class Adapter:
    """A recogniser library behind ``predict(image, field)``.

    make: what builds the client, called on first use and once more if ``repair`` says that a failure can be mended
    (a broken cache, say). method: name of the client's call; asked: options of it that not every version takes.
    """

    def __init__(self, engine: str, make: Callable[..., Any], method: str = "predict", options: dict | None = None, asked: dict | None = None, repair: Callable[[Exception], bool] | None = None, convert: Callable[[Any], Any] | None = None):
        self.engine, self.make, self.method, self.options, self.asked, self.repair, self.convert = engine, make, method, options or {}, asked or {}, repair, convert
        self._client: Any = None

    def client(self) -> Any:
        if self._client is None:
            build = lambda: self.make(**fitting(self.make, self.options))
            try:
                self._client = build()
            except Exception as e:
                if self.repair is None or not self.repair(e):
                    raise
                self._client = build()
        return self._client

    def picture(self, image: Any, field: str | None) -> Any:
        share, least, heights = PICTURES[self.engine]
        long = T.FIELDS.get(field or "", field)
        return pixels.reading_picture(image, share, least, heights[0] if long in DIGIT_FIELDS else heights[1])

    def predict(self, image: Any, field: str | None) -> Any:
        call = getattr(self.client(), self.method)
        shown = self.picture(image, field)
        return call(shown if self.convert is None else self.convert(shown), **fitting(call, self.asked))


def parse_prediction(p: Any) -> tuple[str, float | None]:
    """Text and score of a prediction: a mapping, a pair or a text. No score, or one that is no number, is null."""
    get = lambda d, names: next((d[n] for n in names if d.get(n)), None)
    if isinstance(p, dict):
        text, score = get(p, ("text", "prediction", "pred")), get(p, ("prob", "confidence", "score")) or 0.0
    elif isinstance(p, (tuple, list)) and len(p) >= 2:
        text, score = p[0], p[1]
    else:
        text, score = p, None
    try:
        return str(text or ""), None if score is None else float(score)
    except (TypeError, ValueError):
        return str(text or ""), None


def recognise(crops: DataFrame, load: Callable[[], Recogniser], engine: str, raw_width: int | None = None) -> DataFrame:
    """crop_id, text, score, engine, error for crops (crop_id, field_name, content).

    A picture that cannot be decoded or a failing recogniser gives an empty text and an error, never a failed task.
    Raw gray pictures have ``raw_width``, or each its own in a column of that name.
    """
    own = "raw_width" in crops.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    if engine not in _LOADED:
                        _LOADED[engine] = load()
                    image = pixels.decode(r.content, int(r.raw_width) if own else raw_width)
                    if image is None or image.size == 0:
                        raise ValueError(NO_PICTURE)
                    text, score = parse_prediction(_LOADED[engine].predict(image, r.field_name))
                    rows.append((r.crop_id, text, score, engine, None))
                except Exception as e:
                    rows.append((r.crop_id, "", 0.0, engine, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["crop_id", "text", "score", "engine", "error"])

    return crops.select("crop_id", "field_name", "content", *(["raw_width"] if own else [])).mapInPandas(run, READING)


def recognise_lines(crops: DataFrame, load: Callable[[], Recogniser], engine: str, raw_width: int | None = None) -> DataFrame:
    """crop_id, field_name, idx, text, confidence, x1, y1, x2, y2: the lines of whatever layout a recogniser predicts.

    The prediction is flattened by the automaton of nested records. A failure gives a crop no line.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    if engine not in _LOADED:
                        _LOADED[engine] = load()
                    image = pixels.decode(r.content, raw_width)
                    found = [] if image is None else _LOADED[engine].predict(image, r.field_name)
                    for i, (_, text, score, box, _) in enumerate(nested.segments(found, nested.classify(found))):
                        xs, ys = ([p[k] for p in box] for k in (0, 1)) if box else ([None], [None])
                        rows.append((r.crop_id, r.field_name, i, text, score, min(xs), min(ys), max(xs), max(ys)) if box else (r.crop_id, r.field_name, i, text, score, None, None, None, None))
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["crop_id", "field_name", "idx", "text", "confidence", "x1", "y1", "x2", "y2"])

    return crops.select("crop_id", "field_name", "content").mapInPandas(run, LINE)


@F.pandas_udf(types.StructType([types.StructField("content", types.BinaryType()), types.StructField("raw_width", types.IntegerType())]))
def _cut(content: pd.Series, width: pd.Series, box: pd.DataFrame) -> pd.DataFrame:
    """The part of raw gray pictures within whole-pixel boxes."""
    rows = []
    for c, w, b in zip(content, width, box.itertuples(index=False), strict=True):
        a = pixels.decode(c, int(w))
        part = None if a is None else a[max(b.y1, 0) : b.y2, max(b.x1, 0) : b.x2]
        rows.append((None, 0) if part is None or part.size == 0 else (part.tobytes(), part.shape[1]))
    return pd.DataFrame(rows, columns=["content", "raw_width"])


def finish(readings: DataFrame, field: Column) -> DataFrame:
    """Raw readings cleaned, calibrated (a missing score is estimated) and judged: clean, conf, form, needs_review."""
    d = readings.withColumn("f", T.canonical_field(field)).withColumn("clean", T.cleanup(F.col("text"), F.col("f")))
    raw = F.coalesce("score", T.estimated_confidence(F.col("text"), F.col("f")))
    d = d.withColumn("conf", T.calibrated_confidence(F.col("clean"), raw, F.col("f"))).withColumn("form", T.field_form(F.col("clean"), F.col("f")))
    return d.withColumn("needs_review", (F.col("conf") < 0.5) | (F.col("form") == "")).drop("f")


def both(crops: DataFrame, viet: Callable[[], Recogniser], paddle: Callable[[], Recogniser], raw_width: int | None = None, m: ensemble.Margins | None = None) -> DataFrame:
    """crop_id, engine, reason, margin, text, score, form, needs_review, errors: the choice between two recognisers.

    A crop without a picture has the engine 'ensemble', the reason 'empty_image', no text and a review; a recogniser
    that fails counts as one that read nothing, and its error is kept.
    """
    fields = crops.select("crop_id", "field_name")
    sides = []
    for load, engine, text, conf in ((viet, ensemble.VIET, "text_vietocr", "conf_vietocr"), (paddle, ensemble.PADDLE, "text_paddle", "conf_paddle")):
        r = finish(recognise(crops, load, engine, raw_width).join(fields, "crop_id"), F.col("field_name"))
        sides.append(r.select("crop_id", F.col("clean").alias(text), F.col("conf").alias(conf), F.col("error").alias(f"error_{engine}")))
    d = fields.join(sides[0], "crop_id").join(sides[1], "crop_id")
    c = ensemble.choose(ensemble.features(d, cleaned=True), m)
    errors = F.array_compact(F.array(f"error_{ensemble.VIET}", f"error_{ensemble.PADDLE}"))
    blank = F.coalesce(F.col(f"error_{ensemble.VIET}").contains(NO_PICTURE), F.lit(False))
    either = lambda a, b: F.when(blank, a).otherwise(b)
    return c.select(
        "crop_id", either("ensemble", F.col("e_engine")).alias("engine"), either("empty_image", F.col("e_reason")).alias("reason"), either(F.lit(0.0), F.col("e_margin")).alias("margin"), either("", F.col("e_text")).alias("text"),
        either(F.lit(0.0), F.col("e_score")).alias("score"), either("", F.col("e_form")).alias("form"), (blank | F.col("e_review")).alias("needs_review"), errors.alias("errors"),
    )


def hybrid(crops: DataFrame, viet: Callable[[], Recogniser], paddle: Callable[[], Recogniser], raw_width: int) -> DataFrame:
    """crop_id, field_name, paddle (refined text), paddle_conf, viet, viet_conf, part: 'whole' or 'part'.

    crops: raw gray pictures of one width. The second recogniser's lines are searched for the value; where it has a
    box that is large enough, the first one reads that part too, and the better of its two readings is kept.
    """
    crops = crops.withColumn("field_name", T.canonical_field(F.col("field_name")))
    lines = materialize(recognise_lines(crops, paddle, f"{ensemble.PADDLE}-lines", raw_width), "lines")  # recognised once, read by three branches
    joined = linepick.joined_text(lines.select("crop_id", "idx", "text", ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.col("x1").alias("x")))
    base = crops.select("crop_id", "field_name").join(joined, "crop_id", "left").join(lines.groupBy("crop_id").agg(F.avg("confidence").alias("conf")), "crop_id", "left")
    base = base.withColumns({"raw_text": F.col("text"), "text": T.collapse(F.col("text"))})
    found = linepick.refine(lines, base).select("crop_id", "field_name", "new_text", "new_conf", "kind", *linepick.BOX)
    at = found.join(crops.select("crop_id", "content"), "crop_id").withColumn("height", F.floor(F.length("content") / raw_width))
    box = G.pixel_window(G.expand(G.box(*[F.col(c) for c in linepick.BOX]), F.lit(raw_width), F.col("height"), F.col("kind") == "same_line"))
    at = at.filter("x1 is not null").withColumn("box", box).filter((F.col("box.x2") - F.col("box.x1") >= LEAST_PART[0]) & (F.col("box.y2") - F.col("box.y1") >= LEAST_PART[1]))
    parts = at.select("crop_id", "field_name", _cut("content", F.lit(raw_width), "box").alias("c")).select("crop_id", "field_name", "c.*").filter("content is not null")
    read = lambda pictures, width, to: finish(recognise(pictures, viet, ensemble.VIET, width).join(crops.select("crop_id", "field_name"), "crop_id"), F.col("field_name")).select("crop_id", F.col("clean").alias(to), F.col("conf").alias(f"{to}_conf"), F.lit(True).alias(f"has_{to}"))
    d = found.join(read(crops, raw_width, "whole"), "crop_id", "left").join(read(parts, None, "part"), "crop_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    pick = F.when(F.col("has_part"), linepick.whole_or_part(T.canonical_field(F.col("field_name")), F.col("whole"), z("whole_conf"), F.col("part"), z("part_conf"), F.col("new_text"))).otherwise("whole")
    d = d.withColumn("pick", pick)
    better = lambda a, b: F.when(F.col("pick") == "part", F.col(b)).otherwise(F.col(a))
    return d.select("crop_id", "field_name", F.col("new_text").alias("paddle"), F.col("new_conf").alias("paddle_conf"), better("whole", "part").alias("viet"), better("whole_conf", "part_conf").alias("viet_conf"), F.col("pick").alias("part"))


def empty_result(engine: str) -> Column:
    return F.struct(F.lit("").alias("text"), F.lit(0.0).alias("score"), F.lit(engine).alias("engine"), F.lit(True).alias("needs_review"), F.lit("").alias("form"))
