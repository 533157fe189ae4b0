"""Command line: python -m fieldloom evaluate | queue | labels | manifest | statistics (see --help of each)."""

from __future__ import annotations

import argparse
import dataclasses
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import cards, ensemble, evaluate, quality, review
from fieldloom.runtime import build_session, ship
from fieldloom.sources import files, schemas

LOG = logging.getLogger("fieldloom")


def _arrivals(rows: DataFrame) -> DataFrame:
    """Rows with row_id, the order of arrival, where the records have none of their own."""
    return rows.withColumn("row_id", F.monotonically_increasing_id())


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Error rates of each engine as JSON and CSV, and the worst readings as JSON lines."""
    s = evaluate.scored(files.read_jsonl(spark, a.input, schemas.REVIEWED), spaces=not a.keep_spaces, fold_case=not a.keep_case)
    rates = evaluate.summary(s)
    document = files.summary_document(rates)
    files.write_json(spark, document, f"{a.output}/summary.json")
    files.write_summary_csv(rates, f"{a.output}/summary.csv")
    files.write_jsonl(evaluate.top_errors(s, a.worst), f"{a.output}/top_errors.jsonl", single=True)
    LOG.info("%s", {k: v["overall"] for k, v in document.items()})


def run_queue(spark: SparkSession, a: argparse.Namespace) -> None:
    """A review queue from a preset and what is given beside it."""
    given = {k: v for k, v in (("splits", a.splits and tuple(a.splits)), ("buckets", a.buckets and tuple(a.buckets)), ("needs_review", a.needs_review or None), ("min_conf", a.min_conf), ("max_conf", a.max_conf), ("sort", a.sort), ("limit", a.limit)) if v is not None}
    path = files.first_existing(spark, a.input, a.candidates)
    rows = review.select(_arrivals(files.read_jsonl(spark, path, schemas.REVIEWED)), dataclasses.replace(review.PRESETS[a.preset], **given))
    files.write_jsonl(rows.drop("row_id"), a.output, single=True)
    LOG.info("%s: %s", path, a.output)


def run_labels(spark: SparkSession, a: argparse.Namespace) -> None:
    """Pseudo labels from records with both readings."""
    files.write_jsonl(ensemble.pseudo_labels(_arrivals(files.read_jsonl(spark, a.input, schemas.REVIEWED))).drop("row_id"), a.output)


def _dataset(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of all splits below the root, in one id space."""
    t = files.read_coco(spark, files.find_documents(spark, a.root, tuple(a.splits)))
    keyed = files.union_rekeyed(t["images"], list(a.splits)).withColumnRenamed("new_id", "image_id")
    link = keyed.select("split", F.col("id").alias("old_id"), F.col("image_id").alias("new_id"))
    boxes = quality.enrich(t["annotations"].withColumnRenamed("image_id", "old_id"), link, t["categories"], on=["split", "old_id"])
    side = [F.get("bbox", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xywh")]
    return keyed.drop("id"), boxes.select(F.col("new_id").alias("image_id"), "id", F.col("id").alias("seq"), "class", *side)


def run_manifest(spark: SparkSession, a: argparse.Namespace) -> None:
    """The manifest of field crops of a data set's documents and picture folders."""
    images, boxes = _dataset(spark, a)
    index = files.picture_index(files.read_pictures(spark, a.root).select("path"))
    rows = cards.manifest(images, boxes, index, a.fields, a.folder, a.padding, a.card_padding, a.least, not a.no_rectify)
    files.write_jsonl(rows if a.limit is None else rows.orderBy("annotation_id").limit(a.limit), a.output)


def run_statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    """Statistics of a data set's documents as one JSON document."""
    images, boxes = _dataset(spark, a)
    none = images.select("image_id", F.lit(None).cast("double").alias("mean")).limit(0)
    files.write_json(spark, quality.statistics_document(quality.dataset_statistics(images, boxes, none)), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldloom")
    p.add_argument("--log-level", default="INFO")
    commands = p.add_subparsers(required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        c = commands.add_parser(name, help=run.__doc__)
        c.set_defaults(run=run)
        for flag, how in options:
            c.add_argument(flag, **how)

    needed, many, flag = {"required": True}, {"nargs": "*"}, {"action": "store_true"}
    command("evaluate", run_evaluate, ("--input", needed), ("--output", needed), ("--worst", {"type": int, "default": 20}), ("--keep-case", flag), ("--keep-spaces", flag))
    command(
        "queue", run_queue, ("--input", {}), ("--candidates", many | {"default": ["pseudo_labels.jsonl"]}), ("--output", needed), ("--preset", {"choices": sorted(review.PRESETS), "default": "custom"}), ("--splits", many), ("--buckets", many),
        ("--needs-review", flag), ("--min-conf", {"type": float}), ("--max-conf", {"type": float}), ("--sort", {"choices": ["none", "best_conf_asc", "best_conf_desc", "source_image"]}), ("--limit", {"type": int}),
    )
    command("labels", run_labels, ("--input", needed), ("--output", needed))
    data = ("--root", needed), ("--splits", many | {"default": ["train", "val", "test"]}), ("--output", needed)
    command(
        "manifest", run_manifest, *data, ("--fields", many | {"default": list(quality.FIELD_CLASSES)}), ("--folder", {"default": "crops"}), ("--padding", {"type": float, "default": 0.04}),
        ("--card-padding", {"type": float, "default": 0.05}), ("--least", {"type": int, "default": 12}), ("--no-rectify", flag), ("--limit", {"type": int}),
    )
    command("statistics", run_statistics, *data)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level, format="%(asctime)s %(levelname)s %(message)s")
    session = spark or build_session()
    ship(session)
    a.run(session, a)


if __name__ == "__main__":
    main()
