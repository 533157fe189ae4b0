"""Readers and writers: JSON lines, annotation documents, picture folders, label text, CSV and Markdown."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldloom.functions import geometry as G
from fieldloom.runtime import shared_dir
from fieldloom.sources import schemas


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One record a line; blank lines and a byte order mark are skipped, members beyond the schema ignored.

    A line that is no JSON gives a row of nulls, which stays in place and can be counted.
    """
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """One record a line, nulls written out, letters beyond ASCII as they are. ``single`` makes one file of it."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_coco(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Annotation documents by split as flat tables images, annotations and categories, each with its split."""
    docs = None
    for split, path in paths.items():
        d = spark.read.schema(schemas.COCO).option("multiLine", "true").json(_visible(spark, path)).withColumn("split", F.lit(split))
        docs = d if docs is None else docs.unionByName(d)
    if docs is None:
        raise ValueError("no annotation document given")
    return explode_coco(docs)


def _visible(spark: SparkSession, path: str) -> str:
    """``path``, or a copy in the shared folder of a file that scans pass over because its name begins with _ or a point."""
    if not path.rstrip("/").rsplit("/", 1)[-1].startswith(("_", ".")):
        return path
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, target = hadoop.Path(path), hadoop.Path(f"{shared_dir(spark)}/fieldloom/document-{uuid.uuid4().hex}.json")
    hadoop.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    return target.toString()


def explode_coco(docs: DataFrame) -> dict[str, DataFrame]:
    flat = lambda c: docs.select("split", F.explode(c).alias("r")).select("split", "r.*")
    return {"images": flat("images"), "annotations": flat("annotations"), "categories": docs.select(F.explode("categories").alias("r")).select("r.*").distinct()}


def picture_index(paths: DataFrame, column: str = "path") -> DataFrame:
    """file_name -> path of pictures, by file name; the smallest path wins where a name comes twice."""
    p = F.regexp_replace(F.col(column), r"\\", "/")
    return (
        paths.filter(F.lower(p).rlike(r"\.(jpg|jpeg|png)$")).select(F.regexp_extract(p, r"([^/]+)$", 1).alias("file_name"), p.alias("path"))
        .groupBy("file_name").agg(F.min("path").alias("path"))
    )


def read_pictures(spark: SparkSession, root: str) -> DataFrame:
    """path, length and content of all pictures below a folder; a scan that needs no content never loads it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(root)


def write_pictures(df: DataFrame, path: str) -> None:
    """Pictures (columns file_name and content) as table of binaries: one file a task; ``write_files`` makes a file a picture."""
    df.select("file_name", "content").write.mode("overwrite").parquet(path)


def data_uri(content: Column, kind: str = "jpeg") -> Column:
    return F.when(content.isNull() | (F.length(content) == 0), "").otherwise(F.concat(F.lit(f"data:image/{kind};base64,"), F.base64(content)))


def reindex(images: DataFrame, annotations: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and annotations of the kept image ids, renumbered from 0 in order of their ids.

    Numbers come from sums over ranges of ids and ranks within a range, so no task orders all rows.
    """
    kept = images.join(keep.select("image_id").distinct(), images.id == F.col("image_id"), "left_semi")
    new = number(kept, "id", "new_id")
    imgs = new.drop("id").withColumnRenamed("new_id", "id")
    link = new.select(F.col("id").alias("old_image"), F.col("new_id").alias("new_image"))
    anns = annotations.join(link, annotations.image_id == F.col("old_image")).drop("old_image", "image_id").withColumnRenamed("new_image", "image_id")
    return imgs, number(anns, "id", "new_id").drop("id").withColumnRenamed("new_id", "id")


def coco_lines(images: DataFrame, annotations: DataFrame, categories: DataFrame, description: str = "", version: str = "") -> DataFrame:
    """An annotation document as its lines in order (part, no, line): images and annotations renumbered from 0 (``reindex``)."""
    head = {"info": {"description": description, "version": version}, "licenses": [], "categories": [r.asDict() for r in categories.orderBy("id").collect()]}  # a few classes
    text = json.dumps(head, ensure_ascii=False)[:-1]
    fixed = images.sparkSession.createDataFrame([(0, -1, text + ', "images": ['), (2, -1, '], "annotations": ['), (4, -1, "]}")], "part int, no long, line string")
    comma = F.when(F.col("id") > 0, ",").otherwise("")
    body = lambda df, part: df.select(F.lit(part).alias("part"), F.col("id").cast("long").alias("no"), F.concat(comma, F.to_json(F.struct("*"))).alias("line"))
    return fixed.unionByName(body(images, 1)).unionByName(body(annotations, 3))


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, keep: DataFrame | None = None, **about: str) -> None:
    """An annotation document of the images in ``keep`` (image_id; all if none is given), in one text file below ``path``.

    The lines are sorted in all tasks and written by one, a line at a time, so no document has to fit in memory.
    """
    keep = images.select(F.col("id").alias("image_id")) if keep is None else keep
    imgs, anns = reindex(images, annotations, keep)
    lines = coco_lines(imgs, anns, categories, **about).repartitionByRange("part", "no").sortWithinPartitions("part", "no")
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)


def find_documents(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "val", "valid", "test"), name: str = "_annotations.coco.json") -> dict[str, str]:
    """Annotation documents below ``root`` by split: <split>/<name> or <split>.json; splits without one are left out."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for split in splits:
        for candidate in (f"{root.rstrip('/')}/{split}/{name}", f"{root.rstrip('/')}/{split}.json"):
            if split not in found and fs.exists(path_of(candidate)):
                found[split] = candidate
    return found


def first_existing(spark: SparkSession, given: str | None, candidates: list[str]) -> str:
    """``given`` if there is one, else the first of the candidates that exists, else the first."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda p: path_of(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path_of(p))
    return given or next((c for c in candidates if there(c)), candidates[0])


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    """A summary that the driver holds, as an indented JSON document in one file below ``path``."""
    spark.createDataFrame([(json.dumps(payload, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def summary_document(summary: DataFrame) -> dict:
    """Rates of ``evaluate.summary`` nested by engine: overall, and per field. As many rows as engines and fields."""
    out: dict = {}
    for r in summary.orderBy("engine", "scope", "field_name").collect():
        rates = {k: r[k] for k in ("count", "cer", "wer", "exact_match_rate")}
        own = out.setdefault(r.engine, {"overall": None, "per_field": {}})
        if r.scope == "overall":
            own["overall"] = rates
        else:
            own["per_field"][r.field_name] = rates
    return out


def write_files(df: DataFrame, root: str) -> None:
    """A file for each row (columns path, relative to ``root``, and content, text or bytes), written by the tasks that hold it.

    ``root``: a folder that all executors mount. Meant for tools that need files; tables are the better store. Files
    are put in place whole, so a task that runs again leaves the same; rows without content are left out.
    """

    def save(rows) -> None:
        import os

        for r in rows:
            if r.content is None:
                continue
            target = os.path.join(root, r.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.{os.getpid()}", "wb") as f:
                f.write(r.content.encode() if isinstance(r.content, str) else bytes(r.content))
            os.replace(f"{target}.{os.getpid()}", target)

    df.select("path", "content").foreachPartition(save)


def write_label_files(labels: DataFrame, root: str) -> None:
    """Label texts (split, file_name, label) as <root>/<split>/<stem>.txt."""
    stem = F.regexp_replace(F.regexp_extract("file_name", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    write_files(labels.select(F.concat_ws("/", "split", F.concat(stem, F.lit(".txt"))).alias("path"), F.col("label").alias("content")), root)


def number(df: DataFrame, order: str, name: str, width: int = 1 << 20) -> DataFrame:
    """``df`` with consecutive numbers from 0 by a whole-number column, in two steps."""
    cell = F.floor(F.col(order) / width)
    d = df.withColumn("_cell", cell)
    per = d.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_cell", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(order)) - 1
    return d.withColumn("_r", rank).join(per, "_cell").withColumn(name, F.col("_before") + F.col("_r")).drop("_cell", "_r", "_before")


def union_rekeyed(images: DataFrame, order: list[str]) -> DataFrame:
    """Images of several splits in one id space: each split's ids follow the largest of the splits before it."""
    top = images.groupBy("split").agg((F.max("id") + 1).alias("span"))
    rank = F.element_at(F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))]), F.col("split"))
    offset = F.coalesce(F.sum("span").over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a split
    return images.join(F.broadcast(top.select("split", offset.alias("offset"))), "split").withColumn("new_id", F.col("id") + F.col("offset")).drop("offset")


def yolo_labels(images: DataFrame, annotations: DataFrame, classes: list[str]) -> DataFrame:
    """image_id and label text of every image: a line a box of a wanted class, empty text for an image without one."""
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")).cast("int") - 1
    y = G.yolo(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    boxes = annotations.filter(F.col("class").isin(classes)).join(images.select("image_id", "width", "height"), "image_id").withColumn("q", y)
    up = 1e-10  # a tie of the seventh place goes up, whatever the last bit of the quotient
    line = F.format_string("%d %.6f %.6f %.6f %.6f", index, *[F.col(f"q.{c}") + up for c in ("cx", "cy", "w", "h")])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda s: s.line), "\n")
    per = boxes.groupBy("image_id").agg(text.alias("label"))
    return images.select("image_id").join(per, "image_id", "left").select("image_id", F.coalesce("label", F.lit("")).alias("label"))


def yolo_config(classes: list[str], root: str) -> str:
    """The text of a data set description file."""
    return "\n".join([f"path: {root}", "train: images/train", "val: images/val", "test: images/test", f"nc: {len(classes)}", f"names: {json.dumps(classes)}", ""])


def yolo_verify(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Per split: pictures, label files and whether they are as many."""
    a, b = images.groupBy("split").agg(F.count("*").alias("n_images")), labels.groupBy("split").agg(F.count("*").alias("n_labels"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "split", "full").select("split", z("n_images").alias("n_images"), z("n_labels").alias("n_labels"), (z("n_images") == z("n_labels")).alias("ok"))


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """Rates with the overall row ('*') of each engine first."""
    cols = ["engine", "scope", "field_name", "count", "cer", "wer", "exact_match_rate"]
    summary.select(*cols).orderBy("engine", (F.col("scope") != "overall"), "field_name").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def markdown_table(df: DataFrame, limit: int = 20) -> str:
    """A report table of at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)]) + "\n"
