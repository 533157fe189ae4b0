"""Session and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def build_session(app: str = "fieldloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is tested with; a cluster's own settings win."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session whose executors run on this machine (tests); on a cluster
    such a folder would be read back incomplete, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldloom_path = path
    return out


def in_order(df: DataFrame, *keys) -> DataFrame:
    """``df`` in a global order, written: _part and _at give a row's range of the order and its place within it.

    Ranges are of like size whatever the ties, because ``keys`` end in what tells rows apart; no task orders all rows.
    """
    place = F.monotonically_increasing_id()  # the partition above bit 33, the row's place in it below
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(d.withColumns({"_part": F.shiftright(place, 33).cast("int"), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")


def numbered(df: DataFrame, name: str, *keys) -> DataFrame:
    """``df`` with consecutive numbers from 0 in the order of ``keys``."""
    o = in_order(df, *keys)
    per = o.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return o.join(F.broadcast(per.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def discard(df: DataFrame) -> None:
    """Delete the table behind a materialized frame that nothing reads any more."""
    path = getattr(df, "_fieldloom_path", None)
    if not path:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once a context; needless where it is installed on them."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="fieldloom-ship-")) / "fieldloom_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path(here.name) / p.relative_to(here)))
    sc.addPyFile(str(target))
    _SHIPPED[sc.applicationId] = str(target)


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` wrote into the shared folder; frames over them can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/fieldloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
