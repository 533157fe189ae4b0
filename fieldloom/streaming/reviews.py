"""Structured Streaming over deliveries and events (an extension: the batch operators have no streams).

All queries take a streaming or a batch frame, since the plan is the same; late rows are bounded by a watermark, and
state is dropped behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATE = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 16) -> DataFrame:
    """New Parquet files of a folder as they arrive, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Rows and sums in windows of fixed width by kind."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sliding(events: DataFrame, ts: str = "ts", width: str = "2 hours", slide: str = "1 hour", late: str = LATE) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Runs of a key's rows with no pause longer than ``gap``."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str, ts: str, late: str = "7 days") -> DataFrame:
    """Each key once within the watermark: deliveries that come again are dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, checkpoint: str, out: str, mode: str = "append"):
    """All that is there now, into Parquet, exactly once; the next run goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType())])
BEST = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType())])


def running_best(events: DataFrame) -> DataFrame:
    """Per key: rows so far and the best value, with the state held by the engine."""
    import pandas as pd

    def update(key, batches, state):
        n, best = state.get if state.exists else (0, float("-inf"))
        for pdf in batches:
            n += len(pdf)
            best = max(best, float(pdf["value"].max()))
        state.update((n, best))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "best": [best]})

    return events.groupBy("user_id").applyInPandasWithState(update, BEST, STATE, "update", "NoTimeout")
