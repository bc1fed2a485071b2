"""Context memory over a stream of patches, changed in order by the same columns as in batch; windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tracelab.operators.context import EMPTY_CONTEXT, fold_contexts
from tracelab.schemas import PATCH

PATCHES = T.StructType([T.StructField("session", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("patch", PATCH), T.StructField("committed", T.BooleanType())])
CONTEXTS = T.StructType([T.StructField("session", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("context", EMPTY_CONTEXT)])
#: Every so many versions one holds all sessions; the others hold those that changed.
WHOLE_EVERY = 16


def contexts(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """The last turn and context of each session in the versions below ``before``: from the last whole one on."""
    whole = before // WHOLE_EVERY * WHOLE_EVERY - 1
    own = spark.read.schema(T.StructType([*CONTEXTS, T.StructField("version", T.LongType())])).parquet(f"{folder}/contexts")
    own = own.where((F.col("version") >= whole) & (F.col("version") < before))
    return own.groupBy("session").agg(F.max_by(F.struct("turn", "context"), "version").alias("x")).select("session", "x.*")


def remember(patches: DataFrame, folder: str) -> DataStreamWriter:
    """A writer for a stream of PATCHES. Of each batch it writes the contexts after each turn to ``folder``/turns and a version of the sessions' contexts to
    ``folder``/contexts; a batch that is run again, after a failure, writes the same places. Turns up to a session's last one, which came again or too late, are left out."""
    patches.sparkSession.createDataFrame([], CONTEXTS).write.mode("ignore").parquet(f"{folder}/contexts/version=-1")

    def step(batch: DataFrame, version: int) -> None:
        known = contexts(batch.sparkSession, folder, version)
        last = known.select("session", F.col("turn").alias("_last"), F.col("context").alias("_before"))
        fresh = batch.join(last, "session", "left").where(F.col("_last").isNull() | (F.col("turn") > F.col("_last"))).dropDuplicates(["session", "turn"])
        turns = f"{folder}/turns/version={version}"
        fold_contexts(fresh, "session", "turn", "_before").write.mode("overwrite").parquet(turns)
        now = batch.sparkSession.read.parquet(turns).groupBy("session").agg(F.max_by(F.struct("turn", "context"), "turn").alias("x")).select("session", "x.*")
        if version % WHOLE_EVERY == WHOLE_EVERY - 1:
            now = now.unionByName(known.join(now, "session", "left_anti"))
        now.write.mode("overwrite").parquet(f"{folder}/contexts/version={version}")

    return patches.writeStream.foreachBatch(step)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events (ts, event_type, value): counts and sums by window and type, final once the watermark has passed."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return own.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
