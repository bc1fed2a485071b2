"""Intermediate tables in the folder that the driver and the executors share, and numbers over all rows of one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, as in local tests, a folder of the session's own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracelab-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table: its lineage ends there, and a lost executor doesn't lose it."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, columns: Sequence[str | Column], name: str) -> DataFrame:
    """df with ``name``, its place from 1 in the order of columns over all rows; no task sees all rows.

    Rows are put into ranges, sorted and written once, each with its part and its place there. The parts' sizes are counted from what was written, and a row for each part says how
    many rows stand before it: rows and counts come from the same files, whatever columns a caller takes later and however the plan merges partitions. Equal rows get different
    numbers; rows whose columns are all equal stay in one range."""
    part, place = (_free(df.columns, x) for x in ("_part", "_place"))
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    rows = staged(ranged.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))), "numbered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(part).agg(F.count("*").alias("_n")).select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))  # a row for each part
    own = rows.join(F.broadcast(base.select(F.col(part).alias("_p"), "_b")), F.col(part) == F.col("_p"))
    return own.select(*(rows[c] for c in df.columns if c != name), (F.col("_b") + F.col(place) + 1).alias(name))


def _free(columns: Sequence[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name
