"""A cache of model calls that is written: equal requests are made once, what came of them is kept, and a second run makes no call.

The cache is a folder of parts. A part counts from when its record, a JSON file beside it, is there; the record of a compaction names the parts that it replaces. Records appear
in one step, so that writers needn't know of each other: what two of them made of equal requests stands twice until it is compacted, and the smaller text counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators.traces import cache_key
from tracelab.sources.backends import Backend, call
from tracelab.sources.control import _files, put_object
from tracelab.sources.staging import staged

_PART = "call_key string, payload string, bucket int"
#: Files of a compacted cache, by the first digits of a key.
BUCKETS = 64


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """The parts that count, by name."""
    system, place = _files(spark, folder)
    if not system.util().exists(place):
        return []
    names = [s.getPath().getName() for s in system.util().listStatus(place)]
    records = [n for n in names if n.startswith("part-") and n.endswith(".json")]
    if not records:
        return []
    rows = spark.read.schema("replaces array<string>").option("multiLine", True).json([f"{folder}/{n}" for n in records]).collect()  # a row for each part
    gone = {x for r in rows for x in r["replaces"] or []}
    return sorted(n.removesuffix(".json") for n in records if n.removesuffix(".json") not in gone)


def _bucket(key) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """call_key and payload of all calls that are kept, each key once."""
    folder = folder.rstrip("/")
    parts = _parts(spark, folder)
    if not parts:
        return spark.createDataFrame([], "call_key string, payload string")
    own = spark.read.schema(_PART).parquet(*(f"{folder}/{p}" for p in parts))
    return own.groupBy("call_key").agg(F.min("payload").alias("payload"))


def keep(rows: DataFrame, folder: str, replaces: list[str] | None = None) -> None:
    """Adds a part with rows of call_key and payload."""
    folder = folder.rstrip("/")
    part = f"part-{uuid.uuid4().hex}"
    rows.select("call_key", "payload", _bucket("call_key").alias("bucket")).write.parquet(f"{folder}/{part}")
    put_object(rows.sparkSession, f"{folder}/{part}.json", {"replaces": replaces or []})


def compact(spark: SparkSession, folder: str) -> int:
    """All parts in one, each key once and those of a bucket in one file; how many parts were replaced. Runs that read the old parts meanwhile still find them."""
    parts = _parts(spark, folder.rstrip("/"))
    if len(parts) > 1:
        keep(cached(spark, folder).repartition(BUCKETS, _bucket(F.col("call_key"))), folder, parts)
    return len(parts) if len(parts) > 1 else 0


def memoised(requests: DataFrame, factory: Callable[[], Backend], folder: str, namespace: str = "", attempts: int = 2) -> DataFrame:
    """requests: request_id, role, messages, seed. Rows as of ``backends.call``, ``cached`` for those whose reply was kept before. Requests that are equal but for their ids make one call.

    Replies are kept in the cache at ``folder`` before anything is returned; failed calls aren't, and are made again by a later run."""
    spark = requests.sparkSession
    key = cache_key(namespace, F.col("role"), F.col("messages"), F.col("seed").cast("long"))
    own = requests.select(F.col("request_id").cast("string").alias("request_id"), "role", "messages", F.col("seed").cast("long").alias("seed"), key.alias("call_key"))
    known = cached(spark, folder)
    once = own.groupBy("call_key").agg(F.first("role").alias("role"), F.first("messages").alias("messages"), F.first("seed").alias("seed"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # calls take time however small their rows are: they aren't merged into few tasks
    missed = once.join(known, "call_key", "left_anti").withColumnRenamed("call_key", "request_id").repartition(tasks)
    made = staged(call(missed, factory, namespace=namespace, attempts=attempts).drop("call_key").withColumnRenamed("request_id", "call_key"), "calls")
    found = staged(own.select("call_key").distinct().join(known, "call_key"), "calls-known")
    good = made.where("reply IS NOT NULL")
    if not good.isEmpty():
        keep(good.select("call_key", F.col("reply").alias("payload")), folder)
    every = made.select("call_key", "reply", "error", "attempt", "cached").unionByName(found.select("call_key", F.col("payload").alias("reply"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempt"), F.lit(True).alias("cached")))
    return own.select("request_id", "call_key").join(every, "call_key").select("request_id", "call_key", "reply", "error", "attempt", "cached")
