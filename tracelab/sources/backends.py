"""Model calls behind one interface, with a cache table in front.

A backend is made in each task by a factory that can be sent there. Calls whose keys the cache holds aren't made. Failures are rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.operators.traces import cache_key


class Backend(Protocol):
    def complete(self, role: str, messages: str, seed: int | None) -> str: ...


class Scripted:
    """A deterministic stand-in: a JSON reply derived from role, messages and seed."""

    def __init__(self, replies: dict[str, str] | None = None):
        self.replies = replies or {}

    def complete(self, role: str, messages: str, seed: int | None) -> str:
        if role in self.replies:
            return self.replies[role]
        own = hashlib.sha256(f"{role}\0{messages}\0{seed}".encode()).digest()
        return json.dumps({"text": own[:6].hex(), "scores": [1 + b % 5 for b in own[6:11]]})


def call(requests: DataFrame, factory: Callable[[], Backend], cache: DataFrame | None = None, namespace: str = "", attempts: int = 2) -> DataFrame:
    """requests: request_id, role, messages (JSON text), seed. request_id, call_key, reply, error, attempt and cached."""
    keyed = requests.withColumn("call_key", cache_key(namespace, F.col("role"), F.col("messages"), F.col("seed")))
    columns = "request_id string, call_key string, reply string, error string, attempt int, cached boolean"
    if cache is None:
        missed, found = keyed, None
    else:
        joined = keyed.join(cache.select("call_key", F.col("payload").alias("reply")), "call_key", "left")
        found = joined.where("reply IS NOT NULL").select("request_id", "call_key", "reply", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempt"), F.lit(True).alias("cached"))
        missed = joined.where("reply IS NULL").drop("reply")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for b in batches:
            replies, errors, tries = [], [], []
            for role, messages, seed in zip(*(b.column(c).to_pylist() for c in ("role", "messages", "seed")), strict=True):
                reply = error = None
                for attempt in range(1, attempts + 1):
                    try:
                        reply = backend.complete(role, messages, seed)
                        json.loads(reply)
                        error = None
                        break
                    except Exception as e:  # a failed call is a row, not a failed job
                        reply, error = None, f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
                tries.append(attempt)
            yield pa.RecordBatch.from_pydict({"request_id": b.column("request_id"), "call_key": b.column("call_key"), "reply": pa.array(replies, pa.string()), "error": pa.array(errors, pa.string()), "attempt": pa.array(tries, pa.int32()), "cached": pa.array([False] * b.num_rows)})

    made = missed.select(F.col("request_id").cast("string").alias("request_id"), "call_key", "role", "messages", F.col("seed").cast("long").alias("seed")).mapInArrow(run, columns)
    return made if found is None else made.unionByName(found.withColumn("request_id", F.col("request_id").cast("string")))


def judged(responses: DataFrame, factory: Callable[[], Backend], seed: int | None = None, asked_by: Callable[..., DataFrame] = call) -> tuple[DataFrame, DataFrame]:
    """responses: split, example_id, model_id, response. Judgments (five scores) and failures."""
    from tracelab.schemas import DIMENSIONS

    key = F.to_json(F.array("split", "example_id", "model_id"))
    asked = responses.withColumn("request_id", key).select("request_id", F.lit("judge").alias("role"), F.to_json(F.struct("response")).alias("messages"), F.lit(seed).cast("long").alias("seed"))
    got = asked_by(asked, factory).withColumn("s", F.from_json("reply", "scores array<int>")["scores"])
    ok = (F.size("s") == len(DIMENSIONS)) & F.forall("s", lambda x: x.between(1, 5))
    whole = responses.withColumn("request_id", key).join(got.withColumn("_ok", F.coalesce(ok, F.lit(False))), "request_id")
    scores = [F.col("s")[i].alias(d) for i, d in enumerate(DIMENSIONS)]
    return whole.where("_ok").select("split", "example_id", "model_id", *scores), whole.where("NOT _ok").select("split", "example_id", "model_id", F.coalesce("error", F.lit("scores out of range")).alias("error"))
