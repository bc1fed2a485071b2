"""Conversations in durable rounds: a round of all open conversations is one job, and its result a written table.

A table for each round holds the conversations that were open before it, with their rounds so far and, for those that ended, how. When it is whole, a record beside it says so, with
counts. A run that stops is taken up after its last whole round: the model is never asked again for rounds that are whole. A lost task repeats its own conversations' round only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.operators.checks import round_limits
from tracelab.operators.generation import CONVERSATION, _round
from tracelab.sources.backends import Backend
from tracelab.sources.control import claim, get_object, put_object

_ROUND = pa.struct([("round_index", pa.int32()), ("mode", pa.string()), ("strategy", pa.string()), ("seeker", pa.string()), ("supporter", pa.string())])
_ROW = pa.schema([("conversation_id", pa.string()), ("status", pa.string()), ("failed_stage", pa.string()), ("error", pa.string()), ("rounds", pa.list_(_ROUND))])
STATE = "conversation_id string, status string, failed_stage string, error string, rounds " + CONVERSATION.rpartition("rounds ")[2]


def ended(rounds: list[dict], most: int) -> str | None:
    if rounds and rounds[-1]["mode"] == "closing":
        return "completed"
    return "truncated" if len(rounds) >= most else None


def superstep(open_: DataFrame, factory: Callable[[], Backend], most: int, seed: int) -> DataFrame:
    """open_: STATE rows without status. The same after one more round each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for b in batches:
            out = []
            for conversation, rounds in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rounds, row = list(rounds or []), {"conversation_id": conversation, "failed_stage": None, "error": None}
                status = ended(rounds, most)
                if status is None:
                    try:
                        public = [x for r in rounds for x in (r["seeker"], r["supporter"])]
                        rounds.append(_round(backend, conversation, seed, public, len(rounds) + 1, rounds[-1]["mode"] if rounds else None, [r["strategy"] for r in rounds[-3:]]))
                        status = ended(rounds, most)
                    except RuntimeError as e:
                        status, row["failed_stage"], row["error"] = "failed", e.args[0], e.args[1]
                out.append(row | {"status": status, "rounds": rounds})
            yield pa.RecordBatch.from_pylist(out, _ROW)

    tasks = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # calls take time however small their rows are
    return open_.select("conversation_id", "rounds").repartition(tasks).mapInArrow(run, STATE)


def converse(profiles: DataFrame, factory: Callable[[], Backend], folder: str, limits: tuple[int, int, int] = (1, 8, 12), seed: int = 42, resume: bool = False, on_round: Callable[[dict[str, Any]], None] | None = None) -> DataFrame:
    """profiles: conversation_id and, to go on from, rounds. CONVERSATION rows as of ``generation.generate``, from tables under ``folder``.

    A new run needs an empty folder, a resumed one a folder of a run with the same limits and seed. ``on_round`` is told of every round that becomes whole: its number, how many
    conversations it had, and how many are open, completed, truncated and failed after it."""
    spark, folder = profiles.sparkSession, folder.rstrip("/")
    round_limits(*limits)
    claim(spark, f"{folder}/manifest.json", {"limits": list(limits), "seed": seed}, resume)
    table = lambda n: spark.read.schema(STATE).parquet(f"{folder}/round={n}")
    tell = lambda n: get_object(spark, f"{folder}/round={n}.json")
    whole = -1
    while (record := tell(whole + 1)) is not None:
        whole, last = whole + 1, record
    if whole < 0:
        kind = STATE.rpartition("rounds ")[2]
        own = profiles.select(F.col("conversation_id").cast("string"), (F.col("rounds") if "rounds" in profiles.columns else F.lit(None)).cast(kind).alias("rounds"))
        nothing = F.lit(None).cast("string")
        whole, last = 0, _commit(own.select("conversation_id", nothing.alias("status"), nothing.alias("failed_stage"), nothing.alias("error"), "rounds"), folder, 0)
    while last["open"]:
        whole += 1
        last = _commit(superstep(table(whole - 1).where("status IS NULL"), factory, limits[2], seed), folder, whole)
        if on_round:
            on_round(last)
    every = table(0)
    for n in range(1, whole + 1):
        every = every.unionByName(table(n))
    done = every.where("status IS NOT NULL")
    return done.select("conversation_id", "status", F.size("rounds").alias("completed_rounds"), F.try_element_at("rounds", F.lit(-1))["mode"].alias("final_mode"), "failed_stage", "error", "rounds")


def _commit(rows: DataFrame, folder: str, n: int) -> dict[str, Any]:
    """Writes a round's table, in place of what a run that stopped left of it, and then its record."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{folder}/round={n}")
    counts = {r["status"]: r["count"] for r in spark.read.schema(STATE).parquet(f"{folder}/round={n}").groupBy("status").count().collect()}
    record = {"round": n, "conversations": sum(counts.values()), "open": counts.get(None, 0)} | {s: counts.get(s, 0) for s in ("completed", "truncated", "failed")}
    put_object(spark, f"{folder}/round={n}.json", record)
    return record
