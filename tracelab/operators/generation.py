"""Conversations and replies made by a backend: a keyed loop, resumed from whole rounds, with failures as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.operators.checks import round_limits
from tracelab.sources.backends import Backend, call

CONVERSATION = "conversation_id string, status string, completed_rounds int, final_mode string, failed_stage string, error string, rounds array<struct<round_index:int,mode:string,strategy:string,seeker:string,supporter:string>>"
MODES = ("exploring", "supporting", "closing")


def _round(backend: Backend, conversation: str, seed: int, public: list[str], index: int, mode: str | None, recent: list[str]) -> dict:
    """One round; a step that fails raises with its stage as first argument."""

    def ask(stage: str, **what: object) -> dict:
        try:
            reply = json.loads(backend.complete(stage, json.dumps({"conversation": conversation, "round": index, "public": public} | what, ensure_ascii=False), seed + index))
        except Exception as e:
            raise RuntimeError(stage, f"{type(e).__name__}: {e}") from e
        return reply if isinstance(reply, dict) else {}

    said = str(ask("seeker_simulator").get("text") or "")
    if not said.strip():
        raise RuntimeError("seeker_simulator", "empty utterance")
    try:
        chosen = ask("dialogue_manager", previous=mode, last=said).get("mode")
    except RuntimeError:
        chosen = None
    kept = chosen if chosen in MODES else mode or MODES[0]  # a decision that can't be read keeps the mode
    answer = ask("teacher", last=said, mode=kept, recent=recent)
    if not str(answer.get("text") or "").strip():
        raise RuntimeError("teacher", "empty reply")
    return {"round_index": index, "mode": kept, "strategy": str(answer.get("strategy") or "Others"), "seeker": said, "supporter": str(answer["text"])}


def generate(profiles: DataFrame, factory: Callable[[], Backend], limits: tuple[int, int, int] = (1, 8, 12), seed: int = 42) -> DataFrame:
    """profiles: conversation_id and, to resume, rounds. CONVERSATION rows: completed when the mode closes, truncated after the most rounds, else failed."""
    round_limits(*limits)
    own = profiles if "rounds" in profiles.columns else profiles.withColumn("rounds", F.lit(None).cast(CONVERSATION.rpartition("rounds ")[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for b in batches:
            out = []
            for conversation, rounds in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rounds = list(rounds or [])
                row = {"conversation_id": conversation, "status": None, "failed_stage": None, "error": None}
                while row["status"] is None:
                    last = rounds[-1]["mode"] if rounds else None
                    if last == "closing" or len(rounds) >= limits[2]:
                        row["status"] = "completed" if last == "closing" else "truncated"
                        break
                    try:
                        public = [x for r in rounds for x in (r["seeker"], r["supporter"])]
                        rounds.append(_round(backend, conversation, seed, public, len(rounds) + 1, last, [r["strategy"] for r in rounds[-3:]]))
                    except RuntimeError as e:
                        row |= {"status": "failed", "failed_stage": e.args[0], "error": e.args[1]}
                out.append(row | {"completed_rounds": len(rounds), "final_mode": rounds[-1]["mode"] if rounds else None, "rounds": rounds})
            round_type = pa.struct([("round_index", pa.int32()), ("mode", pa.string()), ("strategy", pa.string()), ("seeker", pa.string()), ("supporter", pa.string())])
            schema = pa.schema([("conversation_id", pa.string()), ("status", pa.string()), ("completed_rounds", pa.int32()), ("final_mode", pa.string()), ("failed_stage", pa.string()), ("error", pa.string()), ("rounds", pa.list_(round_type))])
            yield pa.RecordBatch.from_pylist(out, schema)

    return own.select(F.col("conversation_id").cast("string"), "rounds").mapInArrow(run, CONVERSATION)


def responses(traces: DataFrame, models: list[dict], factory: Callable[[], Backend], asked_by: Callable[..., DataFrame] = call) -> tuple[DataFrame, DataFrame]:
    """traces: split, example_id, prompt, final_response. A reply for each model (the teacher's is reused), and failures. asked_by: what makes the calls, ``call`` or one with a cache."""
    base = traces.select("split", "example_id", "prompt", "final_response")
    done = failed = None
    for m in models:
        own = base.withColumn("model_id", F.lit(m["model_id"]))
        if m["source"] == "teacher":
            good = own.select("split", "example_id", "model_id", F.col("final_response").alias("response"), F.lit(True).alias("reused"))
            bad = None
        else:
            key = F.to_json(F.array("split", "example_id"))
            asked = own.select(key.alias("request_id"), F.lit(m["model_id"]).alias("role"), F.to_json(F.array("prompt")).alias("messages"), F.lit(m.get("seed")).cast("long").alias("seed"))
            got = own.withColumn("request_id", key).join(asked_by(asked, factory, namespace=m["model_id"]), "request_id").withColumn("response", F.get_json_object("reply", "$.text"))
            some = F.coalesce(F.length(F.trim("response")) > 0, F.lit(False))
            good = got.where(some).select("split", "example_id", "model_id", "response", F.lit(False).alias("reused"))
            bad = got.where(~some).select("split", "example_id", "model_id", F.coalesce("error", F.lit("empty response")).alias("error"))
        done = good if done is None else done.unionByName(good)
        if bad is not None:
            failed = bad if failed is None else failed.unionByName(bad)
    return done, failed if failed is not None else base.select("split", "example_id", F.lit("").alias("model_id"), F.lit("").alias("error")).limit(0)
