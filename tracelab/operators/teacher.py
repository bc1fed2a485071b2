"""Traces made by a model, stage by stage over all histories at once: context, state, plan, a candidate for each strategy, selection.

Each stage is one job that asks for all rows that are still whole, and its result a written table: no call is repeated by what reads it later, and with a cache (``memo.memoised``) none by
a later run. Seeds come from a call's own ids. A row whose reply can't be used fails in its stage; only a context patch that can't be read isn't fatal: it counts as empty, with an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions import numbers as N
from tracelab.functions import text as X
from tracelab.operators.checks import first_problem, history_rules, patch_rules, plan_rules, state_rules
from tracelab.operators.context import EMPTY_CONTEXT, merge_columns, read_patch
from tracelab.operators.traces import fan_out, select_candidate, shown_order
from tracelab.schemas import CALL_RECORD, CANDIDATE, CONTEXT_FIELDS, STATE_ANALYSIS, TRACE
from tracelab.sources.backends import Backend, call
from tracelab.sources.staging import staged

FAILURE = "example_id string, split string, stage string, error string"


def recent(turns: Column) -> Column:
    """The last turn, after the supporter's before it, if it is one."""
    return F.when(F.try_element_at(turns, F.lit(-2))["role"] == "supporter", F.slice(turns, -2, 2)).otherwise(F.slice(turns, F.greatest(F.size(turns), F.lit(1)), F.lit(1)))


class _Run:
    def __init__(self, factory: Callable[[], Backend], asked_by: Callable[..., DataFrame], protocol: str):
        self.factory, self.asked_by, self.protocol = factory, asked_by, protocol
        self.failed: DataFrame | None = None

    def ask(self, rows: DataFrame, role: str, message: Column, slot: Column | None = None) -> DataFrame:
        """rows with ``reply``, ``error`` and ``record``, the call's record."""
        parts = [F.col("example_id"), *([] if slot is None else [slot])]
        seed = N.stable_seed(self.protocol, F.col("example_id"), role, *([] if slot is None else [slot]))
        keyed = rows.withColumn("request_id", F.to_json(F.array(*parts)))
        requests = keyed.select("request_id", F.lit(role).alias("role"), F.to_json(message).alias("messages"), seed.alias("seed"))
        got = self.asked_by(requests, self.factory, namespace=self.protocol).select("request_id", "reply", "error", "attempt", "cached")
        no = F.lit(False)
        record = F.struct(F.lit(role).alias("role"), F.col("attempt").cast("int").alias("attempt"), F.col("reply").alias("raw_text"), F.col("reply").alias("parsed"), no.alias("schema_retry"), no.alias("metadata_fallback"), F.col("cached").alias("cached"))
        return keyed.join(got, "request_id").withColumn("record", record.cast(CALL_RECORD)).drop("request_id", "attempt", "cached")

    def passed(self, rows: DataFrame, stage: str, problem: Column) -> DataFrame:
        """The rows without a problem, from a written table; the others are kept as failures of the stage."""
        marked = staged(rows.withColumn("_problem", F.coalesce("error", problem)), f"teacher-{stage}")
        bad = marked.where("_problem IS NOT NULL").select("example_id", "split", F.lit(stage).alias("stage"), F.col("_problem").alias("error"))
        self.failed = bad if self.failed is None else self.failed.unionByName(bad)
        return marked.where("_problem IS NULL").drop("_problem", "reply", "error")


def run(examples: DataFrame, factory: Callable[[], Backend], asked_by: Callable[..., DataFrame] = call, protocol: str = "trace-1") -> tuple[DataFrame, DataFrame]:
    """examples: example_id (each once), split, history and, if there is one, context_before. Traces (TRACE) and failures (FAILURE)."""
    own = _Run(factory, asked_by, protocol)
    empty = F.struct(*(F.array().cast("array<string>").alias(f) for f in CONTEXT_FIELDS))
    before = F.coalesce("context_before", empty) if "context_before" in examples.columns else empty
    rows = examples.select("example_id", "split", "history", before.cast(EMPTY_CONTEXT).alias("context_before"), F.lit(None).cast("string").alias("error"))
    rows = own.passed(rows, "history", first_problem(history_rules()))

    asked = own.ask(rows, "context_updater", F.struct(recent(F.col("history.turns")).alias("turns"), F.col("context_before").alias("context")))
    read = asked.withColumn("_read", read_patch(F.col("reply"))).withColumn("context_patch", F.col("_read.patch"))
    wrong = F.coalesce(F.col("error"), F.col("_read.error"), F.when(F.col("context_patch").isNotNull(), first_problem(patch_rules("context_patch", CONTEXT_FIELDS))))
    read = read.withColumn("_wrong", F.when(wrong.isNotNull(), F.concat(F.lit("context updater failed: "), wrong))).withColumn("context_patch", F.when(F.col("_wrong").isNull(), F.col("context_patch")))
    merged = merge_columns(read, "context_before", "context_patch")
    errors = F.concat(F.array_compact(F.array("_wrong")), F.col("context_merge_errors"))
    rows = own.passed(merged.withColumns({"context_merge_errors": errors, "call_records": F.array("record"), "error": F.lit(None).cast("string")}).drop("_read", "_wrong", "record"), "context", F.lit(None).cast("string"))

    asked = own.ask(rows, "multi_view_state_analyzer", F.struct("history", F.col("context_after").alias("context")))
    asked = _recorded(asked).withColumn("state_analysis", F.from_json("reply", STATE_ANALYSIS)).withColumn("state", F.col("state_analysis.state"))
    rows = own.passed(asked, "state", first_problem(state_rules()))

    asked = _recorded(own.ask(rows, "planner", F.struct("history", "state", F.col("context_after").alias("context"))))
    rows = own.passed(asked.withColumn("plan", F.from_json("reply", "strategies array<string>")), "plan", first_problem(plan_rules()))

    slots = fan_out(rows.select("example_id", "plan.strategies")).join(rows.select("example_id", "split", "history", "state", F.col("context_after").alias("context")), "example_id")
    asked = own.ask(slots, "candidate", F.struct("history", "state", "context", "strategy"), F.col("strategy_id"))
    said = {c: F.coalesce(F.get_json_object("reply", f"$.{c}"), F.lit("")) for c in ("response", "response_goal", "response_act")}
    seed = N.stable_seed(protocol, F.col("example_id"), "candidate", F.col("strategy_id")).cast("int").alias("seed")
    candidate = F.struct("candidate_id", "strategy_id", "strategy", *(v.alias(c) for c, v in said.items()), seed)
    candidate = F.struct(*(candidate[f].alias(f) for f in CANDIDATE.names))
    blank = F.coalesce("error", F.when(~X.not_blank(said["response"]), "a candidate has no response"))
    each = asked.select("example_id", candidate.alias("candidate"), "record", blank.alias("error")).groupBy("example_id")  # at most three
    gathered = each.agg(F.array_sort(F.collect_list("candidate")).alias("candidates"), F.transform(F.array_sort(F.collect_list(F.struct("candidate.candidate_id", "record"))), lambda x: x["record"]).alias("_records"), F.min("error").alias("error"))
    both = rows.join(gathered, "example_id").withColumn("call_records", F.concat("call_records", "_records")).drop("_records")
    rows = own.passed(both, "candidate", F.lit(None).cast("string"))

    shown = F.transform(shown_order(F.col("candidates"), protocol, F.col("example_id")), lambda c: F.struct(c["candidate_id"].alias("candidate_id"), c["response"].alias("response")))
    asked = _recorded(own.ask(rows, "final_selector", F.struct("history", "state", F.col("context_after").alias("context"), shown.alias("candidates"))))
    of = lambda name: F.get_json_object("reply", f"$.{name}")
    chosen = select_candidate(F.col("candidates"), of("selected_candidate_id"), of("response_goal"), of("response_act"))
    rows = own.passed(asked.withColumn("final_selection", chosen), "selection", F.when(F.col("final_selection").isNull(), "no candidate, or more than one, is selected"))
    traces = rows.withColumn("final_response", F.col("final_selection.response")).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TRACE))
    return traces, own.failed


def _recorded(asked: DataFrame) -> DataFrame:
    return asked.withColumn("call_records", F.concat("call_records", F.array("record"))).drop("record")
