"""Validation: a table of rules gives valid and rejected rows, or raises."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.functions import text as X
from tracelab.schemas import EVIDENCE_BASES, SPLITS, STATE_FIELDS, STATE_VALUES, STRATEGIES

Rule = tuple[str, Column]


def first_problem(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that doesn't hold; null if all do. Null counts as not holding."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(name))
    return out


def marked(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df with ``reason``, the first rule that a row breaks, or null.

    Rules are evaluated once for a row: as what a row explodes to, the reason isn't pushed down as a filter, in which each use of a column would be the whole expression behind it."""
    return df.withColumn("reason", F.explode(F.array(first_problem(rules))))


def validated(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with a ``reason``."""
    both = marked(df, rules)
    return both.where("reason IS NULL").drop("reason"), both.where("reason IS NOT NULL")


def required(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df; reading a row that breaks a rule raises."""
    problem = first_problem(rules)
    one = df.columns[0]
    return df.withColumn(one, F.when(problem.isNull(), F.col(one)).otherwise(F.raise_error(problem).cast(df.schema[one].dataType)))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if bad := repeated_keys(df, *keys).take(3):
        raise ValueError(f"repeated {', '.join(keys)}: {[tuple(r)[:-1] for r in bad]}")
    return df


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks, with ``lacks``: left or right."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("lacks", F.lit("right")).unionByName(b.join(a, key, "left_anti").withColumn("lacks", F.lit("left")))


def unknown_keys(raw: Column, schema: T.StructType) -> Column:
    """Paths of object keys in JSON text that the schema lacks, at any depth."""
    found: list[Column] = []

    def visit(value: Column, kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            names = [f.name for f in kind.fields]
            keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
            found.append(F.transform(F.array_except(keys, F.array(*map(F.lit, names))), lambda k: F.concat(F.lit(path), k)))
            for f in kind.fields:
                visit(F.get_json_object(value, f"$.{f.name}"), f.dataType, f"{path}{f.name}.")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            items = F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))
            own = unknown_keys
            found.append(F.flatten(F.transform(items, lambda x: F.transform(own(x, kind.elementType), lambda k: F.concat(F.lit(path), k)))))

    visit(raw, schema, "")
    return F.flatten(F.array(*found))


def profile_id(raw: Column) -> Column:
    """The stripped id; null if it is blank or holds a control character."""
    own = X.strip(raw.cast("string"))
    return F.when((F.length(own) > 0) & ~F.rlike(own, F.lit(r"[\x00-\x1f\x7f]")), own)


def history_rules(turns: str = "history.turns") -> list[Rule]:
    t = F.col(turns)
    return [
        ("history is empty", F.size(t) > 0),
        ("a turn is empty or has an unknown role", F.forall(t, lambda x: x["role"].isin("seeker", "supporter") & (F.length(x["content"]) > 0))),
        ("history must end with a seeker turn", F.try_element_at(t, F.lit(-1))["role"] == "seeker"),
    ]


def patch_rules(patch: str, fields: Sequence[str]) -> list[Rule]:
    return [(f"{f}: replace.old and replace.new must differ", F.forall(F.col(f"{patch}.replace.{f}"), lambda p: p["old"] != p["new"])) for f in fields]


def state_rules(analysis: str = "state_analysis") -> list[Rule]:
    out: list[Rule] = []
    for f in STATE_FIELDS:
        value, evidence = F.col(f"{analysis}.state.{f}"), F.col(f"{analysis}.state_evidence.{f}")
        absent = evidence["basis"] == "absent_or_ambiguous"
        out += [
            (f"{f} has an unknown value", value.isin(*STATE_VALUES[f]) & evidence["basis"].isin(*EVIDENCE_BASES)),
            (f"{f} value and evidence basis disagree", (value == "unknown") == absent),
            (f"{f} requires non-blank evidence", (value == "unknown") | X.not_blank(evidence["evidence"])),
        ]
    return out


def plan_rules(strategies: str = "plan.strategies") -> list[Rule]:
    s = F.col(strategies)
    return [
        ("a plan has one to three strategies", F.size(s).between(1, 3)),
        ("a strategy is unknown", F.forall(s, lambda x: x.isin(*STRATEGIES))),
        ("strategy plan must use distinct strategies", F.size(F.array_distinct(s)) == F.size(s)),
    ]


def planned_strategy(strategies: Column, strategy_id: Column) -> Column:
    """The strategy of S1, S2 or S3; null if the plan lacks it."""
    return F.try_element_at(strategies, F.substring(strategy_id, 2, 1).try_cast("int"))


def trace_rules() -> list[Rule]:
    s, candidates = F.col("final_selection"), F.col("candidates")
    chosen = F.filter(candidates, lambda c: c["candidate_id"] == s["selected_candidate_id"])
    one = F.try_element_at(chosen, F.lit(1))
    return [
        ("state differs from its analysis", F.col("state") == F.col("state_analysis.state")),
        ("final response differs from the selection", F.col("final_response") == s["response"]),
        ("a candidate's strategy isn't its slot's", F.forall(candidates, lambda c: c["strategy"] == planned_strategy(F.col("plan.strategies"), c["strategy_id"]))),
        ("the selection must name exactly one candidate", F.size(chosen) == 1),
        ("the selection differs from its candidate", (one["strategy_id"] == s["selected_strategy_id"]) & (one["strategy"] == s["selected_strategy"]) & (one["response"] == s["response"])),
    ]


def prepared_rules() -> list[Rule]:
    meta = [F.col(c) for c in ("conversation_phase", "target_turn", "target_rank", "eligible_target_count")]
    missing = sum((F.when(c.isNull(), 1).otherwise(0) for c in meta), F.lit(0))
    rank, n = meta[2], meta[3]
    from tracelab.operators.preparation import phase_of_rank

    return [
        ("split is unknown", F.col("split").isin(*SPLITS)),
        ("phase metadata must be complete or absent", missing.isin(0, 4)),
        ("target rank exceeds the target count", (missing == 4) | (rank <= n)),
        ("phase differs from the target's rank", (missing == 4) | (meta[0] == phase_of_rank(rank, n))),
    ]


def round_problems(turns: DataFrame) -> DataFrame:
    """turns: conversation_id, turn_index, round_index, role, content. conversation_id and reason, for conversations that aren't whole alternating rounds."""
    from pyspark.sql import Window

    by = Window.partitionBy("conversation_id").orderBy("turn_index", "role")
    at = F.row_number().over(by)
    marked = turns.withColumn("_at", at)
    bad = (
        F.when(F.col("turn_index") != F.col("_at"), "turn indexes aren't contiguous")
        .when(F.col("round_index") != F.ceil(F.col("_at") / 2), "round indexes aren't contiguous")
        .when(F.col("role") != F.when(F.col("_at") % 2 == 1, "seeker").otherwise("supporter"), "turns don't alternate from the seeker")
    )
    found = marked.withColumn("_bad", bad).groupBy("conversation_id").agg(F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("_at"))).alias("reason"), F.count("*").alias("n"))
    return found.withColumn("reason", F.coalesce("reason", F.when(F.col("n") % 2 == 1, "the last round isn't complete"))).where("reason IS NOT NULL").select("conversation_id", "reason")


def round_prefix(turns: Column, round_index: Column) -> Column:
    """The public history that a round's reply is made from."""
    return F.slice(turns, F.lit(1), 2 * round_index - 1)


def terminal_rules() -> list[Rule]:
    """Of a conversation row: status, termination (reason, round_count, final_mode), rounds, seeker_call_records."""
    mode, status = F.col("termination.final_mode"), F.col("status")
    return [
        ("status is unknown", status.isin("completed", "truncated")),
        ("a completed conversation must close", (status == "completed") == (mode == "closing")),
        ("the reason doesn't fit the status", F.col("termination.reason") == F.when(status == "completed", "closing").otherwise("hard_max_rounds")),
        ("round count differs", F.col("termination.round_count") == F.size("rounds")),
        ("call records differ from rounds", F.size("seeker_call_records") >= F.size("rounds")),
        ("a call record isn't the seeker's", F.forall("seeker_call_records", lambda c: c["role"] == "seeker_simulator")),
    ]


def checkpoint_rules() -> list[Rule]:
    """Of a checkpoint row: next_round, previous_mode, last_context, rounds (with mode and context)."""
    last = F.try_element_at(F.col("rounds"), F.lit(-1))
    return [
        ("next_round must follow the last round", F.col("next_round") == F.size("rounds") + 1),
        ("previous_mode differs from the last round's", F.coalesce(F.col("previous_mode"), F.lit("")) == F.coalesce(last["mode"], F.lit(""))),
        ("last_context differs from the last round's", (F.size("rounds") == 0) | (F.col("last_context") == last["context"])),
    ]


def response_rules() -> list[Rule]:
    source = F.col("response_source")
    return [
        ("a teacher's response is reused and has no seed", (source != "teacher") | (F.col("reused") & F.col("generation_seed").isNull())),
        ("a visible response must be its raw text's reply", (source != "visible_sft") | (X.visible_reply(F.col("raw_response")) == F.col("response"))),
        ("response is empty", F.length("response") > 0),
    ]


def registry(models: Sequence[dict], standalone: bool = False) -> list[dict]:
    """Checks a list of models (model_id, source, splits): unique ids, two at least with exactly one teacher, or, standalone, one model that isn't the teacher."""
    ids = [m["model_id"] for m in models]
    teachers = [m for m in models if m["source"] == "teacher"]
    if len(set(ids)) != len(ids):
        raise ValueError("model ids must be unique")
    if standalone and (len(models) != 1 or teachers):
        raise ValueError("a standalone registry has exactly one model, not the teacher")
    if not standalone and len(models) < 2:
        raise ValueError("a registry has at least two models")
    if not standalone and len(teachers) != 1:
        raise ValueError("a registry has exactly one teacher")
    for m in models:
        if len(set(m.get("splits", ()))) != len(m.get("splits", ())):
            raise ValueError(f"splits of {m['model_id']} must be unique")
    return list(models)


def round_limits(least: int, soft: int, hard: int) -> None:
    if not 1 <= least <= soft <= hard:
        raise ValueError("round limits must satisfy 1 <= min <= soft <= hard")


def vector_problems(bank: DataFrame, tolerance: float = 2e-3) -> DataFrame:
    """bank: example_id, vector. Rows whose vector has another width, isn't of unit length, or shares its id."""
    from pyspark.sql import Window

    from tracelab.functions import numbers as N

    width = bank.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).select("w")
    marked = bank.crossJoin(F.broadcast(width)).withColumn("_n", F.count("*").over(Window.partitionBy("example_id")))  # one row
    reason = F.when(F.size("vector") != F.col("w"), "width differs").when(F.abs(N.norm(F.col("vector")) - 1) > tolerance, "not of unit length").when(F.col("_n") > 1, "id is repeated")
    return marked.withColumn("reason", reason).where("reason IS NOT NULL").drop("w", "_n")


def size_problems(df: DataFrame, expected: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Splits whose row count isn't the expected one: expected and found."""
    found = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}  # a row for each split
    return {s: (expected.get(s, 0), found.get(s, 0)) for s in {*expected, *found} if expected.get(s, 0) != found.get(s, 0)}


def token_budget(text: Column, most: int = 128) -> Column:
    """Whether a text has at most so many words between white space."""
    return F.size(X.words(text)) <= most


def encodable(prompt: Column, response: Column, most: int, structure_ids: Sequence[int]) -> Column:
    """Why a pair of id arrays can't be a training example; null if it can. Nothing is cut."""
    return (
        F.when(F.size(response) == 0, "the response is empty")
        .when(F.arrays_overlap(F.concat(prompt, response), F.array(*map(F.lit, structure_ids))), "a structure token occurs in the text")
        .when(F.size(prompt) + F.size(response) > most, "the example is too long")
    )


def loads_object(text: str) -> dict:
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a JSON object is needed")
    return value


def judgment_rules() -> list[Rule]:
    """Scores from 1 to 5 and an overall that is their rounded mean."""
    from tracelab.operators.quality import overall_score
    from tracelab.schemas import DIMENSIONS

    scores = [F.col(f"scores.{d}") for d in DIMENSIONS]
    return [
        *((f"{d} is out of range", s.between(1, 5)) for d, s in zip(DIMENSIONS, scores, strict=True)),
        ("overall differs from the mean of scores", F.col("overall") == overall_score(scores)),
        ("short_reason is too long", F.length("short_reason") <= 500),
    ]


def visible_rules(response: str = "response") -> list[Rule]:
    """Of a row of the visible dataset; ids must be unique besides."""
    return [("split isn't trainable", F.col("split").isin("train", "dev")), ("the target's markers or values are wrong", X.visible_problem(F.col(response)).isNull())]
