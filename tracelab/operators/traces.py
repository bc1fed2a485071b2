"""Traces: candidates of a plan, their order, selection and re-selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions import numbers as N


def fan_out(plans: DataFrame) -> DataFrame:
    """plans: example_id, strategies. A candidate slot for each strategy: candidate_id 1.., strategy_id S1..."""
    slots = plans.select("example_id", F.posexplode("strategies").alias("_i", "strategy"))
    number = (F.col("_i") + 1).cast("string")
    return slots.select("example_id", number.alias("candidate_id"), F.concat(F.lit("S"), number).alias("strategy_id"), "strategy")


def shown_order(candidates: Column, protocol: str, identity: Column) -> Column:
    """Candidates in the order of digests of protocol, identity and candidate id."""
    keyed = F.transform(candidates, lambda c: F.struct(N.digest(protocol, identity, c["candidate_id"]).alias("_h"), c.alias("c")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["_h"] < b["_h"], -1).when(a["_h"] > b["_h"], 1).otherwise(0)), lambda k: k["c"])


def selection_of(candidate: Column) -> Column:
    """The canonical selection of a candidate."""
    return F.struct(
        candidate["candidate_id"].alias("selected_candidate_id"),
        candidate["strategy_id"].alias("selected_strategy_id"),
        candidate["strategy"].alias("selected_strategy"),
        candidate["response_goal"].alias("response_goal"),
        candidate["response_act"].alias("response_act"),
        candidate["response"].alias("response"),
    )


def select_candidate(candidates: Column, chosen_id: Column, goal: Column | None = None, act: Column | None = None) -> Column:
    """The selection of the one candidate with that id; null if none or several have it. Goal and act of a decision come before the candidate's."""
    matches = F.filter(candidates, lambda c: c["candidate_id"] == chosen_id)
    s = selection_of(F.try_element_at(matches, F.lit(1)))
    for name, own in (("response_goal", goal), ("response_act", act)):
        if own is not None:
            s = s.withField(name, F.coalesce(own, s[name]))
    return F.when(F.size(matches) == 1, s)


def plan_selection(selection: Column) -> Column:
    return F.struct(selection["selected_strategy"].alias("strategy"), selection["response_goal"].alias("response_goal"), selection["response_act"].alias("response_act"))


def assemble(observations: DataFrame, responses: DataFrame) -> DataFrame:
    """Traces of observed and responded turns with the same example_id; call records one after another."""
    joined = observations.withColumnRenamed("call_records", "_first").join(responses.withColumnRenamed("call_records", "_then"), "example_id")
    return joined.withColumn("call_records", F.concat("_first", "_then")).withColumn("final_response", F.col("final_selection.response")).drop("_first", "_then")


def reselect(traces: DataFrame, strategy_id: str = "S1") -> DataFrame:
    """traces with the selection moved to the candidate of a slot."""
    chosen = F.filter("candidates", lambda c: c["strategy_id"] == strategy_id)
    only = F.when(F.size(chosen) == 1, F.element_at(chosen, 1))
    moved = F.when(only.isNotNull(), selection_of(only)).otherwise(F.raise_error(F.concat(F.lit(f"no single {strategy_id} candidate in "), "example_id")))
    return traces.withColumn("final_selection", moved).withColumn("final_response", F.col("final_selection.response"))


def slot_counts(traces: DataFrame) -> DataFrame:
    return traces.groupBy(F.col("final_selection.selected_strategy_id").alias("slot")).agg(F.count("*").alias("n")).orderBy("slot")


def cache_key(namespace: Column | str, role: Column, messages: Column, seed: Column) -> Column:
    """Digest of a compact JSON list of what determines a call."""
    own = namespace if isinstance(namespace, Column) else F.lit(namespace)
    return F.sha2(F.to_json(F.array(own, role, messages, seed.cast("string"))), 256)
