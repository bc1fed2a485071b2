"""Exports of traces: allow-listed columns of trainable splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions import numbers as N
from tracelab.functions import text as X
from tracelab.operators.checks import require_unique
from tracelab.operators.traces import plan_selection
from tracelab.schemas import TRAINABLE


def blocked(traces: DataFrame) -> DataFrame:
    """Rows of splits that must not be exported."""
    return traces.where(~F.col("split").isin(*TRAINABLE))


def trainable(traces: DataFrame) -> DataFrame:
    """traces; reading a row of another split raises."""
    wrong = F.raise_error(F.concat(F.lit("split must not be exported: "), "split"))
    return traces.withColumn("split", F.when(F.col("split").isin(*TRAINABLE), F.col("split")).otherwise(wrong))


def sft_rows(traces: DataFrame) -> DataFrame:
    own = trainable(traces).where("split IS NOT NULL")  # the check stays in the plan as a filter
    return own.select("example_id", X.as_prompt(F.col("history.turns")).alias("prompt"), F.col("final_response").alias("response"), F.col("final_selection.selected_strategy").alias("selected_strategy"))


def slot_rows(traces: DataFrame) -> DataFrame:
    own = trainable(traces).where("split IS NOT NULL")
    return own.select("example_id", X.as_prompt(F.col("history.turns")).alias("prompt"), "state", plan_selection(F.col("final_selection")).alias("plan"))


def visible_rows(traces: DataFrame) -> DataFrame:
    strategy = F.col("final_selection.selected_strategy")
    return trainable(traces).select("example_id", "split", "history", X.visible_text(F.col("state"), strategy, F.col("final_response")).alias("response"))


def stage_rows(traces: DataFrame, split: str) -> DataFrame:
    """Of one split, ids once: the four columns that training reads."""
    own = traces.where(F.col("split") == split)
    require_unique(own, "example_id")
    return own.select("example_id", "history", F.col("final_response").alias("response"), "split")


def anchor_payloads(traces: DataFrame) -> DataFrame:
    """Compact JSON of state and of the plan's selection, in field order."""
    options = {"ignoreNullFields": "false"}
    return traces.select("example_id", F.to_json("state", options).alias("state_text"), F.to_json(plan_selection(F.col("final_selection")), options).alias("plan_text"))


def flatten_conversations(conversations: DataFrame) -> DataFrame:
    """A trace for each round of conversations (conversation_id, rounds with trace)."""
    return conversations.select("conversation_id", F.posexplode("rounds").alias("_i", "_r")).select("conversation_id", (F.col("_i") + 1).alias("round_index"), "_r.trace.*")


def encoded(rows: DataFrame, end_id: int) -> DataFrame:
    """rows: example_id, prompt_ids, response_ids. Input ids, labels and the places of the two structure tokens behind the prompt."""
    labels = N.masked_labels(F.col("prompt_ids"), F.col("response_ids"), end_id)
    ids = F.concat("prompt_ids", F.filter(labels, lambda x, i: i >= F.size("prompt_ids")))
    n = F.size("prompt_ids")
    return rows.select("example_id", ids.alias("input_ids"), labels.alias("labels"), F.array(n, n + 1).alias("slots"))


def padded_batches(rows: DataFrame, batch: str, pad_id: int) -> DataFrame:
    """rows: batch, input_ids, labels. Each padded on the right to its batch's longest, with a mask."""
    width = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    wide = rows.withColumn("_w", width)
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("_w") - F.size("input_ids")))
    return wide.withColumns({"attention_mask": mask, "labels": N.padded(F.col("labels"), F.col("_w"), -100), "input_ids": N.padded(F.col("input_ids"), F.col("_w"), pad_id)}).drop("_w")
