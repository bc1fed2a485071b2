"""Generated conversations: modes, endings, resume and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.operators.checks import profile_id, repeated_keys


def adapt_profiles(profiles: DataFrame, at: str = "input_index") -> tuple[DataFrame, DataFrame]:
    """Profiles with a usable id, and failures: conversation_id input-index-i, failed_stage. Raises if an id is repeated."""
    own = profiles.withColumn("profile_id", profile_id(F.col("ID")))
    good = own.where("profile_id IS NOT NULL")
    if bad := repeated_keys(good, "profile_id").take(3):
        raise ValueError(f"repeated profile ids: {[r[0] for r in bad]}")
    failed = own.where("profile_id IS NULL").select(F.concat(F.lit("input-index-"), F.col(at).cast("string")).alias("conversation_id"), F.lit("profile").alias("failed_stage"), F.lit(0).alias("completed_rounds"))
    return good, failed


def pending(expected: DataFrame, *done: DataFrame, keys: tuple[str, ...] = ("conversation_id",)) -> DataFrame:
    """Rows whose keys none of the finished tables holds. Failures aren't finished, so they come again."""
    for d in done:
        expected = expected.join(d.select(*keys), list(keys), "left_anti")
    return expected


def ending(mode: Column, rounds: Column, hard_max: int) -> Column:
    """completed, truncated or null (goes on)."""
    return F.when(mode == "closing", "completed").when(rounds >= hard_max, "truncated")


def endings(rounds: DataFrame, hard_max: int) -> DataFrame:
    """rounds: conversation_id, round_index, mode. status, round_count and final_mode of each conversation."""
    last = rounds.groupBy("conversation_id").agg(F.max("round_index").alias("round_count"), F.max_by("mode", "round_index").alias("final_mode"))
    return last.withColumn("status", F.coalesce(ending(F.col("final_mode"), F.col("round_count"), hard_max), F.lit("open")))


def filled_modes(rounds: DataFrame) -> DataFrame:
    """A round whose mode decision failed (null) keeps the mode of the round before."""
    by = Window.partitionBy("conversation_id").orderBy("round_index")
    kept = F.last("mode", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rounds.withColumns({"audit": F.when(F.col("mode").isNull(), "kept the previous mode"), "mode": kept})


def recent_strategies(rounds: DataFrame, n: int = 3) -> DataFrame:
    by = Window.partitionBy("conversation_id").orderBy("round_index")
    return rounds.withColumn("recent", F.collect_list("strategy").over(by.rowsBetween(-n, -1)))


def routed(outcomes: DataFrame) -> dict[str, DataFrame]:
    """The three tables that outcomes go to, by status."""
    return {s: outcomes.where(F.col("status") == s) for s in ("completed", "truncated", "failed")}


def transitions(rounds: DataFrame, column: str = "mode") -> DataFrame:
    """How often one value follows another within a conversation."""
    by = Window.partitionBy("conversation_id").orderBy("round_index")
    pairs = rounds.select(F.lag(column).over(by).alias("before"), F.col(column).alias("after")).where("before IS NOT NULL")
    return pairs.groupBy("before", "after").agg(F.count("*").alias("n"))


def repeats(rounds: DataFrame, column: str = "strategy") -> DataFrame:
    """Of each conversation, rounds and those that repeat the one before."""
    by = Window.partitionBy("conversation_id").orderBy("round_index")
    flagged = rounds.withColumn("_r", (F.lag(column).over(by) == F.col(column)).cast("int"))
    return flagged.groupBy("conversation_id").agg(F.count("*").alias("rounds"), F.coalesce(F.sum("_r"), F.lit(0)).alias("repeats"))
