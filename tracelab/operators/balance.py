"""A derivative with exact quotas of strategies: planned, applied, checked and put up for review.

A quota is shared over strata in proportion, whole numbers first, what is left to the largest remainders; within a stratum the rows with
the smallest digests are taken, found by histograms of digests. All splits are planned together, as partitions of each step.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions import numbers as N
from tracelab.operators.selection import k_smallest, smallest_share
from tracelab.operators.traces import selection_of
from tracelab.schemas import QUOTAS, SOURCE_STRATEGY, TARGET_STRATEGIES
from tracelab.sources.staging import staged


def reusable(candidates: Column, selected_id: Column, strategy: str) -> Column:
    """Id of the candidate of a strategy that isn't the selected one; null if there is none, an error if there are several."""
    found = F.filter(candidates, lambda c: (c["candidate_id"] != selected_id) & (c["strategy"] == strategy))
    return F.when(F.size(found) > 1, F.raise_error(F.lit(f"several reusable candidates of {strategy}"))).otherwise(F.try_element_at(found, F.lit(1))["candidate_id"])


def _first_of(strategy: str) -> Column:
    """Id of the first candidate of a strategy."""
    return F.try_element_at(F.filter("candidates", lambda c: c["strategy"] == strategy), F.lit(1))["candidate_id"]


def stratum(phase: Column, emotion: Column, distress: Column) -> Column:
    return F.concat_ws(N.NUL, F.coalesce(phase, F.lit("unknown")), emotion, distress)


def allocate(rows: DataFrame, quota: Column, rank: Column, group: str = "split") -> DataFrame:
    """rows: group, stratum, example_id; rank: a hex digest. Those that a group's quota takes. Sizes of strata are aggregated first, and a stratum's share is then found by histograms of
    its digests, so that a stratum may hold all rows."""
    names = rows.columns
    rows = staged(rows.withColumn("_q", quota), "allocate")  # read several times; digests are made again each time, as they are longer than the rest of a row
    sizes = rows.groupBy(group, "stratum").agg(F.count("*").alias("_n"), F.max("_q").alias("_q"))
    over = Window.partitionBy(group)
    shares = sizes.withColumn("_all", F.sum("_n").over(over))
    shares = shares.withColumn("_q", F.least("_q", "_all")).withColumns({"_base": F.expr("(_q * _n) div _all"), "_rest": F.col("_q") * F.col("_n") % F.col("_all")})
    left = F.col("_q") - F.sum("_base").over(over)
    shares = shares.withColumn("_k", F.col("_base") + (F.row_number().over(over.orderBy(F.desc("_rest"), "stratum")) <= left).cast("int")).where("_k > 0").select(group, "stratum", "_k", "_n")
    return k_smallest(rows, [group, "stratum"], shares, rank, "example_id").select(*names)


def plan(
    traces: DataFrame, seed: int, quotas: Mapping[str, Mapping[str, int]] | Callable[[DataFrame], Mapping[str, Mapping[str, int]]] = QUOTAS, targets=TARGET_STRATEGIES, source: str = SOURCE_STRATEGY
) -> DataFrame:
    """traces: example_id, split, stratum, strategy (selected), selected_id, candidates (candidate_id, strategy). Assignments: example_id, split, target_strategy, source, candidate_id.

    For each target: rows with a reusable candidate, then rows that no later target could reuse, then any. Each step depends on those before it, so their rows are staged. quotas, of each
    split and target, may be a function of the pool, the written rows of the source strategy, so that traces are read once."""
    reused = [reusable(F.col("candidates"), F.col("selected_id"), t) for t in targets]
    chosen = [F.coalesce(r, _first_of(t), F.col("selected_id")) for r, t in zip(reused, targets, strict=True)]
    pool = traces.where(F.col("strategy") == source).select("example_id", "split", "stratum", *(r.isNotNull().alias(f"_r{i}") for i, r in enumerate(reused)), *(c.alias(f"_c{i}") for i, c in enumerate(chosen)))
    pool = staged(pool, "plan-pool")
    quotas = quotas(pool) if callable(quotas) else quotas
    taken: DataFrame | None = None
    for i, target in enumerate(targets):
        free = pool if taken is None else pool.join(taken.select("example_id"), "example_id", "left_anti")
        rank = N.digest(seed, target, F.col("example_id"))
        quota = F.coalesce(*(F.when(F.col("split") == s, F.lit(q.get(target, 0))) for s, q in quotas.items()), F.lit(0))
        step, need = None, quota
        apart = F.lit(True)
        for j in range(i + 1, len(targets)):
            apart = apart & ~F.col(f"_r{j}")
        for own in (F.col(f"_r{i}"), apart, F.lit(True)):
            rest = free if step is None else free.join(step.select("example_id"), "example_id", "left_anti")
            rest = rest.where(own).select("example_id", "split", "stratum", f"_r{i}", f"_c{i}")
            names = rest.columns
            if step is not None:
                done = step.groupBy("split").agg(F.count("*").alias("_done"))
                rest = rest.join(F.broadcast(done), "split", "left")  # a row for each split
                need = F.greatest(quota - F.coalesce("_done", F.lit(0)), F.lit(0))
            got = staged(allocate(rest, need, rank).select(*names), "plan-step")
            step = got if step is None else step.unionByName(got)
        step = step.select("example_id", "split", F.lit(target).alias("target_strategy"), F.when(F.col(f"_r{i}"), "reuse").otherwise("generate").alias("source"), F.col(f"_c{i}").alias("candidate_id"))
        taken = step if taken is None else taken.unionByName(step)
    return taken


def apply_reuse(traces: DataFrame, assignments: DataFrame) -> DataFrame:
    """traces with the selection of reused candidates."""
    joined = traces.join(assignments.where("source = 'reuse'").select("example_id", F.col("candidate_id").alias("_id"), F.col("target_strategy").alias("_target")), "example_id", "left")
    chosen = F.try_element_at(F.filter("candidates", lambda c: (c["candidate_id"] == F.col("_id")) & (c["strategy"] == F.col("_target"))), F.lit(1))
    moved = F.when(F.col("_id").isNull(), F.col("final_selection")).when(chosen.isNotNull(), selection_of(chosen)).otherwise(F.raise_error(F.concat(F.lit("invalid reuse for "), "example_id")))
    return joined.withColumn("final_selection", moved).withColumn("final_response", F.col("final_selection.response")).drop("_id", "_target")


def apply_generated(traces: DataFrame, generated: DataFrame) -> DataFrame:
    """generated: example_id, new (a candidate). traces with that candidate in its slot, in the plan, selected, and its call records added."""
    joined = traces.join(generated.select("example_id", F.col("new").alias("_new")), "example_id", "left")
    new, some = F.col("_new"), F.col("_new").isNotNull()
    candidates = F.transform("candidates", lambda c: F.when(some & (c["candidate_id"] == new["candidate_id"]), new).otherwise(c))
    strategies = F.transform("plan.strategies", lambda s, i: F.when(some & (i + 1 == new["candidate_id"].cast("int")), new["strategy"]).otherwise(s))
    return (
        joined.withColumn("candidates", candidates)
        .withColumn("plan", F.struct(strategies.alias("strategies")))
        .withColumn("final_selection", F.when(some, selection_of(new)).otherwise(F.col("final_selection")))
        .withColumn("final_response", F.col("final_selection.response"))
        .drop("_new")
    )


def derivative_problems(before: DataFrame, after: DataFrame, assignments: DataFrame) -> DataFrame:
    """example_id and problem, for rows that a derivative must not have changed, or changed otherwise than assigned."""
    fixed = F.struct("split", "history", "state", "state_analysis")
    keyed = lambda df, tag: df.select("example_id", F.xxhash64(fixed).alias(f"{tag}_fixed"), F.col("final_selection").alias(f"{tag}_sel"))
    both = keyed(before, "a").join(keyed(after, "b"), "example_id", "full").join(assignments.select("example_id", "target_strategy"), "example_id", "left")
    problem = (
        F.when(F.col("a_fixed").isNull(), "row was added")
        .when(F.col("b_fixed").isNull(), "row is missing")
        .when(F.col("a_fixed") != F.col("b_fixed"), "split, history or state changed")
        .when(F.col("target_strategy").isNull() & ~F.col("a_sel").eqNullSafe(F.col("b_sel")), "an unassigned row changed")
        .when(F.col("target_strategy").isNotNull() & (F.col("a_sel.selected_strategy") != SOURCE_STRATEGY), "an assigned row had another strategy")
        .when(F.col("target_strategy").isNotNull() & (F.col("b_sel.selected_strategy") != F.col("target_strategy")), "an assigned row lacks its strategy")
    )
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("example_id", "problem")


def derivative_manifest(planned: DataFrame, after: DataFrame, seed: int, inputs: dict[str, str]) -> dict:
    """What a balanced derivative was made from and holds: the seed, inputs with their digests, rows, and counts by split of assignments, by target and source, and of strategies."""
    def nested(df: DataFrame, *keys: str) -> dict:
        out: dict = {}
        for r in df.groupBy(*keys).count().collect():  # splits times strategies times sources
            at = out
            for k in keys[:-1]:
                at = at.setdefault(r[k], {})
            at[r[keys[-1]]] = r["count"]
        return out

    strategies = after.select("split", F.col("final_selection.selected_strategy").alias("strategy"))
    return {"seed": seed, "inputs": dict(sorted(inputs.items())), "rows": after.count(), "assignments": nested(planned, "split", "target_strategy", "source"), "strategies": nested(strategies, "split", "strategy")}


def review_queue(rows: DataFrame, seed: int, share: float = 0.2) -> DataFrame:
    """rows: example_id, split, target_strategy, source. All generated ones, and of the reused ones of a split and strategy the share with the smallest digests, one at least."""
    reused = smallest_share(rows.where("source = 'reuse'"), ["split", "target_strategy"], share, N.digest(seed, "review", F.col("example_id")), "example_id")
    return rows.where("source = 'generate'").unionByName(reused)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(*columns)
