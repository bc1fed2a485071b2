"""Statistics over scores, vectors and losses."""

from __future__ import annotations



import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def retention(base: Column, teacher: Column, student: Column, least_gain: float = 0.2, strict: bool = False) -> Column:
    """The share of the teacher's gain that the student keeps; if that gain is too small, null, or with ``strict`` an error where it is read."""
    gain = teacher - base
    small = F.raise_error(F.concat(F.lit(f"the teacher's gain is below {least_gain}: "), gain.cast("string"))).cast("double") if strict else F.lit(None).cast("double")
    return F.when(gain >= least_gain, (student - base) / gain).otherwise(small)


def fidelity(full: DataFrame, ablated: DataFrame) -> DataFrame:
    """full: dimension, score; ablated: fn, dimension, score. What each dimension loses without a function."""
    return ablated.alias("a").join(full.alias("f"), "dimension").select("a.fn", "dimension", (F.col("f.score") - F.col("a.score")).alias("loss"))


def fidelity_problems(full: DataFrame, ablated: DataFrame, functions: tuple[str, ...] = ("STATE", "PLAN")) -> DataFrame:
    """Cells that a function lacks, or that the full scores lack."""
    want = full.select("dimension").withColumn("fn", F.explode(F.array(*map(F.lit, functions)))).select("fn", "dimension")
    have = ablated.select("fn", "dimension")
    return want.exceptAll(have).withColumn("problem", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("problem", F.lit("unexpected")))


def average_ranks(df: DataFrame, value: str, name: str, *group: str) -> DataFrame:
    """Ranks from 1; equals share the mean of theirs. Equal values are counted first, so only different values are numbered."""
    sizes = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn(name, F.coalesce(F.sum("_n").over(by), F.lit(0)) + (F.col("_n") + 1) / F.lit(2.0)).drop("_n")
    return df.join(ranked, [*group, value])


def correlation(x: str, y: str) -> Column:
    """Pearson's; null if either side is constant."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def rank_correlation(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df, x, "_x", *group), y, "_y", *group)
    return ranked.groupBy(*group).agg(correlation("_x", "_y").alias("spearman"), F.count("*").alias("n"))


def alignment(cells: DataFrame, *group: str) -> DataFrame:
    """cells: teacher, student. Share of equal signs, rank correlation and L1 distance by the teacher's."""
    same = F.avg((F.signum("teacher") == F.signum("student")).cast("double"))
    distance = F.try_divide(F.sum(F.abs(F.col("teacher") - F.col("student"))), F.sum(F.abs("teacher")))
    simple = cells.groupBy(*group).agg(same.alias("sign_agreement"), distance.alias("normalized_l1"))
    ranks = rank_correlation(cells, "teacher", "student", *group)
    return simple.join(ranks, list(group)) if group else simple.crossJoin(ranks)  # one row each


def positives(examples: DataFrame, bank: DataFrame) -> DataFrame:
    """Vectors by id; an id that the bank lacks raises when it is read."""
    found = examples.join(bank, "example_id", "left")
    return found.withColumn("vector", F.coalesce("vector", F.raise_error(F.concat(F.lit("no vector for "), "example_id")).cast("array<float>")))


def contrastive(slots: DataFrame, bank: DataFrame, temperature: float = 0.1, cosine_weight: float = 1.0, block: int = 4096) -> DataFrame:
    """slots: example_id, vector; bank: the same, a positive for each. Cross-entropy of the positive among the whole bank, cosine of the positive, and loss.

    The bank is cut into blocks; each pair of a block of slots and one of the bank meets in one task, which gives partial log-sums; these are added up stably."""
    n = {name: max(1, -(-df.count() // block)) for name, df in (("slot", slots), ("bank", bank))}
    deal = lambda df, k: F.pmod(F.xxhash64("example_id", F.lit(5)), F.lit(k)).cast("int")
    left = slots.select(F.col("example_id").alias("slot_id"), F.col("vector").alias("slot_vector")).withColumn("s", F.pmod(F.xxhash64("slot_id"), F.lit(n["slot"])).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n["bank"] - 1))))
    right = bank.select("example_id", "vector").withColumn("b", deal(bank, n["bank"])).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n["slot"] - 1))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = {"example_id": pa.string(), "top": pa.float64(), "total": pa.float64(), "cosine": pa.float64()}
        if not a.num_rows or not b.num_rows:
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        unit = lambda t, c: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))(np.array(t.column(c).to_pylist(), np.float64))
        ids = [str(x) for x in a.column("slot_id").to_pylist()]
        at = {str(x): i for i, x in enumerate(b.column("example_id").to_pylist())}
        cos = unit(a, "slot_vector") @ unit(b, "vector").T
        top = cos.max(axis=1) / temperature
        own = [float(cos[i, at[x]]) if x in at else None for i, x in enumerate(ids)]
        return pa.table({"example_id": pa.array(ids), "top": top, "total": np.exp(cos / temperature - top[:, None]).sum(axis=1), "cosine": pa.array(own, pa.float64())})

    parts = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(meet, "example_id string, top double, total double, cosine double")
    best = parts.groupBy("example_id").agg(F.max("top").alias("_top"), F.collect_list(F.struct("top", "total")).alias("_p"), F.max("cosine").alias("cosine"))
    total = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["total"] * F.exp(p["top"] - F.col("_top")))
    entropy = F.col("_top") + F.log(total) - F.col("cosine") / temperature
    return best.select("example_id", "cosine", entropy.alias("cross_entropy"), (entropy + cosine_weight * (1 - F.col("cosine"))).alias("loss"))


def combined_loss(state: Column, plan: Column, response: Column | None = None, state_weight: float = 1.0, plan_weight: float = 1.0) -> Column:
    own = state_weight * state + plan_weight * plan
    return own if response is None else response + own


def sequence_scores(tokens: DataFrame) -> DataFrame:
    """tokens: example_id, pos, label, log_prob (of the label given what is before it; the first has none). Mean over labels that count."""
    counts = (F.col("label") != -100) & (F.col("pos") > 0)
    return tokens.groupBy("example_id").agg(F.sum(F.when(counts, F.col("log_prob"))).alias("total"), F.count_if(counts).alias("n")).withColumn("score", F.try_divide("total", "n"))


def weighted_loss(batches: DataFrame) -> DataFrame:
    return batches.agg(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("loss"))


def early_stopping(metrics: DataFrame, patience: int, *group: str) -> DataFrame:
    """metrics: epoch, metric. Whether an epoch is a new best, how many since the last best, and whether training stops there."""
    by = Window.partitionBy(*group).orderBy("epoch")
    best_so_far = F.min("metric").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = metrics.withColumn("improved", best_so_far.isNull() | (F.col("metric") < best_so_far))
    run = F.sum(F.col("improved").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("_run", run)
    since = F.row_number().over(Window.partitionBy(*group, "_run").orderBy("epoch")) - 1
    return counted.withColumn("bad_epochs", since).withColumn("stops", F.col("bad_epochs") >= patience).drop("_run")


def parameters(table: DataFrame) -> DataFrame:
    """table: name, numel, trainable."""
    return table.agg(F.sum("numel").alias("total"), F.coalesce(F.sum(F.when(F.col("trainable"), F.col("numel"))), F.lit(0)).alias("trainable"), F.coalesce(F.sum(F.when(F.col("name").contains("lora"), F.col("numel"))), F.lit(0)).alias("adapter"))


def stage_plan(requested: list[str], order: tuple[str, ...] = ("A", "B"), start: str | None = None) -> list[str]:
    """The requested stages in order, from start on."""
    own = [s for s in order if s in requested]
    return own[own.index(start) :] if start else own


