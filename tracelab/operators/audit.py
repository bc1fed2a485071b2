"""Collapse diagnostics and pilot checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions import numbers as N
from tracelab.functions import text as X
from tracelab.operators.selection import quantiles
from tracelab.schemas import SOURCE_STRATEGY, STATE_FIELDS

# Shares above (or, for functions, below) which a gate is raised.
GATES = {"strategy": 0.6, "slot": 0.5, "slot_gap": 0.2, "prefix": 0.2, "function": 0.4}


def _share(part: str, whole: str):
    return N.round_exact(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")))


def strategy_funnel(candidates: DataFrame) -> DataFrame:
    """candidates: example_id, slot, strategy, selected. Of each strategy: slots, traces that plan it, selections, and shares."""
    total = candidates.agg(F.count_distinct("example_id").alias("traces"))
    own = candidates.groupBy("strategy").agg(F.count("*").alias("slots"), F.count_distinct("example_id").alias("planned"), F.count_if("selected").alias("selections"))
    return own.crossJoin(F.broadcast(total)).withColumns({"planned_share": _share("planned", "traces"), "selected_share": _share("selections", "traces"), "win_rate": _share("selections", "planned")})  # one row


def slot_share(candidates: DataFrame) -> DataFrame:
    own = candidates.where("selected").groupBy("slot").agg(F.count("*").alias("selections"))
    return own.withColumn("_all", F.sum("selections").over(Window.partitionBy())).withColumn("share", _share("selections", "_all")).drop("_all")  # a row for each slot


def strategy_slot_cube(candidates: DataFrame) -> DataFrame:
    return candidates.cube("strategy", "slot").agg(F.count("*").alias("candidates"), F.count_if("selected").alias("selections"))


def top_prefixes(texts: DataFrame, group: str, k: int, n: int = 4) -> DataFrame:
    """texts: group, text. The k most frequent first n words of each group, with shares; ties to the one that sorts first."""
    counted = texts.withColumn("prefix", X.first_words(F.col("text"), n)).groupBy(group, "prefix").agg(F.count("*").alias("n"))
    totals = texts.groupBy(group).agg(F.count("*").alias("total"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "prefix"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(totals), group).withColumn("share", _share("n", "total"))


def distinct_texts(texts: DataFrame, group: str) -> DataFrame:
    return texts.groupBy(group, F.md5("text").alias("_d")).agg(F.count("*").alias("_n")).groupBy(group).agg(F.sum("_n").alias("texts"), F.count("*").alias("different"))


def contamination(candidates: DataFrame) -> DataFrame:
    """Candidates whose text begins with a fence, by slot."""
    fenced = F.rlike("text", F.lit(r"^\s*```"))
    return candidates.groupBy("slot").agg(F.count("*").alias("candidates"), F.count_if(fenced).alias("fenced"), F.count_if(fenced & F.col("selected")).alias("fenced_selected"))


def retention(rows: DataFrame) -> DataFrame:
    """rows: function, kept, reason. Kept of all, by function."""
    return rows.groupBy("function").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).withColumn("rate", _share("kept", "n"))


def exclusions(rows: DataFrame) -> DataFrame:
    return rows.where("NOT kept").groupBy("function", "reason").agg(F.count("*").alias("n"))


def gates(shares: DataFrame) -> DataFrame:
    """shares: gate, value. Whether each gate of GATES is raised."""
    limit = F.coalesce(*(F.when(F.col("gate") == g, F.lit(x)) for g, x in GATES.items()))
    raised = F.when(F.col("gate") == "function", F.col("value") < limit).otherwise(F.col("value") > limit)
    return shares.withColumns({"limit": limit, "raised": raised})


def collapse_gates(candidates: DataFrame, texts: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """All gates; that of functions (rows as in ``retention``) looks at the one that keeps least."""
    slots = slot_share(candidates)
    parts = [
        strategy_funnel(candidates).agg(F.lit("strategy").alias("gate"), F.max("selected_share").alias("value")),
        slots.agg(F.lit("slot").alias("gate"), F.max("share").alias("value")),
        slots.agg(F.lit("slot_gap").alias("gate"), N.round_exact(F.max("share") - F.min("share")).alias("value")),
        top_prefixes(texts.withColumn("_g", F.lit(1)), "_g", 1).agg(F.lit("prefix").alias("gate"), F.max("share").alias("value")),
    ]
    if functions is not None:
        parts.append(retention(functions).agg(F.lit("function").alias("gate"), F.min("rate").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return gates(out)


def state_rates(traces: DataFrame, strategy: str = SOURCE_STRATEGY) -> DataFrame:
    """traces: the state fields, strategies (planned), strategy (selected). Of each value of each field: rows, share that plan and that select a strategy."""
    flags = traces.select(*STATE_FIELDS, F.array_contains("strategies", strategy).cast("int").alias("_p"), (F.col("strategy") == strategy).cast("int").alias("_s"))
    long = flags.unpivot(["_p", "_s"], list(STATE_FIELDS), "field", "value")
    own = long.groupBy("field", "value").agg(F.count("*").alias("n"), F.sum("_p").alias("planned"), F.sum("_s").alias("selected"))
    return own.withColumns({"planned_rate": _share("planned", "n"), "selected_rate": _share("selected", "n")})


def distribution(df: DataFrame, value: str, *group: str) -> DataFrame:
    """Rows, least and largest value, mean and three exact quantiles, by histograms that are refined. Rows whose value is null count in none of these."""
    kind = df.schema[value].dataType
    own = quantiles(df, F.col(value), (0.05, 0.5, 0.95), *group)
    p = [F.col("quantiles")[i].alias(c) for i, c in enumerate(("p05", "median", "p95"))]
    return own.select(*group, "n", F.col("min").cast(kind).alias("min"), *p, F.col("max").cast(kind).alias("max"), N.round_exact(F.try_divide(F.col("sum"), F.col("n").cast("double"))).alias("mean"))


def mean_words(texts: DataFrame, group: str) -> DataFrame:
    n = F.size(X.words(F.col("text")))
    return texts.groupBy(group).agg(F.count("*").alias("n"), N.round_exact(F.sum(n).cast("double") / F.count("*").cast("double"), 2).alias("mean_words"))


def delta_interval(pairs: DataFrame, z: float = 1.96, *group: str) -> DataFrame:
    """pairs: delta. Mean with a symmetric interval of z standard errors."""
    own = pairs.groupBy(*group).agg(F.count("*").alias("n"), F.avg("delta").alias("_m"), F.stddev_samp("delta").alias("_s"))
    half = z * F.coalesce("_s", F.lit(0.0)) / F.sqrt(F.col("n").cast("double"))
    return own.select(*group, "n", N.round_exact(F.col("_m")).alias("mean"), N.round_exact(F.col("_m") - half).alias("low"), N.round_exact(F.col("_m") + half).alias("high"))


def progress_median(targets: DataFrame, rank: str, count: str, *group: str) -> DataFrame:
    """How far into their dialogues targets lie: the median of rank by count."""
    at = F.col(rank).cast("double") / F.col(count).cast("double")
    own = quantiles(targets, at, (0.5,), *group)
    return own.select(*group, "n", N.round_exact(F.col("quantiles")[0]).alias("median"))


def phase_strategies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("phase", "strategy").agg(F.count("*").alias("n"))
