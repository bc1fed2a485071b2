"""Judged replies: coverage, means, paired comparison, ranking, and blinded review by people.

Scores are integers, so sums are exact; means and rates are rounded once, at the end. A comparison of all models is one self-join on the example
and one aggregate, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions import numbers as N
from tracelab.schemas import DIMENSIONS
from tracelab.sources.staging import numbered

KEY = ["split", "example_id", "model_id"]


def overall_score(scores: Sequence[Column]) -> Column:
    return N.round_exact(sum(scores[1:], scores[0]) / F.lit(float(len(scores))))


def models_table(spark, models: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(m, i) for i, m in enumerate(models)], "model_id string, ord int")


def expected_keys(examples: DataFrame, models: DataFrame) -> DataFrame:
    """examples (split, example_id) times models, a list that a person wrote."""
    return examples.select("split", "example_id").crossJoin(F.broadcast(models.select("model_id")))


def by_dimension(judgments: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """split, example_id, model_id, dimension, points, parts: a score is points / parts; overall has the sum of all as points."""
    total = sum((F.col(d) for d in dimensions[1:]), F.col(dimensions[0]))
    own = judgments.select(*KEY, *(F.col(d).cast("long").alias(d) for d in dimensions), total.cast("long").alias("overall"))
    long = own.unpivot(KEY, [*dimensions, "overall"], "dimension", "points")
    return long.withColumn("parts", F.when(F.col("dimension") == "overall", len(dimensions)).otherwise(1))


def coverage(expected: DataFrame, judgments: DataFrame, failures: DataFrame) -> DataFrame:
    """Of each split and model: expected, successful, failed, missing keys and the rate."""
    flag = lambda df, name: df.select(*KEY).distinct().withColumn(name, F.lit(1))
    all_keys = expected.join(flag(judgments, "_ok"), KEY, "left").join(flag(failures, "_bad"), KEY, "left")
    counted = all_keys.groupBy("split", "model_id").agg(F.count("*").alias("expected"), F.count("_ok").alias("successful"), F.count("_bad").alias("failed"))
    rate = N.round_exact(F.try_divide(F.col("successful").cast("double"), F.col("expected").cast("double")))
    return counted.withColumns({"missing": F.col("expected") - F.col("successful") - F.col("failed"), "coverage_rate": rate})


def means(expected: DataFrame, judgments: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Mean of each dimension over the expected keys that were judged."""
    own = by_dimension(judgments, dimensions).join(expected.select(*KEY), KEY, "left_semi")
    mean = N.round_exact(F.sum("points").cast("double") / F.sum("parts").cast("double"))
    return own.groupBy("split", "model_id", "dimension").agg(mean.alias("mean"), F.count("*").alias("n"))


def paired(judgments: DataFrame, models: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """For each split and pair of models (in the models' order) and dimension, over all examples that both have: pairs, mean_delta, wins, ties, losses and rates of the left one."""
    names = [*dimensions, "overall"]
    total = sum((F.col(d) for d in dimensions[1:]), F.col(dimensions[0]))
    own = judgments.join(F.broadcast(models), "model_id").select("split", "example_id", "model_id", "ord", F.struct(*(F.col(d).cast("long").alias(d) for d in dimensions), total.cast("long").alias("overall")).alias("s"))
    left, right = own.alias("l"), own.alias("r")
    both = left.join(right, (F.col("l.split") == F.col("r.split")) & (F.col("l.example_id") == F.col("r.example_id")) & (F.col("l.ord") < F.col("r.ord")))
    delta = {d: (F.col(f"l.s.{d}") - F.col(f"r.s.{d}")) for d in names}
    sums = []
    for d in names:
        sums += [F.sum(delta[d]).alias(f"{d}_delta"), F.count_if(delta[d] > 0).alias(f"{d}_wins"), F.count_if(delta[d] == 0).alias(f"{d}_ties"), F.count_if(delta[d] < 0).alias(f"{d}_losses")]
    wide = both.groupBy(F.col("l.split").alias("split"), F.col("l.model_id").alias("left_model"), F.col("r.model_id").alias("right_model")).agg(F.count("*").alias("pairs"), *sums)
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(float(len(dimensions) if d == "overall" else 1)).alias("parts"), *(F.col(f"{d}_{x}").alias(x) for x in ("delta", "wins", "ties", "losses"))) for d in names))
    rate = lambda c: N.round_exact(F.col(c).cast("double") / F.col("pairs").cast("double"))
    return (
        wide.select("split", "left_model", "right_model", "pairs", F.explode(each).alias("e"))
        .select("split", "left_model", "right_model", "pairs", "e.*")
        .withColumns({"mean_delta": N.round_exact(F.col("delta").cast("double") / (F.col("pairs").cast("double") * F.col("parts"))), "win_rate": rate("wins"), "tie_rate": rate("ties"), "loss_rate": rate("losses")})
        .drop("delta", "parts")
    )


def ranking(means_of_models: DataFrame, split: str) -> DataFrame:
    """Models of a split by overall mean, the highest first, then by id."""
    own = means_of_models.where((F.col("split") == split) & (F.col("dimension") == "overall"))
    return own.select(F.row_number().over(Window.orderBy(F.desc("mean"), "model_id")).alias("rank"), "model_id", F.col("mean").alias("overall"))  # a row for each model


def report(expected: DataFrame, judgments: DataFrame, failures: DataFrame, models: Sequence[str], dimensions: Sequence[str] = DIMENSIONS) -> dict:
    """The nested report, from tables with a few rows for each model."""
    table = models_table(judgments.sparkSession, models)
    out: dict = {"dimensions": list(dimensions), "splits": {}}
    at = lambda split: out["splits"].setdefault(split, {"models": {}, "paired": {}})
    empty = {d: None for d in [*dimensions, "overall"]}
    for r in coverage(expected, judgments, failures).collect():
        at(r["split"])["models"][r["model_id"]] = {c: r[c] for c in ("expected", "successful", "failed", "missing", "coverage_rate")} | {"means": dict(empty)}
    for r in means(expected, judgments, dimensions).collect():
        at(r["split"])["models"][r["model_id"]]["means"][r["dimension"]] = r["mean"]
    for r in paired(judgments, table, dimensions).collect():
        at(r["split"])["paired"].setdefault(f"{r['left_model']}__vs__{r['right_model']}", {})[r["dimension"]] = {c: r[c] for c in ("pairs", "mean_delta", "wins", "ties", "losses", "win_rate", "tie_rate", "loss_rate")}
    return out


def merge_problems(base: dict, added: dict, base_keys: DataFrame, added_keys: DataFrame) -> list[str]:
    """Why two judged sets can't be merged; manifests have protocol_version, splits, settings and model_ids."""
    out = [f"{k} differ" for k in ("protocol_version", "splits", "settings") if base[k] != added[k]]
    out += ["the added set must have one model"] * (len(added["model_ids"]) != 1) + ["a model is in both sets"] * bool({*base["model_ids"]} & {*added["model_ids"]})
    a, b = (x.select("split", "example_id").distinct() for x in (base_keys, added_keys))
    return out + ["examples differ"] * (not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty())


def merged(base: DataFrame, added: DataFrame, models: DataFrame) -> DataFrame:
    return base.unionByName(added).join(F.broadcast(models), "model_id").orderBy("split", "example_id", "ord").drop("ord")


def anonymous_ids(keys: DataFrame) -> DataFrame:
    """candidate-000001... in the order of split, example and model."""
    return numbered(keys, KEY, "_at").withColumn("candidate", F.format_string("candidate-%06d", "_at")).drop("_at")


def response_problems(responses: DataFrame) -> DataFrame:
    """split, example_id and problem: repeated keys, several histories, or a model that is missing."""
    every = responses.select("model_id").distinct().agg(F.count("*").alias("_all"))
    groups = responses.groupBy("split", "example_id").agg(F.count("*").alias("n"), F.count_distinct("model_id").alias("m"), F.count_distinct(F.to_json("history")).alias("h"))
    why = F.when(F.col("n") > F.col("m"), "duplicate quality response").when(F.col("h") > 1, "conflicting histories").when(F.col("m") < F.col("_all"), "incomplete response group")
    return groups.crossJoin(F.broadcast(every)).withColumn("problem", why).where("problem IS NOT NULL").select("split", "example_id", "problem")  # one row


def blinded_pairs(responses: DataFrame, seed: int) -> DataFrame:
    """responses: split, example_id, model_id, response. pair_id, sides and models; sides alternate in the hashed order of a group."""
    own = responses.select("split", "example_id", "model_id", "response")
    l, r = own.alias("l"), own.alias("r")
    both = l.join(r, (F.col("l.split") == F.col("r.split")) & (F.col("l.example_id") == F.col("r.example_id")) & (F.col("l.model_id") < F.col("r.model_id")))
    pairs = both.select(F.col("l.split").alias("split"), F.col("l.example_id").alias("example_id"), F.col("l.model_id").alias("left"), F.col("r.model_id").alias("right"), F.col("l.response").alias("lr"), F.col("r.response").alias("rr"))
    order = N.digest(seed, F.col("split"), F.col("left"), F.col("right"), F.col("example_id"))
    hashed = numbered(pairs.withColumn("_h", order), ["split", "left", "right", "_h"], "_at")
    first = hashed.groupBy("split", "left", "right").agg(F.min("_at").alias("_f"))
    straight = (F.col("_at") - F.col("_f")) % 2 == 0
    side = lambda a, b: F.when(straight, F.col(a)).otherwise(F.col(b))
    return hashed.join(F.broadcast(first), ["split", "left", "right"]).select(  # a row for each pair of models
        F.format_string("pair-%06d", "_at").alias("pair_id"), "split", "example_id", side("lr", "rr").alias("response_a"), side("rr", "lr").alias("response_b"), side("left", "right").alias("model_a"), side("right", "left").alias("model_b")
    )


def unknown_pairs(annotations: DataFrame, mapping: DataFrame) -> DataFrame:
    return annotations.join(mapping.select("pair_id"), "pair_id", "left_anti")


def votes(annotations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Of each split and pair of models, and each of the two: wins and rate, with ties, missing and invalid votes of the pair."""
    own = mapping.select("pair_id", "split", F.least("model_a", "model_b").alias("first"), F.greatest("model_a", "model_b").alias("second"), "model_a", "model_b")
    choice = F.lower(F.trim(F.coalesce("preference", F.lit(""))))
    cast = own.join(annotations.select("pair_id", choice.alias("choice")), "pair_id", "left")
    choice = F.coalesce("choice", F.lit(""))
    winner = F.when(choice == "a", F.col("model_a")).when(choice == "b", F.col("model_b"))
    valid = choice.isin("a", "b", "tie")
    counted = cast.groupBy("split", "first", "second").agg(
        F.count_if(valid).alias("valid_votes"), F.count_if(choice == "tie").alias("ties"), F.count_if(choice == "").alias("missing"), F.count_if(~valid & (choice != "")).alias("invalid"),
        F.count_if(winner == F.col("first")).alias("_1"), F.count_if(winner == F.col("second")).alias("_2"),
    )
    rate = lambda c: N.round_exact(F.try_divide(c.cast("double"), F.col("valid_votes").cast("double")))
    sides = F.array(F.struct(F.col("first").alias("model_id"), F.col("_1").alias("wins")), F.struct(F.col("second").alias("model_id"), F.col("_2").alias("wins")))
    long = counted.withColumn("_s", F.explode(sides)).select("split", "first", "second", "_s.model_id", "_s.wins", "valid_votes", "ties", "missing", "invalid")
    return long.withColumns({"win_rate": rate(F.col("wins")), "tie_rate": rate(F.col("ties"))})
