import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.functions import numbers as N
from tracelab.operators import audit, balance, quality, selection
from tracelab.sources.staging import numbered


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_over_many_partitions_keep_every_row(spark, adaptive):
    """Rows with a further column, numbered from ranges that are written once: each row and each number once."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 200_000
        keys = spark.range(n).select((F.col("id") % 3).cast("string").alias("split"), F.sha1(F.col("id").cast("string")).alias("example_id"), F.lit("m").alias("model_id"), F.repeat(F.lit("long reply "), 5).alias("further"), "id")
        got = quality.anonymous_ids(keys)
        r = got.agg(F.count("*").alias("n"), F.count_distinct("candidate").alias("c"), F.max("candidate").alias("m"), F.count_distinct("id").alias("i"), F.count("further").alias("f")).head()
        assert tuple(r) == (n, n, f"candidate-{n}", n, n)
        before_it = got.alias("a").join(got.alias("b"), F.substring("b.candidate", 11, 9).cast("int") == F.substring("a.candidate", 11, 9).cast("int") + 1)
        assert before_it.where("struct(a.split, a.example_id) > struct(b.split, b.example_id)").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pairs_keep_their_numbers_with_and_without_responses(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        own = spark.range(20_000).select(F.lit("s").alias("split"), F.col("id").cast("string").alias("example_id"), F.explode(F.array(*map(F.lit, "abc"))).alias("model_id"))
        own = own.withColumn("response", F.concat("model_id", F.sha2("example_id", 256)))
        whole = quality.blinded_pairs(own, 11)
        r = whole.agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("p"), F.max("pair_id").alias("m")).head()
        assert tuple(r) == (60_000, 60_000, "pair-060000")
        bare = quality.blinded_pairs(own, 11).drop("response_a", "response_b")
        assert whole.select(*bare.columns).exceptAll(bare).isEmpty()
        assert whole.where(~F.col("response_a").startswith(F.col("model_a")) | ~F.col("response_b").startswith(F.col("model_b"))).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbered_odd_tables(spark):
    df = spark.createDataFrame([(None, 1), (2, None), (2, None), (1, 7)], "_part int, _place int")
    got = sorted((r.at, r._part, r._place) for r in numbered(df, ["_part", "_place"], "at").collect())
    assert got == [(1, None, 1), (2, 1, 7), (3, 2, None), (4, 2, None)]
    assert numbered(df.limit(0), ["_part"], "at").count() == 0


def smallest(rows, wanted):
    out = []
    for g, k in wanted.items():
        own = sorted((h, e) for x, h, e in rows if x == g)
        out += [(g, e) for _, e in own[: max(0, k)]]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf", [5, 100_000])
def test_k_smallest_equals_sorting(spark, leaf, monkeypatch):
    monkeypatch.setattr(selection, "DIGITS", 1)
    monkeypatch.setattr(selection.cuts, "__defaults__", (leaf,))
    random.seed(1)
    rows = [(random.choice(["hot"] * 8 + ["a", "b", None]), "", f"e{i}") for i in range(400)] + [("a", "", "e1"), ("same", "", "x"), ("same", "", "x"), ("same", "", "x")]
    df = spark.createDataFrame([(g, e) for g, _, e in rows], "g string, example_id string").withColumn("h", N.digest(5, F.col("example_id")))
    hashed = [tuple(r) for r in df.select("g", "h", "example_id").collect()]
    want = {"hot": 37, "a": 0, "b": 10_000, None: 2, "same": 2}
    sizes = df.groupBy("g").agg(F.count("*").alias("_n")).withColumn("_k", F.coalesce(*(F.when(F.col("g").eqNullSafe(F.lit(g)), F.lit(k)) for g, k in want.items())))
    got = selection.k_smallest(df, ["g"], sizes, F.col("h"), "example_id")
    assert got.columns == df.columns
    assert sorted(((r.g, r.example_id) for r in got.collect()), key=str) == smallest(hashed, want)


def test_one_stratum_with_all_rows_is_never_in_one_task(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("s").alias("split"), F.lit("x").alias("stratum"), F.col("id").cast("string").alias("example_id"))
    got = balance.allocate(df, F.lit(1000), N.digest(3, F.col("example_id")))
    top = df.withColumn("h", N.digest(3, F.col("example_id"))).orderBy("h").limit(1000)
    assert {r.example_id for r in got.collect()} == {r.example_id for r in top.collect()}
    sizes = df.groupBy("split").agg(F.count("*").alias("_n")).withColumn("_k", F.lit(1000))
    found = selection.cuts(df.withColumn("_order", N.digest(3, F.col("example_id"))), ["split"], sizes).collect()
    assert all(r["_n"] <= selection.LEAF for r in found)  # what is put in order


def test_review_takes_a_share_and_one_at_least(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("example_id"), F.when(F.col("id") < 3, "few").otherwise("many").alias("split"), F.lit("t").alias("target_strategy"), F.when(F.col("id") % 10 == 9, "generate").otherwise("reuse").alias("source"))
    got = {(r.split, r.source): r["count"] for r in balance.review_queue(rows, 1).groupBy("split", "source").count().collect()}
    assert got == {("few", "reuse"): 1, ("many", "reuse"): round(897 * 0.2), ("many", "generate"): 100}


@pytest.mark.parametrize("leaf", [4, 4096])
def test_quantiles_equal_numpy(spark, leaf):
    random.seed(2)
    rows = [("a", random.gauss(0, 1) * 10 ** random.randint(-9, 9)) for _ in range(301)]
    rows += [("b", float(random.randint(0, 4))) for _ in range(200)] + [("one", 5.0), ("none", None), (None, 2.0), (None, 3.0), ("huge", 1.7e308), ("huge", -1.7e308), ("huge", 0.0), ("tiny", 5e-324), ("tiny", 0.0)]
    rows += [("inf", x) for x in (float("inf"), -float("inf"), 1.0, 2.0, 3.0)]
    shares = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {r.g: r for r in selection.quantiles(spark.createDataFrame(rows, "g string, v double"), F.col("v"), shares, "g", leaf=leaf).collect()}
    for g in {g for g, _ in rows}:
        own = [v for x, v in rows if x == g and v is not None]
        assert got[g].n == len(own)
        if not own:
            assert got[g]["quantiles"] == [None] * len(shares) and got[g]["min"] is None
            continue
        own.sort()
        for s, q in zip(shares, got[g]["quantiles"], strict=True):
            at = (len(own) - 1) * s
            a, b = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert q == (a if a == b else (np.ceil(at) - at) * a + (at - np.floor(at)) * b)


def test_quantiles_of_ten_million_values(spark):
    n = 10_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n + 0.25).alias("v"))  # each once, in no order
    r = selection.quantiles(df, F.col("v"), (0.05, 0.5, 0.95)).head()
    assert r.n == n and r["min"] == 0.25 and r["max"] == n - 0.75
    assert r["quantiles"] == pytest.approx([(n - 1) * s + 0.25 for s in (0.05, 0.5, 0.95)], abs=1e-6)


def test_distribution_and_progress(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 2, 4), ("a", 3, 4), ("b", None, 2)], "g string, v int, n int")
    got = {r.g: r for r in audit.distribution(df, "v", "g").collect()}
    assert (got["a"].n, got["a"]["min"], got["a"].p05, got["a"].median, got["a"].p95, got["a"]["max"], got["a"].mean) == (3, 1, 1.1, 2.0, 2.9, 3, 2.0)
    assert (got["b"].n, got["b"].median, got["b"].mean) == (0, None, None)
    assert audit.progress_median(df, "v", "n").head().median == 0.5
    assert audit.distribution(df.limit(0), "v").head().n == 0
