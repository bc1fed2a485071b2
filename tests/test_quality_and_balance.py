import pytest
from pyspark.sql import functions as F

from tracelab.operators import audit, balance, checks, quality, stats
from tracelab.schemas import DIMENSIONS, TARGET_STRATEGIES

J = "split string, example_id string, model_id string, " + ", ".join(f"{d} int" for d in DIMENSIONS)


def test_paired_and_means(spark):
    own = spark.createDataFrame([("dev", "e", "student", 4, 4, 5, 4, 4), ("dev", "e", "base", 4, 4, 3, 4, 4), ("diagnostic_holdout", "f", "student", 4, 4, 2, 4, 4), ("diagnostic_holdout", "f", "base", 4, 4, 4, 4, 4)], J)
    got = {(r.split, r.dimension): r for r in quality.paired(own, quality.models_table(spark, ["student", "base"])).collect()}
    assert got["dev", "empathy"].mean_delta == 2.0 and got["diagnostic_holdout", "empathy"].mean_delta == -2.0
    assert got["dev", "overall"].wins == 1 and got["dev", "coherence"].ties == 1
    report = quality.report(own.select(*quality.KEY), own, own.limit(0), ["student", "base"])
    assert report["splits"]["dev"]["models"]["student"]["means"]["overall"] == 4.2
    assert report["splits"]["dev"]["paired"]["student__vs__base"]["empathy"]["wins"] == 1


def test_ranking_breaks_ties_by_id(spark):
    means = spark.createDataFrame([("x", m, "overall", s) for m, s in [("extra", 5.0), ("b", 4.0), ("base", 4.0), ("std", 3.0)]], "split string, model_id string, dimension string, mean double")
    assert [(r["rank"], r.model_id) for r in quality.ranking(means, "x").orderBy("rank").collect()] == [(1, "extra"), (2, "b"), (3, "base"), (4, "std")]


def test_coverage_counts_failed_and_missing(spark):
    keys = spark.createDataFrame([("s", str(i), "m") for i in range(4)], "split string, example_id string, model_id string")
    r = quality.coverage(keys, keys.where("example_id < '2'"), keys.where("example_id = '2'")).first()
    assert (r.expected, r.successful, r.failed, r.missing, r.coverage_rate) == (4, 2, 1, 1, 0.5)


def test_votes(spark):
    mapping = spark.createDataFrame([(f"p{i}", "s", "x", "y") if i % 2 else (f"p{i}", "s", "y", "x") for i in range(5)], "pair_id string, split string, model_a string, model_b string")
    cast = spark.createDataFrame([("p0", "A"), ("p1", "a"), ("p1", "tie"), ("p2", " "), ("p3", "no")], "pair_id string, preference string")
    got = {r.model_id: r for r in quality.votes(cast, mapping).collect()}
    assert (got["x"].wins, got["y"].wins, got["x"].valid_votes, got["x"].ties, got["x"].missing, got["x"].invalid) == (1, 1, 3, 1, 2, 1)
    assert quality.unknown_pairs(spark.createDataFrame([("zz", "a")], "pair_id string, preference string"), mapping).count() == 1


def test_blinded_pairs_alternate_and_repeat(spark):
    rows = spark.createDataFrame([("s", str(e), m, f"{m}{e}") for e in range(6) for m in "ab"], "split string, example_id string, model_id string, response string")
    one, two = (sorted(map(tuple, quality.blinded_pairs(rows, 3).collect())) for _ in range(2))
    assert one == two and [r[5] for r in one] == ["a", "b"] * 3 and all(r[3][0] == r[5] for r in one)


def test_allocation(spark):
    rows = spark.createDataFrame([("s", k, f"{k}{i}") for k, n in (("a", 5), ("b", 3), ("c", 2)) for i in range(n)], "split string, stratum string, example_id string")
    got = balance.allocate(rows, F.lit(4), F.sha2("example_id", 256)).groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in got} == {"a": 2, "b": 1, "c": 1}


def test_plan_is_exact_and_disjoint(spark):
    info, rest, self_ = TARGET_STRATEGIES
    cand = lambda other: [("1", "Reflection of feelings"), ("2", other)]
    rows = [(f"e{i}", "train", "x", "Reflection of feelings", "1", cand([info, rest, "Others", self_][i % 4])) for i in range(24)]
    df = spark.createDataFrame(rows, "example_id string, split string, stratum string, strategy string, selected_id string, candidates array<struct<candidate_id:string,strategy:string>>")
    got = balance.plan(df, 1, {"train": {info: 8, rest: 4, self_: 7}}).collect()
    assert len({r.example_id for r in got}) == 19
    count = lambda t, s: sum(r.target_strategy == t and r.source == s for r in got)
    assert [(count(t, "reuse"), count(t, "generate")) for t in TARGET_STRATEGIES] == [(6, 2), (4, 0), (6, 1)]
    assert all(r.candidate_id == ("2" if r.source == "reuse" else "1") for r in got)


def test_review_queue(spark):
    rows = spark.createDataFrame([(f"e{i}", "dev", "Information", "reuse" if i < 12 else "generate") for i in range(15)], "example_id string, split string, target_strategy string, source string")
    got = balance.review_queue(rows, 1).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"generate": 3, "reuse": 2}


def test_statistics(spark):
    cells = spark.createDataFrame([(float(i), i / 2) for i in range(1, 5)], "teacher double, student double")
    r = stats.alignment(cells).first()
    assert (r.sign_agreement, r.normalized_l1) == (1.0, 0.5) and abs(r.spearman - 1) < 1e-9
    r = spark.range(1).select(stats.retention(F.lit(2.0), F.lit(4.0), F.lit(3.5)).alias("a"), stats.retention(F.lit(2.0), F.lit(2.1), F.lit(3.5)).alias("b")).first()
    assert (r.a, r.b) == (0.75, None)
    full = spark.createDataFrame([("x", 4.5), ("y", 4.0)], "dimension string, score double")
    ablated = spark.createDataFrame([("STATE", "x", 3.0), ("STATE", "y", 3.8), ("PLAN", "x", 4.4), ("PLAN", "y", 2.5)], "fn string, dimension string, score double")
    got = {(r.fn, r.dimension): round(r.loss, 6) for r in stats.fidelity(full, ablated).collect()}
    assert got == {("STATE", "x"): 1.5, ("STATE", "y"): 0.2, ("PLAN", "x"): 0.1, ("PLAN", "y"): 1.5}
    assert stats.fidelity_problems(full, ablated).count() == 0 and stats.fidelity_problems(full, ablated.limit(3)).count() == 1


def test_early_stopping(spark):
    rows = spark.createDataFrame(list(enumerate([3.0, 2.0, 2.0, 2.5, 1.0, 1.0])), "epoch int, metric double")
    got = [(r.improved, r.bad_epochs, r.stops) for r in stats.early_stopping(rows, 2).orderBy("epoch").collect()]
    assert got == [(True, 0, False), (True, 0, False), (False, 1, False), (False, 2, True), (True, 0, False), (False, 1, False)]


def test_contamination_and_gates(spark):
    rows = spark.createDataFrame([(1, " ```json\n{}\n```", True), (1, "ok", False)], "slot int, text string, selected boolean")
    assert tuple(audit.contamination(rows).first()) == (1, 2, 1, 1)
    got = {r.gate: r.raised for r in audit.gates(spark.createDataFrame([("slot", 0.51), ("prefix", 0.2), ("function", 0.3)], "gate string, value double")).collect()}
    assert got == {"slot": True, "prefix": False, "function": True}


def test_checks(spark):
    assert spark.createDataFrame([("7",), (" user-7 ",), ("",), ("　",), (None,), ("a\x07",)], "x string").select(checks.profile_id(F.col("x")).alias("p")).collect() == [(x,) for x in ("7", "user-7", None, None, None, None)]
    with pytest.raises(ValueError):
        checks.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")
    with pytest.raises(ValueError):
        checks.round_limits(3, 2, 5)
    t = spark.createDataFrame([("ok", 1, 1, "seeker"), ("ok", 2, 1, "supporter"), ("odd", 1, 1, "seeker"), ("bad", 1, 1, "supporter"), ("bad", 2, 1, "seeker")], "conversation_id string, turn_index int, round_index int, role string")
    assert {r.conversation_id for r in checks.round_problems(t).collect()} == {"odd", "bad"}
