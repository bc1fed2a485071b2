import json

import pytest
from pyspark.sql import functions as F

from tracelab import cli
from tracelab.operators import checks, stats
from tracelab.plans import tables
from tracelab.schemas import TRACE
from tracelab.sources import records

D = "/root/testdata/sf0.001"


def traces(spark, path):
    own = tables.traces(spark, D)
    names = own.columns
    full = own.select(*(F.col(f.name) if f.name in names and f.name != "state_analysis" else F.lit(None).cast(f.dataType).alias(f.name) for f in TRACE))
    full.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return full


def test_balance_and_flatten(spark, tmp_path):
    full = traces(spark, str(tmp_path / "in.jsonl"))
    part = next((tmp_path / "in.jsonl").glob("part-*"))
    (tmp_path / "one.jsonl").write_bytes(part.read_bytes())
    assert cli.main(["balance", "--in", str(tmp_path / "one.jsonl"), "--out", str(tmp_path / "out")]) == 0
    manifest = json.loads((tmp_path / "out-manifest.json").read_text())
    after = records.read_jsonl(spark, str(tmp_path / "out"), TRACE)
    assert manifest["rows"] == after.count() == full.count() and list(manifest["inputs"]) == [str(tmp_path / "one.jsonl")]
    assert sum(sum(v.values()) for v in manifest["strategies"].values()) == full.count()
    box = full.limit(4).select(F.lit("c").alias("conversation_id"), F.array(F.struct(F.struct(*TRACE.names).alias("trace"))).alias("rounds"))
    box.write.option("ignoreNullFields", False).json(str(tmp_path / "conversations"))
    assert cli.main(["flatten", "--in", str(tmp_path / "conversations"), "--out", str(tmp_path / "flat")]) == 0
    assert records.read_jsonl(spark, str(tmp_path / "flat"), TRACE).count() == 4


def test_human_review(spark, tmp_path):
    rows = [("train", str(i), m, f"{m} says {i}") for i in range(6) for m in ("a", "b")]
    own = spark.createDataFrame(rows, "split string, example_id string, model_id string, response string").withColumn("history", F.lit(None).cast("struct<turns:array<struct<role:string,content:string>>>"))
    own.write.json(str(tmp_path / "responses.jsonl"))
    assert cli.main(["human-export", "--in", str(tmp_path / "responses.jsonl"), "--out", str(tmp_path / "sheets")]) == 0
    assert cli.main(["human-summary", "--in", str(tmp_path / "sheets"), str(tmp_path / "sheets-mapping"), "--out", str(tmp_path / "votes")]) == 0
    assert [(r.model_id, r.missing) for r in spark.read.json(str(tmp_path / "votes")).orderBy("model_id").collect()] == [("a", 6), ("b", 6)]
    records.read_annotations(spark, str(tmp_path / "sheets")).withColumn("pair_id", F.lit("pair-999999")).write.option("header", True).csv(str(tmp_path / "wrong"))
    with pytest.raises(ValueError, match="unknown pairs"):
        cli.main(["human-summary", "--in", str(tmp_path / "wrong"), str(tmp_path / "sheets-mapping"), "--out", str(tmp_path / "votes2")])


def test_registry_and_strict_retention(spark):
    teacher, base = {"model_id": "t", "source": "teacher"}, {"model_id": "b", "source": "base"}
    assert checks.registry([teacher, base]) and checks.registry([base], standalone=True)
    for bad in ([teacher], [base, {"model_id": "c", "source": "base"}], [teacher, teacher]):
        with pytest.raises(ValueError):
            checks.registry(bad)
    df = spark.createDataFrame([(0.25, 0.375, 0.5)], "b double, t double, s double")
    assert df.select(stats.retention(F.col("b"), F.col("t"), F.col("s"))).first()[0] is None
    with pytest.raises(Exception, match="gain is below"):
        df.select(stats.retention(F.col("b"), F.col("t"), F.col("s"), strict=True)).collect()
