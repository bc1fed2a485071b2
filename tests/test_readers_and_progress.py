import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.functions.tokens import token_counts, token_ids, within_budget
from tracelab.sources import progress, records

ROW = T.StructType([T.StructField("n", T.LongType()), T.StructField("text", T.StringType())])


def test_a_file_is_read_in_ranges_with_right_line_numbers(spark, tmp_path):
    n, bad = 120_000, {1, 2, 777, 40_000, 99_999, 120_000}
    with open(tmp_path / "a.jsonl", "w") as f:
        for i in range(1, n + 1):
            f.write("\n" if i % 1000 == 5 else "{oops\n" if i in bad else json.dumps({"n": i, "text": "é" * (i % 90)}) + ("\r\n" if i % 7 == 0 else "\n"))
    (tmp_path / "b.jsonl").write_text('{"n": 1, "text": "x"}\n{"n": -1}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        good, rejected, counts = records.read_counted(spark, f"{tmp_path}/*.jsonl", ROW, [("n is negative", F.col("n") > 0)])
        assert good.inputFiles() and len(good.inputFiles()) > 5  # tasks that read the ranges wrote a file each
        got = {(r.path.rsplit("/", 1)[1], r.line): r.reason for r in rejected.collect()}
        assert got == {("a.jsonl", i): "not JSON" for i in bad} | {("b.jsonl", 2): "n is negative"}
        assert counts == {"valid": good.count(), "rejected": 7} and counts["valid"] == n - len(bad) - n // 1000 + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_counts_take_no_second_pass(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df, counts = progress.observed(spark.range(1000).mapInPandas(seen, "id long"), even=F.count_if(F.col("id") % 2 == 0), most=F.max("id"))
    df.write.format("noop").mode("overwrite").save()
    assert counts() == {"even": 500, "most": 999} and calls.value == 1000


def test_streams_tell_of_their_batches(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    told = []
    with progress.streams_watched(spark, told.append):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        stream.writeStream.format("parquet").queryName("q").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    batches = [t for t in told if t["event"] == "batch" and t["query"] == "q"]
    assert max(t["rows"] for t in batches) == 30 and told[0]["event"] == "started" and told[-1] == {"event": "ended", "error": None}


def test_token_counts_equal_the_library(spark):
    tokenizers, paths = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = paths.path("word_bpe_49k.json")
    own = tokenizers.Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    own.encode_special_tokens = True
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    extra = spark.createDataFrame([(-1, 0, "user", None), (-1, 1, "user", ""), (-1, 2, "user", "<|endoftext|> <|startoftext|>"), (-1, 3, "user", "long " * 20_000)], "conv_id long, turn long, role string, text string")
    got = token_ids(df.unionByName(extra), "text", path).collect()
    assert len(got) == df.count() + 4
    for r in got:
        assert r.ids == (None if r.text is None else own.encode(r.text, add_special_tokens=False).ids)
    counts = token_counts(extra, "text", path).select("turn", "tokens", within_budget(F.col("tokens"), 100).alias("fits")).collect()
    assert {r.turn: (r.tokens, r.fits) for r in counts}[0] == (None, False) and {r.turn: r.tokens for r in counts}[3] == 20_000
