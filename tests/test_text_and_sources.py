import json

import pytest
from pyspark.sql import functions as F

from tracelab.functions import numbers as N
from tracelab.functions import text as X
from tracelab.operators import checks, export, traces
from tracelab.schemas import HISTORY, STATE_FIELDS
from tracelab.sources import backends, control, records


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_strip_and_tokens(spark):
    assert one(spark, "　\x1ca b \n", X.strip) == "a b"
    assert one(spark, "Thé café's été, thé", X.tokens) == ["thé", "café's", "été"]
    assert one(spark, " a  b c d e", X.first_words) == "a b c d"


def test_visible(spark):
    good = "".join(f"[{f}]v" for f in STATE_FIELDS) + "[selected_strategy]Question[response] hi [response] "
    assert one(spark, good, X.visible_problem) is None and one(spark, good, X.visible_reply) == "hi [response]"
    assert one(spark, good.replace("[action_intent]v", "[action_intent] "), X.visible_problem) == "visible-SFT value for [action_intent] must not be empty"
    assert "out of order" in one(spark, good[1:], X.visible_problem)
    assert one(spark, "no marker", X.visible_reply) is None and one(spark, "[response] ", X.visible_reply) is None


def test_fences(spark):
    assert one(spark, 'so\n```json\n{"a": 1}\n```', X.fenced_payload) == '{"a": 1}'
    assert one(spark, "```\nno\n```", X.fenced_payload) is None and one(spark, "```{}```\n```{}```", X.fenced_payload) is None
    kinds = [one(spark, t, lambda c: X.reply_kind(c, F.lit(2))) for t in ('{"a": 1}', "```json\n{}\n```", "{oops", "plain")]
    assert kinds == ["object", "fenced", "broken", "plain"] and one(spark, "plain", lambda c: X.reply_kind(c, F.lit(1))) == "retry"


def test_rejections(spark):
    say = lambda s, t: one(spark, t, lambda c: X.rejection_reason(F.lit(s), c, F.lit("I lost my job")))
    assert say("Information", "I'm sure") == "first-person" and say("Information", "it is so") is None
    assert say("Restatement or Paraphrasing", "you should go") == "directive" and say("Restatement or Paraphrasing", "hello there") == "no-overlap" and say("Restatement or Paraphrasing", "your job is gone") is None
    assert say("Self-disclosure", "my therapist") == "self-disclosure"


def test_rounding_and_seeds(spark):
    import hashlib

    rows = spark.createDataFrame([(x / 32,) for x in range(-200, 200)], "x double").select("x", N.round_exact(F.col("x")).alias("y")).collect()
    assert all(r.y == round(r.x, 4) for r in rows)
    got = spark.range(1).select(N.stable_seed("a", F.lit(3), "é").alias("s")).first().s
    assert got == int.from_bytes(hashlib.sha256("a\0003\0é".encode()).digest()[:8], "big") % 2**31


def test_masking_and_padding(spark):
    df = spark.createDataFrame([("a", [10, 11, 12], [20, 21]), ("b", [10], [20, 2])], "example_id string, prompt_ids array<int>, response_ids array<int>")
    got = {r.example_id: r for r in export.encoded(df, 2).collect()}
    assert got["a"].labels == [-100] * 3 + [20, 21, 2] and got["a"].input_ids == [10, 11, 12, 20, 21, 2] and got["a"].slots == [3, 4] and got["b"].labels == [-100, 20, 2]
    pad = {r.example_id: r for r in export.padded_batches(export.encoded(df, 2).withColumn("batch", F.lit(0)), "batch", 0).collect()}
    assert pad["b"].input_ids == [10, 20, 2, 0, 0, 0] and pad["b"].attention_mask == [1, 1, 1, 0, 0, 0] and pad["b"].labels[-3:] == [-100] * 3


def test_selection(spark):
    df = spark.createDataFrame([([("1", "S1", "Question", "r1", None, "g", "a"), ("2", "S2", "Others", "r2", None, "g", "a")],)], "c array<struct<candidate_id:string,strategy_id:string,strategy:string,response:string,seed:int,response_goal:string,response_act:string>>")
    r = df.select(traces.select_candidate(F.col("c"), F.lit("2"), goal=F.lit("new")).alias("s"), traces.select_candidate(F.col("c"), F.lit("9")).alias("n")).first()
    assert r.s.response == "r2" and r.s.response_goal == "new" and r.s.response_act == "a" and r.n is None


def test_exports_block_held_out_splits(spark):
    from pyspark.errors import PySparkException

    from tracelab.plans import tables

    own = tables.traces(spark, "/root/testdata/sf0.001")
    assert set(export.sft_rows(own.where("split = 'dev'")).columns) == {"example_id", "prompt", "response", "selected_strategy"}
    with pytest.raises(PySparkException, match="must not be exported"):
        export.sft_rows(own).collect()


def test_checked_lines(spark, tmp_path):
    lines = ['{"turns": [{"role": "seeker", "content": "a"}]}', "", '{"turns": [{"role": "seeker", "content": "a", "x": 1}]}', "{oops", '{"turns": [{"role": "supporter", "content": "a"}]}', '{"turns": [], "y": 1}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    valid, rejected = records.read_checked(spark, str(tmp_path / "a.jsonl"), HISTORY, checks.history_rules("turns"))
    assert valid.count() == 1
    assert {r.line: r.reason for r in rejected.collect()} == {3: "unknown key turns.x", 4: "not JSON", 5: "history must end with a seeker turn", 6: "unknown key y"}


def test_prepared_container(spark, tmp_path):
    row = lambda i, s: {"example_id": i, "conversation_id": i, "split": s, "history": {"turns": []}}
    box = {"protocol_version": "socialsim-qwen-conversation-v2", "splits": {"train": [row("b", "train"), row("a", "train")], "dev": [row("c", "dev")], "diagnostic_holdout": []}}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(box, indent=1))
    assert [r.example_id for r in records.read_records(spark, str(path), HISTORY).collect()] == ["b", "a", "c"]
    box["splits"]["dev"] = [row("c", "train")]
    path.write_text(json.dumps(box))
    with pytest.raises(ValueError, match="split mismatch"):
        records.read_prepared(spark, str(path))


def test_control_files(spark, tmp_path):
    at, own = tmp_path / "new" / "m.json", {"a": 1, "b": {"c": "é", "d": [1, None]}}
    with pytest.raises(FileNotFoundError):
        control.claim(spark, at, own, True)
    control.claim(spark, at, own, False)
    control.claim(spark, at, own, True)
    assert control.get_object(spark, at) == own and json.loads(at.read_text()) == own
    with pytest.raises(FileExistsError):
        control.claim(spark, at, own, False)
    with pytest.raises(ValueError, match="a, b.c, b.x"):
        control.claim(spark, at, {"a": 2, "b": {"c": "e", "d": [1, None], "x": None}}, True)
    control.put_object(spark, at, {"a": 3})
    assert control.get_object(spark, at) == {"a": 3} and [p.name for p in at.parent.iterdir() if not p.name.startswith(".")] == ["m.json"]
    digest = control.file_digest(at)
    assert control.unchanged({str(at): digest}) == []
    control.put_object(spark, at, {"a": 4})
    assert control.unchanged({str(at): digest, str(tmp_path / "gone"): "x"}) == [str(at), str(tmp_path / "gone")]
    control.publish_folder(tmp_path / "d", {"x": "1"})
    with pytest.raises(FileExistsError):
        control.publish_folder(tmp_path / "d", {"x": "2"})
    assert (tmp_path / "d/x").read_text() == "1" and control.file_digest(tmp_path / "d/x") == "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"


def test_cached_calls(spark):
    asked = spark.createDataFrame([("1", "judge", "[]", 1), ("2", "judge", "[1]", 1)], "request_id string, role string, messages string, seed long")
    first = backends.call(asked, backends.Scripted).collect()
    cache = spark.createDataFrame([(first[0].call_key, first[0].reply)], "call_key string, payload string")
    again = {r.request_id: r for r in backends.call(asked, backends.Scripted, cache).collect()}
    assert again["1"].cached and not again["2"].cached and again["1"].reply == first[0].reply
    failed = backends.call(asked, lambda: backends.Scripted({"judge": "oops"})).collect()
    assert all(r.reply is None and r.error and r.attempt == 2 for r in failed)


def test_a_parsed_text_is_evaluated_once(spark):
    """What a text is made of isn't put in place of each use of it."""
    text = F.concat("t", F.lit("zq"))
    df = spark.createDataFrame([("[response] a",), ("[response]  　",), (None,)], "t string")
    for parsed in (X.visible_problem(text), X.visible_reply(text)):
        assert df.select(parsed.alias("p"))._jdf.queryExecution().optimizedPlan().toString().count("zq") == 1
    assert [r[0] for r in df.select(X.visible_reply(F.col("t"))).collect()] == ["a", None, None]
    assert [r[0] for r in df.select(X.not_blank(F.col("t"))).collect()] == [True, True, False]
