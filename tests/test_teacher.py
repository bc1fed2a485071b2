import json
from pathlib import Path

import pytest

from tracelab import cli
from tracelab.operators import checks, teacher
from tracelab.plans.features import Guide
from tracelab.schemas import CONTEXT_FIELDS, HISTORY, TRACE
from tracelab.sources import memo, published, records

SCHEMA = f"example_id string, split string, history {HISTORY.simpleString()}"


def example(name, *said):
    return name, "dev", {"turns": [{"role": ("seeker", "supporter")[i % 2], "content": c} for i, c in enumerate(said)]}


def logged(log):
    class Logged(Guide):
        def complete(self, role, messages, seed):
            if '"content":"down"' in messages and role == "planner":
                raise OSError("down")
            with open(log, "a") as f:
                f.write(f"{role}\n")
            return super().complete(role, messages, seed)

    return lambda: Logged()


def test_stages_give_whole_traces_and_failures(spark, tmp_path):
    rows = [example("good", "a" * 8), example("longer", "hi", "yes", "b" * 9), example("patch", "c" * 5), example("plan", "d" * 10), example("selection", "e" * 7), example("ends", "hi", "there"), example("empty"), example("down", "down")]
    log, cache = str(tmp_path / "log"), str(tmp_path / "cache")
    ask = lambda requests, factory, namespace="": memo.memoised(requests, factory, cache, namespace, 1)
    good, bad = teacher.run(spark.createDataFrame(rows, SCHEMA), logged(log), ask)
    assert good.schema.names == TRACE.names
    assert {r.example_id: r.stage for r in bad.collect()} == {"plan": "plan", "selection": "selection", "ends": "history", "empty": "history", "down": "plan"}
    got = {r.example_id: r for r in good.collect()}
    assert sorted(got) == ["good", "longer", "patch"]
    assert [c.strategy for c in got["good"].candidates] == got["good"].plan.strategies and got["good"].final_response == got["good"].candidates[0].response
    assert got["longer"].final_selection.selected_candidate_id == "2" and len({c.seed for c in got["longer"].candidates}) == 3
    assert [r.role for r in got["good"].call_records] == ["context_updater", "multi_view_state_analyzer", "planner", "candidate", "candidate", "candidate", "final_selector"]
    assert got["good"].context_after[CONTEXT_FIELDS[0]] == ["length 8"] and got["good"].context_merge_errors == []
    assert got["patch"].context_after[CONTEXT_FIELDS[0]] == [] and got["patch"].context_merge_errors == ["context updater failed: context patch can't be read"]
    valid, rejected = checks.validated(good, [*checks.history_rules(), *checks.state_rules(), *checks.plan_rules(), *checks.trace_rules()])
    assert rejected.count() == 0
    calls = len(Path(log).read_text().split())
    again, _ = teacher.run(spark.createDataFrame(rows, SCHEMA), logged(log), ask)
    assert again.count() == 3 and len(Path(log).read_text().split()) == calls  # none was made again


def test_context_goes_on_from_before(spark):
    before = {f: ["old"] if f == CONTEXT_FIELDS[0] else [] for f in CONTEXT_FIELDS}
    name, split, history = example("x", "a" * 8)
    schema = SCHEMA + ", context_before struct<" + ",".join(f"{f}:array<string>" for f in CONTEXT_FIELDS) + ">"
    good, bad = teacher.run(spark.createDataFrame([(name, split, history, before)], schema), Guide)
    assert good.first().context_after[CONTEXT_FIELDS[0]] == ["old", "length 8"] and bad.count() == 0
    nothing, failed = teacher.run(spark.createDataFrame([], SCHEMA), Guide)
    assert nothing.count() == failed.count() == 0


def test_run_teacher_command(spark, tmp_path):
    rows = [dict(zip(("example_id", "split", "history"), example(n, text), strict=True)) for n, text in (("a", "x" * 8), ("b", "y" * 10))]
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "c.json").write_text(json.dumps({"backend": {"kind": "factory", "factory": "tracelab.plans.features:Guide", "cache_path": str(tmp_path / "cache")}}))
    args = ["run-teacher", "--in", str(tmp_path / "in.jsonl"), "--config", str(tmp_path / "c.json"), "--out", str(tmp_path / "out")]
    assert cli.main(args) == 1  # b fails
    assert [r.example_id for r in records.read_jsonl(spark, str(tmp_path / "out/traces"), TRACE).collect()] == ["a"]
    assert cli.main([*args, "--resume"]) == 1
    (tmp_path / "in.jsonl").write_text(json.dumps(rows[0]) + "\n")
    with pytest.raises(ValueError, match="inputs"):
        cli.main([*args, "--resume"])


def test_bank_with_its_model(spark, tmp_path):
    path = str(tmp_path / "bank")
    bank = spark.createDataFrame([("a", [0.6, 0.8]), ("b", [1.0, 0.0])], "example_id string, vector array<double>")
    assert records.save_bank(bank, path, "m1")["width"] == 2
    assert records.load_bank(spark, path, "m1", 2).count() == 2
    for model, width in (("m2", 2), ("m1", 3)):
        with pytest.raises(ValueError, match="not m2|not 3"):
            records.load_bank(spark, path, model, width)
    with pytest.raises(ValueError, match="not of unit length"):
        records.save_bank(spark.createDataFrame([("a", [0.6, 0.6])], bank.schema), str(tmp_path / "no"), "m1")
    text = tmp_path / "t.txt"
    text.write_text("a\nb\n")
    one = published.text_digest(spark, str(text))
    text.write_text("a\nc\n")
    assert published.text_digest(spark, str(text)) != one
