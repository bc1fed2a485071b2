import json

import pytest
from pyspark.sql import functions as F
from test_cli import traces

from tracelab import cli
from tracelab.schemas import DIMENSIONS
from tracelab.sources import configs, control

MODELS = [{"model_id": "t", "source": "teacher"}, {"model_id": "s", "source": "student", "seed": 3}]


def written(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_configs_name_all_that_is_wrong(tmp_path):
    good = configs.load(written(tmp_path / "c.json", {"models": MODELS}), configs.QUALITY)
    assert good["judge_seed"] == 4242 and good["backend"]["attempts"] == 2 and good["models"][0]["splits"] == []
    bad = {"models": [{"model_id": " ", "source": "teacher"}, 7], "splits": ["dev", "dev"], "judge_seed": True, "backend": {"kind": "x", "attempts": 0, "port": 1}, "extra": 1}
    with pytest.raises(ValueError) as e:
        configs.load(written(tmp_path / "d.json", bad), configs.QUALITY)
    said = str(e.value)
    for part in ("extra: unknown key", "models[0].model_id: must not be blank", "models[1]: must be an object", "splits: must be known", "judge_seed: has the wrong type", "backend.kind: must be", "backend.attempts: must be from 1 to 10", "backend.port: unknown key"):
        assert part in said
    for config, spec in (({"models": MODELS[:1]}, configs.QUALITY), ({}, configs.QUALITY), ({"soft_rounds": 20}, configs.CONVERSATIONS), ({"seed": 1.5}, configs.CONVERSATIONS)):
        with pytest.raises(ValueError):
            configs.load(written(tmp_path / "e.json", config), spec)


def test_sources_of_replies_are_registered(monkeypatch):
    monkeypatch.setattr(configs, "SOURCES", dict(configs.SOURCES))

    @configs.register_source("fixed")
    def make(config):
        return lambda: config["replies"]["x"]

    assert configs.backend({"kind": "fixed", "replies": {"x": 5}})() == 5
    assert configs.backend({"kind": "factory", "factory": "tracelab.sources.backends:Scripted"})().complete("a", "[]", 1)
    with pytest.raises(ValueError, match="module:name"):
        configs.backend({"kind": "factory", "factory": "nothing"})


def test_generate_judge_report_and_merge(spark, tmp_path, capsys):
    traces(spark, str(tmp_path / "in.jsonl"))
    split = spark.read.json(str(tmp_path / "in.jsonl")).groupBy("split").count().collect()
    n = {r["split"]: r["count"] for r in split}["dev"]
    config = {"models": MODELS, "splits": ["dev"], "backend": {"cache_path": str(tmp_path / "cache")}}
    c = written(tmp_path / "c.json", config)
    out = str(tmp_path / "gen")
    assert cli.main(["quality-generate", "--in", str(tmp_path / "in.jsonl"), "--config", c, "--out", out]) == 0
    assert spark.read.json(f"{out}/responses").count() == 2 * n
    with pytest.raises(FileExistsError):
        cli.main(["quality-generate", "--in", str(tmp_path / "in.jsonl"), "--config", c, "--out", out])
    with pytest.raises(ValueError, match="judge_seed"):
        cli.main(["quality-generate", "--in", str(tmp_path / "in.jsonl"), "--config", written(tmp_path / "d.json", config | {"judge_seed": 5}), "--out", out, "--resume"])
    assert cli.main(["quality-generate", "--in", str(tmp_path / "in.jsonl"), "--config", c, "--out", out, "--resume"]) == 0
    (tmp_path / "responses.jsonl").write_text("".join(p.read_text() for p in (tmp_path / "gen/responses").glob("part-*")))

    judged = lambda name, models: cli.main(["quality-judge", "--in", str(tmp_path / f"{name}.jsonl"), "--config", written(tmp_path / "j.json", config | {"models": models, "standalone": len(models) == 1}), "--out", str(tmp_path / f"judged-{name}")])
    assert judged("responses", MODELS) == 0
    found = control.get_object(spark, str(tmp_path / "judged-responses/report.json"))["splits"]["dev"]
    assert found["models"]["s"]["coverage_rate"] == 1.0 and "s" in str(found["paired"])

    # a report against all that was asked for: what is missing lowers the coverage
    spark.read.json(f"{out}/responses").select("split", "example_id").distinct().unionByName(spark.createDataFrame([("dev", "missing")], "split string, example_id string")).write.json(str(tmp_path / "examples"))
    args = ["report", "--in", str(tmp_path / "judged-responses/judgments"), str(tmp_path / "judged-responses/judgments-failures"), "--examples", str(tmp_path / "examples"), "--models", "t", "s"]
    capsys.readouterr()
    assert cli.main(args) == 0
    own = json.loads(capsys.readouterr().out.splitlines()[-1])["splits"]["dev"]["models"]["t"]
    assert own["expected"] == n + 1 and own["missing"] == 1 and own["coverage_rate"] < 1
    with pytest.raises(ValueError, match="asked for"):
        cli.main([*args[:-1]])
    with pytest.raises(ValueError, match="needs"):
        cli.main(args[:4])

    # a further model, merged; other settings refuse
    spark.read.json(f"{out}/responses").where("model_id = 's'").withColumn("model_id", F.lit("u")).coalesce(1).write.json(str(tmp_path / "more"))
    (tmp_path / "extra.jsonl").write_text(next((tmp_path / "more").glob("part-*")).read_text())
    assert judged("extra", [{"model_id": "u", "source": "student"}]) == 0
    assert cli.main(["quality-merge", "--in", str(tmp_path / "judged-responses"), str(tmp_path / "judged-extra"), "--out", str(tmp_path / "merged")]) == 0
    assert spark.read.json(str(tmp_path / "merged/judgments")).count() == 3 * n
    assert control.get_object(spark, str(tmp_path / "merged/judgments-manifest.json"))["model_ids"] == ["t", "s", "u"]
    manifest = control.get_object(spark, str(tmp_path / "judged-extra/judgments-manifest.json"))
    control.put_object(spark, str(tmp_path / "judged-extra/judgments-manifest.json"), manifest | {"settings": {"judge_seed": 7}})
    with pytest.raises(ValueError, match="settings differ"):
        cli.main(["quality-merge", "--in", str(tmp_path / "judged-responses"), str(tmp_path / "judged-extra"), "--out", str(tmp_path / "merged2")])
    assert set(DIMENSIONS) == set(spark.read.json(str(tmp_path / "merged/judgments")).select("scores.*").columns)


def test_conversations_by_command(spark, tmp_path, capsys):
    profiles = written(tmp_path / "p.json", [{"ID": 7}, {"ID": " user-8 "}])
    c = written(tmp_path / "c.json", {"hard_rounds": 3, "soft_rounds": 2, "backend": {"replies": {"dialogue_manager": '{"mode": "closing"}', "teacher": '{"text": "yes"}', "seeker_simulator": '{"text": "hm"}'}}})
    out = str(tmp_path / "out")
    assert cli.main(["generate-conversations", "--in", profiles, "--config", c, "--out", out]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"round": 1, "conversations": 2, "open": 0, "completed": 2, "truncated": 0, "failed": 0}
    assert sorted(r.conversation_id for r in spark.read.json(f"{out}/completed").collect()) == ["7", "user-8"]
    assert cli.main(["generate-conversations", "--in", profiles, "--config", c, "--out", out, "--resume"]) == 0
    silent = written(tmp_path / "s.json", {"backend": {"replies": {"seeker_simulator": '{"text": " "}'}}})
    assert cli.main(["generate-conversations", "--in", profiles, "--config", silent, "--out", str(tmp_path / "silent")]) == 1
    assert {r.failed_stage for r in spark.read.json(str(tmp_path / "silent/failed")).collect()} == {"seeker_simulator"}
    for ids in ([{"ID": " "}], [{"ID": "a"}, {"ID": "a"}]):
        with pytest.raises(ValueError):
            cli.main(["generate-conversations", "--in", written(tmp_path / "q.json", ids), "--config", c, "--out", str(tmp_path / "no")])


def test_balance_makes_what_no_candidate_has(spark, tmp_path):
    traces(spark, str(tmp_path / "in.jsonl"))
    (tmp_path / "one.jsonl").write_text("".join(p.read_text() for p in (tmp_path / "in.jsonl").glob("part-*")))
    c = written(tmp_path / "c.json", {"backend": {"replies": {"candidate": '{"text": "a new reply"}'}}})
    assert cli.main(["balance", "--in", str(tmp_path / "one.jsonl"), "--config", c, "--out", str(tmp_path / "out")]) == 0
    made = json.loads((tmp_path / "out-manifest.json").read_text())["assignments"]
    after = spark.read.json(str(tmp_path / "out"))
    generated = sum(sources.get("generate", 0) for targets in made.values() for sources in targets.values())
    assert generated > 0 and after.where("final_response = 'a new reply'").count() == generated
    assert json.loads((tmp_path / "out-manifest.json").read_text())["unmade"] == {}
    assert cli.main(["balance", "--in", str(tmp_path / "one.jsonl"), "--out", str(tmp_path / "out2")]) == 0
    assert sum(json.loads((tmp_path / "out2-manifest.json").read_text())["unmade"].values()) == generated
