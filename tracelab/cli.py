"""Command line: ``python -m tracelab.cli COMMAND --in PATH... --out PATH``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.operators import balance, checks, dialogue, export, generation, preparation, quality, rounds, teacher, traces
from tracelab.schemas import DIALOGUE, DIMENSIONS, JUDGMENT, PREPARED, QUOTAS, RESPONSE, TRACE
from tracelab.sources import backends, configs, control, memo, published, records
from tracelab.sources.backends import call
from tracelab.sources.staging import staged

#: The version that manifests of replies and judgments name.
PROTOCOL = "quality-2"


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tracelab").getOrCreate()


def validate(a: argparse.Namespace) -> int:
    rules = [*checks.history_rules(), *checks.plan_rules(), *checks.trace_rules()]
    _, rejected, counts = records.read_counted(_spark(), a.inputs[0], TRACE, rules)
    print(json.dumps(counts))
    if a.out:
        records.write_jsonl(rejected, a.out)
    return int(counts["rejected"] > 0)


def prepare(a: argparse.Namespace) -> int:
    spark = _spark()
    raw = records.read_json(spark, a.inputs[0], DIALOGUE).withColumn("conversation_id", checks.profile_id(F.col("ID")))
    if len(a.inputs) > 1:
        preparation.require_profiles(raw, records.read_json(spark, a.inputs[1], DIALOGUE).select(checks.profile_id(F.col("ID")).alias("conversation_id")))
    turns = raw.select("conversation_id", F.explode("Dialogue").alias("t")).select("conversation_id", F.col("t.Turn").alias("turn"), F.col("t.Seeker").alias("seeker"), F.col("t.Supporter").alias("supporter"))
    out = preparation.prepare(preparation.parse_dialogues(turns), json.loads(a.sizes), a.seed)
    records.write_jsonl(out, a.out)
    return 0


def export_rows(a: argparse.Namespace) -> int:
    own = records.read_records(_spark(), a.inputs[0], TRACE)
    kinds = {"sft": export.sft_rows, "slot": export.slot_rows, "visible": export.visible_rows}
    records.write_jsonl(kinds[a.kind](own), a.out)
    return 0


def reselect(a: argparse.Namespace) -> int:
    records.write_jsonl(traces.reselect(records.read_records(_spark(), a.inputs[0], TRACE)), a.out)
    return 0


def show(a: argparse.Namespace) -> int:
    print(records.read_records(_spark(), a.inputs[0], PREPARED).count())
    return 0


def _judgments(spark: SparkSession, path: str):
    return spark.read.schema(JUDGMENT).json(path).select(*quality.KEY, *(F.col(f"scores.{d}").alias(d) for d in DIMENSIONS))


def report(a: argparse.Namespace) -> int:
    """Coverage, means and comparisons of judgments against all examples times models. --in: judgments, then failures if there are any; --examples: rows that had to be judged."""
    spark = _spark()
    own = _judgments(spark, a.inputs[0])
    failed = spark.read.schema("split string, example_id string, model_id string").json(a.inputs[1]) if len(a.inputs) > 1 else own.select(*quality.KEY).limit(0)
    if not a.examples or not a.models:
        raise ValueError("report needs --examples and --models: what was to be judged")
    examples = spark.read.schema("split string, example_id string").json(a.examples).distinct()
    expected = quality.expected_keys(examples, quality.models_table(spark, a.models))
    if odd := own.join(expected, quality.KEY, "left_anti").select(*quality.KEY).take(3):
        raise ValueError(f"judgments of what wasn't asked for: {[tuple(r) for r in odd]}")
    found = quality.report(expected, own, failed, a.models)
    if a.out:
        control.put_object(spark, a.out, found)
    print(json.dumps(found, ensure_ascii=False))
    return 0


def flatten(a: argparse.Namespace) -> int:
    """Traces of all rounds of the conversations in a file."""
    spark = _spark()
    records.write_jsonl(export.flatten_conversations(spark.read.json(a.inputs[0])).select(*TRACE.names), a.out)
    return 0


def balanced(a: argparse.Namespace) -> int:
    """Traces with their selections moved by the assignment plan, and a manifest beside them; refuses if the input changed meanwhile.

    Assignments that no candidate serves are made by the backend of a config that has ``backend``. Without one they stay undone: the manifest and the output count them as ``unmade``."""
    spark = _spark()
    digests = {p: published.text_digest(spark, p) for p in a.inputs}
    own = records.read_records(spark, a.inputs[0], TRACE)
    stratum = F.concat_ws("\0", "state.dominant_emotion", "state.distress_level")
    choices = F.transform("candidates", lambda c: F.struct(c["candidate_id"].alias("candidate_id"), c["strategy"].alias("strategy")))
    planning = own.select("example_id", "split", stratum.alias("stratum"), F.col("final_selection.selected_strategy").alias("strategy"), F.col("final_selection.selected_candidate_id").alias("selected_id"), choices.alias("candidates"))
    planned = staged(balance.plan(planning, a.seed, QUOTAS), "planned")
    reused, made = planned.where("source = 'reuse'"), planned.where("source = 'generate'")
    after = balance.apply_reuse(own, reused)
    done = reused
    if a.config:
        after = balance.apply_generated(after, _generated(own, made, configs.load(a.config, {"backend": configs.QUALITY["backend"]})["backend"], a.seed))
        done = planned
    if bad := balance.derivative_problems(own, after, done).take(3):
        raise ValueError(f"the derivative is wrong: {[tuple(r) for r in bad]}")
    unmade = {f"{r['split']}/{r['target_strategy']}": r["count"] for r in ([] if a.config else made.groupBy("split", "target_strategy").count().collect())}  # splits times strategies
    records.write_jsonl(after, a.out)
    if changed := [p for p, d in digests.items() if published.text_digest(spark, p) != d]:
        raise ValueError(f"changed while it was read: {', '.join(changed)}")
    control.put_object(spark, f"{a.out.rstrip('/')}-manifest.json", balance.derivative_manifest(planned, after, a.seed, digests) | {"unmade": unmade})
    if unmade:
        print(json.dumps({"unmade": unmade}))
    return 0


def _generated(own, made, backend: dict, seed: int):
    """example_id and new, a candidate of the assigned strategy for each assignment; raises if a call failed or its reply has no text."""
    asked = own.join(made.select("example_id", "target_strategy", "candidate_id"), "example_id")
    requests = asked.select(F.col("example_id").alias("request_id"), F.lit("candidate").alias("role"), F.to_json(F.struct("history", "target_strategy")).alias("messages"), F.lit(seed).alias("seed"))
    got = staged(_asked_by(backend)(requests, configs.backend(backend)), "generated")
    text = F.get_json_object("reply", "$.text")
    if bad := got.where(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0).select("request_id", "error").take(3):
        raise ValueError(f"no reply for {[tuple(r) for r in bad]}")
    new = F.struct(
        "candidate_id", F.concat(F.lit("S"), "candidate_id").alias("strategy_id"), F.col("target_strategy").alias("strategy"), text.alias("response"), F.lit(seed).cast("int").alias("seed"),
        F.coalesce(F.get_json_object("reply", "$.response_goal"), F.lit("")).alias("response_goal"), F.coalesce(F.get_json_object("reply", "$.response_act"), F.lit("")).alias("response_act"),
    )
    return asked.join(got, F.col("example_id") == F.col("request_id")).select("example_id", new.alias("new"))


def _asked_by(backend: dict):
    """What makes calls: through the cache that the config names, if it does."""
    if not backend["cache_path"]:
        return lambda requests, factory, namespace="": call(requests, factory, namespace=namespace, attempts=backend["attempts"])
    return lambda requests, factory, namespace="": memo.memoised(requests, factory, backend["cache_path"], namespace, backend["attempts"])


def quality_merge(a: argparse.Namespace) -> int:
    """Judgments of two runs, the second of one further model, in one. Beside each input stands its manifest, as quality-judge writes it; the two must agree in protocol, splits and settings."""
    spark = _spark()
    base, added = (spark.read.schema(JUDGMENT).json(f"{p.rstrip('/')}/judgments") for p in a.inputs[:2])
    manifests = [control.get_object(spark, f"{p.rstrip('/')}/judgments-manifest.json") for p in a.inputs[:2]]
    if None in manifests:
        raise FileNotFoundError("a set of judgments has no judgments-manifest.json")
    if bad := quality.merge_problems(*manifests, base, added):
        raise ValueError("; ".join(bad))
    ids = manifests[0]["model_ids"] + manifests[1]["model_ids"]
    control.claim(spark, f"{a.out.rstrip('/')}/judgments-manifest.json", manifests[0] | {"model_ids": ids}, a.resume)
    records.write_jsonl(quality.merged(base, added, quality.models_table(spark, ids)), f"{a.out.rstrip('/')}/judgments", "overwrite" if a.resume else "errorifexists")
    return 0


def quality_generate(a: argparse.Namespace) -> int:
    """Replies of all models of a config to the traces of its splits, and failures; 1 if there are any. --resume goes on in a folder of a run with the same config."""
    spark, config, out = _spark(), configs.load(a.config, configs.QUALITY), a.out.rstrip("/")
    own = records.read_records(spark, a.inputs[0], TRACE).where(F.col("split").isin(*config["splits"]))
    control.claim(spark, f"{out}/responses-manifest.json", {"protocol_version": PROTOCOL, "stage": "generate", "config": config}, a.resume)
    prompt = F.array_join(F.transform("history.turns", lambda t: F.concat_ws(": ", t["role"], t["content"])), "\n")
    asked = own.select("split", "example_id", "history", prompt.alias("prompt"), "final_response")
    good, bad = generation.responses(asked, config["models"], configs.backend(config["backend"]), _asked_by(config["backend"]))
    sources = quality.models_table(spark, [m["model_id"] for m in config["models"]]).withColumn("response_source", F.element_at(F.array(*(F.lit(m["source"]) for m in config["models"])), F.col("ord") + 1))
    rows = good.join(asked.select("split", "example_id", "history"), ["split", "example_id"]).join(F.broadcast(sources), "model_id").withColumn("protocol_version", F.lit(PROTOCOL))
    return _write_both(rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RESPONSE)), bad, out, "responses", a.resume)


def quality_judge(a: argparse.Namespace) -> int:
    """Judgments of replies, failures and a report; 1 if there are failures."""
    spark, config, out = _spark(), configs.load(a.config, configs.QUALITY), a.out.rstrip("/")
    own = records.read_records(spark, a.inputs[0], RESPONSE).where(F.col("split").isin(*config["splits"]))
    names = [m["model_id"] for m in config["models"]]
    control.claim(spark, f"{out}/judgments-manifest.json", {"protocol_version": PROTOCOL, "splits": config["splits"], "settings": {"judge_seed": config["judge_seed"], "backend": config["backend"]}, "model_ids": names}, a.resume)
    good, bad = backends.judged(own.select(*quality.KEY, "response"), configs.backend(config["backend"]), config["judge_seed"], _asked_by(config["backend"]))
    good, bad = staged(good, "judged"), staged(bad, "unjudged")
    scores = F.struct(*DIMENSIONS).alias("scores")
    wide = good.select(*quality.KEY, scores, quality.overall_score([F.col(d) for d in DIMENSIONS]).alias("overall"))
    code = _write_both(wide.select(*(F.col(f.name) if f.name in wide.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in JUDGMENT)), bad, out, "judgments", a.resume)
    expected = quality.expected_keys(own.select("split", "example_id").distinct(), quality.models_table(spark, names))
    control.put_object(spark, f"{out}/report.json", quality.report(expected, good, bad, names))
    return code


def run_teacher(a: argparse.Namespace) -> int:
    """Traces of prepared examples, made stage by stage by a config's backend, and failures; 1 if there are any."""
    spark, config, out = _spark(), configs.load(a.config, configs.TEACHER), a.out.rstrip("/")
    own = checks.require_unique(records.read_records(spark, a.inputs[0], PREPARED), "example_id")
    control.claim(spark, f"{out}/traces-manifest.json", {"stage": "teacher", "config": config, "inputs": {p: published.text_digest(spark, p) for p in a.inputs}}, a.resume)
    good, bad = teacher.run(own, configs.backend(config["backend"]), _asked_by(config["backend"]), config["protocol_version"])
    return _write_both(good, bad, out, "traces", a.resume)


def _write_both(good, bad, out: str, name: str, resume: bool) -> int:
    mode = "overwrite" if resume else "errorifexists"
    records.write_jsonl(good, f"{out}/{name}", mode)
    records.write_jsonl(bad, f"{out}/{name}-failures", mode)
    return int(not bad.isEmpty())


def generate_conversations(a: argparse.Namespace) -> int:
    """Conversations of all profiles (rows with an ID) in durable rounds, told of on the way, and then a folder each of completed, truncated and failed ones; 1 if any failed."""
    spark, config, out = _spark(), configs.load(a.config, configs.CONVERSATIONS), a.out.rstrip("/")
    raw = records.read_json(spark, a.inputs[0], T.StructType([T.StructField("ID", T.StringType())]))
    own = raw.select(checks.profile_id(F.col("ID")).alias("conversation_id"))
    if own.where("conversation_id IS NULL").count():
        raise ValueError("a profile has no id")
    checks.require_unique(own, "conversation_id")
    limits = config["min_rounds"], config["soft_rounds"], config["hard_rounds"]
    done = rounds.converse(own, configs.backend(config["backend"]), f"{out}/rounds", limits, config["seed"], a.resume, lambda r: print(json.dumps(r), flush=True))
    routes = dialogue.routed(done)
    for status, rows in routes.items():
        records.write_jsonl(rows, f"{out}/{status}", "overwrite" if a.resume else "errorifexists")
    return int(not routes["failed"].isEmpty())


def human_export(a: argparse.Namespace) -> int:
    """Review sheets of blinded pairs, and beside them the mapping that reviewers don't get."""
    responses = records.read_records(_spark(), a.inputs[0], RESPONSE)
    if bad := quality.response_problems(responses).take(3):
        raise ValueError(f"responses can't be paired: {[tuple(r) for r in bad]}")
    pairs = staged(quality.blinded_pairs(responses, a.seed), "pairs")
    records.write_annotations(pairs, a.out)
    records.write_jsonl(pairs.select("pair_id", "split", "example_id", "model_a", "model_b"), f"{a.out.rstrip('/')}-mapping")
    return 0


def human_summary(a: argparse.Namespace) -> int:
    """Votes from filled-in sheets and the mapping; refuses pairs that the mapping lacks."""
    spark = _spark()
    sheets, mapping = records.read_annotations(spark, a.inputs[0]), spark.read.json(a.inputs[1])
    if bad := quality.unknown_pairs(sheets, mapping).take(3):
        raise ValueError(f"unknown pairs: {[r['pair_id'] for r in bad]}")
    records.write_jsonl(quality.votes(sheets, mapping), a.out, order=("split", "first", "second", "model_id"))
    return 0


COMMANDS = {
    "validate": validate, "prepare": prepare, "export": export_rows, "reselect": reselect, "count": show, "report": report, "flatten": flatten, "balance": balanced, "quality-merge": quality_merge, "human-export": human_export, "human-summary": human_summary,
    "quality-generate": quality_generate, "quality-judge": quality_judge, "generate-conversations": generate_conversations, "run-teacher": run_teacher}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracelab")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--in", dest="inputs", nargs="+", required=True)
    p.add_argument("--out")
    p.add_argument("--kind", default="sft", choices=("sft", "slot", "visible"))
    p.add_argument("--sizes", default='{"train": 96, "dev": 16, "diagnostic_holdout": 16}')
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--config")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--examples")
    p.add_argument("--models", nargs="+")
    a = p.parse_args(argv)
    return COMMANDS[a.command](a)


if __name__ == "__main__":
    raise SystemExit(main())
