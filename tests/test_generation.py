from pyspark.sql import functions as F

from tracelab.operators import checks, dialogue, generation
from tracelab.schemas import DIMENSIONS, STATE_VALUES, state_labels
from tracelab.sources import backends


def talker():
    """A backend whose class goes to workers by value."""
    import json

    class Talker:
        def complete(self, role, messages, seed):
            m = json.loads(messages)
            if role == "seeker_simulator":
                if m["conversation"] == "fail":
                    raise OSError("down")
                return json.dumps({"text": f"{m['conversation']} {m['round']}"})
            if role == "dialogue_manager":
                if m["round"] == 2:
                    return "not JSON"
                return json.dumps({"mode": "closing" if m["conversation"] == "short" and m["round"] == 3 else "supporting"})
            return json.dumps({"text": f"reply {m['round']} after {len(m['recent'])}", "strategy": "Question"})

    return lambda: Talker()


def test_loop_routes_and_resumes(spark):
    own = spark.createDataFrame([("short",), ("long",), ("fail",)], "conversation_id string")
    got = {r.conversation_id: r for r in generation.generate(own, talker(), (1, 3, 5)).collect()}
    assert (got["short"].status, got["short"].completed_rounds, got["short"].final_mode) == ("completed", 3, "closing")
    assert (got["long"].status, got["long"].completed_rounds) == ("truncated", 5) and got["long"].rounds[1].mode == "supporting"
    assert (got["fail"].status, got["fail"].failed_stage, got["fail"].completed_rounds) == ("failed", "seeker_simulator", 0)
    assert got["long"].rounds[4].supporter == "reply 5 after 3"
    part = spark.createDataFrame([("long", got["long"].rounds[:2])], generation.generate(own, talker()).select("conversation_id", "rounds").schema)
    assert generation.generate(part, talker(), (1, 3, 5)).first().rounds == got["long"].rounds
    routes = dialogue.routed(generation.generate(own, talker(), (1, 3, 5)))
    assert {k: v.count() for k, v in routes.items()} == {"completed": 1, "truncated": 1, "failed": 1}


def test_responses_and_judgments(spark):
    own = spark.createDataFrame([("dev", "e1", "p", "said"), ("dev", "e2", "p2", "told")], "split string, example_id string, prompt string, final_response string")
    models = checks.registry([{"model_id": "t", "source": "teacher"}, {"model_id": "s", "source": "student", "seed": 3}])
    good, bad = generation.responses(own, models, backends.Scripted)
    assert good.count() == 4 and bad.count() == 0 and {r.response for r in good.where("reused").collect()} == {"said", "told"}
    _, bad = generation.responses(own, models, lambda: backends.Scripted({"s": '{"text": " "}'}))
    assert {r.error for r in bad.collect()} == {"empty response"}
    judged, failed = backends.judged(good, backends.Scripted)
    assert judged.count() == 4 and failed.count() == 0 and set(DIMENSIONS) < set(judged.columns)
    _, failed = backends.judged(good, lambda: backends.Scripted({"judge": '{"scores": [0, 1, 2, 3, 4]}'}))
    assert failed.count() == 4


def test_judgment_rules_and_labels(spark):
    df = spark.createDataFrame([((4, 4, 5, 4, 4), 4.2, "ok"), ((4, 4, 5, 4, 4), 4.3, "ok"), ((0, 4, 5, 4, 4), 3.4, "ok")], f"scores struct<{','.join(f'{d}:int' for d in DIMENSIONS)}>, overall double, short_reason string")
    valid, rejected = checks.validated(df, checks.judgment_rules())
    assert valid.count() == 1 and {r.reason for r in rejected.collect()} == {"overall differs from the mean of scores", "coherence is out of range"}
    assert state_labels(spark).groupBy("field").agg(F.count("*").alias("n")).count() == len(STATE_VALUES)
