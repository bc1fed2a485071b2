"""Queries of what has state, memory or several passes: streams, rounds, caches, published tables, quantiles, tokens."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelab.functions import numbers as N
from tracelab.functions.tokens import token_counts, within_budget
from tracelab.operators import rounds, teacher
from tracelab.operators.selection import quantiles, smallest_share
from tracelab.plans import tables as D
from tracelab.plans.registry import query
from tracelab.schemas import CONTEXT_FIELDS, PATCH, STATE_VALUES, STRATEGIES
from tracelab.sources import memo, published, records
from tracelab.sources.staging import shared_folder
from tracelab.streaming import keyed


def _folder(spark, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@query(f"""WITH o AS (SELECT o_custkey::VARCHAR AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn, o_orderpriority AS fact, o_orderkey % 4 <> 0 AS committed FROM orders),
a AS (SELECT session, turn, list_distinct(list(fact) FILTER (committed) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS facts FROM o)
SELECT session, turn, {", ".join(f"coalesce(len(facts), 0)::BIGINT AS n_{i}" if i in (0, 8) else f"0::BIGINT AS n_{i}" for i in range(len(CONTEXT_FIELDS)))},
  coalesce(array_to_string(list_sort(facts), '|'), '') AS facts FROM a""")
def context_stream(spark, d):
    """The contexts of all turns, from a stream whose files hold them in no order."""
    fact, none = F.array("o_orderpriority"), F.array().cast("array<string>")
    add = F.struct(*((fact if i in (0, 8) else none).alias(f) for i, f in enumerate(CONTEXT_FIELDS)))
    nothing = F.lit(None).cast(PATCH)
    patch = F.struct(add.alias("add"), nothing["replace"].alias("replace"), nothing["remove"].alias("remove"))
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    own = D.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("session"), turn.alias("turn"), patch.alias("patch"), (F.col("o_orderkey") % 4 != 0).alias("committed"))
    folded = keyed.fold_files(own)
    sizes = [F.size(F.col(f"context.{f}")).cast("long").alias(f"n_{i}") for i, f in enumerate(CONTEXT_FIELDS)]
    return folded.select("session", "turn", *sizes, F.array_join(F.array_sort(F.col(f"context.{CONTEXT_FIELDS[8]}")), "|").alias("facts"))


class Sayings:
    """A backend that answers from a conversation's number alone: some close, some never do, some fail in their second round."""

    def complete(self, role: str, messages: str, seed: int | None) -> str:
        m = json.loads(messages)
        n, index = int(m["conversation"]), m["round"]
        if role == "seeker_simulator" and n % 11 == 5 and index == 2:
            raise OSError("down")
        if role == "dialogue_manager":
            return json.dumps({"mode": "closing" if n % 3 < 2 and index > n % 4 else "supporting"})
        return json.dumps({"text": f"{role} {n} {index}", "strategy": "Question"})


@query("""WITH c AS (SELECT DISTINCT conv_id, conv_id % 11 = 5 AS fails, CASE WHEN conv_id % 3 < 2 THEN conv_id % 4 + 1 END AS closes FROM conversations)
SELECT conv_id::VARCHAR AS conversation_id, CASE WHEN fails AND coalesce(closes, 9) > 1 THEN 'failed' WHEN closes IS NOT NULL THEN 'completed' ELSE 'truncated' END AS status,
  (CASE WHEN fails AND coalesce(closes, 9) > 1 THEN 1 ELSE coalesce(closes, 5) END)::INTEGER AS completed_rounds,
  CASE WHEN fails AND coalesce(closes, 9) > 1 THEN 'supporting' WHEN closes IS NOT NULL THEN 'closing' ELSE 'supporting' END AS final_mode,
  CASE WHEN fails AND coalesce(closes, 9) > 1 THEN 'seeker_simulator' END AS failed_stage FROM c""")
def durable_rounds(spark, d):
    own = D.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id")).distinct()
    out = rounds.converse(own, Sayings, _folder(spark, "rounds"), (1, 3, 5))
    return out.select("conversation_id", "status", "completed_rounds", "final_mode", "failed_stage")


class Echo:
    def complete(self, role: str, messages: str, seed: int | None) -> str:
        return json.dumps({"text": f"{role}/{messages}/{seed}"})


@query("""SELECT o_orderkey::VARCHAR AS request_id, '{"text": "' || o_orderpriority || '/[' || (o_custkey % 50) || ']/' || (o_custkey % 3) || '"}' AS reply, (o_custkey % 50) % 2 = 0 AS cached FROM orders""")
def memo_calls(spark, d):
    """Half of the different requests were made by an earlier run."""
    asked = D.read(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("role"), F.concat(F.lit("["), (F.col("o_custkey") % 50).cast("string"), F.lit("]")).alias("messages"), (F.col("o_custkey") % 3).alias("seed"), (F.col("o_custkey") % 50 % 2 == 0).alias("before"))
    folder = _folder(spark, "memo")
    memo.memoised(asked.where("before"), Echo, folder).isEmpty()
    memo.compact(spark, folder)
    return memo.memoised(asked, Echo, folder).select("request_id", "reply", "cached")


@query("""SELECT p_partkey, p_name, p_retailprice, (SELECT count(*) FROM part) AS "rows", 0 AS problems FROM part""")
def published_parts(spark, d):
    path = _folder(spark, "published")
    record = published.publish(D.read(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path, lines=True)
    return published.read_published(spark, path).select("*", F.lit(record["rows"]).cast("long").alias("rows"), F.lit(len(published.problems(spark, path))).alias("problems"))


@query(f"""SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS least, {", ".join(f"cast(format('{{:.4f}}', quantile_cont(l_extendedprice, {q})) AS DOUBLE) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.99))}, max(l_extendedprice) AS most FROM lineitem GROUP BY 1""")
def price_quantiles(spark, d):
    own = quantiles(D.read(spark, d, "lineitem"), F.col("l_extendedprice"), (0.25, 0.5, 0.99), "l_returnflag")
    return own.select("l_returnflag", "n", F.col("min").alias("least"), *(N.round_exact(F.col("quantiles")[i]).alias(c) for i, c in enumerate(("q25", "q50", "q99"))), F.col("max").alias("most"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('5' || chr(0) || event_id), event_id) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id FROM r WHERE pos <= greatest(1, round_even(n * 0.1::DOUBLE, 0))""")
def share_of_events(spark, d):
    """The tenth of each type's events with the smallest digests, whatever a type's size."""
    return smallest_share(D.read(spark, d, "events").select("event_type", "event_id"), ["event_type"], 0.1, N.digest(5, F.col("event_id")), "event_id")


@query("""SELECT event_type, sum((value >= 0)::BIGINT)::BIGINT AS valid, sum((value < 0)::BIGINT)::BIGINT AS rejected FROM (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN -value - 1 ELSE value END AS value FROM events) GROUP BY 1""")
def counted_lines(spark, d):
    """Events as JSON lines, some with a value that a rule rejects; read in ranges, and the counts by type from valid and rejected rows."""
    path = _folder(spark, "lines")
    value = F.when(F.col("event_id") % 5 == 0, -F.col("value") - 1).otherwise(F.col("value"))
    own = D.read(spark, d, "events").select("event_id", "event_type", value.alias("value"))
    records.write_jsonl(own, path)
    good, bad, counts = records.read_counted(spark, path, own.schema, [("value is negative", F.col("value") >= 0)])
    kind = F.get_json_object("raw", "$.event_type")
    both = good.select("event_type", F.lit(1).alias("v"), F.lit(0).alias("r")).unionByName(bad.select(kind.alias("event_type"), F.lit(0).alias("v"), F.lit(1).alias("r")))
    out = both.groupBy("event_type").agg(F.sum("v").alias("valid"), F.sum("r").alias("rejected"))
    return out.where(F.lit(counts["valid"] + counts["rejected"] > 0))


@query()
def token_budget_of_turns(spark, d):
    """Tokens of every turn by a tokenizer, and whether the turns of a conversation stay within 256 together."""
    import public_tokenizers

    own = token_counts(D.read(spark, d, "conversations"), "text", public_tokenizers.path("word_bpe_49k.json"))
    total = own.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))
    return total.withColumn("fits", within_budget(F.col("tokens"), 256))


class Guide:
    """A backend that makes each stage's reply from the seeker's last words alone; some plans repeat a strategy, some selections name nobody, some patches can't be read."""

    def complete(self, role: str, messages: str, seed: int | None) -> str:
        m = json.loads(messages)
        turns = m["turns"] if "turns" in m else m["history"]["turns"]
        n = len(turns[-1]["content"])
        if role == "context_updater":
            lists = {f: [] for f in CONTEXT_FIELDS}
            return json.dumps({"add": lists | {CONTEXT_FIELDS[0]: [f"length {n}"]}, "replace": lists, "remove": lists} if n % 5 else {"add": 1})
        if role == "multi_view_state_analyzer":
            view = {"summary": "s", "evidence": "e", "uncertainty": "u"}
            state = {f: v[n % (len(v) - 1)] for f, v in STATE_VALUES.items()}
            return json.dumps({"views": {v: view for v in ("emotion", "need", "relationship", "intent")}, "state": state, "state_evidence": {f: {"evidence": "said so", "basis": "explicit"} for f in state}})
        if role == "planner":
            return json.dumps({"strategies": [STRATEGIES[n % 8], STRATEGIES[(n + 1) % 8], STRATEGIES[(n + 1) % 8 if n % 7 == 3 else (n + 2) % 8]]})
        if role == "candidate":
            return json.dumps({"response": f"{m['strategy']}: {n}", "response_goal": "g", "response_act": "a"})
        return json.dumps({"selected_candidate_id": str(n % 4 + 1)})


@query(f"""WITH h AS (SELECT conv_id, arg_max(role, turn) AS role, length(arg_max(text, turn)) AS n FROM conversations WHERE role <> 'system' GROUP BY 1),
s AS (SELECT *, {D._sql_list(STRATEGIES)} AS names FROM h WHERE role = 'user')
SELECT conv_id::VARCHAR AS example_id, CASE WHEN n % 7 = 3 THEN 'plan' WHEN n % 4 = 3 THEN 'selection' END AS failed_stage,
  CASE WHEN n % 7 <> 3 AND n % 4 <> 3 THEN names[((n + n % 4) % 8 + 1)::INTEGER] || ': ' || n END AS final_response,
  CASE WHEN n % 7 <> 3 AND n % 4 <> 3 THEN {D._sql_list(STATE_VALUES["dominant_emotion"])}[(n % 12 + 1)::INTEGER] END AS emotion,
  CASE WHEN n % 7 <> 3 AND n % 4 <> 3 THEN CASE WHEN n % 5 = 0 THEN '' ELSE 'length ' || n END END AS concerns, CASE WHEN n % 7 <> 3 AND n % 4 <> 3 THEN 7 END AS calls FROM s""")
def teacher_traces(spark, d):
    """Traces of the conversations that end with a user, all stages; and where the others failed."""
    role = F.when(F.col("role") == "user", "seeker").otherwise("supporter")
    turns = F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), F.col("text").alias("content"))))  # one conversation's turns
    own = D.read(spark, d, "conversations").where("role <> 'system'").groupBy("conv_id").agg(turns.alias("t"), F.max_by("role", "turn").alias("last")).where("last = 'user'")
    history = F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
    examples = own.select(F.col("conv_id").cast("string").alias("example_id"), F.lit("train").alias("split"), history.alias("history"))
    good, bad = teacher.run(examples, Guide)
    none = F.lit(None).cast("string")
    done = good.select("example_id", none.alias("failed_stage"), "final_response", F.col("state.dominant_emotion").alias("emotion"), F.array_join(F.col(f"context_after.{CONTEXT_FIELDS[0]}"), "|").alias("concerns"), F.size("call_records").alias("calls"))
    return done.unionByName(bad.select("example_id", F.col("stage").alias("failed_stage"), none.alias("final_response"), none.alias("emotion"), none.alias("concerns"), F.lit(None).cast("int").alias("calls")))
