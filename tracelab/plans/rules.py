"""Rules over the values of the test tables themselves: the SQL evaluates each rule again, instead of knowing which rows were broken."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.functions import numbers as N
from tracelab.operators import audit, checks, stats
from tracelab.plans import tables as D
from tracelab.plans.registry import query
from tracelab.schemas import DIMENSIONS


def _rounded(x: str, places: int = 4) -> str:
    return f"cast(format('{{:.{places}f}}', {x}) AS DOUBLE)"


@query("""SELECT conv_id, CASE WHEN bool_or(role NOT IN ('user', 'assistant') OR length(coalesce(text, '')) = 0) THEN 'a turn is empty or has an unknown role'
  WHEN arg_max(role, turn) <> 'user' THEN 'history must end with a seeker turn' ELSE 'valid' END AS reason FROM conversations GROUP BY 1""")
def history_rules_of_conversations(spark, d):
    role = F.when(F.col("role") == "user", "seeker").when(F.col("role") == "assistant", "supporter").otherwise(F.col("role"))
    turn = F.struct("turn", role.alias("role"), F.col("text").alias("content"))
    own = D.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # one conversation's turns
    reason = checks.first_problem(checks.history_rules("turns"))
    return own.select("conv_id", F.coalesce(reason, F.lit("valid")).alias("reason"))


_SCORES = ", ".join(f"((event_id * {i + 3} + floor(value)::BIGINT) % 11 // 2 + (value > {60 * i})::BIGINT)::INTEGER AS {x}" for i, x in enumerate(DIMENSIONS))
_OVERALL = f"({' + '.join(DIMENSIONS)}) / 5.0::DOUBLE"


@query(f"""WITH s AS (SELECT event_id, value, {_SCORES} FROM events)
SELECT event_id, CASE {" ".join(f"WHEN NOT {x} BETWEEN 1 AND 5 THEN '{x} is out of range'" for x in DIMENSIONS)} WHEN event_type_is_odd AND value > 50 THEN 'overall differs from the mean of scores'
  WHEN floor(value) * 3 > 500 THEN 'short_reason is too long' ELSE 'valid' END AS reason FROM (SELECT *, event_id % 2 = 1 AS event_type_is_odd FROM s)""")
def score_rules_of_events(spark, d):
    """Scores, their overall and a reason from an event's value; the overall is off where it is over 50 and the id odd."""
    value = F.col("value")
    scores = [F.expr(f"cast((event_id * {i + 3} + floor(value)) % 11 div 2 + cast(value > {60 * i} AS int) AS int)").alias(x) for i, x in enumerate(DIMENSIONS)]
    own = D.read(spark, d, "events").select("event_id", "value", F.struct(*scores).alias("scores"), F.repeat(F.lit("x"), (F.floor(value) * 3).cast("int")).alias("short_reason"))
    mean = N.round_exact(sum((F.col(f"scores.{x}") for x in DIMENSIONS[1:]), F.col(f"scores.{DIMENSIONS[0]}")) / F.lit(5.0))
    own = own.withColumn("overall", mean + F.when((F.col("event_id") % 2 == 1) & (value > 50), 0.1).otherwise(0.0))
    return own.select("event_id", F.coalesce(checks.first_problem(checks.judgment_rules()), F.lit("valid")).alias("reason"))


@query(r"""SELECT conv_id, turn, CASE WHEN length(trim(text)) > 0 AND NOT regexp_matches(text, '[\x00-\x1f\x7f]') THEN trim(text) END AS profile_id FROM conversations
UNION ALL SELECT doc_id, -1, CASE WHEN length(trim(text)) > 0 AND NOT regexp_matches(text, '[\x00-\x1f\x7f]') THEN trim(text) END FROM documents""")
def profile_ids_of_texts(spark, d):
    """Texts as ids: those with a line end or tab inside are none."""
    said = D.read(spark, d, "conversations").select("conv_id", "turn", "text")
    own = said.unionByName(D.read(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), "text"))
    return own.select("conv_id", "turn", checks.profile_id(F.col("text")).alias("profile_id"))


@query("""SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k <> 'turns')), '|') AS keys FROM events""")
def property_keys_of_events(spark, d):
    kind = T.StructType([T.StructField("turns", T.StringType())])
    return D.read(spark, d, "events").select("event_id", F.array_join(F.array_sort(checks.unknown_keys(F.col("props"), kind)), "|").alias("keys"))


_KEPT = "SELECT l_returnflag AS f, l_discount < 0.05 AS kept, CASE WHEN l_tax > 0.04 THEN 'tax' ELSE 'discount' END AS reason FROM lineitem"


def _kept(spark, d):
    return D.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("function"), (F.col("l_discount") < 0.05).alias("kept"), F.when(F.col("l_tax") > 0.04, "tax").otherwise("discount").alias("reason"))


@query(f"""SELECT f AS "function", count(*) AS n, count(*) FILTER (kept) AS kept, {_rounded("count(*) FILTER (kept) / count(*)::DOUBLE")} AS rate FROM ({_KEPT}) GROUP BY 1""")
def retention_of_lines(spark, d):
    return audit.retention(_kept(spark, d)).select("function", "n", "kept", "rate")


@query(f"""SELECT f AS "function", reason, count(*) AS n FROM ({_KEPT}) WHERE NOT kept GROUP BY 1, 2""")
def exclusions_of_lines(spark, d):
    return audit.exclusions(_kept(spark, d))


@query(f"""SELECT {_rounded("sum(l_tax * l_quantity) / sum(l_quantity)", 6)} AS loss FROM lineitem""")
def weighted_loss_of_lines(spark, d):
    own = stats.weighted_loss(D.read(spark, d, "lineitem").select(F.col("l_tax").alias("loss"), F.col("l_quantity").alias("n")))
    return own.select(N.round_exact(F.col("loss"), 6).alias("loss"))


@query(f"""WITH g AS (SELECT l_returnflag, l_linestatus, year(l_shipdate) AS y, avg(l_discount) AS b, max(l_quantity) / 50 AS t, avg(l_quantity) / 50 AS s FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, y::INTEGER AS y, CASE WHEN t - b >= 0.2 THEN {_rounded("(s - b) / (t - b)")} END AS retention, {_rounded("s + 2 * t + b")} AS loss FROM g""")
def kept_gains_of_lines(spark, d):
    """The share of a gain that is kept, and a loss of three parts, of each flag, status and year."""
    own = D.read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("y")).agg(F.avg("l_discount").alias("b"), (F.max("l_quantity") / 50).alias("t"), (F.avg("l_quantity") / 50).alias("s"))
    kept = stats.retention(F.col("b"), F.col("t"), F.col("s"))
    return own.select("l_returnflag", "l_linestatus", "y", N.round_exact(kept).alias("retention"), N.round_exact(stats.combined_loss(F.col("s"), F.col("t"), F.col("b"), plan_weight=2.0)).alias("loss"))


@query("""SELECT sum(p_size)::BIGINT AS total, sum(CASE WHEN p_retailprice > 1200 THEN p_size ELSE 0 END)::BIGINT AS trainable, sum(CASE WHEN p_brand LIKE '%1%' THEN p_size ELSE 0 END)::BIGINT AS adapter FROM part""")
def parameters_of_parts(spark, d):
    name = F.when(F.col("p_brand").contains("1"), F.concat("p_name", F.lit(".lora_A"))).otherwise(F.col("p_name"))
    return stats.parameters(D.read(spark, d, "part").select(name.alias("name"), F.col("p_size").cast("long").alias("numel"), (F.col("p_retailprice") > 1200).alias("trainable")))


@query("""WITH v AS (SELECT vec_id, CASE label % 5 WHEN 1 THEN list_transform(embedding, lambda x: x / 2) WHEN 2 THEN embedding[1:63] ELSE embedding END AS v, label FROM embeddings),
b AS (SELECT * FROM v UNION ALL SELECT * FROM v WHERE label % 5 = 3), c AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM b)
SELECT vec_id::VARCHAR AS example_id, CASE WHEN len(v) <> 64 THEN 'width differs' WHEN abs(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 2e-3 THEN 'not of unit length' WHEN n > 1 THEN 'id is repeated' END AS reason
FROM c WHERE reason IS NOT NULL""")
def vector_rules_of_embeddings(spark, d):
    """The bank with vectors of some labels halved, cut or repeated."""
    at = F.col("label") % 5
    vector = F.when(at == 1, F.transform("embedding", lambda x: (x / 2).cast("float"))).when(at == 2, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    own = D.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("example_id"), vector.alias("vector"), at.alias("at"))
    return checks.vector_problems(own.unionByName(own.where("at = 3")).drop("at")).select("example_id", "reason")


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 300 AS fits FROM documents""")
def word_budgets_of_documents(spark, d):
    return D.read(spark, d, "documents").select("doc_id", checks.token_budget(F.col("text"), 300).alias("fits"))
