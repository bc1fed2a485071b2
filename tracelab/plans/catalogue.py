"""The catalogue: each query's function and, where SQL can express it, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelab.functions import numbers as N
from tracelab.functions import text as X
from tracelab.operators import audit, balance, checks, dialogue, export, preparation, quality, stats
from tracelab.operators import traces as T
from tracelab.plans import tables as D
from tracelab.plans.registry import query
from tracelab.schemas import DIMENSIONS, QUOTAS, SOURCE_STRATEGY, STATE_FIELDS, TARGET_STRATEGIES
from tracelab.sources.staging import numbered

def rounded(x: str, places: int = 4) -> str:
    return f"cast(format('{{:.{places}f}}', {x}) AS DOUBLE)"


# Preparation


@query(f"""WITH {D.TURNS}
SELECT conversation_id, count(*) AS n_turns, count(*) FILTER (role = 'supporter') AS n_targets,
  CASE WHEN count(*) FILTER (role = 'supporter') < 3 THEN 'fewer than three response targets' END AS reason
FROM turns GROUP BY 1""")
def dialogue_parse(spark, d):
    own = preparation.parse_dialogues(D.turns(spark, d))
    return own.select("conversation_id", F.size("turns").cast("long").alias("n_turns"), F.size("targets").cast("long").alias("n_targets"), "reason")


@query(f"""WITH {D.TURNS}, n AS (SELECT conversation_id, count(*) FILTER (role = 'supporter') AS n FROM turns GROUP BY 1)
SELECT 'fewer than three response targets' AS reason, count(*) AS n FROM n WHERE n < 3 HAVING count(*) > 0""")
def dialogue_rejects(spark, d):
    own = preparation.parse_dialogues(D.turns(spark, d)).where("reason IS NOT NULL")
    return own.groupBy("reason").agg(F.count("*").alias("n"))


_PHASED = f"""WITH {D.TURNS},
phased AS (SELECT conversation_id, rank::INTEGER AS rank, turn AS target_turn, ['early', 'middle', 'late'][least(2, (rank - 1) * 3 // n)::INTEGER + 1] AS phase FROM targets WHERE n >= 3)"""


@query(f"{_PHASED} SELECT * FROM phased")
def phase_targets(spark, d):
    own = preparation.parse_dialogues(D.turns(spark, d)).where("reason IS NULL")
    each = own.select("conversation_id", F.size("targets").alias("n"), F.posexplode("targets").alias("i", "target_turn"))
    rank = F.col("i") + 1
    return each.select("conversation_id", rank.alias("rank"), "target_turn", preparation.phase_of_rank(rank, F.col("n")).alias("phase"))


@query(f"{_PHASED} SELECT phase, count(*) AS n FROM phased GROUP BY 1")
def phase_counts(spark, d):
    return phase_targets(spark, d).groupBy("phase").agg(F.count("*").alias("n"))


def _prepared(spark, d) -> DataFrame:
    own = preparation.parse_dialogues(D.turns(spark, d))
    n = own.where("reason IS NULL").count()
    sizes = {"train": n - 2 * (n // 5), "dev": n // 5, "diagnostic_holdout": n // 5}
    return preparation.prepare(own, sizes, D.SEED)


def _sha(*parts: str) -> str:
    return f"sha256(concat_ws(chr(0), {', '.join(parts)}))"


_PREPARED = f"""WITH {D.TURNS},
placed AS (SELECT *, row_number() OVER (ORDER BY {_sha(f"'{D.SEED}'", "conversation_id")}, conversation_id) AS place, count(*) OVER () AS total FROM eligible),
split AS (SELECT *, CASE WHEN place <= total - 2 * (total // 5) THEN 'train' WHEN place <= total - total // 5 THEN 'dev' ELSE 'diagnostic_holdout' END AS split FROM placed),
within AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_sha(f"'{D.SEED}'", "'phase'", "conversation_id")}, conversation_id) AS k, count(*) OVER (PARTITION BY split) AS size FROM split),
exact AS (SELECT DISTINCT split, size, p AS prio, size * f AS x FROM within, (VALUES (0, 0.1::DOUBLE), (1, 1.0::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE), (2, 0.1::DOUBLE)) AS v(p, f)),
rest AS (SELECT *, floor(x) + CASE WHEN row_number() OVER (PARTITION BY split ORDER BY x - floor(x) DESC, prio) <= size - sum(floor(x)) OVER (PARTITION BY split) THEN 1 ELSE 0 END AS c FROM exact),
ends AS (SELECT *, sum(c) OVER (PARTITION BY split ORDER BY prio) AS last FROM rest),
phase AS (SELECT w.*, (SELECT min(prio) FROM ends e WHERE e.split = w.split AND w.k <= e.last) AS prio FROM within w),
drawn AS (SELECT p.*, t.rank, t.turn AS target_turn, row_number() OVER (PARTITION BY p.conversation_id ORDER BY {_sha(f"'{D.SEED}'", "'rank'", "p.conversation_id", "t.rank::VARCHAR")}) AS o
  FROM phase p JOIN targets t ON t.conversation_id = p.conversation_id AND least(2, (t.rank - 1) * 3 // t.n) = p.prio),
prepared AS (SELECT 'ssconv-' || conversation_id AS example_id, conversation_id, split, ['early', 'middle', 'late'][prio + 1] AS conversation_phase, target_turn, rank::INTEGER AS target_rank, n::INTEGER AS eligible_target_count FROM drawn WHERE o = 1)"""


@query(f"{_PREPARED} SELECT * FROM prepared")
def split_assignment(spark, d):
    return _prepared(spark, d).drop("history")


@query(f"{_PREPARED} SELECT split, conversation_phase, count(*) AS n FROM prepared GROUP BY ALL")
def phase_quota(spark, d):
    return _prepared(spark, d).groupBy("split", "conversation_phase").agg(F.count("*").alias("n"))


@query(f"""{_PREPARED} SELECT conversation_phase, count(*) AS n, {rounded("quantile_cont(target_rank::DOUBLE / eligible_target_count, 0.5)")} AS median FROM prepared GROUP BY 1""")
def target_progress(spark, d):
    return audit.progress_median(_prepared(spark, d), "target_rank", "eligible_target_count", "conversation_phase")


@query(f"""{_PREPARED} SELECT example_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt
FROM prepared JOIN turns USING (conversation_id) WHERE turn < target_turn GROUP BY 1""")
def history_prefix(spark, d):
    stripped = F.col("history.turns")
    return _prepared(spark, d).select("example_id", F.size(stripped).cast("long").alias("n_turns"), X.as_prompt(stripped).alias("prompt"))


@query("""SELECT c.k AS conversation_id, 'right' AS lacks FROM (SELECT DISTINCT conv_id::VARCHAR AS k FROM conversations) c WHERE k NOT IN (SELECT doc_id::VARCHAR FROM labels)
UNION ALL SELECT l.k, 'left' FROM (SELECT DISTINCT doc_id::VARCHAR AS k FROM labels) l WHERE k NOT IN (SELECT conv_id::VARCHAR FROM conversations)""")
def profile_integrity(spark, d):
    ids = lambda t, c: D.read(spark, d, t).select(F.col(c).cast("string").alias("conversation_id"))
    return checks.same_keys(ids("conversations", "conv_id"), ids("labels", "doc_id"), "conversation_id")


@query(f"""SELECT doc_id, (('0x' || substr({_sha("'v1'", "doc_id::VARCHAR", "'42'", "'1'", "'seeker'", "'<none>'")}, 9, 8))::BIGINT & 2147483647)::BIGINT AS seed FROM documents""")
def seed_values(spark, d):
    return D.read(spark, d, "documents").select("doc_id", N.stable_seed("v1", F.col("doc_id"), 42, 1, "seeker", "<none>").alias("seed"))


# Traces


@query(f"""WITH {D.CANDIDATES} SELECT example_id, candidate_id,
  (row_number() OVER (PARTITION BY example_id ORDER BY {_sha("'v1'", "example_id", "candidate_id")}))::INTEGER AS place FROM cand""")
def candidate_order(spark, d):
    own = D.traces(spark, d).select("example_id", F.posexplode(T.shown_order(F.col("candidates"), "v1", F.col("example_id"))).alias("i", "c"))
    return own.select("example_id", "c.candidate_id", (F.col("i") + 1).alias("place"))


@query(f"WITH {D.CANDIDATES} SELECT example_id, candidate_id AS selected_candidate_id, strategy_id AS selected_strategy_id, strategy AS selected_strategy, 'goal ' || slot AS response_goal, 'decided' AS response_act, response FROM cand WHERE selected")
def candidate_selected(spark, d):
    chosen = T.select_candidate(F.col("candidates"), F.col("final_selection.selected_candidate_id"), act=F.lit("decided"))
    return D.traces(spark, d).select("example_id", chosen.alias("s")).select("example_id", "s.*")


@query(f"""WITH {D.CANDIDATES} SELECT 'before' AS at, strategy_id AS slot, count(*) AS n FROM cand WHERE selected GROUP BY ALL
UNION ALL SELECT 'after', 'S1', count(DISTINCT example_id) FROM cand""")
def reselect_first(spark, d):
    slot = F.col("final_selection.selected_strategy_id")
    both = T.reselect(D.traces(spark, d).withColumn("_before", slot)).select(F.explode(F.create_map(F.lit("before"), "_before", F.lit("after"), slot)).alias("at", "slot"))
    return both.groupBy("at", "slot").agg(F.count("*").alias("n"))  # both counts in one pass


@query(f"WITH {D.CANDIDATES} SELECT example_id, candidate_id, strategy_id, strategy FROM cand")
def plan_fan_out(spark, d):
    return T.fan_out(D.traces(spark, d).select("example_id", "plan.strategies"))


@query(f"""WITH {D.CANDIDATES}, total AS (SELECT count(DISTINCT example_id) AS traces FROM cand),
s AS (SELECT strategy, count(*) AS slots, count(DISTINCT example_id) AS planned, count(*) FILTER (selected) AS selections FROM cand GROUP BY 1)
SELECT *, {rounded("planned / traces::DOUBLE")} AS planned_share, {rounded("selections / traces::DOUBLE")} AS selected_share, {rounded("selections / planned::DOUBLE")} AS win_rate FROM s, total""")
def strategy_funnel(spark, d):
    return audit.strategy_funnel(D.candidates(spark, d))


_SLOTS = f"""WITH {D.CANDIDATES}, s AS (SELECT slot, count(*) AS selections FROM cand WHERE selected GROUP BY 1),
shares AS (SELECT slot, selections, {rounded("selections / (sum(selections) OVER ())::DOUBLE")} AS share FROM s)"""


@query(f"{_SLOTS} SELECT * FROM shares")
def slot_share(spark, d):
    return audit.slot_share(D.candidates(spark, d))


@query(f"WITH {D.CANDIDATES} SELECT strategy, slot, count(*) AS candidates, count(*) FILTER (selected) AS selections FROM cand GROUP BY CUBE (strategy, slot)")
def strategy_slot_cube(spark, d):
    return audit.strategy_slot_cube(D.candidates(spark, d))


def _state_case() -> str:
    parts = []
    for f in STATE_FIELDS:
        parts.append(f"SELECT '{f}' AS field, {f} AS value, p, s FROM flags")
    return " UNION ALL ".join(parts)


@query(f"""WITH {D.CANDIDATES}, flags AS (SELECT example_id, {", ".join(f"any_value({f}) AS {f}" for f in STATE_FIELDS)},
  max((strategy = '{SOURCE_STRATEGY}')::INTEGER) AS p, max((strategy = '{SOURCE_STRATEGY}' AND selected)::INTEGER) AS s FROM cand GROUP BY 1),
long AS ({_state_case()}), g AS (SELECT field, value, count(*) AS n, sum(p)::BIGINT AS planned, sum(s)::BIGINT AS selected FROM long GROUP BY 1, 2)
SELECT *, {rounded("planned / n::DOUBLE")} AS planned_rate, {rounded("selected / n::DOUBLE")} AS selected_rate FROM g""")
def state_reflection_rates(spark, d):
    own = D.traces(spark, d).select("state.*", "plan.strategies", F.col("final_selection.selected_strategy").alias("strategy"))
    return audit.state_rates(own)


@query(f"WITH {D.CANDIDATES} SELECT phase, strategy, count(*) AS n FROM cand WHERE selected GROUP BY ALL")
def phase_strategies(spark, d):
    return audit.phase_strategies(D.candidates(spark, d).where("selected"))


_SAID = ("I'm sure of it", "you should rest", "my therapist helped", "nothing shared", "what about that supplier", "plain words")


@query(f"""WITH {D.CANDIDATES} SELECT example_id, candidate_id, CASE
  WHEN strategy = 'Information' AND said IN (0, 2) THEN 'first-person' WHEN strategy = 'Restatement or Paraphrasing' AND said = 1 THEN 'directive'
  WHEN strategy = 'Restatement or Paraphrasing' AND said <> 4 THEN 'no-overlap' WHEN strategy = 'Self-disclosure' AND said = 2 THEN 'self-disclosure' END AS reason
FROM (SELECT *, example_id::BIGINT % 6 AS said FROM cand)""")
def rejection_flags(spark, d):
    """Replies of each kind that needs review, and of kinds that don't."""
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("example_id").cast("long") % 6 + 1).cast("int"))
    return D.candidates(spark, d).select("example_id", "candidate_id", X.rejection_reason(F.col("strategy"), said, F.col("asked")).alias("reason"))


# Balance


def _quotas(pool: DataFrame) -> dict[str, dict[str, int]]:
    """The fixed quotas, scaled to the source rows of each split."""
    rows = {r["split"]: r["count"] for r in pool.groupBy("split").count().collect()}
    return {s: {t: rows.get(s, 0) * n // 1000 for t, n in q.items()} for s, q in QUOTAS.items()}


def _plan(spark, d) -> DataFrame:
    return balance.plan(D.planning(spark, d), D.SEED, _quotas)


def _planner_sql() -> str:
    """The planner, a chain of steps for each target: pool of a kind, shares of strata, rows within them."""
    case = " ".join(f"WHEN split = '{s}' AND t = {i} THEN {n}" for s, q in QUOTAS.items() for i, n in enumerate(q.values()))
    ctes = [
        f"WITH {D.CANDIDATES}",
        f"sel AS (SELECT example_id, candidate_id AS selected_id FROM cand WHERE selected AND strategy = '{SOURCE_STRATEGY}')",
        "pool AS (SELECT c.example_id, any_value(split) AS split, any_value(concat_ws(chr(0), phase, dominant_emotion, distress_level)) AS stratum, any_value(selected_id) AS selected_id, "
        + ", ".join(f"max(CASE WHEN strategy = '{t}' AND candidate_id <> selected_id THEN candidate_id END) AS r{i}" for i, t in enumerate(TARGET_STRATEGIES))
        + " FROM cand c JOIN sel s ON c.example_id = s.example_id GROUP BY 1)",
        f"quota AS (SELECT split, t, count(*) * (CASE {case} ELSE 0 END) // 1000 AS q FROM pool, (VALUES (0), (1), (2)) AS v(t) GROUP BY split, t)",
    ]
    taken: list[str] = []
    for i, target in enumerate(TARGET_STRATEGIES):
        apart = " AND ".join([f"r{j} IS NULL" for j in range(i + 1, 3)] or ["true"])
        for j, kind in enumerate((f"r{i} IS NOT NULL", apart, "true")):
            n = f"{i}{j}"
            before = " UNION ALL ".join(f"SELECT example_id FROM got{x}" for x in taken) or "SELECT NULL WHERE false"
            done = " + ".join([f"(SELECT count(*) FROM got{i}{x} g WHERE g.split = p.split)" for x in range(j)] or ["0"])
            ctes += [
                f"free{n} AS MATERIALIZED (SELECT * FROM pool WHERE {kind} AND example_id NOT IN ({before}))",
                f"size{n} AS (SELECT split, stratum, count(*) AS n FROM free{n} GROUP BY 1, 2)",
                f"need{n} AS (SELECT p.split, p.stratum, p.n, sum(p.n) OVER (PARTITION BY p.split) AS total, greatest((SELECT max(q) FROM quota WHERE quota.split = p.split AND t = {i}) - ({done}), 0) AS q FROM size{n} p)",
                f"part{n} AS (SELECT *, least(q, total) * n // total AS base, least(q, total) * n % total AS rest FROM need{n})",
                f"share{n} AS (SELECT split, stratum, base + (row_number() OVER (PARTITION BY split ORDER BY rest DESC, stratum) <= least(q, total) - sum(base) OVER (PARTITION BY split))::INTEGER AS k FROM part{n})",
                f"rank{n} AS (SELECT *, row_number() OVER (PARTITION BY split, stratum ORDER BY {_sha(f"'{D.SEED}'", f"'{target}'", 'example_id')}, example_id) AS pos FROM free{n})",
                f"got{n} AS MATERIALIZED (SELECT r.*, {i} AS t FROM rank{n} r JOIN share{n} s ON r.split = s.split AND r.stratum = s.stratum WHERE pos <= k)",
            ]
            taken.append(n)
    rows = " UNION ALL ".join(f"SELECT example_id, split, selected_id, r{x[0]} AS r, t FROM got{x}" for x in taken)
    names = ", ".join(f"'{t}'" for t in TARGET_STRATEGIES)
    ctes.append(
        f"plan AS (SELECT g.example_id, g.split, [{names}][t + 1] AS target_strategy, CASE WHEN r IS NULL THEN 'generate' ELSE 'reuse' END AS source, "
        f"coalesce(r, (SELECT min(candidate_id) FROM cand c WHERE c.example_id = g.example_id AND c.strategy = [{names}][g.t + 1]), selected_id) AS candidate_id FROM ({rows}) g)"
    )
    return ",\n".join(ctes)


_PLAN = _planner_sql()


@query(f"{_PLAN} SELECT * FROM plan")
def assignment_plan(spark, d):
    return _plan(spark, d)


@query(f"{_PLAN} SELECT split, target_strategy, source, count(*) AS n FROM plan GROUP BY ALL")
def assignment_counts(spark, d):
    return balance.value_counts(_plan(spark, d), "split", "target_strategy", "source")


@query(f"""WITH {D.CANDIDATES}, rows AS (SELECT example_id, split, concat_ws(chr(0), phase, dominant_emotion, distress_level) AS stratum FROM cand WHERE selected),
size AS (SELECT split, stratum, count(*) AS n FROM rows GROUP BY 1, 2), part AS (SELECT *, sum(n) OVER (PARTITION BY split) AS total FROM size),
q AS (SELECT *, least(100, total) * n // total AS base, least(100, total) * n % total AS rest FROM part),
share AS (SELECT split, stratum, base + (row_number() OVER (PARTITION BY split ORDER BY rest DESC, stratum) <= least(100, total) - sum(base) OVER (PARTITION BY split))::INTEGER AS k FROM q),
placed AS (SELECT *, row_number() OVER (PARTITION BY split, stratum ORDER BY {_sha("'7'", "'sample'", "example_id")}, example_id) AS a FROM rows)
SELECT r.example_id, r.split FROM placed r JOIN share s ON r.split = s.split AND r.stratum = s.stratum WHERE a <= k""")
def quota_sample(spark, d):
    own = D.planning(spark, d).select("example_id", "split", "stratum")
    return balance.allocate(own, F.lit(100), N.digest(7, "sample", F.col("example_id"))).select("example_id", "split")


@query(f"""{_PLAN}, moved AS (SELECT c.example_id, c.split, coalesce(max(CASE WHEN p.source = 'reuse' AND c.candidate_id = p.candidate_id THEN c.strategy END), max(CASE WHEN c.selected THEN c.strategy END)) AS strategy
FROM cand c LEFT JOIN plan p USING (example_id) GROUP BY 1, 2) SELECT split, strategy, count(*) AS n FROM moved GROUP BY ALL""")
def assignment_apply(spark, d):
    after = balance.apply_reuse(D.traces(spark, d), _plan(spark, d))
    return after.groupBy("split", F.col("final_selection.selected_strategy").alias("strategy")).agg(F.count("*").alias("n"))


@query(f"""{_PLAN}, r AS (SELECT c.example_id, bool_or(p.source = 'reuse') AS assigned FROM cand c LEFT JOIN plan p USING (example_id) GROUP BY 1),
b AS (SELECT example_id, CASE WHEN k = 1 THEN 'row is missing' WHEN k = 2 THEN 'split, history or state changed' WHEN k = 3 AND NOT assigned THEN 'an unassigned row changed' WHEN k = 4 AND assigned THEN 'an assigned row lacks its strategy' END AS problem
FROM (SELECT example_id, coalesce(assigned, false) AS assigned, example_id::BIGINT % 13 AS k FROM r))
SELECT * FROM b WHERE problem IS NOT NULL UNION ALL SELECT 'new-' || example_id, 'row was added' FROM r WHERE example_id::BIGINT % 13 = 5""")
def derivative_diff(spark, d):
    """A derivative with rows dropped, added, changed in what is fixed, changed without an assignment, or left as they were despite one."""
    own = D.traces(spark, d)
    planned = _plan(spark, d).where("source = 'reuse'")
    at = F.col("example_id").cast("long") % 13
    after = balance.apply_reuse(own.withColumn("_before", F.col("final_selection")), planned).join(planned.select("example_id", F.lit(True).alias("_assigned")), "example_id", "left")
    assigned = F.coalesce("_assigned", F.lit(False))
    selection = F.when((at == 3) & ~assigned, F.col("final_selection").withField("response", F.lit("~"))).when((at == 4) & assigned, F.col("_before")).otherwise(F.col("final_selection"))
    after = after.withColumns({"final_selection": selection, "state": F.when(at == 2, F.col("state").withField("dominant_emotion", F.lit("~"))).otherwise(F.col("state"))})
    ids = F.when(at == 1, F.array().cast("array<string>")).when(at == 5, F.array("example_id", F.concat(F.lit("new-"), "example_id"))).otherwise(F.array("example_id"))
    return balance.derivative_problems(own, after.withColumn("example_id", F.explode(ids)), planned)


@query(f"""{_PLAN}, q AS (SELECT *, row_number() OVER (PARTITION BY source, split, target_strategy ORDER BY {_sha(f"'{D.SEED}'", "'review'", "example_id")}, example_id) AS pos,
greatest(1, round_even(count(*) OVER (PARTITION BY source, split, target_strategy) * 0.2::DOUBLE, 0)) AS k FROM plan)
SELECT example_id, split, target_strategy, source FROM q WHERE source = 'generate' OR pos <= k""")
def review_queue(spark, d):
    return balance.review_queue(_plan(spark, d).drop("candidate_id"), D.SEED)


# Exports

_VISIBLE = " || ".join([*(f"'[{f}]' || {f}" for f in STATE_FIELDS), "'[selected_strategy]' || strategy", "'[response]' || response"])


@query(f"WITH {D.CANDIDATES} SELECT example_id, 'seeker: ' || asked AS prompt, response, strategy AS selected_strategy FROM cand WHERE selected AND split IN ('train', 'dev')")
def export_sft(spark, d):
    return export.sft_rows(D.traces(spark, d).where(F.col("split").isin("train", "dev")))


@query(f"WITH {D.CANDIDATES} SELECT example_id, 'seeker: ' || asked AS prompt, {', '.join(STATE_FIELDS)}, strategy, 'goal ' || slot AS response_goal, 'act ' || slot AS response_act FROM cand WHERE selected AND split IN ('train', 'dev')")
def export_slot(spark, d):
    return export.slot_rows(D.traces(spark, d).where(F.col("split").isin("train", "dev"))).select("example_id", "prompt", "state.*", "plan.*")


@query(f"WITH {D.CANDIDATES} SELECT example_id, split, {_VISIBLE} AS response FROM cand WHERE selected AND split IN ('train', 'dev')")
def export_visible(spark, d):
    return export.visible_rows(D.traces(spark, d).where(F.col("split").isin("train", "dev"))).drop("history")


@query(f"""WITH {D.CANDIDATES} SELECT example_id, CASE WHEN k IN (2, 3) THEN NULL ELSE response END AS reply,
CASE WHEN k IN (1, 2) THEN 'visible-SFT marker [{STATE_FIELDS[0]}] is missing or out of order' WHEN k = 3 THEN 'visible-SFT value for [response] must not be empty' WHEN k = 4 THEN 'visible-SFT marker [selected_strategy] is missing or out of order' END AS problem
FROM (SELECT *, example_id::BIGINT % 7 AS k FROM cand WHERE selected AND split IN ('train', 'dev'))""")
def visible_parse(spark, d):
    """Targets that parse, and some whose first marker, all markers, reply or strategy marker is gone."""
    at, text = F.col("example_id").cast("long") % 7, F.col("response")
    broken = F.when(at == 1, F.substring(text, F.lit(2), F.length(text))).when(at == 2, "no marker").when(at == 3, F.concat(F.substring_index(text, "[response]", 1), F.lit("[response] "))).when(at == 4, F.replace(text, F.lit("[selected_strategy]"), F.lit("(strategy)"))).otherwise(text)
    return export_visible(spark, d).select("example_id", X.visible_reply(broken).alias("reply"), X.visible_problem(broken).alias("problem"))


@query(f"WITH {D.CANDIDATES} SELECT example_id, response, split FROM cand WHERE selected AND split = 'train'")
def stage_rows(spark, d):
    return export.stage_rows(D.traces(spark, d), "train").drop("history")


@query(f"WITH {D.CANDIDATES} SELECT split, count(*) AS n FROM cand WHERE selected AND split NOT IN ('train', 'dev') GROUP BY 1")
def export_blocked(spark, d):
    return export.blocked(D.traces(spark, d)).groupBy("split").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, role, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: length(w)) AS ids FROM conversations),
p AS (SELECT a.conv_id, a.turn, b.ids AS p, a.ids AS r FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.role = 'assistant' AND b.role = 'user'),
e AS (SELECT *, CASE WHEN r[-1] = 2 THEN r ELSE list_append(r, 2) END AS e FROM p)
SELECT conv_id, turn, array_to_string(list_concat(p, e), ' ') AS input_ids, array_to_string(list_concat(list_transform(p, lambda x: -100), e), ' ') AS labels, len(p)::BIGINT AS slot FROM e""")
def label_mask(spark, d):
    own = D.read(spark, d, "conversations").withColumn("ids", F.transform(X.words(F.col("text")), lambda w: F.length(w)))
    by = Window.partitionBy("conv_id").orderBy("turn")
    both = own.withColumns({"_p": F.lag("ids").over(by), "_r": F.lag("role").over(by), "_t": F.lag("turn").over(by)}).where("role = 'assistant' AND _r = 'user' AND _t = turn - 1")
    rows = both.select(F.struct("conv_id", "turn").alias("example_id"), F.col("_p").alias("prompt_ids"), F.col("ids").alias("response_ids"))
    flat = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return export.encoded(rows, 2).select("example_id.conv_id", "example_id.turn", flat("input_ids").alias("input_ids"), flat("labels").alias("labels"), F.col("slots")[0].cast("long").alias("slot"))


# Dialogue


@query(f"""WITH {D.ROUNDS}, l AS (SELECT lag(mode) OVER (PARTITION BY conversation_id ORDER BY round_index) AS before, mode AS after FROM rounds)
SELECT before, after, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY ALL""")
def mode_transitions(spark, d):
    return dialogue.transitions(D.rounds(spark, d))


@query(f"""WITH {D.ROUNDS}, e AS (SELECT conversation_id, max(round_index) AS round_count, arg_max(mode, round_index) AS final_mode FROM rounds GROUP BY 1)
SELECT *, CASE WHEN final_mode = 'purchase' THEN 'completed' WHEN round_count >= 60 THEN 'truncated' ELSE 'open' END AS status FROM e""")
def terminal_status(spark, d):
    own = D.rounds(spark, d).withColumn("mode", F.when(F.col("mode") == "purchase", "closing").otherwise(F.col("mode")))
    return dialogue.endings(own, 60).withColumn("final_mode", F.when(F.col("final_mode") == "closing", "purchase").otherwise(F.col("final_mode")))


@query(f"""WITH {D.ROUNDS} SELECT conversation_id, round_index,
concat_ws('|', lag(strategy, 3) OVER w, lag(strategy, 2) OVER w, lag(strategy, 1) OVER w) AS recent FROM rounds WINDOW w AS (PARTITION BY conversation_id ORDER BY round_index)""")
def recent_strategies(spark, d):
    return dialogue.recent_strategies(D.rounds(spark, d)).select("conversation_id", "round_index", F.array_join("recent", "|").alias("recent"))


@query(f"""WITH {D.ROUNDS}, f AS (SELECT *, (lag(strategy) OVER (PARTITION BY conversation_id ORDER BY round_index) = strategy)::INTEGER AS r FROM rounds)
SELECT conversation_id, count(*) AS rounds, coalesce(sum(r), 0)::BIGINT AS repeats FROM f GROUP BY 1""")
def strategy_repeats(spark, d):
    return dialogue.repeats(D.rounds(spark, d))


@query(f"""WITH {D.ROUNDS}, m AS (SELECT conversation_id, round_index, CASE WHEN round_index % 3 = 0 THEN NULL ELSE mode END AS mode FROM rounds)
SELECT conversation_id, round_index, last_value(mode IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY round_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mode,
CASE WHEN mode IS NULL THEN 'kept the previous mode' END AS audit FROM m""")
def filled_modes(spark, d):
    own = D.rounds(spark, d).withColumn("mode", F.when(F.col("round_index") % 3 != 0, F.col("mode"))).drop("strategy")
    return dialogue.filled_modes(own)


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_pending(spark, d):
    done = D.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    return dialogue.pending(D.read(spark, d, "orders").select(F.col("o_orderkey").alias("key")), done, keys=("key",))


@query(f"""WITH {D.TURNS}, r AS (SELECT conversation_id, count(*) FILTER (role = 'supporter') AS rounds FROM turns GROUP BY 1)
SELECT count(*) AS n, min(rounds) AS min, quantile_cont(rounds, 0.05) AS p05, quantile_cont(rounds, 0.5) AS median, quantile_cont(rounds, 0.95) AS p95, max(rounds) AS max, {rounded("sum(rounds)::DOUBLE / count(*)")} AS mean FROM r""")
def round_distribution(spark, d):
    return audit.distribution(dialogue_parse(spark, d), "n_targets")


# Quality


@query(f"WITH {D.JUDGMENTS} SELECT split, example_id, model_id, {rounded('(coherence + effectiveness + empathy + non_coerciveness + relevance) / 5.0')} AS overall FROM judged")
def judgment_overall(spark, d):
    return D.judgments(spark, d).select(*quality.KEY, quality.overall_score([F.col(x) for x in DIMENSIONS]).alias("overall"))


def _models(spark, df: DataFrame) -> DataFrame:
    names = [r[0] for r in df.select("model_id").distinct().orderBy("model_id").collect()]  # a list as long as that of models
    return quality.models_table(spark, names)


_EXPECTED = """WITH o AS (SELECT DISTINCT CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'dev' ELSE 'diagnostic_holdout' END AS split, o_custkey::VARCHAR AS example_id, o_orderpriority AS model_id FROM orders),
c AS (SELECT CASE WHEN c_custkey % 10 < 7 THEN 'train' WHEN c_custkey % 10 < 8 THEN 'dev' ELSE 'diagnostic_holdout' END AS split, c_custkey::VARCHAR AS example_id FROM customer),
e AS (SELECT c.*, m.model_id FROM c CROSS JOIN (SELECT DISTINCT model_id FROM o) m)"""


@query(f"""{_EXPECTED}, g AS (SELECT e.split, e.model_id, count(*) AS expected, count(o.model_id) AS successful, count(*) FILTER (o.model_id IS NULL AND e.example_id::BIGINT % 4 = 0) AS failed FROM e LEFT JOIN o USING (split, example_id, model_id) GROUP BY 1, 2)
SELECT *, expected - successful - failed AS missing, {rounded("successful / expected::DOUBLE")} AS coverage_rate FROM g""")
def model_coverage(spark, d):
    done = D.scored_orders(spark, d)
    expected = quality.expected_keys(D.customers(spark, d), _models(spark, done))
    failed = dialogue.pending(expected, done, keys=tuple(quality.KEY)).where(F.col("example_id").cast("long") % 4 == 0)
    return quality.coverage(expected, done, failed)


@query(f"{_EXPECTED} SELECT e.* FROM e ANTI JOIN o USING (split, example_id, model_id)")
def expected_keys_missing(spark, d):
    done = D.scored_orders(spark, d)
    return dialogue.pending(quality.expected_keys(D.customers(spark, d), _models(spark, done)), done, keys=tuple(quality.KEY))


_PARTS = "sum(CASE WHEN dimension = 'overall' THEN 5 ELSE 1 END)"
_MEANS = f"WITH {D.JUDGMENTS}, means AS (SELECT split, model_id, dimension, {rounded(f'sum(points)::DOUBLE / {_PARTS}')} AS mean, count(*) AS n FROM long GROUP BY 1, 2, 3)"


@query(f"{_MEANS} SELECT * FROM means")
def model_means(spark, d):
    own = D.judgments(spark, d)
    return quality.means(own.select(*quality.KEY), own)


@query(f"{_MEANS} SELECT (row_number() OVER (ORDER BY mean DESC, model_id))::INTEGER AS rank, model_id, mean AS overall FROM means WHERE split = 'diagnostic_holdout' AND dimension = 'overall'")
def model_ranking(spark, d):
    return quality.ranking(model_means(spark, d), "diagnostic_holdout")


@query(f"""WITH {D.JUDGMENTS}, d AS (SELECT l.split, l.model_id AS left_model, r.model_id AS right_model, l.dimension, l.points - r.points AS x FROM long l JOIN long r ON l.split = r.split AND l.example_id = r.example_id AND l.dimension = r.dimension AND l.model_id < r.model_id),
g AS (SELECT split, left_model, right_model, dimension, count(*) AS pairs, sum(x)::BIGINT AS s, count(*) FILTER (x > 0) AS wins, count(*) FILTER (x = 0) AS ties, count(*) FILTER (x < 0) AS losses FROM d GROUP BY 1, 2, 3, 4)
SELECT split, left_model, right_model, dimension, pairs, wins, ties, losses, {rounded("s::DOUBLE / (pairs::DOUBLE * CASE WHEN dimension = 'overall' THEN 5 ELSE 1 END)")} AS mean_delta,
{rounded("wins / pairs::DOUBLE")} AS win_rate, {rounded("ties / pairs::DOUBLE")} AS tie_rate, {rounded("losses / pairs::DOUBLE")} AS loss_rate FROM g""")
def paired_comparison(spark, d):
    own = D.judgments(spark, d)
    return quality.paired(own, _models(spark, own))


@query(f"""WITH {D.JUDGMENTS} SELECT split, example_id, model_id, 'candidate-' || lpad((row_number() OVER (ORDER BY split, example_id, model_id))::VARCHAR, 6, '0') AS candidate FROM judged""")
def anonymous_ids(spark, d):
    return quality.anonymous_ids(D.judgments(spark, d).select(*quality.KEY))


_PAIRS = f"""WITH {D.JUDGMENTS}, b AS (SELECT l.split, l.example_id, l.model_id AS lm, r.model_id AS rm, {_sha("'11'", "l.split", "l.model_id", "r.model_id", "l.example_id")} AS h
  FROM judged l JOIN judged r ON l.split = r.split AND l.example_id = r.example_id AND l.model_id < r.model_id),
n AS (SELECT *, row_number() OVER (ORDER BY split, lm, rm, h) AS pos, row_number() OVER (PARTITION BY split, lm, rm ORDER BY h) AS k FROM b),
pairs AS (SELECT 'pair-' || lpad(pos::VARCHAR, 6, '0') AS pair_id, split, example_id, CASE WHEN k % 2 = 1 THEN lm ELSE rm END AS model_a, CASE WHEN k % 2 = 1 THEN rm ELSE lm END AS model_b, pos FROM n)"""


@query(f"{_PAIRS} SELECT pair_id, split, example_id, model_a, model_b FROM pairs")
def human_pairs(spark, d):
    own = D.judgments(spark, d).withColumn("response", F.concat("model_id", F.lit(" says")))
    return quality.blinded_pairs(own, 11).drop("response_a", "response_b")


@query(f"""{_PAIRS}, v AS (SELECT *, least(model_a, model_b) AS first, greatest(model_a, model_b) AS second, CASE (pos * 7) % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'tie' WHEN 3 THEN 'x' WHEN 4 THEN '' END AS c FROM pairs),
g AS (SELECT split, first, second, count(*) FILTER (c IN ('a', 'b', 'tie')) AS valid_votes, count(*) FILTER (c = 'tie') AS ties, count(*) FILTER (coalesce(c, '') = '') AS missing, count(*) FILTER (c = 'x') AS invalid,
  count(*) FILTER (CASE c WHEN 'a' THEN model_a WHEN 'b' THEN model_b END = first) AS w1, count(*) FILTER (CASE c WHEN 'a' THEN model_a WHEN 'b' THEN model_b END = second) AS w2 FROM v GROUP BY 1, 2, 3),
l AS (SELECT *, first AS model_id, w1 AS wins FROM g UNION ALL SELECT *, second, w2 FROM g)
SELECT split, first, second, model_id, wins, valid_votes, ties, missing, invalid, {rounded("wins / valid_votes::DOUBLE")} AS win_rate, {rounded("ties / valid_votes::DOUBLE")} AS tie_rate FROM l""")
def vote_summary(spark, d):
    pairs = human_pairs(spark, d)
    at = F.regexp_extract("pair_id", r"(\d+)$", 1).cast("long") * 7 % 6
    choice = F.when(at == 0, " A ").when(at == 1, "b").when(at == 2, "Tie").when(at == 3, "x").when(at == 4, "")
    return quality.votes(pairs.select("pair_id", choice.alias("preference")).where(at != 5), pairs)


# Statistics


@query(f"""WITH c AS (SELECT c_nationkey AS nation, c_acctbal AS x, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS y FROM customer),
r AS (SELECT nation, rank() OVER (PARTITION BY nation ORDER BY x) + (count(*) OVER (PARTITION BY nation, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY nation ORDER BY y) + (count(*) OVER (PARTITION BY nation, y) - 1) / 2.0::DOUBLE AS b FROM c)
SELECT nation, {rounded("CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END", 6)} AS spearman, count(*) AS n FROM r GROUP BY 1""")
def rank_correlation(spark, d):
    orders = D.read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("y"))
    own = D.read(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return stats.rank_correlation(own, "x", "y", "nation").withColumn("spearman", N.round_exact(F.col("spearman"), 6))


_CELLS = f"{_MEANS}, f AS (SELECT dimension, mean AS score FROM means WHERE split = 'train' AND model_id = (SELECT min(model_id) FROM means)), cells AS (SELECT m.split, m.model_id, dimension, f.score - m.mean AS loss FROM means m JOIN f USING (dimension))"


def _cells(spark, d) -> DataFrame:
    own = model_means(spark, d)
    least = own.agg(F.min("model_id").alias("m"))
    full = own.where("split = 'train'").join(F.broadcast(least), F.col("model_id") == F.col("m")).select("dimension", F.col("mean").alias("score"))  # one row
    ablated = own.select(F.concat_ws("/", "split", "model_id").alias("fn"), "dimension", F.col("mean").alias("score"))
    return stats.fidelity(full, ablated)


@query(f"{_CELLS} SELECT split || '/' || model_id AS fn, dimension, {rounded('loss', 6)} AS loss FROM cells")
def fidelity_matrix(spark, d):
    return _cells(spark, d).withColumn("loss", N.round_exact(F.col("loss"), 6))


@query(f"""{_CELLS}, p AS (SELECT a.model_id, {rounded("a.loss", 6)} AS x, {rounded("b.loss", 6)} AS y FROM cells a JOIN cells b ON a.model_id = b.model_id AND a.dimension = b.dimension AND a.split = 'dev' AND b.split = 'diagnostic_holdout'),
r AS (SELECT *, rank() OVER (PARTITION BY model_id ORDER BY x) + (count(*) OVER (PARTITION BY model_id, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY model_id ORDER BY y) + (count(*) OVER (PARTITION BY model_id, y) - 1) / 2.0::DOUBLE AS b FROM p)
SELECT model_id, {rounded("avg((sign(x) = sign(y))::INTEGER)", 6)} AS sign_agreement, {rounded("sum(abs(x - y)) / sum(abs(x))", 6)} AS normalized_l1, {rounded("CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END", 6)} AS spearman, count(*) AS n FROM r GROUP BY 1""")
def matrix_alignment(spark, d):
    own = fidelity_matrix(spark, d).withColumns({"split": F.split("fn", "/")[0], "model_id": F.split("fn", "/")[1]})
    side = lambda s, name: own.where(F.col("split") == s).select("model_id", "dimension", F.col("loss").alias(name))
    out = stats.alignment(side("dev", "teacher").join(side("diagnostic_holdout", "student"), ["model_id", "dimension"]), "model_id")
    return out.withColumns({c: N.round_exact(F.col(c), 6) for c in ("sign_agreement", "normalized_l1", "spearman")})


@query(f"""{_MEANS}, p AS (SELECT split, dimension, min_by(mean, model_id) AS base, max_by(mean, model_id) AS teacher, avg(mean) AS student FROM means GROUP BY 1, 2)
SELECT split, dimension, CASE WHEN teacher - base >= 0.2 THEN {rounded("(student - base) / (teacher - base)", 6)} END AS retention FROM p""")
def retention_by_dim(spark, d):
    own = model_means(spark, d).groupBy("split", "dimension").agg(F.min_by("mean", "model_id").alias("b"), F.max_by("mean", "model_id").alias("t"), F.avg("mean").alias("s"))
    return own.select("split", "dimension", N.round_exact(stats.retention(F.col("b"), F.col("t"), F.col("s")), 6).alias("retention"))


@query(f"""SELECT vec_id, {rounded("sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))", 6)} AS norm, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 0.002 AS unit FROM embeddings""")
def vector_norms(spark, d):
    n = N.norm(F.col("embedding"))
    return D.read(spark, d, "embeddings").select("vec_id", N.round_exact(n, 6).alias("norm"), (F.abs(n - 1) <= 0.002).alias("unit"))


@query(f"""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
s AS (SELECT vec_id, list_reverse(v) AS v FROM u), c AS (SELECT s.vec_id, u.vec_id = s.vec_id AS own, list_inner_product(s.v, u.v) AS c FROM s, u),
g AS (SELECT vec_id, max(c) / 0.1 AS m, max(c) FILTER (own) AS p FROM c GROUP BY 1)
SELECT g.vec_id::VARCHAR AS example_id, {rounded("max(p)", 6)} AS cosine, {rounded("max(m) + ln(sum(exp(c / 0.1 - m))) - max(p) / 0.1", 6)} AS cross_entropy FROM c JOIN g USING (vec_id) GROUP BY g.vec_id""")
def contrastive_loss(spark, d):
    own = D.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("example_id"), F.col("embedding").alias("vector"))
    out = stats.contrastive(own.withColumn("vector", F.reverse("vector")), own)
    return out.select("example_id", N.round_exact(F.col("cosine"), 6).alias("cosine"), N.round_exact(F.col("cross_entropy"), 6).alias("cross_entropy"))


@query(f"""WITH n AS (SELECT count(*) - 50 AS total FROM events), s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS step FROM events)
SELECT step, {rounded("CASE WHEN step < 100 THEN (step + 1) / 100.0::DOUBLE WHEN step >= total THEN 0 ELSE 0.5 * (1 + cos(pi() * ((step - 100) / (total - 100)::DOUBLE))) END", 6)} AS factor FROM s, n""")
def lr_schedule(spark, d):
    """The factor of each event, as a step in the order of ids; the schedule ends 50 steps before the last."""
    own = numbered(D.read(spark, d, "events").select("event_id"), ["event_id"], "at").select((F.col("at") - 1).alias("step"))
    total = own.count() - 50
    return own.select("step", N.round_exact(N.learning_factor(F.col("step"), 100, total), 6).alias("factor"))


_MONTHS = "m AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS epoch, count(*) AS metric FROM orders GROUP BY 1)"


@query(f"""WITH {_MONTHS}, b AS (SELECT *, min(metric) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m),
i AS (SELECT *, best IS NULL OR metric < best AS improved FROM b), r AS (SELECT *, sum(improved::INTEGER) OVER (ORDER BY epoch) AS run FROM i)
SELECT epoch, metric, improved, (row_number() OVER (PARTITION BY run ORDER BY epoch) - 1)::INTEGER AS bad_epochs, row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 >= 3 AS stops FROM r""")
def early_stopping(spark, d):
    months = D.read(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("epoch")).agg(F.count("*").alias("metric"))
    return stats.early_stopping(months, 3)


# Texts


@query(f"""WITH p AS (SELECT lang, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:4], ' ') AS prefix FROM documents), g AS (SELECT lang, prefix, count(*) AS n FROM p GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang)::BIGINT AS total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, prefix) AS rank FROM g)
SELECT lang, prefix, n, rank::INTEGER AS rank, total, {rounded("n / total::DOUBLE")} AS share FROM r WHERE rank <= 10""")
def prefix_topk(spark, d):
    return audit.top_prefixes(D.read(spark, d, "documents").select("lang", "text"), "lang", 10)


@query("SELECT lang, count(*) AS texts, count(DISTINCT text) AS different FROM documents GROUP BY 1")
def distinct_responses(spark, d):
    return audit.distinct_texts(D.read(spark, d, "documents"), "lang")


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query(f"SELECT lang, count(*) AS n, {rounded(f'sum(len({_WORDS}))::DOUBLE / count(*)', 2)} AS mean_words FROM documents GROUP BY 1")
def mean_words(spark, d):
    return audit.mean_words(D.read(spark, d, "documents"), "lang")


@query(f"""WITH {D.JUDGMENTS}, x AS (SELECT l.model_id AS m, (l.points - r.points) / 5.0::DOUBLE AS x FROM long l JOIN long r ON l.split = r.split AND l.example_id = r.example_id AND l.dimension = 'overall' AND r.dimension = 'overall' AND l.model_id > r.model_id AND r.model_id = (SELECT min(model_id) FROM judged)),
g AS (SELECT m, count(*) AS n, avg(x) AS a, 1.96 * stddev_samp(x) / sqrt(count(*)) AS h FROM x GROUP BY 1)
SELECT m AS model_id, n, {rounded("a")} AS mean, {rounded("a - h")} AS low, {rounded("a + h")} AS high FROM g""")
def delta_interval(spark, d):
    own = quality.by_dimension(D.judgments(spark, d)).where("dimension = 'overall'")
    least = own.agg(F.min("model_id").alias("m"))
    base = own.join(F.broadcast(least), F.col("model_id") == F.col("m")).select("split", "example_id", F.col("points").alias("p"))  # one row
    both = own.join(base, ["split", "example_id"]).join(F.broadcast(least), F.col("model_id") > F.col("m"))
    return audit.delta_interval(both.withColumn("delta", (F.col("points") - F.col("p")) / F.lit(5.0)), 1.96, "model_id")


@query(f"""{_SLOTS}, texts AS (SELECT array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:4], ' ') AS p FROM documents), top AS (SELECT count(*) AS n FROM texts GROUP BY p ORDER BY n DESC LIMIT 1),
sel AS (SELECT strategy, count(*) AS n FROM cand WHERE selected GROUP BY 1),
v AS (SELECT 'strategy' AS gate, {rounded("max(n) / (SELECT count(DISTINCT example_id) FROM cand)::DOUBLE")} AS value, 0.6 AS l FROM sel UNION ALL SELECT 'slot', max(share), 0.5 FROM shares
UNION ALL SELECT 'slot_gap', {rounded("max(share) - min(share)")}, 0.2 FROM shares UNION ALL SELECT 'prefix', {rounded("max(n) / (SELECT count(*) FROM documents)::DOUBLE")}, 0.2 FROM top)
SELECT gate, value, l::DOUBLE AS "limit", value > l AS raised FROM v""")
def collapse_gates(spark, d):
    return audit.collapse_gates(D.candidates(spark, d), D.read(spark, d, "documents"))


@query("""SELECT lang, count(*) FILTER (doc_id % 7 = 0) AS fenced, count(*) AS candidates, count(*) FILTER (doc_id % 21 = 0) AS fenced_selected FROM documents GROUP BY 1""")
def contamination(spark, d):
    """Texts with and without a fence before them."""
    body = F.coalesce("text", F.lit(""))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" \n```json\n"), body)).otherwise(F.concat(F.lit("x ```"), body))
    own = D.read(spark, d, "documents").select(F.col("lang").alias("slot"), text.alias("text"), (F.col("doc_id") % 3 == 0).alias("selected"))
    return audit.contamination(own).withColumnRenamed("slot", "lang")
