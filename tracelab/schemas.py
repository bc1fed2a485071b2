"""Record types, as Spark schemas, and the values that fields can take."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and orders that data carry.
STRATEGIES = ("Question", "Restatement or Paraphrasing", "Reflection of feelings", "Self-disclosure", "Affirmation and Reassurance", "Providing Suggestions", "Information", "Others")
STATE_VALUES = {
    "dominant_emotion": ("sadness_loss", "fear_anxiety", "anger_frustration", "shame_guilt", "hurt_disappointment", "loneliness", "overwhelm", "relief", "hope_positive", "neutral", "mixed", "other", "unknown"),
    "distress_level": ("low", "moderate", "high", "unknown"),
    "primary_support_need": ("validation", "esteem_support", "sensemaking", "information", "decision_support", "action_support", "connection", "unknown"),
    "advice_receptivity": ("closed", "hesitant", "open", "requested", "unknown"),
    "action_intent": ("not_considering", "ambivalent", "considering", "committed", "acting", "unknown"),
    "action_capacity": ("blocked", "limited", "adequate", "strong", "unknown"),
    "continuation_intent": ("closing", "passive_open", "engaged", "explicitly_continuing", "unknown"),
}
STATE_FIELDS = tuple(STATE_VALUES)
EVIDENCE_BASES = ("explicit", "strong_inference", "absent_or_ambiguous")
CONTEXT_FIELDS = (
    "active_concerns",
    "events_and_triggers",
    "functional_impacts",
    "goals_and_priorities",
    "people_and_relationships",
    "constraints_and_resources",
    "coping_attempts_and_outcomes",
    "support_preferences_and_boundaries",
    "communication_preferences",
)
PHASES = ("early", "middle", "late")
SPLITS = ("train", "dev", "diagnostic_holdout")
TRAINABLE = ("train", "dev")
DIMENSIONS = ("coherence", "effectiveness", "empathy", "non_coerciveness", "relevance")
TARGET_STRATEGIES = ("Information", "Restatement or Paraphrasing", "Self-disclosure")
SOURCE_STRATEGY = "Reflection of feelings"
QUOTAS = {
    "train": {"Information": 83, "Restatement or Paraphrasing": 208, "Self-disclosure": 62},
    "dev": {"Information": 9, "Restatement or Paraphrasing": 20, "Self-disclosure": 6},
    "diagnostic_holdout": {"Information": 13, "Restatement or Paraphrasing": 27, "Self-disclosure": 9},
}
VISIBLE_MARKERS = (*(f"[{f}]" for f in STATE_FIELDS), "[selected_strategy]", "[response]")
PREPARED_PROTOCOLS = ("socialsim-qwen-conversation-v1", "socialsim-qwen-conversation-v2")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I, _L = T.StringType(), T.IntegerType(), T.ArrayType
TURN = _struct(role=_S, content=_S)
HISTORY = _struct(turns=_L(TURN))
CONTEXT = _struct(**{f: _L(_S) for f in CONTEXT_FIELDS})
PATCH = _struct(add=CONTEXT, replace=_struct(**{f: _L(_struct(old=_S, new=_S)) for f in CONTEXT_FIELDS}), remove=CONTEXT)
STATE = _struct(**{f: _S for f in STATE_FIELDS})
STATE_EVIDENCE = _struct(**{f: _struct(evidence=_S, basis=_S) for f in STATE_FIELDS})
STATE_ANALYSIS = _struct(views=_struct(**{v: _struct(summary=_S, evidence=_S, uncertainty=_S) for v in ("emotion", "need", "relationship", "intent")}), state=STATE, state_evidence=STATE_EVIDENCE)
CANDIDATE = _struct(candidate_id=_S, strategy_id=_S, strategy=_S, response=_S, seed=_I, response_goal=_S, response_act=_S)
SELECTION = _struct(selected_candidate_id=_S, selected_strategy_id=_S, selected_strategy=_S, response_goal=_S, response_act=_S, response=_S)
CALL_RECORD = _struct(role=_S, attempt=_I, raw_text=_S, parsed=_S, schema_retry=T.BooleanType(), metadata_fallback=T.BooleanType(), cached=T.BooleanType())
TRACE = _struct(
    example_id=_S, split=_S, history=HISTORY, context_before=CONTEXT, context_patch=PATCH, context_after=CONTEXT, context_merge_errors=_L(_S),
    state_analysis=STATE_ANALYSIS, state=STATE, plan=_struct(strategies=_L(_S)), candidates=_L(CANDIDATE), final_selection=SELECTION, final_response=_S, call_records=_L(CALL_RECORD),
)
PREPARED = _struct(example_id=_S, conversation_id=_S, split=_S, history=HISTORY, conversation_phase=_S, target_turn=_I, target_rank=_I, eligible_target_count=_I)
DIALOGUE = T.StructType([T.StructField("ID", _S), T.StructField("Dialogue", _L(_struct(Turn=_I, Seeker=_S, Supporter=_S)))])
ROUND_TURN = _struct(turn_index=_I, round_index=_I, role=_S, content=_S)
RESPONSE = _struct(protocol_version=_S, example_id=_S, split=_S, model_id=_S, response_source=_S, history=HISTORY, response=_S, raw_response=_S, generation_seed=_I, generation_config=_S, reused=T.BooleanType())
JUDGMENT = _struct(example_id=_S, split=_S, model_id=_S, scores=_struct(**{d: _I for d in DIMENSIONS}), overall=T.DoubleType(), dimension_reasons=_struct(**{d: _S for d in DIMENSIONS}), short_reason=_S, call_records=_L(CALL_RECORD))
ANNOTATION = ("pair_id", "split", "example_id", "history", "response_a", "response_b", "preference", "reviewer_id", "comment")


def state_labels(spark):
    """field and value, with the place of a value within its field: a small table for lookups and coverage."""
    rows = [(f, v, i) for f, values in STATE_VALUES.items() for i, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "field string, value string, place int")
