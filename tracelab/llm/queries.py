"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelab.llm import chat, fingerprint, language, lexical, lexicon, lines, neardup, packing, quality, topk, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": neardup.op1_neardup,
    "op2_language": language.op2_language,
    "op3_topk": topk.op3_topk,
    "op4_fingerprint": fingerprint.op4_fingerprint,
    "op5_packing": packing.op5_packing,
    "op6_chat": chat.op6_chat,
    "op7_lines": lines.op7_lines,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bpe": lexicon.op9_bpe,
    "op10_warc": warc.op10_warc,
    "op11_quality": quality.op11_quality,
    "op12_lexical": lexical.op12_lexical,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk": topk.OP3_SQL,
    "op6_chat": chat.OP6_SQL,
    "op10_warc": warc.OP10_SQL,
    "op12_lexical": lexical.OP12_SQL,
}
