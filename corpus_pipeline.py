"""A corpus from documents: language ID, toxicity, line dedup, near-dedup, packing. Part of the subpackage ``tracelab.llm``.

All stages: extra columns pass through untouched, whatever their names, up to packing, which leaves all but ids out. Repeated rows count each until near-dedup keeps one. Models are
learned from the stage's own input and the labels; an empty table goes through all stages to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import _shared as S
from tracelab.llm import language, lines, neardup, packing, toxicity


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text reads like one of the learned languages. Null texts and texts without a letter go; where no document names a language, all go."""
    model = language.fit(language.learnable(docs))
    names = tuple(S.free_name(docs.columns, x) for x in ("_language", "_chance", "_accepted"))
    return language.identify(docs, model, out=names).where(F.col(names[2])).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. Null and empty texts have the score of a text without features, below 0.5 unless most labels are toxic; so has every text without labels of both kinds."""
    model = toxicity.train(docs, toxicity.learnable(S.table(spark, sf_dir, "labels")))
    score = S.free_name(docs.columns, "_toxicity")
    return toxicity.score_toxicity(docs, model, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines, with n_chars counted anew; those of which nothing is left go. Null and empty texts stay as they are. A text that repeats stays once, where its
    id is smallest."""
    kept = lines.dedup_lines(docs)
    chars = F.when(F.col("_line_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.where("_line_deleted = 0 OR _line_deleted < _line_count").withColumn("n_chars", chars).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id. Null and empty texts are copies of each other."""
    return neardup.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of tokens. A null or empty text is one end mark; long texts are cut."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("lines", dedup_lines),
    ("neardup", dedup_documents),
    ("packing", pack),
]

ORACLE_SQL = None  # models and token ids have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = S.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
