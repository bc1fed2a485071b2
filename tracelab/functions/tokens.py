"""Numbers of tokens by a tokenizer's file, in Arrow batches; each different text is encoded once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    own.encode_special_tokens = True  # their strings in a text are ordinary text
    return own


def token_ids(df: DataFrame, text: str, path: str, out: str = "ids") -> DataFrame:
    """df with the token ids of a text column, without special tokens; null for null. Equal texts, which may be many, are encoded once and joined back by their digest.

    path: of a tokenizer's JSON file that every executor has."""
    key = F.sha2(F.col(text).cast("string"), 256)
    once = df.where(F.col(text).isNotNull()).groupBy(key.alias("_key")).agg(F.first(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [e.ids for e in own.encode_batch(part.column(1).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["_key", "_ids"])

    encoded = once.mapInArrow(run, "_key string, _ids array<int>")
    return df.withColumn("_key", key).join(encoded, "_key", "left").select(*df.columns, F.col("_ids").alias(out))


def token_counts(df: DataFrame, text: str, path: str, out: str = "tokens") -> DataFrame:
    return token_ids(df, text, path, "_token_ids").withColumn(out, F.size("_token_ids").cast("long")).withColumn(out, F.when(F.col("_token_ids").isNotNull(), F.col(out))).drop("_token_ids")


def within_budget(tokens: Column, most: int) -> Column:
    """Whether a text has at most so many tokens; false without a text."""
    return F.coalesce(tokens <= most, F.lit(False))
