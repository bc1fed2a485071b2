"""Readers and writers of records: JSON lines, JSON documents, prepared containers, CSV and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.operators.checks import Rule, first_problem, require_unique, unknown_keys, vector_problems
from tracelab.schemas import ANNOTATION, PREPARED, PREPARED_PROTOCOLS, SPLITS
from tracelab.sources.progress import observed
from tracelab.sources.published import commit_of, publish, read_published
from tracelab.sources.published import problems as published_problems
from tracelab.sources.staging import staged


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A row for each line that isn't blank; a line that doesn't fit the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON list, or the one row of an object."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _container(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("protocol_version", T.StringType()), T.StructField("splits", T.StructType([T.StructField(s, T.ArrayType(PREPARED)) for s in SPLITS]))])
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a prepared container with their place, splits in order; raises on other protocols, repeated ids or a row in another split's list."""
    box = _container(spark, path)
    rows = None
    for i, s in enumerate(SPLITS):
        own = box.select("protocol_version", F.lit(i).alias("_s"), F.posexplode(f"splits.{s}").alias("_i", "e")).withColumn("_own", F.lit(s))
        rows = own if rows is None else rows.unionByName(own)
    wrong = F.when(~F.coalesce(F.col("protocol_version"), F.lit("")).isin(*PREPARED_PROTOCOLS), F.lit("unknown protocol")).when(F.col("e.split") != F.col("_own"), F.lit("split mismatch"))
    if bad := rows.where(wrong.isNotNull()).select(wrong).head():
        raise ValueError(bad[0])
    out = rows.select((F.col("_s") * F.lit(2**32) + F.col("_i")).alias("ordinal"), "e.*")
    return require_unique(out, "example_id")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records in any layout: .jsonl lines, a JSON list, a prepared container, or one object."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    box = _container(spark, path).where(F.col("protocol_version").isin(*PREPARED_PROTOCOLS) & F.col("splits").isNotNull())
    if not box.isEmpty():
        return read_prepared(spark, path).orderBy("ordinal").drop("ordinal")
    return read_json(spark, path, schema)


def read_counted(spark: SparkSession, path: str, schema: T.StructType, rules: Sequence[Rule] = ()) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows of JSON lines that fit a schema, with no unknown key at any depth, and keep rules; rejects: path, line, raw, reason; and how many of each there are.

    A file is read in the ranges of bytes that Spark splits it into, each a task's, and written once, with its range and place there. A reject's line is its place in its range and the
    lines of the ranges before it, which are a row each: no task sees a whole file. The counts come from that one pass. Blank lines count as lines."""
    text = spark.read.text(path).select(F.col("value").alias("_value"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blank = F.length(F.trim("_value")) == 0
    parsed = text.select("*", F.from_json("_value", schema, {"mode": "PERMISSIVE"}).alias("_row"), unknown_keys(F.col("_value"), schema).alias("_unknown"), F.try_parse_json("_value").isNull().alias("_broken"))
    wide = parsed.select("_path", "_block", "_at", "_value", "_unknown", "_broken", "_row.*")
    reason = F.when(F.col("_broken"), F.lit("not JSON")).when(F.size("_unknown") > 0, F.concat(F.lit("unknown key "), F.col("_unknown")[0]))
    marked = wide.withColumn("_reason", F.when(~blank, F.coalesce(reason, first_problem(rules)))).withColumn("_blank", blank)
    raw = F.when(F.col("_reason").isNotNull(), F.col("_value"))
    good = ~F.col("_blank") & F.col("_reason").isNull()
    seen, counts = observed(marked.select("_path", "_block", "_at", "_blank", "_reason", raw.alias("_raw"), *schema.names), valid=F.count_if(good), rejected=F.count_if(F.col("_reason").isNotNull()))
    rows = staged(seen, "checked")
    ranges = rows.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each range of a file
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_path", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    line = F.col("_before") + F.col("_at") - F.col("_first") + 1
    rejected = rows.where("_reason IS NOT NULL").join(F.broadcast(starts), ["_path", "_block"])
    return rows.where(good).select(*schema.names), rejected.select(F.col("_path").alias("path"), line.alias("line"), F.col("_raw").alias("raw"), F.col("_reason").alias("reason")), counts()


def read_checked(spark: SparkSession, path: str, schema: T.StructType, rules: Sequence[Rule] = ()) -> tuple[DataFrame, DataFrame]:
    """``read_counted`` without the counts."""
    return read_counted(spark, path, schema, rules)[:2]


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", order: Sequence[str] = ()) -> None:
    """JSON lines with null fields; in one ordered file if ``order`` is given, for small results."""
    own = df.orderBy(*order).coalesce(1) if order else df
    own.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def publish_once(df: DataFrame, path: str, lines: bool = False) -> None:
    """A table at path, Parquet or JSON lines; refuses to replace one."""
    own = df.write.mode("errorifexists").option("ignoreNullFields", False)
    (own.json if lines else own.parquet)(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ANNOTATION])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_annotations(pairs: DataFrame, path: str) -> None:
    """The public side of blinded pairs: no model names, empty fields for a reviewer."""
    own = pairs.select(*(F.col(c) if c in pairs.columns else F.lit("").alias(c) for c in ANNOTATION))
    own.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def save_bank(bank: DataFrame, path: str, model: str) -> dict:
    """Publishes example_id and vector (as floats) once, with the model that made them, their width and number; raises if vectors break the rules of a bank."""
    own = bank.select("example_id", F.col("vector").cast("array<float>").alias("vector"))
    if bad := vector_problems(own).select("example_id", "reason").take(3):
        raise ValueError(f"not a bank: {[tuple(r) for r in bad]}")
    width = own.agg(F.max(F.size("vector")).alias("w")).head()["w"]
    return publish(own, path, more={"model": model, "width": width})


def load_bank(spark: SparkSession, path: str, model: str, width: int | None = None) -> DataFrame:
    """The vectors of a published bank; raises if it was made by another model, has another width, or isn't as it was published."""
    record = commit_of(spark, path)
    wrong = [f"{k} is {record[k]}, not {v}" for k, v in (("model", model), ("width", width)) if v is not None and record[k] != v] + published_problems(spark, path)
    if wrong:
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return read_published(spark, path)


def save_vectors(bank: DataFrame, path: str) -> None:
    bank.select("example_id", F.col("vector").cast("array<float>").alias("vector")).write.mode("errorifexists").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
