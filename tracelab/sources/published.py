"""Tables that are published once, on any file system that driver and executors share.

A writer puts its part files into a folder of its own under ``path`` and then a commit record: which files, with length and SHA-256, how many rows, and a digest of the rows that
doesn't depend on their order or files. The record stands in a folder that takes its final name in one step, which succeeds for one writer only; who comes second finds another's
record and raises. Readers see the files that the record names and nothing else, so what a failed or beaten writer left behind is never read."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.sources.control import _files, get_object, put_object

_WORDS = range(0, 64, 8)


def table_digest(df: DataFrame) -> dict[str, Any]:
    """rows and a digest of all rows as a multiset: each row's SHA-256, as JSON with all columns in the order of their names, is added up word by word. One pass, one row for each task."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring("_h", at + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{at}") for at in _WORDS]
    found = df.select(row.alias("_h")).agg(F.count("*").alias("n"), *words).head()
    return {"rows": found["n"], "digest": "".join(f"{int(found[f'w{at}'] or 0) % 2**32:08x}" for at in _WORDS)}


def text_digest(spark: SparkSession, path: str) -> str:
    """Of the lines of a text file, or of all in a folder, in any store and of any size; not of the lines' order."""
    return table_digest(spark.read.text(path))["digest"]


def file_digests(spark: SparkSession, folder: str) -> dict[str, dict[str, Any]]:
    """name, length and SHA-256 of a folder's part files; each file is read by one task, as one value, so of at most 2 GB."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    own = parts.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    return {r["name"]: {"length": r["length"], "sha256": r["sha256"]} for r in own.collect()}  # a row for each file


def publish(df: DataFrame, path: str, lines: bool = False, more: dict[str, Any] | None = None) -> dict[str, Any]:
    """Writes df under path as Parquet or JSON lines and commits it; raises FileExistsError if path is committed, also if another writer was faster. ``more`` goes into the record."""
    spark, path = df.sparkSession, path.rstrip("/")
    if get_object(spark, f"{path}/_commit/commit.json") is not None:
        raise FileExistsError(f"{path} is published")
    writer = uuid.uuid4().hex
    out = df.write.option("ignoreNullFields", False)
    (out.json if lines else out.parquet)(f"{path}/data-{writer}")
    files = file_digests(spark, f"{path}/data-{writer}")
    kept = _read(spark, [f"{path}/data-{writer}/{n}" for n in sorted(files)], lines, df.schema)
    record = (more or {}) | {"writer": writer, "format": "json" if lines else "parquet", "schema": df.schema.json(), "files": files} | table_digest(kept)
    put_object(spark, f"{path}/_commit-{writer}/commit.json", record)
    system, target = _files(spark, f"{path}/_commit")
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commit-{writer}")
    try:
        system.rename(aside, target, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        if get_object(spark, f"{path}/_commit/commit.json") is None:
            raise
        raise FileExistsError(f"{path} was published by another writer") from error
    if get_object(spark, f"{path}/_commit/commit.json")["writer"] != writer:  # where a file system moves a folder into an existing one instead of refusing
        raise FileExistsError(f"{path} was published by another writer")
    return record


def _read(spark: SparkSession, files: list[str], lines: bool, schema) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.json(files) if lines else reader.parquet(*files)


def commit_of(spark: SparkSession, path: str) -> dict[str, Any]:
    record = get_object(spark, f"{path.rstrip('/')}/_commit/commit.json")
    if record is None:
        raise FileNotFoundError(f"{path} isn't published")
    return record


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files that the commit record names."""
    import json

    from pyspark.sql.types import StructType

    record = commit_of(spark, path)
    return _read(spark, [f"{path.rstrip('/')}/data-{record['writer']}/{n}" for n in sorted(record["files"])], record["format"] == "json", StructType.fromJson(json.loads(record["schema"])))


def problems(spark: SparkSession, path: str) -> list[str]:
    """What isn't as it was committed: files that are gone, changed or added, by name; and, where all files are as they were, other rows."""
    record, path = commit_of(spark, path), path.rstrip("/")
    system, folder = _files(spark, f"{path}/data-{record['writer']}")
    now = file_digests(spark, folder.toString()) if record["files"] and system.util().exists(folder) else {}
    out = [f"{n} is gone" for n in sorted(record["files"]) if n not in now] + [f"{n} was added" for n in sorted(now) if n not in record["files"]]
    out += [f"{n} was changed" for n in sorted(now) if n in record["files"] and now[n] != record["files"][n]]
    if not out and table_digest(read_published(spark, path)) != {k: record[k] for k in ("rows", "digest")}:
        out.append("the rows differ")
    return out
