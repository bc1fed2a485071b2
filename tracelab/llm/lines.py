"""Line dedup over a suffix array of line-ID sequences, built by distributed prefix doubling.

A document is the sequence of its lines that aren't blank; a line's ID is a 64-bit hash of it without white space at its ends. A *run* is a sequence of consecutive
lines. A line is deleted if it lies in a run of at least ``min_words`` words that also stands somewhere earlier, by document id and then line; so every
repeated run of that many words stays once, where it comes first. A line that stands at least ``often`` times in different texts counts for ``min_words`` words, however short it is: it is
boilerplate. So what stays repeated are lines of fewer than min_words words that stand less than ``often`` times and not in a longer repeated run.

1. Whole copies of a text are found by digest. The first stays in the suffix array for all; the others have no line that isn't repeated.
2. Lines that occur once end every repeated run; only the others are positions of the suffix array.
3. Prefix doubling: ranks of positions by their first 1, 2, 4, ... lines, each round from pairs of ranks of the one before, numbered in sorted order over ranges of
   pairs. A suffix that ends, or meets a line that occurs once, sorts before those that go on. It is sorted to the depth of a power of two that is at least min_words, as no
   window below is longer. The last ranks are the suffix array, those who share one being equal to that depth.
4. Longest common prefixes of neighbours in the array, by descent through the rounds' ranks: 4 lines, then 2, then 1. A stretch of the array without a prefix
   shorter than n lines is an interval whose suffixes share n lines; it is named by where it begins.
5. Of each position, the shortest window of min_words words that starts, or ends, there, looked up in the interval of its length. A repeated
   maximal run is the union of such windows: a line of it is either in the shortest window from the run's start or in the one that ends at the line.
6. In each interval the first window stays; all others are deleted, and so is a blank line that follows a deleted line.

Groups of any size are only ever counted or reduced to their first position; what is joined back to them is salted.

Edge cases: a null text stays null, an empty one empty. Repeated rows (equal id and text) are copies of each other; one of them is the first. A null id comes after
all others; ties between ids go to the smaller digest. A text without repeated runs loses nothing, whatever its length. An empty table gives an empty result. Extra columns pass through ``dedup_lines``
untouched, whatever their names, but for _line_count and _line_deleted, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.llm import _shared as S

MIN_WORDS, OFTEN, SALTS = 5, 10, 8
LAST = 2**63 - 1


def windows(words: list[int], least: int) -> list[tuple[int, int]]:
    """Start and length of the shortest windows of at least so many words from each line, and up to each line."""
    ends = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    first = np.arange(n)
    stop = np.searchsorted(ends, ends[:-1] + least)  # ends[stop] - ends[first] >= least
    start = np.searchsorted(ends, ends[1:] - least, side="right") - 1
    out = {(int(i), int(j - i)) for i, j in zip(first, stop, strict=True) if j <= n}
    out |= {(int(i), int(j + 1 - i)) for i, j in zip(start, first, strict=True) if i >= 0}
    return sorted(out)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, digest, words (of each line that isn't blank) and line (their IDs) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words = [], []
            for text in b.column(2).to_pylist():
                own = [x for line in text.split("\n") if (x := line.strip())]
                ids.append([xxhash.xxh3_64_intdigest(x.encode()) - 2**63 for x in own])
                words.append([len(x.split()) for x in own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "digest", "words", "line"])

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), _digest(F.col("text")).alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest binary, words array<int>, line array<long>")


def _salted(df: DataFrame, few: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """df joined with few, which has a row for each key, each spread over SALTS tasks."""
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(few, [*keys, "_salt"], how).drop("_salt")


def numbered(keys: DataFrame, columns: list[str], tag: str) -> DataFrame:
    """keys (each once) with ``rank``, their place in sorted order over all."""
    spark = keys.sparkSession
    ranged = keys.repartitionByRange(S.partitions(spark), *columns).sortWithinPartitions(*columns)
    kept = S.written(ranged.withColumn("_id", F.monotonically_increasing_id()), tag)
    part, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each task
    base = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return kept.withColumn("_part", part).join(F.broadcast(base), "_part").select(*columns, (own + F.col("_base")).alias("rank"))


def suffix_array(positions: DataFrame, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """positions: doc, i, rank, often. The same with ranks to ``depth`` lines, a power of two, and the ranks of the rounds before (doc, i, rank of those with so many lines)."""
    level, rounds, h = positions.withColumn("full", F.lit(True)), [], 1
    while h < depth:
        rounds.append(level.where("full").select("doc", "i", "rank"))
        other = level.select("doc", (F.col("i") - h).alias("i"), F.col("rank").alias("b"), F.col("full").alias("goes_on"))
        pairs = level.withColumnRenamed("rank", "a").join(other, ["doc", "i"], "left")
        more = F.col("full") & F.coalesce("goes_on", F.lit(False))
        pairs = S.written(pairs.select("doc", "i", "often", "a", F.when(F.col("full"), F.coalesce("b", F.lit(-1))).otherwise(F.lit(-1)).alias("b"), more.alias("full")), "lines-pairs")
        ranked = _salted(pairs, numbered(pairs.select("a", "b").distinct(), ["a", "b"], "lines-numbers"), ["a", "b"], F.xxhash64("doc", "i"))
        level = S.written(ranked.select("doc", "i", "often", "rank", "full"), "lines-level")
        h *= 2
    return level, rounds


def common_prefixes(array: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """rank and lcp: how many lines the suffixes of a rank share with those of the rank before, 0 for the first."""
    one = S.written(array.groupBy("rank").agg(F.min(F.struct("doc", "i")).alias("at")), "lines-ranks")
    before = one.select((F.col("rank") + 1).alias("rank"), F.col("at").alias("other"))
    state = one.join(before, "rank", "left").select("rank", F.col("at.doc").alias("d1"), F.col("at.i").alias("i1"), F.col("other.doc").alias("d2"), F.col("other.i").alias("i2"), F.lit(0).alias("lcp"))
    for k, level in reversed(list(enumerate(rounds))):
        for d, i, x in (("d1", "i1", "x"), ("d2", "i2", "y")):
            own = level.select(F.col("doc").alias(d), F.col("i").alias("_i"), F.col("rank").alias(x))
            state = state.withColumn("_i", F.col(i) + F.col("lcp")).join(own, [d, "_i"], "left").drop("_i")
        state = state.withColumn("lcp", F.col("lcp") + F.when(F.col("x") == F.col("y"), 1 << k).otherwise(0)).drop("x", "y")
        state = S.written(state, "lines-lcp")
    return state.select("rank", "lcp")


def intervals(prefixes: DataFrame, depth: int) -> DataFrame:
    """rank and begins: for 1, 2, ... depth lines the first rank of the interval of suffixes that share so many."""
    ordered = prefixes.repartitionByRange(S.partitions(prefixes.sparkSession), "rank").sortWithinPartitions("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last = TaskContext.get().partitionId(), np.full(depth, -1, np.int64)  # -1: it began in a task before
        for b in batches:
            rank, lcp = (b.column(c).to_numpy().astype(np.int64) for c in ("rank", "lcp"))
            begins = np.where(lcp[:, None] <= np.arange(depth), rank[:, None], -1)
            begins = np.maximum.accumulate(np.concatenate([last[None], begins]), axis=0)[1:]
            if len(begins):
                last = begins[-1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, depth * len(rank) + 1, depth, dtype=np.int32)), pa.array(begins.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("rank"), pa.array(np.full(len(rank), task, np.int32)), lists], names=["rank", "task", "begins"])

    kept = S.written(ordered.select("rank", "lcp").mapInArrow(run, "rank long, task int, begins array<long>"), "lines-intervals")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each task
    carried = kept.groupBy("task").agg(*(F.max(F.col("begins")[n]).alias(f"b{n}") for n in range(depth)))
    carried = carried.select("task", F.array(*(F.max(f"b{n}").over(before) for n in range(depth))).alias("earlier"))
    whole = F.zip_with("begins", "earlier", lambda x, y: F.when(x >= 0, x).otherwise(y))
    return kept.join(F.broadcast(carried), "task").select("rank", whole.alias("begins"))


def repeats(table: DataFrame, min_words: int = MIN_WORDS, often: int = OFTEN) -> tuple[DataFrame, DataFrame]:
    """table: a written line_table. doc_id, digest, whole (all of it is a later copy), starts and lengths of the runs to delete, only of documents that lose lines;
    and the digests of texts that hold a line which stands often."""
    depth = 1 << max(0, min_words - 1).bit_length()
    some = table.where(F.size("line") > 0)
    texts = some.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first"), F.count("*").alias("n"))
    several = texts.where("n > 1").select("digest", "first")

    # One document for each text; doc grows with the order that decides which copy stays.
    once = some.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("doc_id"), F.first("words").alias("words"), F.first("line").alias("line"))
    once = once.repartitionByRange(S.partitions(table.sparkSession), "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    once = S.written(once.withColumn("doc", F.monotonically_increasing_id()), "lines-once")
    at = once.select("doc", F.posexplode("line").alias("i", "line"))
    counted = S.written(at.groupBy("line").agg(F.count("*").alias("n")).where("n > 1"), "lines-counts")
    lines = numbered(counted.select("line", (F.col("n") >= often).alias("often")), ["line", "often"], "lines-ids")
    positions = S.written(_salted(at, lines, ["line"], F.xxhash64("doc", "i")).select("doc", "i", "rank", "often"), "lines-positions")
    boilerplate = positions.where("often").select("doc").distinct().join(once.select("doc", "digest"), "doc").select("digest")
    enough = some.where(F.aggregate("words", F.lit(0), lambda a, w: a + w) >= min_words).select("digest").unionByName(boilerplate).distinct()
    several = several.join(enough, "digest", "left_semi")
    copies = _salted(some.select("doc_id", "digest"), several, ["digest"], F.xxhash64("doc_id")).where(F.coalesce("doc_id", F.lit(LAST)) != F.col("first")).select("doc_id", "digest").distinct()
    array, rounds = suffix_array(positions, depth)
    names = array.groupBy("doc").agg(F.collect_list("i").alias("i"), F.collect_list("rank").alias("rank"), F.collect_list("often").alias("often"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, words, i, rank, boilerplate in zip(*(c.to_pylist() for c in b.columns), strict=True):
                weight, name = np.array(words), np.full(len(words), -1, np.int64)
                weight[[x for x, y in zip(i, boilerplate, strict=True) if y]] = np.maximum(weight[[x for x, y in zip(i, boilerplate, strict=True) if y]], min_words)
                name[i] = rank
                lone = np.concatenate([[0], np.cumsum(name < 0)])
                out += [(doc, start, size, int(name[start])) for start, size in windows(weight, min_words) if lone[start + size] == lone[start]]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc", "start", "size", "rank"])

    joined = once.select("doc", "words").join(names, "doc").select("doc", "words", "i", "rank", "often")
    found = joined.mapInArrow(cover, "doc long, start int, size int, rank long")
    found = _salted(found, intervals(common_prefixes(array, rounds), depth), ["rank"], F.xxhash64("doc", "start"))
    found = S.written(found.select("doc", "start", "size", F.expr("begins[size - 1]").alias("begin")), "lines-windows")
    place = F.struct("doc", "start")
    firsts = found.groupBy("size", "begin").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = _salted(found, firsts, ["size", "begin"], F.xxhash64("doc", "start")).where(place > F.col("first"))
    runs = later.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("lengths"))
    runs = runs.join(once.select("doc", "doc_id", "digest"), "doc").select(F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "digest", "starts", "lengths", F.lit(False).alias("whole"))
    empty = F.lit(None).cast("array<int>")
    return runs.unionByName(copies.select("doc_id", "digest", empty.alias("starts"), empty.alias("lengths"), F.lit(True).alias("whole"))), boilerplate


def without(text: str, whole: bool, starts: list[int] | None, lengths: list[int] | None) -> tuple[str, int, int]:
    """The text that stays, its lines that aren't blank before, and how many of them went."""
    lines = text.split("\n")
    blank = [not x.strip() for x in lines]
    n = len(lines) - sum(blank)
    gone = np.zeros(n + 1, np.int64)
    for a, size in zip(starts or (), lengths or (), strict=True):
        gone[a] += 1
        gone[a + size] -= 1
    off = np.ones(n, bool) if whole else np.cumsum(gone)[:n] > 0
    if not off.any():
        return text, n, 0
    kept, k, last = [], -1, False
    for line, empty in zip(lines, blank, strict=True):
        if not empty:
            k += 1
            last = bool(off[k])
        if not last:
            kept.append(line)
    return "\n".join(kept), n, int(off.sum())


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, often: int = OFTEN) -> DataFrame:
    """docs with what stays of its text, _line_count and _line_deleted (lines that aren't blank)."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("_line_count", "_line_deleted")))
    names = docs.columns
    an_id, digest, starts, lengths, whole, copy, task = (S.free_name(names, x) for x in ("_line_doc", "_line_digest", "_line_starts", "_line_lengths", "_line_whole", "_line_copy", "_line_task"))
    table = S.written(line_table(docs), "lines")
    same_id = F.coalesce("doc_id", F.lit(LAST)).alias(an_id)
    runs, boilerplate = repeats(table, min_words, often)
    gone = runs.select(same_id, F.col("digest").alias(digest), F.col("starts").alias(starts), F.col("lengths").alias(lengths), F.col("whole").alias(whole))
    keyed = docs.withColumn(an_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(digest, F.coalesce(_digest(F.col("text")), F.lit(b"")))
    joined = keyed.join(gone.hint("merge"), [an_id, digest], "left").withColumn(copy, F.lit(False))
    repeated = S.written(table.groupBy(same_id, F.col("digest").alias(digest)).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "lines-repeated")
    if not repeated.isEmpty():  # of equal rows, the first one in the first task that has some is no copy; these rows are dealt out by task
        rare = _salted(keyed.withColumn(task, F.spark_partition_id()), repeated, [an_id, digest], F.spark_partition_id(), "left_semi")
        number = F.row_number().over(Window.partitionBy(an_id, digest, task).orderBy(F.lit(0)))
        first = rare.groupBy(an_id, digest).agg(F.min(task).alias("_first"))
        rare = _salted(rare.withColumn(copy, number > 1), first, [an_id, digest], F.col(task)).withColumn(copy, F.col(copy) | (F.col(task) != F.col("_first"))).drop("_first")
        heavy = S.written(boilerplate.select(F.col("digest").alias(digest), F.lit(True).alias("_often")), "lines-boilerplate")
        rare = _salted(rare, heavy, [digest], F.col(task), "left").withColumn(copy, F.col(copy) & (F.coalesce("_often", F.lit(False)) | (F.size(F.split(F.trim("text"), r"\s+")) >= min_words))).drop("_often")
        others = joined.join(repeated.hint("merge"), [an_id, digest], "left_anti")
        joined = others.unionByName(_salted(rare, gone, [an_id, digest], F.col(task), "left").drop(task))
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, deleted = [], [], []
            for text, at, n_lines, is_whole, is_copy in zip(*(b.column(i).to_pylist() for i in (text_at, *range(len(names), len(names) + 4))), strict=True):
                if text is None:
                    kept, n, k = None, 0, 0
                else:
                    kept, n, k = without(text, bool(is_whole) or is_copy, at, n_lines)
                texts.append(kept)
                counts.append(n)
                deleted.append(k)
            columns = [*b.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(deleted, pa.int64())]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_line_count", "_line_deleted"])

    schema = T.StructType([*docs.schema, T.StructField("_line_count", T.LongType()), T.StructField("_line_deleted", T.LongType())])
    return joined.select(*names, starts, lengths, whole, copy).mapInArrow(run, schema)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.col("_line_count").alias("n_lines"), F.col("_line_deleted").alias("n_deleted"))
