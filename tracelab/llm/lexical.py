"""Ranked lexical search: integer BM25 scores by sort-based accumulation.

Terms are runs of ASCII letters and digits and of anything beyond ASCII, with A to Z lower-cased. Documents are read once: each becomes its number of terms and, for those terms that any
item has, ids and numbers of occurrences, in a written table. From that table come the corpus counts (documents, terms, documents of each term) and then, in a second pass, the scores:
of a group of documents the arrays of matched items, documents and impacts are concatenated, keys that pack item and document are put in order by a radix sort of 16-bit digits, and
the impacts of equal keys are summed by ``reduceat``. A task keeps a heap of the k best documents of each item and what can't enter it is left out before. The heaps of all tasks
are range-partitioned by item, score and document, cut to k again within each range, and ranked.

Items are taken in blocks of ``ITEMS``, so that what is broadcast (an item's terms, the block's vocabulary and weights) has a bound; each block reads all documents. Within a
task at most about ``PAIRS`` triples of item, document and impact are held at a time.

Scores are 64-bit integers. Where a document's length times the number of documents leaves that range, the length's part is reckoned in Python's integers.

Edge cases: null and empty texts, and texts without a term, count nowhere and are never found. Each row of items is an item, so that rows that repeat an id have as many rankings; an item
without terms, or with none that a document has, gets no row. Documents that repeat an id each have their rank; those without id come last among equals. Fewer than k documents
are all returned. Empty tables give an empty result. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelab.llm import _shared as S
from tracelab.sources.staging import numbered

ITEMS, PAIRS, TOP = 2048, 4_000_000, 10
_BYTES = np.arange(256)
#: Bytes that belong to terms, and what A to Z become.
_INSIDE = (_BYTES >= 128) | np.isin(_BYTES, [*range(48, 58), *range(65, 91), *range(97, 123)])
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def terms_of(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different terms of some texts, for each term in order which it is, and how many terms stand before each text and the last one's end."""
    data, offsets = S.bytes_of(column)
    if not len(data):
        return [], np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[offsets < len(data)]
    first[at] = inside[at]  # a term ends with its text
    starts = np.flatnonzero(first)
    ends = np.append(np.cumsum(inside)[starts] - 1, inside.sum()).astype(np.int32)
    own = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
    return own.dictionary.to_pylist(), own.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts keys, not negative, by their 16-bit digits from the lowest on."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    most, shift = int(keys.max(initial=0)), 16
    while most >> shift:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


class Items:
    """A block of items: its vocabulary, and for each term the items that have it, with how often."""

    def __init__(self, rows: list[tuple[int, bytes, int]]):
        self.terms = sorted({t for _, t, _ in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        rows = sorted((number[t], item, times) for item, t, times in rows)
        term, self.item, self.times = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ((), (), ())))
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))


def item_terms(items: DataFrame) -> list[tuple[int, bytes, int]]:
    """items: _item, text. Each item's terms and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in S.slices(b, 1):
                terms, which, before = terms_of(part.column(1))
                row = np.repeat(np.arange(part.num_rows), np.diff(before))
                key, times = np.unique(row * (len(terms) + 1) + which, return_counts=True)
                row, which = np.divmod(key, len(terms) + 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array([terms[i] for i in which.tolist()], pa.binary()), pa.array(times)], names=["item", "term", "times"])

    return [tuple(r) for r in items.select("_item", "text").mapInArrow(run, "item long, term binary, times long").collect()]  # of at most ITEMS items


def postings(docs: DataFrame, items: Items) -> DataFrame:
    """docs: doc_id, text. doc_id, n and, of the terms that items have, ids and times as 32-bit integers; documents with at least one term."""
    held, key = docs.sparkSession.sparkContext.broadcast(items.terms), uuid.uuid4().hex  # the terms of at most ITEMS items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = S.held(("lexical", key), lambda: {t: i for i, t in enumerate(held.value)})
        for b in batches:
            for part in S.slices(b, 1):
                terms, which, before = terms_of(part.column(1))
                n = np.diff(before)
                term = np.fromiter((number.get(t, -1) for t in terms), np.int64, len(terms))[which]
                row = np.repeat(np.arange(part.num_rows), n)[term >= 0]
                pair, times = np.unique(row * (len(number) + 1) + term[term >= 0], return_counts=True)
                row, term = np.divmod(pair, len(number) + 1)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                whole = pa.RecordBatch.from_arrays([part.column(0), pa.array(n), S.rows_of(term.astype("<i4"), ends), S.rows_of(times.astype("<i4"), ends)], names=["doc_id", "n", "ids", "times"])
                yield whole.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, ids binary, times binary")


def document_counts(found: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for ids in b.column(0).to_pylist():
                total[np.frombuffer(ids, "<i4")] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at), "df": pa.array(total[at])})

    out = np.zeros(size, np.int64)
    for r in found.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the vocabulary of a block
        out[r["term"]] = r["df"]
    return out


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A document's m, from its number of terms."""
    if 75 * int(n.max(initial=0)) * documents >= 2**63:
        return np.array([25 + 75 * x * documents // terms for x in n.tolist()], np.int64)
    return 25 + 75 * n * documents // terms


class Heaps:
    """The k best documents of each item: by score, then those with an id, then the smallest id."""

    def __init__(self, k: int):
        self.k, self.best = k, {}
        self.floor = np.zeros(0, np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, named: np.ndarray) -> None:
        if len(item) and int(item.max()) >= len(self.floor):
            self.floor = np.append(self.floor, np.ones(int(item.max()) + 1 - len(self.floor), np.int64))
        keep = np.flatnonzero(score >= self.floor[item])
        order = keep[np.lexsort((doc[keep], ~named[keep], -score[keep], item[keep]))]
        of = item[order]
        new = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
        rank = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
        for i in order[rank < self.k].tolist():
            own = self.best.setdefault(int(item[i]), [])
            entry = (int(score[i]), bool(named[i]), -int(doc[i]))
            if len(own) < self.k:
                heapq.heappush(own, entry)
            elif entry > own[0]:
                heapq.heapreplace(own, entry)
        for x in np.unique(of).tolist():
            if len(self.best[x]) == self.k:
                self.floor[x] = self.best[x][0][0]

    def rows(self) -> pa.RecordBatch:
        out = [(x, s, -d if named else None) for x, own in self.best.items() for s, named, d in own]
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "score", "doc_id"])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)


def accumulated(term: np.ndarray, row: np.ndarray, impact: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, row and summed impact of all pairs that share a term; term, row, impact: of each posting."""
    share = items.start[term + 1] - items.start[term]
    at = S.spread(items.start[term], share)
    size = int(row.max(initial=0)) + 1
    key = items.item[at] * size + np.repeat(row, share)
    value = np.repeat(impact, share) * items.times[at]
    order = radix_order(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    sums = np.add.reduceat(value[order], first) if len(first) else value
    item, own = np.divmod(key[first], size)
    return item, own, sums


def best_of_tasks(found: DataFrame, items: Items, documents: int, terms: int, k: int) -> DataFrame:
    """Each task's k best documents of each item: item (its place in the block), score, doc_id."""
    df = document_counts(found, len(items.terms))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    held = found.sparkSession.sparkContext.broadcast((items, weight))  # of at most ITEMS items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = held.value
        heaps = Heaps(k)
        for b in batches:
            ids, named = _ids(b.column(0))
            m = lengths(b.column(1).to_numpy(), documents, terms)
            each = [np.frombuffer(x, "<i4") for x in b.column(2).to_pylist()]
            size = np.array([len(x) for x in each])
            term, times = np.concatenate(each).astype(np.int64), np.frombuffer(b"".join(b.column(3).to_pylist()), "<i4").astype(np.int64)
            row = np.repeat(np.arange(len(each)), size)
            impact = weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[row]))
            pairs = np.append(0, np.cumsum(items.start[term + 1] - items.start[term]))
            ends = np.append(0, np.cumsum(size))
            at = 0
            while at < len(each):  # whole documents, of about PAIRS pairs
                stop = max(at + 1, int(np.searchsorted(pairs[ends], pairs[ends[at]] + PAIRS, side="right")) - 1)
                own = slice(ends[at], ends[stop])
                item, of, score = accumulated(term[own], row[own] - at, impact[own], items)
                heaps.offer(item, score, ids[of + at], named[of + at])
                at = stop
        yield heaps.rows()

    return found.mapInArrow(run, "item long, score long, doc_id long")


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """heaps: a written table of item, score, doc_id. The k best of each item, ranked; an item's entries may stand in several ranges, each of which is cut to k first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Heaps(k)
        for b in batches:
            own.offer(b.column(0).to_numpy(), b.column(1).to_numpy(), *_ids(b.column(2)))
        yield own.rows()

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    cut = heaps.repartitionByRange(F.col("item"), *order).mapInArrow(run, "item long, score long, doc_id long")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = ITEMS) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. The k documents with the highest scores of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    own = numbered(items.select("item_id", F.col("text").cast("string").alias("text")), ["item_id", "text"], "_item")
    out = None
    for low in range(1, own.count() + 1, block):
        asked = own.where(F.col("_item").between(low, low + block - 1)).withColumn("_item", F.col("_item") - low)
        of = Items(item_terms(asked))
        found = S.written(postings(docs, of), "lexical-postings")
        total = found.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).head()
        heaps = S.written(best_of_tasks(found, of, total["documents"], total["terms"] or 1, k), "lexical-heaps")
        ranked = merged(heaps, k).join(F.broadcast(asked.select("item_id", F.col("_item").alias("item"))), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(S.table(spark, sf_dir, "documents").select("doc_id", "text"), S.table(spark, sf_dir, "benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH items AS (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS terms FROM benchmark),
asked AS (SELECT k, item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
held AS (SELECT r, doc_id, len(terms) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, terms, unnest(terms) AS term FROM docs) GROUP BY ALL),
every AS (SELECT count(*) AS nd, sum(len(terms))::BIGINT AS nt FROM docs WHERE len(terms) > 0),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, every GROUP BY term),
scored AS (
  SELECT k, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), every GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
