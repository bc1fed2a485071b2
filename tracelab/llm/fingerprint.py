"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (what stands between line ends) hashes to a wide vector in two parts: ``UNIFORM`` lanes of 64 bits from SHA-256 of its bytes, and
``LANES`` lanes of 32 bits that sum a sign for each of its ``GRAM``-character pieces at the lane that the piece's hash names. A fingerprint
is the sum of its paragraphs' vectors, lane by lane, modulo 2**64 and 2**32. So the order of paragraphs doesn't
matter, a paragraph is inserted by adding its vector and deleted by subtracting it, and equal multisets of paragraphs have equal fingerprints; with
others, the uniform lanes are equal only by a 256-bit collision. Signed lanes estimate how alike two texts are: the cosine
between them is that between the texts' piece counts, give or take 1 / sqrt(LANES). A lane would wrap only in texts of over 2**31 pieces, more than a string can hold.

The edited text of a document needs the start of the next one by descending id. Ids are cut into ranges at quantiles; a row that comes first in
its range also goes to the range before, marked as a copy, so that each range holds all that it needs, in order, in a stream.

Edge cases: null and empty texts have one empty paragraph. Rows without id stand after all others. Rows with the same id are ordered by text; each counts as
a document of its own. With one document the next one is itself. An empty table gives an empty result. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import _shared as S

LANES, UNIFORM, GRAM = 256, 4, 8
_M = S.multipliers(GRAM + 1, 4)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Uniform lanes and signed lanes of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    c = S.code_points("\n".join(texts) + "\n").astype(np.uint64)
    ends = np.cumsum(sizes + 1) - 1
    stop = np.flatnonzero(c == 10)  # of each paragraph
    start = np.concatenate([[0], stop[:-1] + 1])
    owner = np.searchsorted(ends, stop)
    n = len(c) - GRAM + 1
    signed = np.zeros((len(texts), LANES), np.int64)
    if n > 0:
        h = np.full(n, GRAM, np.uint64)
        for j in range(GRAM):
            h += (c[j : j + n] + np.uint64(1)) * _M[j]
        S.mix(h)
        room = np.maximum(stop - start - GRAM + 1, 0)  # pieces of each paragraph
        at = S.spread(start, room)
        _add(signed, np.repeat(owner, room), h[at])
    short = np.flatnonzero((stop - start < GRAM) & (stop > start))  # a paragraph shorter than a piece is one
    h = np.zeros(len(short), np.uint64)
    for j in range(GRAM - 1):
        on = start[short] + j < stop[short]
        h[on] += (c[(start[short] + j)[on]] + np.uint64(1)) * _M[j]
    h += (stop - start)[short].astype(np.uint64) * _M[GRAM]
    _add(signed, owner[short], S.mix(h))
    uniform = np.zeros((len(texts), UNIFORM), np.uint64)
    sha = hashlib.sha256
    for i, text in enumerate(texts):
        raw = b"".join([sha(p).digest() for p in text.encode().split(b"\n")])
        uniform[i] = np.frombuffer(raw, "<u8").reshape(-1, UNIFORM).sum(axis=0, dtype=np.uint64)
    return uniform, signed.astype(np.uint32)


def _add(signed: np.ndarray, owner: np.ndarray, h: np.ndarray) -> None:
    cell = owner * LANES + ((h >> np.uint64(32)) % np.uint64(LANES)).astype(np.int64)
    up = (h & np.uint64(1)).astype(bool)
    signed += np.bincount(cell[up], minlength=signed.size).reshape(signed.shape) - np.bincount(cell[~up], minlength=signed.size).reshape(signed.shape)


def combine(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of the union of two multisets (sign 1), or of a without b (sign -1)."""
    return (a[0] + b[0], a[1] + b[1]) if sign > 0 else (a[0] - b[0], a[1] - b[1])


def strings(v: tuple[np.ndarray, np.ndarray]) -> list[str]:
    return [u.astype("<u8").tobytes().hex() + "." + base64.b64encode(s.astype("<u4").tobytes()).decode() for u, s in zip(*v, strict=True)]


def parsed(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    halves = [x.split(".") for x in fingerprints]
    return np.array([np.frombuffer(bytes.fromhex(a), "<u8") for a, _ in halves]).reshape(-1, UNIFORM), np.array([np.frombuffer(base64.b64decode(b), "<u4") for _, b in halves]).reshape(-1, LANES)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """From 0 to 1; 1 for equal fingerprints."""
    x, y = (v[1].astype(np.uint32).view(np.int32).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    return np.where(same, 1.0, np.clip((x * y).sum(axis=1) / np.where(norm > 0, norm, 1), 0, 1))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (doc_id, text) with ``slot`` and ``copy``, in ranges of descending id: within a slot, a row is followed by the next document's.

    The last row of a slot is a copy of the first of the next slot, of the first of all at the end."""
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else []
    held = docs.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))  # 8 bytes a range

    @F.arrow_udf("int")
    def above(ids: pa.Array) -> pa.Array:
        """How many cuts are not above each id; only ids go to Python."""
        return pa.array(np.searchsorted(held.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    slotted = docs.withColumn("slot", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(above("doc_id"))).withColumn("copy", F.lit(0))
    tops = {r["slot"]: r["top"] for r in slotted.groupBy("slot").agg(F.max("doc_id").alias("top")).collect()}  # a row for each range
    order = sorted(tops, reverse=True)
    if not order:
        return slotted
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    heads = docs.sparkSession.createDataFrame([(s, tops[s], before[s]) for s in order], "slot int, top long, before int")
    first = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNotNull().alias("some"))
    lead = slotted.join(F.broadcast(heads), "slot").where(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("before").agg(F.min(first).alias("first"), F.first("doc_id").alias("doc_id"))
    copies = lead.select("doc_id", F.when(F.col("first.some"), F.col("first.text")).alias("text"), F.col("before").alias("slot"), F.lit(1).alias("copy"))
    return slotted.unionByName(copies)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of op4's contract, for docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranges = S.partitions(spark)
    rows = neighbours(docs, ranges).repartitionById(ranges + 1, F.col("slot") + 1).sortWithinPartitions("slot", "copy", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")), F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row that waits for the next: id, text, slot
        vector = None
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                own = list(zip(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()], part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                v = vectors([r[1] for r in own])
                rows = own if last is None else [last, *own]
                v = v if last is None else tuple(np.concatenate([x, y]) for x, y in zip(vector, v, strict=True))
                k = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
                if k:
                    changed = [edited(rows[i][1], rows[i + 1][1]) for i in k]
                    w = vectors(changed)
                    a = tuple(x[k] for x in v)
                    after = tuple(x[[i + 1 for i in k]] for x in v)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([rows[i][0] for i in k], pa.int64()),
                            "n_chars": pa.array([len(rows[i][1]) for i in k], pa.int64()),
                            "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in changed],
                            "fingerprint": strings(a),
                            "edited_fingerprint": strings(w),
                            "near_edited": likeness(a, w),
                            "near_next": likeness(a, after),
                        }
                    )
                last, vector = rows[-1], tuple(x[-1:] for x in v)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(S.table(spark, sf_dir, "documents"))
