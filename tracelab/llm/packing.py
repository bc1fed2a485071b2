"""Best-fit packing of documents into token sequences, after Martello and Toth's dominance reduction.

Only a histogram of piece lengths decides how to pack: it has at most ``capacity`` rows whatever the input, so the plan
is made on the driver, over lengths with counts, and holds patterns (lengths that share a sequence) with counts. The reduction
goes over lengths from the largest, j, and fixes sets that dominate all others that hold j: j alone if nothing fits beside it; j with a piece
that fills the rest exactly; j with the largest piece that fits if no two do; j with the largest piece and the largest
beside it if no three fit and no other pair has a smaller member above the latter. It repeats until nothing is fixed. What remains
is packed by best fit, from the largest length on, all copies of a length at once.

Pieces get ranks within their length: a rank within the task that made them, plus the counts of earlier tasks, from a window over task counts.
No task sees all pieces of a length, however common. A plan's segment says which ranks of a length stand where.

Tokens: white space always ends a token of this vocabulary, so ids are kept by what stands between white space (about ``CACHE`` stretches, then afresh), over all tasks
of a worker. Of stretches that aren't known yet, those of plain characters are lower-cased and split here, and their different parts merged many at once; others go to the library.

Edge cases: null and empty texts give a document of one id, the end mark. Repeated rows are packed each. An empty table
gives an empty result. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelab.llm import _shared as S
from tracelab.llm.merges import Merges

CAPACITY, END_ID, CACHE = 4096, 1, 800_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: What is split, lower-cased and merged here; the library gets the rest.
PLAIN = re.compile(r"[ \t-\r!-~¡§°·¿«»À-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Ids:
    """Ids of whole texts."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.merge, self.kept = Tokenizer.from_file(path), Merges(path), S.Kept(cache, np.uint32)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def _learn(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [s.decode() for s in stretches]
        parts = [PARTS.findall(t.lower()) if PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        new = list(set().union(*(p for p in parts if p)))
        ids = dict(zip(new, self.merge([p.encode() for p in new]), strict=True))
        other = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, parts, strict=True) if p is None], add_special_tokens=False))
        found = [np.array(next(other).ids, "<u4").tobytes() if own is None else b"".join([ids[p] for p in own]) for own in parts]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin and the last one's end."""
        different, which, before = S.stretched(texts, S.at_blanks)
        return self.kept.rows(self.kept.numbers(different, self._learn)[which], before)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows of PIECE with task and rank: the rank of a piece among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task = S.held(("packing", path), lambda: Ids(path)), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for part in S.slices(b, 1):
                rows = []
                flat, ends = ids(part.column(1))
                raw = memoryview(flat.astype("<u4").tobytes())
                for doc, first, stop in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    for k, i in enumerate(range(0, stop - first + 1, capacity)):
                        n = min(capacity, stop - first + 1 - i)
                        last = i + n > stop - first
                        crc = zlib.crc32(raw[4 * (first + i) : 4 * (first + i + n - last)])
                        rows.append((doc, k, i, n, zlib.crc32(end, crc) if last else crc, task, int(seen[n])))
                        seen[n] += 1
                columns = zip(*rows, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{PIECE}, task int, rank long")


class Plan:
    """Segments: ranks from ``rank`` on of pieces of a length, ``each`` of them in each of ``bins`` sequences from ``first`` on, at ``offset``."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left = capacity, {k: v for k, v in counts.items() if v}
        self.sizes, self.next, self.segments, self.bins = sorted(self.left), Counter(), [], 0
        self.fixed = 0
        self._reduce()
        self.fixed = self.bins
        self._best_fit()

    def _emit(self, pattern: list[tuple[int, int]], bins: int) -> None:
        offset = 0
        for size, each in pattern:
            self.segments.append((size, self.next[size], bins, each, self.bins, offset))
            self.next[size] += bins * each
            offset += size * each
        self.bins += bins

    def _fix(self, *sizes: int) -> None:
        need = Counter(sizes)
        bins = min(self.left[s] // n for s, n in need.items())
        self._emit(sorted(need.items(), reverse=True), bins)
        for s, n in need.items():
            self.left[s] -= bins * n
            if not self.left[s]:
                self.sizes.pop(bisect_left(self.sizes, s))

    def _largest(self, most: int, *used: int) -> int:
        """The largest size up to most that has a piece besides the used ones; 0 if none."""
        at = bisect_right(self.sizes, most) - 1
        while at >= 0 and self.left[self.sizes[at]] <= used.count(self.sizes[at]):
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def _smallest(self, j: int, n: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes[: n + 1]:
            out += [s] * min(n, self.left[s] - (s == j))
        return (out + [self.capacity + 1] * n)[:n]

    def _dominant(self, j: int) -> tuple[int, ...]:
        """The set that dominates all that hold j, if one of up to three pieces does."""
        rest = self.capacity - j
        small = self._smallest(j, 3)
        if small[0] > rest:
            return (j,)
        big = self._largest(rest, j)
        if big == rest or small[0] + small[1] > rest:
            return (j, big)
        if sum(small) <= rest:
            return ()
        beside = self._largest(rest - big, j, big)
        if not beside:
            return ()
        lesser = self._largest(rest // 2, j)  # the largest smaller member of a pair that fits
        while lesser > beside:
            at = bisect_left(self.sizes, lesser)
            partner = lesser if self.left[lesser] > 1 + (lesser == j) else next((s for s in self.sizes[at + 1 : at + 3] if self.left[s] > (s == j)), self.capacity)
            if lesser + partner <= rest:
                return ()
            lesser = self._largest(lesser - 1, j)
        return (j, big, beside)

    def _reduce(self) -> None:
        while True:
            before = self.bins
            for j in self.sizes[::-1]:
                while self.left[j] and (chosen := self._dominant(j)):
                    self._fix(*chosen)
            if self.bins == before:
                return

    def _best_fit(self) -> None:
        open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}  # by room left
        rooms: list[int] = []

        def put(room: int, pattern: list[tuple[int, int]], bins: int) -> None:
            if bins:
                if room not in open_bins:
                    open_bins[room] = []
                    insort(rooms, room)
                open_bins[room].append((pattern, bins))

        for s in self.sizes[::-1]:
            m = self.left[s]
            while m:
                at = bisect_left(rooms, s)
                if at < len(rooms):
                    room = rooms[at]
                    pattern, bins = open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room]
                        rooms.pop(at)
                else:
                    room, pattern, bins = self.capacity, [], -(-m // (self.capacity // s))
                each = min(room // s, m)
                full = min(bins, m // each)
                put(room - each * s, [*pattern, (s, each)], full)
                put(room, pattern, bins - full if pattern else 0)
                m -= full * each
        for own in open_bins.values():
            for pattern, bins in own:
                self._emit(pattern, bins)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Segments sorted by length and rank, and their keys."""
        table = np.array(sorted(self.segments), np.int64).reshape(-1, 6)
        return table, (table[:, 0] << 48) + table[:, 1]


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows of ``pieces`` (a written table), with sequence_id and offset in place of task and rank."""
    tasks = S.written(rows.groupBy("length", "task").agg(F.count("*").alias("n")), "packing-counts")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, keys = Plan(counts, capacity).arrays()
    shipped = rows.sparkSession.sparkContext.broadcast((table, keys))  # by the histogram's size, not by the rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Tasks times lengths are too many to broadcast.
    ranked = rows.join(base.hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys = shipped.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            size, first, _, each, sequence, offset = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1].T
            k = rank - first
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence + k // each), pa.array(offset + (k % each) * size)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECE}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of docs (doc_id, text): its place in its document and in its sequence."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return packed(S.written(pieces(docs, path, capacity, end_id), "packing-pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(S.table(spark, sf_dir, "documents").select("doc_id", "text"))
