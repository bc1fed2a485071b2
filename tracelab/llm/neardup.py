"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its lower-cased words between white space. Sketch: its shingles are runs of ``K`` words (fewer words are one shingle), each labelled with how often it
stood before, so that labelled shingles are unique in a text. For each of ``BANDS`` hash functions the ``KEPT`` shingles with the smallest hashes, in the order in which they
stand in the text, are the band's key: reordered text changes it, as it changes the edit similarity. Texts that share the
key of a band are in one of its buckets.

Verification aligns two texts word by word: their longest common subsequence within the band of offsets that an alignment of
enough similarity can have. With m words matched of n1 and n2 the similarity is m / (n1 + n2 - m), at least ``SIMILARITY`` for a link. It never is above that of the
multisets of words, by which most pairs are ruled out before they are aligned.

Classes are the connected components of links. Equal texts are one node from the start. A round compares one leader of each bucket, chosen by hash, with the
members that are of another class and of fitting length, and contracts the classes that links join. A leader has met all of its bucket and leaves it. A
bucket leaves when one class is left in it. In the second round all members of a bucket of at most ``SMALL`` members, whatever their classes, lead. The larger
buckets that still hold several classes, few or many, then are cut into blocks of about ``BLOCK`` members, and each two blocks meet in a task of their own: it counts the words that each two
texts of different classes share, aligns those that share enough, and passes over pairs that it has joined through others. Members of a bucket's largest class aren't
held against each other. So each pair in a bucket is linked, or in one class, or compared, and no table holds a group's pairs; but the time for a group that stays
in many classes grows with the square of its members.

Recall: words that are changed one by one break K shingles each. Two texts of words similar to 0.8 then share about 0.42 of their shingles, a band's key with a chance of
0.42 ** KEPT, and no bucket with one of 2 in 100; at 0.85 it is 1 in 1000. Copies of one text are mostly joined through each other besides.

Cost of a round: the tables of buckets, pairs, links and classes are small beside the texts. Each is written in as many files as its rows need, not one for each shuffle
partition, so that with many partitions and few rows a round is tens of tasks and its joins can be broadcast.

Edge cases: a null text is an empty one; empty texts are copies of each other. Repeated rows are copies. The document that stands for a class has the smallest id, then
the smallest digest, and of repeated rows one is chosen; a null id comes after all others. An empty table gives an empty result. Extra columns are left out by ``near_duplicates`` and pass through ``one_of_each``
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import _shared as S

K, BANDS, KEPT, SIMILARITY, SALTS, CACHE, SMALL, ROUNDS = 5, 20, 2, 0.8, 8, 500_000, 16, 2
#: Members of a bucket that one copy of its leader's text serves.
FAN = 1000
#: Members and words of a block, and words that a product of two blocks takes at a time.
BLOCK, VOLUME, WIDE = 512, 4_000_000, 4096
#: Rows of a file of a table of keys, pairs or labels, and files that such a table may always have.
FEW, FILES = 20_000, 8
LAST = 2**63 - 1
_M = S.multipliers(K + 1, 1)
_TURNS = S.multipliers(BANDS, 11)


def labelled(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's items and of how often each stood before."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    run = h[order]
    new = np.append(True, run[1:] != run[:-1]) if n else np.empty(0, bool)
    h = h.copy()
    if not new.all():
        start = np.flatnonzero(new)
        label = np.empty(n, np.uint64)
        label[order] = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        h += label * _M[K]
    return S.mix(h)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the labelled shingles of a text's word hashes, in order."""
    n = max(1, len(words) - K + 1) if len(words) else 0
    h = np.zeros(n, np.uint64)
    for j in range(min(K, len(words))):
        h += words[j : j + n] * _M[j]
    return labelled(h)


def keys(of: np.ndarray) -> np.ndarray:
    """A key for each band, from labelled shingles."""
    n = len(of)
    kept = min(KEPT, n)
    out = np.empty(BANDS, np.uint64)
    step = max(1, 1_000_000 // max(1, n))
    for at in range(0, BANDS, step):
        turns = _TURNS[at : at + step]
        h = of[None, :] * turns[:, None]
        row = np.arange(len(turns))
        places = []
        for _ in range(kept):
            places.append(h.argmin(axis=1))
            h[row, places[-1]] = np.uint64(2**64 - 1)
        key = turns.copy()
        for own in of[np.sort(np.array(places), axis=0)]:
            key = S.mix(key * _M[0] + own)
        out[at : at + step] = key
    return out


def matched(a: np.ndarray, b: np.ndarray, enough: int) -> int:
    """Length of the longest common subsequence of two texts' words, a and b small integers, if it is at least ``enough``; else something less.

    A bit for each word of a, cleared once it ends a longer subsequence, all at once for each word of b; only the words of a within the band are looked at."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    out, need = head + tail, enough - head - tail
    if not a or not b:
        return out
    band = len(a) + len(b) - 2 * need
    if band < 0:
        return out
    rows = max(128, band)
    low, high, open_ = 0, 0, 0  # columns of the window, and its bits
    for at in range(0, len(b), rows):
        first, stop = max(0, at - band), min(len(a), at + rows + band)
        first = min(first, high)
        gone = first - low
        out += gone - (open_ & ((1 << gone) - 1)).bit_count()
        open_ = (open_ >> gone) | (((1 << (stop - high)) - 1) << (high - first))
        low, high = first, max(high, stop)
        full = (1 << (high - low)) - 1
        where: dict[int, int] = {}
        bit = 1
        for x in a[low:high]:
            where[x] = where.get(x, 0) | bit
            bit <<= 1
        for y in b[at : at + rows]:
            if m := where.get(y):
                m &= open_
                open_ = ((open_ + m) | (open_ - m)) & full
    return out + (high - low) - open_.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Of two texts' words, by their alignment within the band that ``least`` allows; 0 if it is below ``least``."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2:
        return float(n1 == n2)
    enough = int(np.ceil(least / (1 + least) * (n1 + n2) - 1e-9))
    if min(n1, n2) < enough:
        return 0.0
    kinds, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = code[:n1], code[n1:]
    if np.minimum(np.bincount(one, minlength=len(kinds)), np.bincount(two, minlength=len(kinds))).sum() < enough:
        return 0.0
    m = matched(one, two, enough)
    return m / (n1 + n2 - m) if m >= enough else 0.0


class Sketcher:
    """Word hashes of texts; those of what stands between white space are kept, about CACHE stretches, then afresh."""

    def __init__(self):
        self.kept = S.Kept(CACHE, np.uint64)

    @staticmethod
    def _learn(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [s.decode().lower().split() for s in stretches]
        digest = xxhash.xxh3_64_intdigest
        return np.array([digest(w.encode()) for own in words for w in own], np.uint64), np.fromiter(map(len, words), np.int64, len(words))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        different, which, before = S.stretched(texts, S.at_blanks)
        return self.kept.rows(self.kept.numbers(different, self._learn)[which], before)


def sketches(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, raw (digest of the text), node (digest of its words), n (words), keys and words; of copies in a task, the first alone has the last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, seen, task, count = S.held("neardup", Sketcher), set(), TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for part in S.slices(b, 1, rows=500):
                flat, ends = sketcher.words(part.column(1))
                raw = [hashlib.md5(t or b"").digest() for t in part.column(1).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()]
                node, bands, own = [], [], []
                for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    words = flat[i:j]
                    node.append(hashlib.md5(words.tobytes()).digest())
                    if node[-1] in seen or i == j:
                        bands.append(None)
                        own.append(None)
                        continue
                    if len(seen) > CACHE:
                        seen.clear()
                    seen.add(node[-1])
                    bands.append(keys(shingles(words)).view(np.int64))
                    own.append((words >> np.uint64(32)).astype("<u4").tobytes())
                row = pa.array(np.arange(task + count, task + count + part.num_rows))
                count += part.num_rows
                columns = [row, part.column(0), pa.array(raw, pa.binary()), pa.array(node, pa.binary()), pa.array(np.diff(ends).astype(np.int32)), pa.array(bands, pa.list_(pa.int64())), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "raw", "node", "n", "keys", "words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, doc_id long, raw binary, node binary, n int, keys array<long>, words binary")


def _few(df: DataFrame, tag: str, rows: int) -> DataFrame:
    """df as a written table, in no more files than about so many rows need. Where that is as many as there are shuffle partitions, as Spark deals it."""
    n = max(FILES, math.ceil(rows / FEW))
    return S.written(df.coalesce(n) if n < S.partitions(df.sparkSession) else df, tag)


def _salted(many: DataFrame, few: DataFrame, on: list[str], salt, how: str = "inner") -> DataFrame:
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(few, [*on, "_salt"], how).drop("_salt")


def verified(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """Of pairs (leader, node, fan), those that are similar enough, as a and b. sequences: node, words. A leader's text has as many copies as its largest fan."""
    copies = pairs.groupBy("leader").agg(F.max("fan").alias("copies")).select(F.col("leader").alias("node"), "copies")
    one = sequences.join(copies, "node").select(F.col("node").alias("leader"), F.col("words").alias("left"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_salt"))
    two = sequences.select("node", F.col("words").alias("right"))
    whole = pairs.withColumn("_salt", F.pmod(F.xxhash64("node"), F.col("fan")).cast("int")).join(one, ["leader", "_salt"]).join(two, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = [similarity(np.frombuffer(left[i].as_py(), "<u4"), np.frombuffer(right[i].as_py(), "<u4"), least) >= least for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.select([0, 1]).filter(pa.array(ok, pa.bool_())).columns, names=["a", "b"])

    return whole.select("leader", "node", "left", "right").mapInArrow(run, "a binary, b binary")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many labelled words each text of left has in common with each of right."""
    sides = [(np.repeat(np.arange(len(x)), [len(t) for t in x]), np.concatenate(x)) for x in (left, right)]
    common = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for row, own in sides:
        at = np.searchsorted(common, own)
        has = at < len(common)
        has[has] = common[at[has]] == own[has]
        order = np.argsort(at[has], kind="stable")
        places.append((row[has][order], at[has][order]))
    for start in range(0, len(common), WIDE):
        ones = []
        for x, (row, at) in zip((left, right), places, strict=True):
            i, j = np.searchsorted(at, [start, start + WIDE])
            m = np.zeros((len(x), min(WIDE, len(common) - start)), np.float32)
            m[row[i:j], at[i:j] - start] = 1
            ones.append(m)
        out += ones[0] @ ones[1].T
    return out.astype(np.int64)


def block_links(labels: list[bytes], texts: list[np.ndarray], first: np.ndarray, within: bool, least: float) -> list[tuple[bytes, bytes]]:
    """Links that join the classes of texts, between those of the first block and the others, or within one block; none that others imply."""
    one = np.arange(len(texts)) if within else np.flatnonzero(first)
    two = one if within else np.flatnonzero(~first)
    if not len(one) or not len(two):
        return []
    _, group = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)
    n = np.array([len(x) for x in texts])
    n1, n2 = n[one][:, None], n[two][None, :]
    may = (group[one][:, None] != group[two][None, :]) & (np.minimum(n1, n2) >= least * np.maximum(n1, n2) - 1e-9)
    if within:
        may = np.triu(may, 1)
    if not may.any():
        return []
    marked = [labelled(t.astype(np.uint64)) for t in texts]
    may &= shared([marked[i] for i in one], [marked[i] for i in two]) >= np.ceil(least / (1 + least) * (n1 + n2) - 1e-9)
    parent = list(range(int(group.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(may)), strict=True):
        i, j = int(one[i]), int(two[j])
        a, b = root(int(group[i])), root(int(group[j]))
        if a != b and similarity(texts[i], texts[j], least) >= least:
            parent[a] = b
            out.append((labels[i], labels[j]))
    return out


def blockwise(now: DataFrame, sequences: DataFrame, least: float, rows: int | None = None) -> DataFrame:
    """Links (a, b) of labels between the members of each bucket. now, a written table of at most so many rows: key, node, n, label."""
    of_label = now.groupBy("key", "label").agg(F.count("*").alias("count"), F.sum("n").alias("volume"))
    about = of_label.groupBy("key").agg(F.max(F.struct("count", "volume", "label")).alias("main"), F.sum("count").alias("count"), F.sum("volume").alias("volume"))
    blocks = lambda count, volume: F.greatest(F.ceil(count / BLOCK), F.ceil(volume / VOLUME), F.lit(1)).cast("int")
    others = blocks(F.col("count") - F.col("main.count"), F.col("volume") - F.col("main.volume"))
    about = about.select("key", F.col("main.label").alias("main"), others.alias("others"), blocks(F.col("main.count"), F.col("main.volume")).alias("mains"))
    about = _few(about, "neardup-blocks", now.count() if rows is None else rows)
    split = _salted(now, about, ["key"], F.xxhash64("node"))
    is_main, draw = F.col("label") == F.col("main"), F.xxhash64("node", "key")
    own = F.when(is_main, F.col("others") + F.pmod(draw, F.col("mains"))).otherwise(F.pmod(draw, F.col("others"))).cast("int")
    last = F.when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    split = split.select("key", "node", "label", own.alias("own"), last.alias("last")).join(sequences, "node")
    met = split.select("key", "label", "words", "own", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "words")

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        texts = [np.frombuffer(x, "<u4") for x in group.column("words").to_pylist()]
        links = block_links(group.column("label").to_pylist(), texts, group.column("own").to_numpy() == i, i == j, least)
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return met.groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def contracted(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for the nodes of edges (a, b) whose label isn't their own."""
    edges = S.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "neardup-edges")
    labels, most = None, edges.count()
    rows = most
    while rows:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = _few(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a"), "neardup-parents", rows)
        moved = True
        while moved:  # of chains of parents, all end at their last node, so that no node of this round is met again in the next
            hop = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parent = _few(parent.join(hop, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "neardup-parents", rows)
            moved = not parent.where("moved").isEmpty()
            parent = parent.select("a", "p")
        up = lambda df, c: df.join(parent.select(F.col("a").alias(c), F.col("p").alias("_p")), c, "left").withColumn(c, F.coalesce("_p", c)).drop("_p")
        nodes = parent.select(F.col("a").alias("node"), F.col("p").alias("label"))
        labels = nodes if labels is None else up(labels, "label").unionByName(nodes)
        labels = _few(labels, "neardup-labels", most)
        edges = up(up(edges, "a"), "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = _few(edges, "neardup-edges", rows)
        rows = edges.count()
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def classes(table: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """node and label for the nodes of a written ``sketches`` table whose class has another node too; label is a node of the class."""
    once = table.where("keys IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    once = _few(once, "neardup-keys", table.count())
    spread, order = once.select("node", "n", F.explode("keys").alias("key")), F.xxhash64("key", "node")
    several = spread.groupBy("key").agg(F.count("*").alias("size"), F.min(order).alias("least")).where("size > 1")
    active = _salted(spread, several, ["key"], F.xxhash64("node")).select("key", "node", "n", F.col("node").alias("label"), "size", (order == F.col("least")).alias("leads"))
    active = _few(active, "neardup-members", BANDS * table.count())
    some = active.select("node").distinct()
    sequences = S.written(table.where("keys IS NOT NULL").select("node", "words").join(some, "node").dropDuplicates(["node"]), "neardup-shingles")
    labels, tested = None, None
    for turn in range(ROUNDS + 1):
        rows = active.count()
        if turn:
            now = members if labels is None else members.join(labels, "node", "left")
            now = now.withColumn("label", F.col("node") if labels is None else F.coalesce("label", "node"))
            about = now.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(order).alias("least"))
            about = _few(about.where("low <> high").select("key", "size", "least"), "neardup-buckets", rows)
            leads = (order == F.col("least")) | (F.col("size") <= SMALL)
            active = _few(_salted(now, about, ["key"], F.xxhash64("node")).select("key", "node", "n", "label", "size", leads.alias("leads")), "neardup-active", rows)
            rows = active.count()
        if not rows:
            break
        if turn == ROUNDS:  # what is left are large buckets
            links = blockwise(active, sequences, least, rows)
        else:
            leaders = active.where("leads").select("key", F.col("node").alias("leader"), F.col("n").alias("m"), F.col("label").alias("other"), F.ceil(F.col("size") / FAN).cast("int").alias("fan"))
            met = _salted(active.select("key", "node", "n", "label"), leaders, ["key"], F.xxhash64("node"))
            fits = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - 1e-9
            first, second = F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")
            pairs = met.where(fits & (F.col("label") != F.col("other"))).groupBy(first, second).agg(F.max(F.struct("fan", "leader", "node")).alias("x")).select("a", "b", "x.*")
            pairs = _few(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "neardup-pairs", rows * (SMALL if turn else 1))
            tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
            links = verified(pairs, sequences, least)
            if labels is not None:
                for c in ("a", "b"):
                    links = links.join(labels.select(F.col("node").alias(c), F.col("label").alias("_l")), c, "left").withColumn(c, F.coalesce("_l", c)).drop("_l")
        new = contracted(links)
        if labels is None:
            labels = new
        else:
            moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("_l")), "label", "left").select("node", F.coalesce("_l", "label").alias("label"))
            labels = _few(moved.unionByName(new.join(labels.select("node"), "node", "left_anti")), "neardup-labels", table.count())
        members = active.where("NOT leads").select("key", "node", "n")
    return labels if labels is not None else table.sparkSession.createDataFrame([], "node binary, label binary")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text): doc_id, raw, class_id (the smallest id of its class), copies (rows of its class) and kept (it alone stands for its class)."""
    table = S.written(sketches(docs), "neardup-sketches")
    labels = classes(table, least)
    rows = table.select("row", F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "raw", "node")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "raw", "row")).alias("first"), F.count("*").alias("copies"))
    nodes = _few(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "neardup-nodes", table.count())
    best = nodes.groupBy("label").agg(F.min("first").alias("best"), F.sum("copies").alias("all"))
    of_node = _salted(nodes.select("node", "label"), best, ["label"], F.xxhash64("node")).select("node", "best", "all")
    joined = _salted(rows, of_node, ["node"], F.xxhash64("row"))
    own = F.when(F.col("doc_id") < LAST, F.col("doc_id"))
    stands = F.col("row") == F.col("best.row")
    return joined.select(own.alias("doc_id"), "raw", F.when(F.col("best.doc_id") < LAST, F.col("best.doc_id")).alias("class_id"), F.col("all").alias("copies"), stands.alias("kept"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class. Rows that repeat id and text are reduced in the tasks that read them before they meet."""
    an_id, raw, times = (S.free_name(docs.columns, x) for x in ("_id", "_raw", "_times"))
    found = near_duplicates(docs, least)
    marks = found.groupBy(F.coalesce("doc_id", F.lit(LAST)).alias(an_id), F.col("raw").alias(raw)).agg(F.count("*").alias(times), F.max("kept").alias("kept"))
    marks = S.written(marks.where("kept").drop("kept"), "neardup-kept")
    keyed = docs.withColumn(an_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(raw, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    once, several = marks.where(F.col(times) == 1).drop(times), marks.where(F.col(times) > 1).drop(times)
    out = keyed.join(once.hint("merge"), [an_id, raw], "left_semi").select(*docs.columns)
    if several.isEmpty():
        return out
    repeated = _salted(keyed, several, [an_id, raw], F.spark_partition_id())  # any of the equal keys' rows will do
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return out.unionByName(repeated.groupBy(an_id, raw).agg(F.first(whole).alias("x")).select("x.*"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(S.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "kept")
