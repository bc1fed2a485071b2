"""Exact top-k search by inner product over KD-trees, one for each shard.

Shards are dealt by space: a bounded sample of vectors is split at medians of the coordinate with the widest extent until there are enough parts, and every vector goes to the part
that it falls into; where one part is enough nothing is dealt or routed. A shard's bounding box is taken from all its vectors. A query first goes to the shard whose box allows it the highest score; the kth score found there goes
with it to those other shards whose boxes allow as much, and to no others. Where many queries come to a shard they are cut into groups of about ``BLOCK_ROWS``, and each group meets the
shard in a task of its own.

A shard's tree splits at the median of the coordinate with the widest extent
and keeps for each node a tight bounding box and its smallest id. A query goes through nodes best first: by the largest inner product
that a node's box allows, the sum over coordinates of the larger of q * low and q * high. It stops at the first node whose
bound is below its kth score. What remains is that vectors without clusters in many dimensions have boxes that rule out little: then each query meets most shards.

Scores are integers: products and sums below 2**53 are exact in floating point; beyond, scores are summed in 64-bit integers, beyond these in Python's, and bounds are widened by
their rounding error. A score that doesn't fit into 64 bits raises.
Of equal vectors, only those with the k + 1 smallest ids can be among a query's k best, since ties go to smaller ids, and of rows that repeat an id and a vector only k; the shards hold these.

Edge cases: a vector that is null or empty or holds a null or a non-finite component takes no part. A query meets vectors of its own length. Rows with a query's
id are its own and aren't candidates; repeated query rows count once. Fewer than k candidates are all returned. An empty table gives an empty result.
Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelab.llm import _shared as S

SHARD_ROWS, BLOCK_ROWS, LEAF, EXACT = 16_384, 8192, 256, 2**53
#: Vectors of each length, at most, that the splits are made from; shards of each length, at most, so that boxes have a bound: 16 bytes a component and shard.
SAMPLE, SHARDS = 20_000, 16_384
FOUND = "query_id long, query_code long, vec_id long, score long"


def box_bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The largest inner product that each box allows each query, or a little more where floating point rounds it."""
    low, high, queries = (x.astype(np.float64) for x in (low, high, queries))
    out = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    most = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
    return np.where(most < EXACT, out, out + most * queries.shape[1] * 2.0**-50)


class Splits:
    """Median splits of a sample into parts; a part's number for any vector."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, and for what is below it and the rest a node, or -1 - part
        self.parts = 0
        self.root = self._split(sample, parts)

    def _split(self, own: np.ndarray, parts: int) -> int:
        if parts > 1 and len(own):
            axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
            column = own[:, axis]
            cut = float(np.median(column))
            if not (column < cut).any():
                above = column[column > cut]
                cut = float(above.min()) if len(above) else cut
            left = column < cut
            if left.any() and not left.all():
                at = len(self.nodes)
                self.nodes.append((axis, cut, 0, 0))
                below = self._split(own[left], parts // 2)
                rest = self._split(own[~left], parts - parts // 2)
                self.nodes[at] = (axis, cut, below, rest)
                return at
        self.parts += 1
        return -self.parts

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        stack = [(self.root, np.arange(len(vectors)))]
        while stack:
            node, of = stack.pop()
            if node < 0:
                out[of] = -1 - node
                continue
            axis, cut, below, rest = self.nodes[node]
            left = vectors[of, axis] < cut
            stack += [(below, of[left]), (rest, of[~left])]
        return out


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        nodes: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            me = len(nodes)
            nodes.append((a, b))
            self.children.append(None)
            if parent >= 0:
                left, right = self.children[parent] or (0, 0)
                self.children[parent] = (me, right) if side == 0 else (left, me)
            own = order[a:b]
            if b - a <= leaf:
                continue
            part = vectors[own]
            axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
            middle = (b - a) // 2
            order[a:b] = own[np.argpartition(part[:, axis], middle)]
            stack += [(a + middle, b, me, 1), (a, a + middle, me, 0)]
        self.ids, self.vectors, self.nodes = ids[order], vectors[order], nodes
        self.low = np.array([self.vectors[a:b].min(axis=0) for a, b in nodes])
        self.high = np.array([self.vectors[a:b].max(axis=0) for a, b in nodes])
        self.least = [int(self.ids[a:b].min()) for a, b in nodes]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return box_bounds(self.low, self.high, queries)

    def search(self, own: int, query: np.ndarray, bound: list, k: int, floor: float, visited: list[int] | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best, best first; floor: a score that k others are known to reach."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            full = len(best) == k
            if -b < floor or full and -b < best[0][0]:
                break
            if full and -b == best[0][0] and self.least[node] > -best[0][1]:
                continue
            if pair := self.children[node]:
                for child in pair:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            if visited is not None:
                visited.append(node)
            start, end = self.nodes[node]
            scores = self.vectors[start:end] @ query
            at = np.flatnonzero(scores >= (max(floor, best[0][0]) if full else floor))
            if len(at) > 4 * k:  # the k + 1 best of a leaf, own row included, by score and then id
                at = at[np.lexsort((self.ids[start + at], -scores[at]))]
                same = int((self.ids[start + at] == own).sum())
                at = at[: k + same]
            for i in at.tolist():
                if (vec := int(self.ids[start + i])) == own:
                    continue
                found = (int(scores[i]), -vec)
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(table: pa.Table, name: str, dim: int) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return (column.flatten() if len(column) else pa.array([], pa.int64())).to_numpy(zero_copy_only=False).reshape(-1, dim)


def smallest_of_equals(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows whose ids are among the k + 1 smallest of their vector's."""
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, same = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, same))
    group, by = same[order], ids[order]
    new_group = np.append(True, group[1:] != group[:-1])
    new_id = new_group | np.append(True, by[1:] != by[:-1])
    rank = np.cumsum(new_id)
    rank -= np.repeat(rank[new_group], np.diff(np.append(np.flatnonzero(new_group), len(order))))
    return np.sort(order[rank <= k])


def search_group(vectors: pa.Table, queries: pa.Table, k: int, dim: int) -> pa.Table:
    out: list[tuple] = []
    if vectors.num_rows and queries.num_rows:
        ids, v, q = vectors.column("vec_id").to_numpy(), _matrix(vectors, "code", dim), _matrix(queries, "asked", dim)
        most = float(np.abs(v.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).max()) * dim
        kind = np.float64 if most < EXACT else np.int64 if most < 2**62 else object
        keep = smallest_of_equals(ids, v, k)
        tree = Tree(ids[keep], v[keep].astype(kind))
        q, floors = q.astype(kind), [-math.inf if f is None else f for f in queries.column("floor").to_pylist()]
        names = [queries.column(c).to_pylist() for c in ("query_id", "query_code")]
        for at in range(0, len(q), 256):  # bounds of so many queries at a time
            for i, b in enumerate(tree.bounds(q[at : at + 256]).tolist(), at):
                out += [(names[0][i], names[1][i], vec, score) for score, vec in tree.search(names[0][i], q[i], b, k, floors[i])]
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_code", "vec_id", "score"])


def coded(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and code, floor(scale * x) of each component; without vectors that take no part."""
    ok = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND abs(cast(x AS double)) < double('infinity')) AND vec_id IS NOT NULL"
    code = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return df.where(ok).select(F.col("vec_id").cast("long"), code.alias("code"), F.size("embedding").alias("dim"))


def _best(df: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id", "query_code").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, int, np.ndarray]]:
    """The rows of each length in a batch, with the length and the vectors as a matrix."""
    for b in batches:
        table = pa.Table.from_batches([b])
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = table.filter(pa.array(dims == dim))
            yield own, dim, _matrix(own, column, dim)


def lengths(vectors: DataFrame) -> dict[int, int]:
    """How many vectors have each length."""
    return {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}  # a row for each length


def dealt(vectors: DataFrame, shard_rows: int, counts: dict[int, int] | None = None) -> DataFrame:
    """vectors (vec_id, code, dim) with their shard, in a written table."""
    counts = lengths(vectors) if counts is None else counts
    share = F.coalesce(*(F.when(F.col("dim") == d, F.lit(min(1.0, SAMPLE / n))) for d, n in counts.items()), F.lit(1.0))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 20)) < share * (1 << 20)).select("dim", "code").collect()  # about SAMPLE of each length
    splits = {d: Splits(np.array([r["code"] for r in drawn if r["dim"] == d], np.float64).reshape(-1, d), min(SHARDS, max(1, math.ceil(n / shard_rows)))) for d, n in counts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, dim, v in by_length(batches, "code"):
            yield from own.append_column("shard", pa.array(splits[dim](v).astype(np.int32))).to_batches()

    return S.written(vectors.mapInArrow(run, "vec_id long, code array<long>, dim int, shard int"), "topk-dealt")


def boxes(shards: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the shards that hold vectors and their tight boxes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for own, dim, v in by_length(batches, "code"):
            shard = own.column("shard").to_numpy()
            for x in np.unique(shard).tolist():
                mine = v[shard == x]
                low, high = found.get((dim, x), (mine[0], mine[0]))
                found[dim, x] = [np.minimum(low, mine.min(axis=0)), np.maximum(high, mine.max(axis=0))]
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d for d, _ in found], pa.int32()), "shard": pa.array([x for _, x in found], pa.int32()), "low": pa.array([a.tolist() for a, _ in found.values()], pa.list_(pa.int64())), "high": pa.array([b.tolist() for _, b in found.values()], pa.list_(pa.int64()))})

    def whole(key: tuple, own: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        low, high = _matrix(own, "low", dim).min(axis=0), _matrix(own, "high", dim).max(axis=0)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": key[1:2], "low": pa.array([low.tolist()], pa.list_(pa.int64())), "high": pa.array([high.tolist()], pa.list_(pa.int64()))})

    schema = "dim int, shard int, low array<long>, high array<long>"
    rows = shards.mapInArrow(part, schema).groupBy("dim", "shard").applyInArrow(whole, schema).collect()  # at most SHARDS rows of a length
    return {d: tuple(np.array([r[c] for r in rows if r["dim"] == d]) for c in ("shard", "low", "high")) for d in {r["dim"] for r in rows}}


def routed(queries: DataFrame, held, home: bool) -> DataFrame:
    """queries with ``shard``: the one whose box allows the highest score, or (with ``home`` and ``floor``) each other one whose box allows the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, dim, q in by_length(batches, "asked"):
            if dim not in held.value:
                continue
            shard, low, high = held.value[dim]
            step = max(1, 4_000_000 // len(shard))
            for at in range(0, len(q), step):
                bound = box_bounds(low, high, q[at : at + step])
                if home:
                    row, of = np.arange(len(bound)), bound.argmax(axis=1)
                else:
                    floor = np.array([-math.inf if f is None else f for f in own.column("floor").slice(at, step).to_pylist()])
                    row, of = np.nonzero((bound >= floor[:, None]) & (shard[None, :] != own.column("home").to_numpy()[at : at + step, None]))
                for i in range(0, len(row), 20_000):
                    yield from own.take(pa.array(at + row[i : i + 20_000])).append_column("shard", pa.array(shard[of[i : i + 20_000]].astype(np.int32))).to_batches()

    kept = ["query_id", "query_code", "asked", "dim", *([] if home else ["home", "floor"])]
    return queries.select(*kept).mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.select(*kept).schema) + ", shard int")


def searched(shards: DataFrame, asked: DataFrame, k: int, block_rows: int) -> DataFrame:
    """asked: routed queries with ``floor``, read twice. What each query finds in its shards."""
    groups = asked.groupBy("dim", "shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("groups"))  # a row for each shard, at most SHARDS of a length
    groups = S.written(groups, "topk-groups")
    one, two = (F.broadcast(groups.select("dim", "shard", F.col("groups").alias(x))) for x in ("_of_vectors", "_of_queries"))
    left = shards.join(one, ["dim", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_of_vectors") - 1)))
    left = left.select("dim", "shard", "part", "vec_id", "code").groupBy("dim", "shard", "part")
    right = asked.join(two, ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("query_id", "query_code"), F.col("_of_queries")).cast("int"))
    right = right.select("dim", "shard", "part", "query_id", "query_code", "asked", "floor").groupBy("dim", "shard", "part")
    return left.cogroup(right).applyInArrow(lambda key, a, b: search_group(a, b, k, key[0].as_py()), FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors: vec_id, code, dim. For each that is a query: query_id, rank, vec_id, score."""
    queries = vectors.where(is_query).dropDuplicates(["vec_id", "code"]).select(F.col("vec_id").alias("query_id"), F.col("code").alias("asked"), F.size("code").alias("dim"), F.xxhash64("code").alias("query_code"))
    same_row, same = Window.partitionBy("code", "vec_id").orderBy("dim"), Window.partitionBy("code").orderBy("vec_id")
    few = vectors.withColumn("_n", F.row_number().over(same_row)).where(F.col("_n") <= k).withColumn("_n", F.dense_rank().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    few = S.written(few, "topk-few")
    counts = lengths(few)
    if max(counts.values(), default=0) <= shard_rows:  # one shard of each length: nothing to route
        asked = queries.select("query_id", "query_code", "asked", "dim", F.lit(0).alias("shard"), F.lit(None).cast("long").alias("floor"))
        return _best(searched(few.withColumn("shard", F.lit(0)), asked, k, block_rows), k).select("query_id", "rank", "vec_id", "score")
    shards = dealt(few, shard_rows, counts)
    held = vectors.sparkSession.sparkContext.broadcast(boxes(shards))
    first = S.written(routed(queries, held, True).withColumn("floor", F.lit(None).cast("long")), "topk-home")
    found = S.written(searched(shards, first, k, block_rows), "topk-first")
    kth = found.groupBy("query_id", "query_code").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    others = first.drop("floor").withColumnRenamed("shard", "home").join(kth, ["query_id", "query_code"], "left")
    rest = S.written(routed(others, held, False), "topk-rest")
    return _best(found.unionByName(searched(shards, rest, k, block_rows)), k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(coded(S.table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS code FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.code, c.code)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
