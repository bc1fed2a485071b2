"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams (3 to 6 characters, within a word and its two ends) that it holds, each once, hashed to 2 ** ``BITS`` places. Those are kept that stand in at least two
training texts and in shares of the two classes that differ by ``APART`` standard errors or more; their number isn't bounded otherwise.
Feature f counts as r_f = log((p_f / |p|) / (n_f / |n|)), with p_f and n_f the smoothed numbers of toxic and clean
training texts that hold f; a logistic regression with an L2 penalty is fitted on these scaled features. Its intercept is then moved by the
difference between the classes' log-odds in the sample and in the labels, so that 0.5 divides where label 1 gets likelier.

Fitting uses a sample with documented bounds: at most ``per_class`` ids of label 1 and twice as many of label 0, those with the smallest hashes; of the rows that repeat
an id the one whose text has the smallest digest. Texts are turned into features in parallel, and the regression, in one task, sees at most 2 ** BITS places of each, however long
it is. Scoring covers whole texts of all rows.

Edge cases: null and empty texts have no feature and get the intercept's score. Equal texts get equal scores. Rows of
an empty table give an empty result. With no label of one class every score is the smoothed share of label 1. Labels that are null or
neither 0 nor 1 aren't learned from; of several labels of one id, or of one text, the largest counts. Extra columns pass through ``score_toxicity`` untouched, but for one of the
name that it adds, which it replaces.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.llm import _shared as S

BITS, ORDERS, PER_CLASS, L2 = 20, (3, 4, 5, 6), 1500, 1.0
#: Standard errors by which a feature's shares in the two classes must differ.
APART = 2.0
CHUNK = 250
_M = S.multipliers(max(ORDERS), 8)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of each word (with repeats), one after another, and how many each has."""
    c = S.code_points(" " + " ".join(words) + " ").astype(np.uint64)
    spaces = c == 32
    before = np.concatenate([[0], np.cumsum(spaces)])
    feats, owner = [], []
    for n in ORDERS:
        size = len(c) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        for j in range(n):
            h += (c[j : j + size] + np.uint64(1)) * _M[j]
        ok = np.flatnonzero(before[n - 1 : n - 1 + size] == before[1 : size + 1])
        feats.append((S.mix(h[ok]) >> np.uint64(64 - BITS)).astype(np.int32))
        owner.append((before[ok + 1] - 1).astype(np.int64))
    if not feats:
        return np.empty(0, np.int32), np.zeros(len(words), np.int64)
    feats, owner = np.concatenate(feats), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return feats[order], np.bincount(owner, minlength=len(words))


def _features(texts: list[str | None], place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features of all texts, each pair once; with place, only features whose place isn't negative, as places."""
    vocab: dict[str, int] = {}
    row, word = [], []
    for i, text in enumerate(texts):
        own = set(S.LETTERS.findall(text.lower())) if text else ()
        row.append(np.full(len(own), i, np.int64))
        word.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in own), np.int64, len(own)))
    if not vocab:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row, word = np.concatenate(row), np.concatenate(word)
    feats, count = _grams(list(vocab))
    if place is not None:
        at = place[feats]
        owner = np.repeat(np.arange(len(count)), count)[at >= 0]
        feats, count = at[at >= 0], np.bincount(owner, minlength=len(count))
    first = np.cumsum(count) - count
    n = count[word]
    key = np.unique((np.repeat(row, n) << BITS) | feats[S.spread(first[word], n)])
    return key >> BITS, key & ((1 << BITS) - 1)


def _minimise(f, x: np.ndarray, steps: int = 150, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f gives the value and the gradient."""
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    value, g = f(x)
    for _ in range(steps):
        d, back = g.copy(), []
        for s, y, rho in reversed(pairs):
            back.append(a := rho * (s @ d))
            d -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            d *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(back), strict=True):
            d += (a - rho * (y @ d)) * s
        slope, step = -(g @ d), 1.0 if pairs else 1 / max(1.0, np.abs(g).sum())
        if slope > -1e-9:
            break
        while True:
            new_value, new_g = f(x - step * d)
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = -step * d, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        x, value, g = x + s, new_value, new_g
        if done:
            break
    return x


def fit(features: list[np.ndarray], labels: list[int], share: float, l2: float = L2) -> dict:
    """features: of each text, all different; share: of label 1 among all labels."""
    y = np.array(labels, np.float64)
    share = min(max(share, 1e-6), 1 - 1e-6)
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return {"ids": np.empty(0, np.int32), "w": np.empty(0, np.float32), "b": float(np.log(share / (1 - share))), "key": uuid.uuid4().hex}
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(f) for f in features])
    at = np.concatenate(features)
    toxic = y[row] == 1
    pos, neg = np.bincount(at[toxic], minlength=1 << BITS), np.bincount(at[~toxic], minlength=1 << BITS)
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((pos + 1) / (n1 + 2)) - np.log((neg + 1) / (n0 + 2))
    share_of = (pos + neg) / len(y)
    apart = np.abs(pos / n1 - neg / n0) / np.sqrt(np.maximum(share_of * (1 - share_of) * (1 / n1 + 1 / n0), 1e-12))
    ids = np.flatnonzero((pos + neg > 1) & (apart >= APART))
    place = _place({"ids": ids})[at]
    row, at = row[place >= 0], place[place >= 0].astype(np.int32)
    order = np.argsort(at, kind="stable")
    columns = np.searchsorted(at[order], np.arange(len(ids)))  # where each feature's texts begin
    of_column, scale = row[order], ratio[ids]
    starts = np.searchsorted(row, np.arange(len(y) + 1))
    some = starts[1:] > starts[:-1]

    def loss(w):
        z = np.full(len(y), w[-1])
        if some.any():
            z[some] += np.add.reduceat((scale * w[:-1])[at], starts[:-1][some])
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        g = p - y
        value = np.logaddexp(0, z).sum() - y @ z + l2 / 2 * (w[:-1] @ w[:-1])
        by_feature = scale * np.add.reduceat(g[of_column], columns) if len(ids) else np.empty(0)
        return value, np.append(by_feature + l2 * w[:-1], g.sum())

    w = _minimise(loss, np.zeros(len(ids) + 1))
    return {"ids": ids.astype(np.int32), "w": (w[:-1] * scale).astype(np.float32), "b": float(w[-1] + np.log(share / (1 - share)) - np.log(n1 / n0)), "key": uuid.uuid4().hex}


def scores(model: dict, texts: list[str | None], place: np.ndarray | None = None) -> np.ndarray:
    row, at = _features(texts, _place(model) if place is None else place)
    z = np.bincount(row, model["w"][at] if len(at) else None, len(texts)) + model["b"]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _place(model: dict) -> np.ndarray:
    place = np.full(1 << BITS, -1, np.int64)
    place[model["ids"]] = np.arange(len(model["ids"]))
    return place


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """docs: doc_id, text; labels: doc_id, toxic, only those that may be learned from."""
    labels = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    nearest = lambda k, n: labels.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = nearest(1, per_class).unionByName(nearest(0, 2 * per_class)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = counts.get(1, 0) / max(1, sum(counts.values()))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in S.slices(b, 1):
                row, feature = _features(part.column(1).to_pylist())
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                own = S.rows_of(feature.astype("<i4"), ends)
                digest = [hashlib.md5(t or b"").digest() for t in part.column(1).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), own, part.column(2)], names=["doc_id", "digest", "features", "toxic"])

    # The joins' one side has at most 3 * per_class ids and so has what comes out, which one task can hold.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string"), "text", "toxic")
    described = sample.mapInArrow(describe, "doc_id string, digest binary, features binary, toxic int")
    one = described.groupBy("doc_id").agg(F.min(F.struct("digest", "features", "toxic")).alias("x"))
    one = one.groupBy(F.col("x.digest").alias("digest")).agg(F.first("x.features").alias("features"), F.max("x.toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, np.frombuffer(f, "<i4"), y) for b in batches for d, f, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit([f for _, f, _ in rows], [y for _, _, y in rows], share))]})

    rows = one.select("digest", "features", "toxic").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else fit([], [], share)


def score_toxicity(docs: DataFrame, model: dict, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1 in the column ``out``; a column of this name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS weights
    names, kept = docs.columns, [i for i, c in enumerate(docs.columns) if c.lower() != out.lower()]
    at, key = names.index(text), model["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = S.held(("toxicity", key), lambda: _place(held.value))
        for b in batches:
            for part in S.slices(b, at, rows=CHUNK):
                found = pa.array(scores(held.value, part.column(at).to_pylist(), place))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), found], names=[*(names[i] for i in kept), out])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[i] for i in kept), T.StructField(out, T.DoubleType())]))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(S.remainder(F.col("doc_id"), 5) != 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learnable(S.table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model, out="score").select("doc_id", (S.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
