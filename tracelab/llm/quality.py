"""Quality of documents by attention-based multiple-instance learning: a document is a bag of passages, and only whole documents have labels.

A text is cut at white space into passages of about ``SIZE`` characters. A passage is described by how often it holds each kind of character, pair and triple of kinds (lower and
upper case, digits, blanks, line ends, each ASCII mark, anything else), hashed to ``PLACES`` places, as square roots of shares, and by ratios of its words: how many repeat the word
before, how many stood before in the passage, how long they are. It is encoded as h = tanh(W x + b). Gated attention gives it the weight a = softmax over the document's passages of
w . (tanh(V h) * sigmoid(U h)), and the document's score is sigmoid(c . (sum of a h) + d). All of it is learned together by gradient descent (Adam) from the documents' labels; the
intercept d is then moved by the difference between the classes' log-odds in the sample and in the labels.

Fitting uses a sample with documented bounds: at most ``per_class`` ids of label 0 and twice as many of label 1, those with the smallest hashes, of equal texts one, and of each text at most
``FIT_PASSAGES`` passages, spread evenly over the whole of it; it is one task, of at most 3 * per_class * FIT_PASSAGES descriptions of 2 bytes a place. Scoring covers all passages of whole
texts of all rows; of a text only the passages' encodings are held together.

Edge cases: null and empty texts are one passage without characters. Equal texts get equal scores. Rows of an empty table give an empty result. Without labels of both classes every
score is the smoothed share of label 1. Labels that are null or neither 0 nor 1 aren't learned from; of several labels of one id, or of one text, the largest counts. Extra
columns pass through ``score_quality`` untouched, but for one of the name that it adds, which it replaces.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelab.llm import _shared as S
from tracelab.llm.lexical import terms_of

SIZE, BITS, PER_CLASS, FIT_PASSAGES, TOGETHER = 600, 10, 1500, 16, 2048
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 32, 16, 12, 64, 3e-3, 1e-4
PLACES, RATIOS = 1 << BITS, 5
WIDTH = PLACES + RATIOS
_BYTES = np.arange(256)
#: The kind of each byte: of letters the case, of marks each its own; the bytes that go on a character are left out beforehand.
_KIND = np.where((_BYTES >= 97) & (_BYTES <= 122), 1, np.where((_BYTES >= 65) & (_BYTES <= 90), 2, np.where((_BYTES >= 48) & (_BYTES <= 57), 3, np.where(_BYTES >= 128, 4, np.where(_BYTES == 10, 5, np.where((_BYTES <= 32) | (_BYTES == 127), 6, _BYTES - 26)))))).astype(np.int64)
_BLANK = (_BYTES <= 32) | (_BYTES == 127)


def passages(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The passages of some texts, and the text of each."""
    data, offsets = S.bytes_of(column)
    length = np.diff(offsets)
    aims = np.maximum((length + SIZE // 2) // SIZE - 1, 0)  # after every SIZE bytes; the last passage has half as many at least
    text = np.repeat(np.arange(len(length)), aims)
    aim = (S.spread(np.zeros(len(length), np.int64), aims) + 1) * SIZE + offsets[text]
    blanks = np.append(np.flatnonzero(_BLANK[data]), len(data))
    cut = blanks[np.searchsorted(blanks, aim)]
    inside = cut < offsets[text + 1]
    text, cut = np.append(np.arange(len(length)), text[inside]), np.append(offsets[:-1], cut[inside])
    order = np.lexsort((cut, text))
    text, cut = text[order], cut[order]
    new = np.append(True, (text[1:] != text[:-1]) | (cut[1:] != cut[:-1]))[: len(text)]
    text, cut = text[new], cut[new]
    ends = np.append(cut, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]), text


def _ratios(own: pa.Array) -> np.ndarray:
    """RATIOS numbers of each passage, from its words."""
    terms, which, before = terms_of(own)
    n, of = len(own), np.repeat(np.arange(len(own)), np.diff(before))
    size = np.fromiter(map(len, terms), np.int64, len(terms))[which]
    same = np.append(False, (which[1:] == which[:-1]) & (of[1:] == of[:-1]))[: len(which)]
    _, first = np.unique(of * (len(terms) + 1) + which, return_index=True)
    seen = np.ones(len(which), bool)
    seen[first] = False
    count = np.maximum(np.bincount(of, minlength=n), 1)
    return np.column_stack([np.bincount(of, x.astype(np.float64), n) / count for x in (same, seen, np.minimum(size, 40) / 10, size > 12, size < 3)]).astype(np.float32)


def described(own: pa.Array) -> np.ndarray:
    """The descriptions of some passages."""
    data, offsets = S.bytes_of(own)
    n, first = len(own), (data & 0xC0) != 0x80
    of = np.repeat(np.arange(n), np.diff(offsets))[first]
    kind = _KIND[data[first]]
    total, key = np.zeros(n * PLACES, np.float32), np.zeros(len(kind), np.int64)
    for order in range(3):  # runs of one, two and three kinds that end at a character
        key = np.append(0, key[:-1])[: len(kind)] * 61 + kind
        whole = np.arange(len(kind)) >= order
        whole[order:] &= of[order:] == of[: len(of) - order]
        mixed = ((key[whole] + (order << 20)) * 0x2545F4914F6CDD1D) >> 40
        total += np.bincount(of[whole] * PLACES + (mixed & (PLACES - 1)), minlength=n * PLACES).astype(np.float32)
    size = np.maximum(np.bincount(of, minlength=n), 1).astype(np.float32)
    return np.hstack([np.sqrt(total.reshape(n, PLACES) / size[:, None]), _ratios(own)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """The encoder, the gated attention and the classifier; x: descriptions of passages, h: encodings, starts: where each document's passages begin."""

    def __init__(self, constant: float = 0.0):
        self.p: dict[str, np.ndarray] = {}
        self.constant = constant

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) * self.scale, -6, 6) @ self.p["W"] + self.p["b"])

    def forward(self, h: np.ndarray, starts: np.ndarray) -> dict:
        v, u = np.tanh(h @ self.p["V"]), _sigmoid(h @ self.p["U"])
        e = (v * u) @ self.p["w"]
        sizes = np.diff(np.append(starts, len(h)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"v": v, "u": u, "a": a, "z": z, "sizes": sizes, "score": _sigmoid(z @ self.p["c"] + self.p["d"])}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; x is standardised."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        f = self.forward(h, starts)
        each = lambda of: np.repeat(of, f["sizes"], axis=0)
        g = (f["score"] - y) / len(y)
        dz = g[:, None] * p["c"]
        along = (each(dz) * h).sum(axis=1)  # what a weight adds to the loss
        de = f["a"] * (along - each(np.add.reduceat(f["a"] * along, starts)))
        dv = de[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2)
        du = de[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * each(dz) + dv @ p["V"].T + du @ p["U"].T
        ds = dh * (1 - h**2)
        return {"W": x.T @ ds, "b": ds.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ g, "d": np.array([g.sum()])}


def fit(bags: list[np.ndarray], labels: list[int], share: float) -> Model:
    """bags: each document's descriptions; share: of label 1 among all labels."""
    y = np.array(labels, np.float64)
    share = min(max(share, 1e-6), 1 - 1e-6)
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return Model(share)
    model, rng = Model(), np.random.default_rng(11)
    n = sum(len(b) for b in bags)
    mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / n
    square = sum((b.astype(np.float64) ** 2).sum(axis=0) for b in bags) / n
    model.mean = mean.astype(np.float32)
    model.scale = (1 / np.sqrt(np.maximum(square - mean**2, 0) + 1e-4)).astype(np.float32)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    odds = np.log(y.mean() / (1 - y.mean()))
    model.p = {"W": draw(WIDTH, HIDDEN) * 0.5, "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.array([odds], np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step, steps = 0, EPOCHS * (-(-len(bags) // BATCH))
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), BATCH):
            some = order[at : at + BATCH]
            own = [bags[i] for i in some]
            x = np.clip((np.concatenate(own).astype(np.float32) - model.mean) * model.scale, -6, 6)
            starts = np.cumsum([0, *(len(b) for b in own[:-1])])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in model.gradients(x, starts, y[some]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model.p[k] = (model.p[k] - rate * (move + DECAY * model.p[k])).astype(np.float32)
    model.p["d"] = model.p["d"] + np.float32(np.log(share / (1 - share)) - odds)
    return model


def spread_evenly(n: int, most: int) -> np.ndarray:
    return np.arange(n) if n <= most else np.linspace(0, n - 1, most).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality, only those that may be learned from."""
    labels = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    nearest = lambda k, n: labels.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = nearest(0, per_class).unionByName(nearest(1, 2 * per_class)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = counts.get(1, 0) / max(1, sum(counts.values()))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in S.slices(b, 1, 1 << 20):
                each, text = passages(part.column(1))
                ends = np.searchsorted(text, np.arange(part.num_rows + 1))
                own = [described(each.take(pa.array(a + spread_evenly(e - a, FIT_PASSAGES)))).astype(np.float16).tobytes() for a, e in zip(ends[:-1], ends[1:], strict=True)]
                digest = [hashlib.md5(t or b"").digest() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(own, pa.binary()), part.column(2)], names=["doc_id", "digest", "bag", "quality"])

    # The join's one side has at most 3 * per_class ids and so has what comes out, which one task can hold.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string"), "text", "quality")
    rows = sample.mapInArrow(describe, "doc_id string, digest binary, bag binary, quality int")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("digest", "bag", "quality")).alias("x"))
    one = one.groupBy(F.col("x.digest").alias("digest")).agg(F.first("x.bag").alias("bag"), F.max("x.quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((d, x, y) for b in batches for d, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        bags = [np.frombuffer(x, np.float16).reshape(-1, WIDTH) for _, x, _ in own]
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(bags, [y for _, _, y in own], share))]})

    rows = one.select("digest", "bag", "quality").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else fit([], [], share)


def scores(model: Model, column: pa.Array) -> np.ndarray:
    own, text = passages(column)
    starts = np.searchsorted(text, np.arange(len(column)))
    if not model.p:
        return np.full(len(column), model.constant)
    h = [model.encode(described(own.slice(at, TOGETHER))) for at in range(0, len(own), TOGETHER)]
    return model.forward(np.concatenate(h), starts)["score"] if h else np.empty(0)


def score_quality(docs: DataFrame, model: Model, text: str = "text", out: str = "quality") -> DataFrame:
    """docs with a score from 0 to 1 in the column ``out``; a column of this name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH * HIDDEN weights
    names, kept = docs.columns, [i for i, c in enumerate(docs.columns) if c.lower() != out.lower()]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in S.slices(b, at, 1 << 20):
                found = pa.array(scores(held.value, part.column(at)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), found], names=[*(names[i] for i in kept), out])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[i] for i in kept), T.StructField(out, T.DoubleType())]))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(S.remainder(F.col("doc_id"), 4) != 2)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learnable(S.table(spark, sf_dir, "labels")))
    return score_quality(docs, model, out="score").select("doc_id", (S.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
