import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracelab.llm import _shared as S
from tracelab.llm import language as L
from tracelab.llm import toxicity as X

D = "/root/testdata/sf0.01"


class Plain:
    """Interpolated Kneser-Ney from raw counts, by dictionaries and recursion."""

    def __init__(self, words):
        self.count = [Counter() for _ in range(L.ORDER + 1)]
        longer = [set() for _ in range(L.ORDER + 1)]
        for w, times in words.items():
            text = f" {w} "
            for i in range(1, len(text)):
                for n in range(1, min(i + 1, L.ORDER) + 1):
                    gram = text[i + 1 - n : i + 1]
                    if n in (i + 1, L.ORDER):
                        self.count[n][gram] += times
                    else:
                        longer[n].add(text[i - n : i + 1])
        for n, own in enumerate(longer):
            self.count[n].update(g[1:] for g in own)
        self.chars = len(set("".join(words)) | {" "}) + 1
        self.discount = [0.5] * (L.ORDER + 1)
        for n, own in enumerate(self.count):
            ones, twos = (sum(c == k for c in own.values()) for k in (1, 2))
            if ones and twos:
                self.discount[n] = ones / (ones + 2 * twos)

    def p(self, gram):
        n = len(gram)
        lower = self.p(gram[1:]) if n > 1 else 1 / self.chars
        after = {g: c for g, c in self.count[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return lower
        total = sum(after.values())
        return max(after.get(gram, 0) - self.discount[n], 0) / total + self.discount[n] * len(after) / total * lower

    def word(self, w):
        text = f" {w} "
        return sum(math.log(self.p(text[max(0, i + 1 - L.ORDER) : i + 1])) for i in range(1, len(text)))


def test_kneser_ney_equals_plain_counts():
    kinds = [Counter({"banana": 5, "bandana": 2, "cab": 1, "ananas": 3, "a": 7}), Counter({"quick": 3, "fox": 2, "jumps": 1, "banal": 2}), Counter({"x": 1})]
    plain = [Plain(c) for c in kinds]
    words = ["banana", "bandit", "cab", "quick", "banal", "zzz", "a", "x", "bananabananas", "ébana"]
    want = np.array([[p.word(w) for p in plain] for w in words])
    for together in (1, 2, 4):
        models = [L.fit_model(c) for c in kinds]
        merged = [L.merged(models[i : i + together]) for i in range(0, 3, together)]
        assert np.allclose(L.word_scores(merged, words), want, atol=1e-4)
    for p in plain:  # all continuations of a context, over the alphabet and one unknown letter
        for context in (" ", "ban", "anan", "zz"):
            assert abs(sum(p.p(context + c) for c in [*set("".join(p.count[1])), "~"]) - 1) < 1e-9


def test_language_limits_follow_length(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = L.fit(L.learnable(docs))
    limits = model["limits"]
    assert (np.diff(limits, axis=1) < 0.35).all() and (limits[:, -1] < limits[:, 1]).all()
    held = docs.where(S.remainder(docs.doc_id, 4) == 2)
    kept = [r.accepted for r in L.identify(held.where("text IS NOT NULL"), model).collect()]
    assert np.mean(kept) >= 0.995
    random.seed(3)
    foreign = "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita suomen kieli on kaunis ja vanha kansan puhuma metsä".split()
    noise = ["".join(random.choices("bcdfghjklmnpqrstvwxz", k=random.randint(3, 9))) for _ in range(60)]
    for words, least in ((foreign, 60), (noise, 30)):
        rows = [(n * 100 + k, " ".join(random.choices(words, k=n // 6))) for n in (least, 240, 1000) for k in range(20)]
        got = L.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
        rejected = {n: 1 - np.mean([r.accepted for r in got if r.doc_id // 100 == n]) for n in (least, 240, 1000)}
        assert rejected[1000] == 1 and rejected[240] >= 0.95, rejected


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in L.op2_language(spark, D).collect()}
    truth = spark.read.parquet(f"{D}/documents.parquet").collect()
    assert len(got) == len(truth)
    held = [r for r in truth if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held) and sum(g.held_out for g in got.values()) == len(held)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    assert np.mean([g.accepted for g in got.values()]) > 0.98 and all(0 <= g.score <= 1 for g in got.values())


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(i, t * 20 + str(i), lang) for i in range(40) for lang, t in (("aa", "the cat sat "), ("bb", "der hund lief "))], "doc_id long, text string, lang string")
    model = L.fit(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !!", "x"), (4, "the cat " * 3000, "x"), (4, "the cat " * 3000, "x"), (None, "der hund", None)], "doc_id long, text string, score2 string")
    got = [(r.lang_pred, r.accepted) for r in L.identify(odd, model).collect()]
    assert got[:3] == [("und", False)] * 3 and got[3] == got[4] == ("aa", True) and got[5][0] == "bb"
    assert L.identify(odd.limit(0), model).count() == 0
    none = L.fit(docs.where("false"))
    assert {r.lang_pred for r in L.identify(odd, none).collect()} == {"und"}
    clashing = L.identify(odd.withColumnsRenamed({"score2": "Score"}).withColumn("accepted", F.lit("y")), model)
    assert clashing.columns == ["doc_id", "text", "lang_pred", "score", "accepted"] and clashing.where("accepted").count() == 3
    strange = L.identify(spark.createDataFrame([(1, "qxz vkj " * 50)], "doc_id long, text string"), model).first()
    assert not strange.accepted


def test_toxicity_of_held_out_documents(spark):
    got = {r.doc_id: r for r in X.op8_toxicity(spark, D).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    held = [(got[i].score, y, got[i].predicted) for i, y in labels.items() if got[i].held_out]
    pos, neg = ([s for s, y, _ in held if y == k] for k in (1, 0))
    assert np.mean([p > n for p in pos for n in neg]) > 0.95
    assert np.mean([y == p for _, y, p in held]) > 0.9
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, g in got.items())


def test_toxicity_equals_a_dense_fit():
    """Ratios and weights against a plain implementation: sets of n-grams, dense matrix, Newton's method."""
    random.seed(5)
    words = ["mild", "calm", "vile", "awful", "tree", "stone", "river"]
    texts = [" ".join(random.choices(words, weights=[3, 3, 4 * (i % 3 == 0) + 0.2, 2 * (i % 3 == 0) + 0.2, 3, 3, 3], k=random.randint(0, 9))) for i in range(60)]
    y = np.array([int(i % 3 == 0) for i in range(60)], float)
    grams = [{f" {w} "[a : a + n] for w in t.split() for n in X.ORDERS for a in range(len(w) + 3 - n)} for t in texts]
    stands = Counter(g for own in grams for g in own)
    kinds = sorted(g for g, n in stands.items() if n > 1)
    x = np.array([[g in own for g in kinds] for own in grams], float)
    share, size = x.mean(axis=0), (y.sum(), (1 - y).sum())
    apart = abs(x[y == 1].mean(axis=0) - x[y == 0].mean(axis=0)) / np.sqrt(share * (1 - share) * (1 / size[0] + 1 / size[1]) + 1e-12)
    kinds = [g for g, a in zip(kinds, apart, strict=True) if a >= X.APART]
    x = x[:, apart >= X.APART]
    p, n = x[y == 1].sum(axis=0) + 1, x[y == 0].sum(axis=0) + 1
    ratio = np.log(p / (y.sum() + 2)) - np.log(n / ((1 - y).sum() + 2))
    z = np.column_stack([x * ratio, np.ones(60)])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.ones(len(kinds)), 0) * X.L2
    for _ in range(50):
        q = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag(penalty + 1e-12), z.T @ (q - y) + penalty * w)
    row, feature = X._features(texts)
    model = X.fit([feature[row == i] for i in range(60)], y.astype(int).tolist(), y.mean())
    assert len(model["ids"]) == len(kinds)
    assert np.allclose(X.scores(model, texts), 1 / (1 + np.exp(-z @ w)), atol=2e-3)
    moved = X.fit([feature[row == i] for i in range(60)], y.astype(int).tolist(), 0.01)
    assert moved["b"] < model["b"] and np.allclose(moved["w"], model["w"])


def test_toxicity_edge_cases(spark):
    random.seed(1)
    rows = [(i, " ".join(random.choice(["mild", "calm", "soft", "warm"]) for _ in range(12)) + (" vile" if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (2, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "so vile", 3), (4, "so calm", 4), (5, "calm " * 50_000, 5)], "doc_id long, text string, toxic int")
    got = [r.toxicity for r in X.score_toxicity(odd, model).orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[2] > 0.5 > got[3] and got[4] < 0.5
    assert X.score_toxicity(odd.where("false"), model).count() == 0
    clash = X.score_toxicity(odd.withColumn("Out", F.lit("y")).withColumn("key", F.lit(2)), model, out="out")
    assert clash.columns == ["doc_id", "text", "toxic", "key", "out"] and [r.out for r in clash.orderBy("doc_id").collect()] == got
    repeated = X.train(docs.unionByName(docs), labels)
    assert np.array_equal(repeated["ids"], model["ids"]) and np.allclose(repeated["w"], model["w"], atol=1e-5)
    flat = X.train(docs, labels.where("toxic = 0"))
    assert len({r.toxicity for r in X.score_toxicity(odd, flat).collect()}) == 1
    assert X.train(docs, labels.where("false"))["ids"].size == 0
