import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracelab.llm import lexical as X
from tracelab.llm import whitening as W

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in own:
            m = 100 - 75 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            scores += [(-s, d is None, d or 0)] * (s > 0)
        out += [(item, i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_terms_are_the_matches():
    random.seed(1)
    texts = ["".join(random.choice("aZ9 .-é_中\n\t{`@/:[") for _ in range(random.randint(0, 30))) for _ in range(300)] + ["", None, "ends", "begins"]
    column = pa.array(["skipped", *texts]).slice(1)
    words, which, before = X.terms_of(column)
    got = [[words[i].decode() for i in which[a:b]] for a, b in zip(before[:-1], before[1:], strict=True)]
    assert got == [terms(t) for t in texts]
    assert len(set(words)) == len(words)


def test_radix_order_sorts_and_is_stable():
    keys = np.random.default_rng(2).integers(0, 2**50, 5000)
    keys[::3] = keys[1::3][: len(keys[::3])] if len(keys[1::3]) >= len(keys[::3]) else keys[0]
    assert (X.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(X.radix_order(np.empty(0, np.int64))) == 0


def test_lengths_beyond_64_bits():
    n = np.array([1, 2**40], np.int64)
    assert X.lengths(n, 10**9, 10**13).tolist() == [25 + 75 * int(x) * 10**9 // 10**13 for x in n]


@pytest.mark.parametrize(("block", "k"), [(3, 4), (2048, 1000)])
def test_search_equals_brute_force(spark, block, k, monkeypatch):
    monkeypatch.setattr(X, "PAIRS", 50)
    random.seed(3)
    word = lambda: random.choice(["Tea", "tea", "a", "of", "éa", "zq", "w7", "rare"] + ["the"] * 8)
    docs = [(i, " ".join(word() for _ in range(random.randint(0, 12)))) for i in range(60)]
    docs += [(60, docs[0][1]), (3, docs[3][1]), (None, docs[5][1]), (None, "rare"), (61, None), (62, ""), (63, "?!")]
    docs.append((64, "the " * 5000 + "rare"))
    items = [(i, " ".join(word() for _ in range(5))) for i in range(7)] + [(7, None), (8, "unseen"), (9, "..."), (2, "rare rare tea"), (None, "w7")]
    got = X.search(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, N string"), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"), k, block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, k)


def test_search_of_empty_tables(spark):
    none = lambda name: spark.createDataFrame([], f"{name} long, text string")
    one = lambda name: spark.createDataFrame([(1, "tea")], f"{name} long, text string")
    for docs, items in ((none("doc_id"), one("item_id")), (one("doc_id"), none("item_id")), (none("doc_id"), none("item_id"))):
        got = X.search(docs, items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def plain_whitening(rows, components=32):
    dims = max(len(v) for _, v in rows)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    away = n * x - s
    cov = (away.T @ away).astype(np.float64) / n**3
    value, vector = np.linalg.eigh(cov)
    keep = min(components, dims)
    return [int((a * a).sum()) for a in away], (away.astype(np.float64) / n) @ vector[:, ::-1][:, :keep], value[::-1][:keep], np.trace(cov)


@pytest.mark.parametrize("pairs", [7, 8256])
def test_whitening_equals_plain_numpy(spark, pairs, monkeypatch):
    monkeypatch.setattr(W, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    rows = [(i % 37, [float(np.float32(c)) for c in rng.normal(0, 0.3, 6) * [3, 1, 1, 2, 0.5, 1]]) for i in range(40)] + [(None, [0.1] * 6), (50, [0.5, -0.5])]
    bad = [(60, None), (61, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (62, [float("nan")] * 6), (63, [float("inf"), *[0.0] * 5])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows + bad], "vec_id long, embedding array<float>, whitened double")
    got = W.whiten(df).collect()
    deviation, projected, value, trace = plain_whitening(rows)
    assert len(got) == len(rows) * 6 and {r.n for r in got} == {len(rows)}
    assert sorted(r.deviation for r in got) == sorted(d for d in deviation for _ in range(6))
    assert all(r.identity_error < 1e-9 for r in got)
    for c in range(6):
        own = sorted(r.whitened for r in got if r.component == c + 1)
        want = projected[:, c] / math.sqrt(value[c])
        assert min(np.abs(np.array(own) - np.sort(sign * want)).max() for sign in (1, -1)) < 1e-9
        assert all(abs(r.explained - value[c] / trace) < 1e-12 for r in got if r.component == c + 1)


def test_whitening_without_full_rank(spark):
    few = spark.createDataFrame([(1, [0.5, 0.25, 0.0]), (2, [-0.5, 0.75, 1.0]), (3, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = W.whiten(few).collect()
    assert {r.whitened for r in got if r.component == 3} == {0.0} and {r.explained for r in got if r.component == 3} == {0.0}
    assert max(r.identity_error for r in got) < 1e-9
    same = W.whiten(spark.createDataFrame([(i, [0.5, 0.25]) for i in range(3)], "vec_id long, embedding array<double>")).collect()
    assert [(r.whitened, r.deviation, r.identity_error) for r in same] == [(0.0, 0, 0.0)] * 6
    assert W.whiten(few.limit(0)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, []), (2, None)], "vec_id long, embedding array<double>")).count() == 0


def test_whitening_of_large_entries(spark):
    rows = [(i, [float(2**40 * (i % 3)), float(i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        W.whiten(df).collect()
    model = W.fit(W.usable(df))  # sums of 38 digits
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    away = 5 * x - x.sum(axis=0)
    value = np.linalg.eigvalsh((away.T @ away).astype(np.float64) / 125)
    assert abs(model.explained[0] - value[1] / value.sum()) < 1e-12
    wide = [(i, [float(2**22 * (i % 3)), float(i)]) for i in range(5)]  # sums of 64 bits
    model = W.fit(W.usable(spark.createDataFrame(wide, df.schema)))
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in wide], object)
    away = 5 * x - x.sum(axis=0)
    value = np.linalg.eigvalsh((away.T @ away).astype(np.float64) / 125)
    assert abs(model.explained[0] - value[1] / value.sum()) < 1e-12
    with pytest.raises(OverflowError):
        W.fit(W.usable(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")))
