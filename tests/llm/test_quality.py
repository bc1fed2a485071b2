import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracelab.llm import quality as Q

D = "/root/testdata/sf0.01"


def test_passages_cover_whole_texts():
    long = "wörd number " * 3000
    texts = ["", None, "short", "x" * 5000, long, " ", "a b " * 200, "last"]
    own, text = Q.passages(pa.array(["skipped", *texts]).slice(1))
    parts = own.to_pylist()
    assert ["".join(p for p, i in zip(parts, text, strict=True) if i == j) for j in range(len(texts))] == [t or "" for t in texts]
    assert set(text.tolist()) == set(range(len(texts)))  # an empty text is a passage too
    mine = [p for p, i in zip(parts, text, strict=True) if i == 4]
    assert len(mine) > 40 and all(300 <= len(p.encode()) <= 950 and not p[-1:].isspace() for p in mine[:-1])


def test_descriptions_do_not_depend_on_neighbours():
    texts = ["Hello, world! 42", "", "tea tea tea é", "AB\ncd | ef", "x"]
    together = Q.described(pa.array(texts))
    for t, x in zip(texts, together, strict=True):
        assert np.array_equal(Q.described(pa.array([t]))[0], x)
    assert not together[1].any() and len(np.unique(together, axis=0)) == len(texts)
    assert abs((together[0, : Q.PLACES] ** 2).sum() - 3) < 0.3  # shares of one, two and three kinds


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    model = Q.Model()
    size = {"W": (7, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": (1,)}
    model.p = {k: rng.normal(size=s) for k, s in size.items()}
    x, starts, y = rng.normal(size=(9, 7)), np.array([0, 2, 3, 7]), np.array([1.0, 0, 1, 0])

    def loss():
        s = model.forward(np.tanh(x @ model.p["W"] + model.p["b"]), starts)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    got = model.gradients(x, starts, y)
    for k, v in model.p.items():
        for at in np.ndindex(*v.shape):
            old = v[at]
            v[at] = old + 1e-5
            up = loss()
            v[at] = old - 1e-5
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-5 - np.reshape(got[k], v.shape)[at]) < 1e-7


def test_attention_weights_sum_to_one():
    rng = np.random.default_rng(6)
    model = Q.fit([rng.random((n, Q.WIDTH)).astype(np.float16) for n in (1, 3, 2, 5)], [0, 1, 1, 0], 0.5)
    f = model.forward(rng.normal(size=(6, Q.HIDDEN)), np.array([0, 1, 4]))
    assert np.allclose(np.add.reduceat(f["a"], [0, 1, 4]), 1) and (f["a"] > 0).all()


def test_held_out_accuracy_and_whole_texts(spark, monkeypatch):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows = [r for r in Q.op11_quality(spark, D).collect()]
    assert len(rows) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.96
    # junk far behind the start of a long text is seen, however it is cut into blocks
    model = Q.train(spark.read.parquet(f"{D}/documents.parquet"), Q.learnable(spark.read.parquet(f"{D}/labels.parquet")))
    clean = next(r.text for r in spark.read.parquet(f"{D}/documents.parquet").where("n_chars > 3000 AND lang = 'en'").collect() if Q.scores(model, pa.array([r.text]))[0] > 0.95)
    junk = clean + " " + "".join(f"{w.upper()}!! " for w in clean.split()) * 3
    one = Q.scores(model, pa.array([clean, junk, None]))
    monkeypatch.setattr(Q, "TOGETHER", 3)
    assert np.allclose(one, Q.scores(model, pa.array([clean, junk, None])), atol=1e-5)
    assert one[0] > 0.95 and one[1] < one[0] - 0.3


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "again", "a"), (2, "", "b"), (None, "text " * 10, "c"), (3, "x" * 100_000, None), (4, "A!! " * 300, "d"), (5, "Good words, here they are.", "e")], "doc_id long, text string, score string")
    labels = [(1, 1), (2, None), (4, 0), (5, 1), (5, 0), (None, 1), (3, 7), (9, 0)]
    model = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = Q.score_quality(docs, model, out="_s")
    assert got.columns == ["doc_id", "text", "score", "_s"]
    assert got.count() == 7 and got.where("_s BETWEEN 0 AND 1").count() == 7
    assert Q.score_quality(docs, model, out="SCORE").columns == ["doc_id", "text", "SCORE"]
    for few in ([], [(1, 1)], [(4, 0)]):
        same = Q.score_quality(docs, Q.train(docs, spark.createDataFrame(few, "doc_id long, quality int")), out="_s").agg(F.count_distinct("_s")).head()[0]
        assert same == 1
    assert Q.score_quality(docs.limit(0), model, out="_s").count() == 0
