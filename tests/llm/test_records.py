import gzip
import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelab.llm import chat as C
from tracelab.llm import queries as Q
from tracelab.llm import topk as X
from tracelab.llm import warc as W

D = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "conversations", "labels", "benchmark")


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = Q.QUERIES[name](spark, D)
    got = con.execute(Q.ORACLE_SQL[name])
    order = sorted(range(len(got.description)), key=lambda i: got.description[i][0])
    assert sorted(x[0] for x in got.description) == sorted(df.columns)
    want = sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr) == want


def brute_top(rows, k=5):
    v = [(i, tuple(math.floor(256 * x) for x in e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, c in sorted({x for x in v if x[0] % 50 == 0}):
        best = sorted((-sum(a * b for a, b in zip(c, w, strict=True)), i) for i, w in v if i != q and len(w) == len(c))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 50, "block_rows": 3}])
def test_top_k_equals_brute_force(spark, sizes):
    random.seed(1)
    odd = [[1.0, 1.0], [1.0, 1.0], [0.5, 2.0], [0.5, -1.0], None, [], [None, 1.0], [float("nan"), 1.0], [1.0], [1e6, -1e6]]
    rows = [(i % 97 * 5, random.choice(odd)) for i in range(500)] + [(1000, [1e6, 2e6])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    assert sorted(map(tuple, X.top_k(X.coded(df), F.col("vec_id") % 50 == 0, **sizes).collect())) == brute_top(rows)
    assert X.top_k(X.coded(df.where("false")), F.col("vec_id") % 50 == 0, **sizes).count() == 0


def test_shards_are_skipped_where_vectors_cluster(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 2, (16, 12))
    rows = [(i, (centres[i % 16] + rng.normal(0, 0.05, 12)).tolist()) for i in range(3000)]
    coded = X.coded(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    shards = X.dealt(coded, 100)
    own = X.boxes(shards)
    assert len(own[12][0]) >= 16 and shards.groupBy("shard").count().agg(F.max("count")).first()[0] < 400
    for r in shards.take(50):
        at = own[12][0].tolist().index(r.shard)
        assert (own[12][1][at] <= r.code).all() and (own[12][2][at] >= r.code).all()
    asked = coded.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "code AS asked", "dim", "0L AS query_code", "0 AS home", "cast(2000000 AS long) AS floor")
    sent = X.routed(asked, spark.sparkContext.broadcast(own), False).count()
    assert 0 < sent < asked.count() * len(own[12][0]) / 2
    got = sorted(map(tuple, X.top_k(coded, F.col("vec_id") % 50 == 0, shard_rows=100, block_rows=20).collect()))
    assert got == brute_top(rows)


def test_large_scores_and_many_equal_vectors(spark):
    big = [(i, [float((-1) ** i * (i + 1) * 3e4), 2.5e6 + i]) for i in range(120)] + [(1000 + i, [1.0, 1.0]) for i in range(400)] + [(50, [1.0, 1.0])] * 9
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, X.top_k(X.coded(df), F.col("vec_id") % 50 == 0, shard_rows=30).collect())) == brute_top(big)


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 300, (40, 8))
    v = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 10, (8000, 8)))
    tree = X.Tree(np.arange(8000), v)
    for a, b in tree.nodes:
        assert b > a
    q = v[17]
    visited = []
    got = tree.search(17, q, tree.bounds(q[None])[0].tolist(), 5, -math.inf, visited)
    want = sorted((-int(s), i) for i, s in enumerate(v @ q) if i != 17)[:5]
    assert got == [(-s, i) for s, i in want] and len(visited) < sum(c is None for c in tree.children) / 2


def brute_chats(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        said = "".join(x for _, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


@pytest.mark.parametrize("size", [10, 300, 10**6])
def test_chats_read_back(spark, size):
    random.seed(3)
    nasty = ["<|turn|>", "<\\|turn|>", "a<\\\\|end|>é", "<<|end|>>", "[[INST]", "</s></s>\\", "\n", "", "<|", "日本<s>", None, "<|/chat|>" * 50]
    rows = [(k % 5 if k % 7 else None, k // 3 if k % 11 else None, random.choice(["user", "assistant", "<|text|>", None]), random.choice(nasty)) for k in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    formatted = C.format_chats(df, part_bytes=size)
    assert {r[0]: tuple(r)[1:5] for r in C.read_chats(formatted).collect()} == brute_chats(rows)
    for r in formatted.collect():
        for s in r.loss:
            assert b"<|" not in C.ESCAPE.sub(b"", r.formatted[s.start : s.end]) or b"<|end|>" not in r.formatted[s.start : s.end]
    assert C.format_chats(df.where("false")).count() == 0


def brute_pages(rows):
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[(h or "").encode()].append(p)
    out = []
    for p, _, h in rows:
        own = groups[(h or "").encode()]
        ids = [i for i in own if i is not None]
        first = min(ids) if ids and len(own) > 1 else None
        again = first is not None and p != first
        out.append((p, len((h or "").encode()), W.digest((h or "").encode()), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [97, 1001, 1 << 20])
def test_archives_read_back(spark, tmp_path, size):
    rows = [(1, "u", "é" * 5000), (2, None, "é" * 5000), (2, "x", "a"), (2, "x", "a"), (3, "y z", None), (None, "q", ""), (5, "w", "\r\n\r\nWARC/1.1\r\n"), (None, "r", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    W.write_archives(df, f"file://{tmp_path}/w", segment_bytes=size)
    got = W.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert all(r.error is None for r in got) and sorted((tuple(r)[:5] for r in got), key=str) == brute_pages(rows)


def test_many_pages_and_large_pages_are_bounded_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 60_000)
    rows = [(i, "u", f"{i} " * (8000 if i % 10 == 0 else 10)) for i in range(60)]
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/w", segment_bytes=1024)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) > 4 and max(sizes) < 70_000
    assert sorted((tuple(r)[:5] for r in W.read_archives(spark, f"file://{tmp_path}/w").collect()), key=str) == brute_pages(rows)


def test_segments_are_kept_only_of_records_that_go_on_in_another_archive(spark, tmp_path, monkeypatch):
    kept, written = [], W.S.written
    monkeypatch.setattr(W.S, "written", lambda *a: kept.append(written(*a)) or kept[-1])
    rows = [(i, "u", f"{i} " * (8000 if i % 10 == 0 else 900)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for at, archive_bytes in (("one", 32 << 20), ("many", 60_000)):
        monkeypatch.setattr(W, "ARCHIVE_BYTES", archive_bytes)
        W.write_archives(df, f"file://{tmp_path}/{at}", segment_bytes=1024)
        got = W.read_archives(spark, f"file://{tmp_path}/{at}").collect()
        assert all(r.error is None for r in got) and sorted((tuple(r)[:5] for r in got), key=str) == brute_pages(rows)
    one, many = (x.where("origin IS NOT NULL") for x in kept)
    files = len([*(tmp_path / "many").glob("*.gz")])
    assert one.count() == 0 and files > 4 and 0 < many.select("origin").distinct().count() <= files - 1


def test_segments_in_any_order_and_archive(spark, tmp_path):
    def records(page, text):
        return W.page_records(page, "u", text, W.digest(text), None, False, f"urn:{page}", 60)

    in_one, over_two, twice, also_there = (records(i, bytes([96 + i]) * 500) for i in range(1, 5))
    archives = [in_one[::-1] + over_two[::2] + twice + twice[1:2] + also_there, over_two[1::2] + also_there[1:2]]
    (tmp_path / "w").mkdir()
    for n, x in enumerate(archives):
        (tmp_path / "w" / f"{n}.warc.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in x)))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.error is None) for r in W.read_archives(spark, f"file://{tmp_path}/w").collect()), key=str)
    sha = [W.digest(bytes([96 + i]) * 500) for i in range(5)]
    assert got == [(0, None, None, False), (1, 500, sha[1], True), (2, 500, sha[2], True), (3, None, sha[3], False), (4, 500, sha[4], True)]


def test_malformed_records_are_rows(spark, tmp_path):
    sha = W.digest(b"abc")
    good = [b"".join(r + b"\r\n\r\n" for r in W.page_records(i, "u", b"abc" * k, W.digest(b"abc" * k), None, False, f"urn:{i}", 60)) for i, k in ((1, 1), (2, 90))]
    revisit = W.page_records(3, "u", b"abc", sha, 1, True, "urn:3")[0] + b"\r\n\r\n"
    assert b"WARC-Refers-To: <urn:page:1:" + sha.encode() in revisit
    lost = W.page_records(4, "u", b"x" * 500, W.digest(b"x" * 500), None, False, "urn:4", 60)
    lost = b"".join(r + b"\r\n\r\n" for r in lost[:2] + lost[3:])
    wrong = W.page_records(5, "u", b"abc", W.digest(b"abd"), None, False, "urn:5")[0] + b"\r\n\r\n"
    no_length = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 6\r\n\r\nabc\r\n\r\n"
    short = (W.page_records(7, "u", b"abc", sha, None, False, "urn:7")[0]).replace(b"Content-Length: ", b"Content-Length: 9") + b"\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(gzip.compress(b"junk\r\n\r\n" + good[0] + short + no_length + good[1] + lost + wrong + revisit))
    got = {r.page_id: r for r in W.read_archives(spark, f"file://{tmp_path}/w").collect() if r.page_id is not None}
    assert {i for i, r in got.items() if r.error is None} == {1, 2, 3} and {i for i, r in got.items() if r.error} == {4, 5, 6, 7}
    assert (got[2].payload_bytes, got[3].refers_to, got[3].record_type) == (270, 1, "revisit")


def test_empty_archive(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_archives(df, f"file://{tmp_path}/w")
    assert W.read_archives(spark, f"file://{tmp_path}/w").count() == 0


def test_segments_and_chunks():
    block = bytes(range(256)) * 40
    assert W.unchunked(W.chunked(block, 7)) == block == W.unchunked(W.chunked(block)) and W.unchunked(W.chunked(b"")) == b""
    assert W.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    parts = [(2, None, b"b"), (1, None, b"a"), (3, 3, b"c")]
    assert W.joined_segments(parts) == b"abc"
    for bad in (parts[:2], [(1, None, b"a"), (3, 2, b"c")], [(1, None, b"a"), (2, 5, b"b")]):
        with pytest.raises(ValueError):
            W.joined_segments(bad)
    with pytest.raises(ValueError):
        W.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
