import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracelab.llm import _shared as S
from tracelab.llm import fingerprint as P
from tracelab.llm import lines as X
from tracelab.llm import neardup as N

D = "/root/testdata/sf0.001"


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or "", r[1] is not None))
    out = []
    for i, (k, x) in enumerate(order):
        x, n = x or "", order[(i + 1) % len(order)][1] or ""
        h = len(x) // 2
        out.append((k, hashlib.sha256((x[: len(x) - h] + n[:h]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("extra", [[], [(None, "zz"), (None, None), (7, "same id"), (7, "another"), (7, "another"), (3, ""), (4, None)]])
def test_edits_and_fingerprints(spark, extra):
    random.seed(3)
    rows = [(i * 5, "".join(random.choice("ab \né") for _ in range(random.randint(0, 60)))) for i in range(30)] + extra
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, slot string")
    got = P.fingerprints(df).collect()
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == edits(rows)
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_fingerprint_of_few_rows(spark):
    df = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    r = P.fingerprints(df).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    assert P.fingerprints(df.where("false")).count() == 0


def test_likeness_equals_plain_counts():
    """Against the cosine between the counts of 8-character pieces, and on texts in which one piece stands more often than 16 bits can count."""
    docs = [r["text"] or "" for r in pq.read_table(f"{D}/documents.parquet", columns=["text"]).to_pylist()][:60]
    changed = [t[: len(t) // 2] + docs[(i + 1) % 60][: len(t) // 2] for i, t in enumerate(docs)]

    def pieces(text):
        of = Counter()
        for p in text.split("\n"):
            of.update(p[i : i + 8] for i in range(len(p) - 7))
            if 0 < len(p) < 8:
                of[p] += 1
        return of

    def cosine(a, b):
        norm = np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(a[k] * b[k] for k in a) / norm if norm else float(a == b)

    for other in (changed, docs[1:] + docs[:1]):
        got = P.likeness(P.vectors(docs), P.vectors(other))
        want = np.array([cosine(pieces(a), pieces(b)) for a, b in zip(docs, other, strict=True)])
        assert np.abs(got - want).max() < 4 / np.sqrt(P.LANES) and np.abs(got - want).mean() < 1 / np.sqrt(P.LANES)
    for n in (1000, 33_000, 70_000, 200_000):
        assert P.likeness(P.vectors(["a" * n]), P.vectors(["a" * 1000]))[0] > 0.999
    assert (P.likeness(P.parsed(P.strings(P.vectors(docs))), P.vectors(docs)) == 1).all()


def test_homomorphism():
    a, b, both, swapped = (P.vectors([t]) for t in ("one para\nanother", "third here", "one para\nanother\nthird here", "third here\nanother\none para"))
    assert P.strings(P.combine(a, b)) == P.strings(both) == P.strings(swapped)
    assert P.strings(P.combine(both, b, -1)) == P.strings(a)
    back = P.parsed(P.strings(both))
    assert (back[0] == both[0]).all() and (back[1] == both[1]).all() and P.likeness(both, back)[0] == 1.0
    assert P.strings(P.vectors([""])) != P.strings(P.vectors(["\n"]))


def test_edited_is_nearer_than_next(spark):
    got = P.op4_fingerprint(spark, D).collect()
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.97


def brute_lines(rows, least, often):
    order = sorted(rows, key=lambda r: r[0])
    seqs = [[x.strip() for x in t.split("\n") if x.strip()] for _, t in order]
    stands = Counter(x for t in {t for _, t in order} for y in t.split("\n") if (x := y.strip()))
    weight = {x: max(len(x.split()), least if n >= often else 0) for x, n in stands.items()}
    first = {}
    spans = lambda s: ((i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    for d, s in enumerate(seqs):
        for i, j in spans(s):
            first.setdefault(tuple(s[i:j]), (d, i))
    out = []
    for d, s in enumerate(seqs):
        off = [False] * len(s)
        for i, j in spans(s):
            if sum(weight[x] for x in s[i:j]) >= least and first[tuple(s[i:j])] < (d, i):
                off[i:j] = [True] * (j - i)
        out.append((order[d][0], [x for x, o in zip(s, off, strict=True) if not o], sum(off)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,least,often", [(5, 4, 1000), (6, 9, 1000), (7, 30, 60), (8, 5, 12), (9, 1, 5)])
def test_line_runs_equal_brute_force(spark, seed, least, often):
    random.seed(seed)
    base = [" ".join(random.choice("abcd") for _ in range(random.randint(1, 6))) for _ in range(8)]
    rows = [(i, "\n".join(random.choice([*base, "", f"only {i}"]) for _ in range(random.randint(0, 14)))) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(3)] + [(200, "x"), (201, ""), (202, base[0]), (203, base[0]), (204, base[0] + "\n" + base[1]), (204, base[0] + "\n" + base[1]), (205, "x"), (205, "x")]
    got = X.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least, often).collect()
    assert sorted([(r.doc_id, [x.strip() for x in r.text.split("\n") if x.strip()], r._line_deleted) for r in got], key=str) == brute_lines(rows, least, often)


def test_suffix_array_and_prefixes_equal_brute_force(spark):
    random.seed(3)
    docs = [[random.choice("aabbcdX") for _ in range(random.randint(0, 20))] for _ in range(30)]
    kinds = {c: k for k, c in enumerate("abcd")}  # X: a line that stands once
    rows = [(d, i, kinds[c], False) for d, s in enumerate(docs) for i, c in enumerate(s) if c != "X"]
    depth = 8
    array, rounds = X.suffix_array(spark.createDataFrame(rows, "doc long, i int, rank long, often boolean"), depth)

    def suffix(d, i):
        own = docs[d][i : i + depth]
        return own[: own.index("X")] if "X" in own else own

    order = sorted({tuple(suffix(d, i)) for d, i, _, _ in rows})
    assert {(r.doc, r.i): r["rank"] for r in array.collect()} == {(d, i): order.index(tuple(suffix(d, i))) for d, i, _, _ in rows}
    common = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(order, order[1:])]
    prefixes = S.written(X.common_prefixes(array, rounds), "test-prefixes")
    assert [r.lcp for r in prefixes.orderBy("rank").collect()] == common
    for r in X.intervals(prefixes, depth).collect():
        assert list(r.begins) == [next(k for k in range(r["rank"], -1, -1) if common[k] < n) for n in range(1, depth + 1)]


def test_no_boilerplate_line_of_the_test_table_stands_often(spark):
    got = X.op7_lines(spark, "/root/testdata/sf0.01").collect()
    stands = Counter(x.strip() for r in got if r.text for x in r.text.split("\n") if x.strip())
    assert all(n == 1 for x, n in stands.items() if len(x.split()) >= X.MIN_WORDS) and max(stands.values()) < X.OFTEN


def test_line_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, f"start\n{long}\n\nend", "k"), (5, f"{long}\n\nother", "k"), (1, None, "k"), (2, "", "k"), (None, long, "k"), (9, long, "k"), (9, long, "k"), (10, "short\nshort", "k"), (11, "a\n" * 20_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted(((r.doc_id or 0, r.text) for r in X.dedup_lines(df).collect()), key=str)
    assert got == sorted([(3, f"start\n{long}\n\nend"), (5, "other"), (1, None), (2, ""), (0, ""), (9, ""), (9, ""), (10, "short\nshort"), (11, "a")], key=str)
    assert X.dedup_lines(df.where("false")).count() == 0
    odd = df.selectExpr("doc_id", "text", "digest AS whole", "1 AS starts", "2 AS lengths", "3 AS _line_digest", "4 AS _LINE_COUNT", "5 AS doc", "6 AS rank")
    out = X.dedup_lines(odd)
    assert out.columns == ["doc_id", "text", "whole", "starts", "lengths", "_line_digest", "doc", "rank", "_line_count", "_line_deleted"]
    assert {r[2:8] for r in out.collect()} == {("k", 1, 2, 3, 5, 6)} and sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str) == got


def test_windows_cover_a_run():
    assert X.windows([60], 50) == [(0, 1)] and X.windows([10, 10], 50) == []
    assert X.windows([30, 30, 5], 50) == [(0, 2), (0, 3)]


def plain_words(text):
    return (text or "").lower().split()


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_similarity(a, b):
    if not a or not b:
        return float(a == b)
    m = longest_common(a, b)
    return m / (len(a) + len(b) - m)


def as_numbers(words):
    return np.array([zlib.crc32(w.encode()) for w in words], np.uint32)


def brute_classes(rows, least=0.8, similar=None):
    """Components of all pairs of texts that share a band's key and are similar."""
    similar = similar or (lambda a, b: N.similarity(as_numbers(a), as_numbers(b), least))
    texts = defaultdict(list)
    for d, t in rows:
        texts[" ".join(plain_words(t))].append(d)
    kinds = [k.split() for k in texts]
    flat, ends = N.Sketcher().words(pa.array(list(texts)))
    buckets = defaultdict(list)
    for i in range(len(kinds)):
        if kinds[i]:
            for k in set(N.keys(N.shingles(flat[ends[i] : ends[i + 1]])).tolist()):
                buckets[k].append(i)
    parent = list(range(len(kinds)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in sorted({(i, j) for own in buckets.values() for i in own for j in own if i > j}):
        a, b = root(i), root(j)
        if a != b and similar(kinds[j], kinds[i]) >= least:
            parent[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i, k in enumerate(texts):
        members[root(i)] += texts[k]
    return {d: min(m) for m in members.values() for d in m}


def test_alignment_equals_plain_longest_common_subsequence():
    random.seed(2)
    for _ in range(400):
        a = [random.randrange(random.choice([3, 30])) for _ in range(random.randint(1, 60))]
        b = list(a)
        for _ in range(random.randint(0, 12)):
            at = random.randrange(len(b) + 1)
            b[at : at + random.randint(0, 2)] = [random.randrange(30) for _ in range(random.randint(0, 2))]
        if not b:
            continue
        want, x, y = plain_similarity(a, b), np.array(a, np.uint32), np.array(b, np.uint32)
        for least in (0.5, 0.8, 0.95):
            assert N.similarity(x, y, least) == (pytest.approx(want) if want >= least else 0.0)
    long = [random.randrange(500) for _ in range(3000)]
    other = [x if random.random() > 0.04 else 501 for x in long[:1500] + long[1510:]] + [502] * 5
    assert N.similarity(np.array(long, np.uint32), np.array(other, np.uint32)) == pytest.approx(plain_similarity(long, other))


def test_recall_of_planted_near_copies(spark):
    """Copies with 5 to 9 of 100 words changed, dropped or added, each of a text of its own; and all pairs of the test table with an edit ratio of 0.9 or more."""
    random.seed(8)
    rows, near = [], []
    for k in range(300):
        base = [f"w{random.randrange(3000)}" for _ in range(random.randint(40, 400))]
        own = list(base)
        for _ in range(max(1, round(random.uniform(0.05, 0.09) * len(base)))):
            at = random.randrange(len(own))
            own[at : at + 1] = random.choice([[f"v{random.randrange(10**6)}"]] * 4 + [[], [own[at], f"v{random.randrange(10**6)}"]])
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
        near.append((2 * k, 2 * k + 1))
    label = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([label[a] == label[b] for a, b in near]) >= 0.97
    assert all(label[i] // 2 == i // 2 for i in label)

    docs = {r.doc_id: plain_words(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    label = {r.doc_id: r.class_id for r in N.op1_neardup(spark, "/root/testdata/sf0.01").collect()}
    some = sorted((i for i, w in docs.items() if w), key=lambda i: len(docs[i]))
    bags, found, missed = {i: Counter(docs[i]) for i in some}, 0, []
    for x, i in enumerate(some):
        for j in some[x + 1 :]:
            n1, n2 = len(docs[i]), len(docs[j])
            if n1 < 0.8 * n2:
                break
            if docs[i] != docs[j] and 2 * sum((bags[i] & bags[j]).values()) >= 0.9 * (n1 + n2) and 2 * longest_common(docs[i], docs[j]) >= 0.9 * (n1 + n2):
                found += label[i] == label[j]
                missed += [(i, j)] * (label[i] != label[j])
    assert found >= 40 and found >= 0.9 * (found + len(missed)), (found, missed)


def variants(seed, many, words, changes):
    """Copies of one text, each with changed words of its own."""
    own = random.Random(seed)
    base = [f"w{own.randrange(5000)}" for _ in range(words)]
    rows = []
    for i in range(many):
        text = list(base)
        for at in own.sample(range(words), changes):
            text[at] = f"v{own.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    return rows


def test_variants_of_one_text_equal_brute_force(spark):
    rows = variants(1, 400, 100, 8)
    want = brute_classes(rows)
    assert 17 < len(set(want.values())) < 400
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_large_bucket_of_few_classes_equals_brute_force(spark):
    rows = variants(3, 400, 100, 6)
    want = brute_classes(rows)
    assert len(set(want.values())) == 1
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


@pytest.mark.parametrize("size", [3, 512])
def test_blocks_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(N, "BLOCK", size)
    monkeypatch.setattr(N, "WIDE", 50)
    rows = variants(5, 40, 50, 3)
    texts = [as_numbers(t.split()) for _, t in rows]
    now = [("k", bytes([i]), len(x), bytes([i // 2 if i < 20 else 0])) for i, x in enumerate(texts)]
    sequences = spark.createDataFrame([(bytes([i]), x.astype("<u4").tobytes()) for i, x in enumerate(texts)], "node binary, words binary")
    links = N.blockwise(spark.createDataFrame(now, "key string, node binary, n int, label binary"), sequences, 0.8).collect()
    near = {tuple(sorted((now[i][3], now[j][3]))) for i in range(40) for j in range(i) if now[i][3] != now[j][3] and N.similarity(texts[j], texts[i]) >= 0.8}

    def components(pairs):
        of = {r[3]: r[3] for r in now}
        for a, b in pairs:
            x, y = of[bytes(a)], of[bytes(b)]
            of = {k: min(x, y) if v in (x, y) else v for k, v in of.items()}
        return of

    assert {tuple(sorted((bytes(r.a), bytes(r.b)))) for r in links} <= near
    assert components([(r.a, r.b) for r in links]) == components(near)


def test_components_of_chains_and_stars(spark):
    random.seed(4)
    name = lambda i: f"{i:04d}".encode()
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + random.randrange(40), 200 + random.randrange(40)) for _ in range(35)]
    got = N.contracted(spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")).collect()
    of = {x: x for e in edges for x in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    assert len(got) == len({bytes(r.node) for r in got})
    assert {bytes(r.node): bytes(r.label) for r in got} == {name(a): name(b) for a, b in of.items() if a != b}


def test_near_edge_cases(spark):
    text = " ".join(f"a{i}" for i in range(80))
    rows = [(None, text), (4, text), (4, text), (6, text + " end"), (7, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.copies, r.kept) for r in found)[:1] == [(0, 4, 4, False)] and sum(r.kept for r in found) == 2
    assert sorted(r.doc_id for r in N.one_of_each(df).collect()) == [4, 7]
    odd = df.selectExpr("doc_id", "text", "'y' AS _n", "'z' AS _ID", "1 AS kept", "2 AS label", "3 AS key", "4 AS _raw", "5 AS row")
    kept = N.one_of_each(odd).collect()
    assert sorted(r.doc_id for r in kept) == [4, 7] and kept[0][2:] == ("y", "z", 1, 2, 3, 4, 5)
    assert N.near_duplicates(df.where("false")).count() == 0


def test_order_matters_to_similarity_and_keys():
    words = N.Sketcher().words(pa.array([" ".join(f"w{i}" for i in range(200))]))[0]
    turned = np.concatenate([words[100:], words[:100]])
    assert N.similarity(words, words) == 1.0 and N.similarity(words, turned) == 0.0
    own = N.shingles(words)
    assert not set(N.keys(own).tolist()) & set(N.keys(own[::-1]).tolist())
    assert len(set(N.shingles(np.full(30, 7, np.uint64)).tolist())) == 26  # labelled


def tasks_of(spark, group, run):
    """What run() gives, and how many tasks it took with 200 shuffle partitions that aren't merged."""
    own = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "256k"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    seen = spark.sparkContext.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for i in map(seen.getStageInfo, stages) if i)


def test_few_rows_take_few_tasks_with_many_partitions(spark):
    """A round's tables are written in as many files as their rows need, not in one for each shuffle partition."""
    name = lambda i: f"{i:04d}".encode()
    edges = spark.createDataFrame([(name(i), name(i + 1)) for i in range(60)], "a binary, b binary")
    got, tasks = tasks_of(spark, "few-edges", lambda: N.contracted(edges).collect())
    assert {bytes(r.node): bytes(r.label) for r in got} == {name(i): name(0) for i in range(1, 61)}
    assert tasks < 250, tasks
