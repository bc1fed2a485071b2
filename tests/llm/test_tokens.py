import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tracelab.llm import lexicon as X
from tracelab.llm import packing as P
from tracelab.llm.merges import Merges

D = "/root/testdata/sf0.001"
NASTY = ["it's a dog's  life x́ ẛ̣ ΑΣ Σ 123   a\x1cb", "<|endoftext|>hi <|endoftext|> <|endoftext|>x", "", " \n", "é ́a ½ ²x a_b-c...\n\n  日本語 text\u0085n İI  ", "a" * 3000, "\0 \0", "I'LL we'll 'sx  \t\n b", "😀 hi", "ab" * 700 + " x"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    ids, want = P.Ids(public_tokenizers.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    flat, ends = ids(pa.array([*NASTY, None]))
    for i, text in enumerate(NASTY):
        assert flat[ends[i] : ends[i + 1]].tolist() == want(text), text
    assert ends[-1] == ends[-2]


def test_codec_equals_the_library():
    path, want = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    words = [" the", " a", "The", "\n", "é", " life", "日本"]
    merge = Merges(path)
    raw = [w.encode() for w in words]
    data = X.Automaton.build(dict(zip(raw, merge(raw), strict=True)))
    codec = X.Codec(path, X.Automaton(np.frombuffer(data, np.uint8)))
    for texts in (NASTY, [t for t in NASTY if "<|" not in t]):
        flat, ends = codec.encode(pa.array([*texts, None]))
        assert codec.decode(flat, ends).to_pylist() == [*texts, ""]
        for i, text in enumerate(texts):
            assert flat[ends[i] : ends[i + 1]].tolist() == want(text), text
    cut = codec.encode(pa.array(["日"]))[0][:1]
    assert codec.decode(cut, np.array([0, 1])).to_pylist() == [Tokenizer.from_file(path).decode(cut.tolist(), skip_special_tokens=False)]


def test_random_texts_equal_the_library():
    path, path5 = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    want, want5 = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
    codec, ids = X.Codec(path, X.Automaton(np.frombuffer(X.Automaton.build({}), np.uint8))), P.Ids(path5)
    random.seed(6)
    some = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\u0085", "\x1c", "\u1680", "a", "B", "é", "e\u0301", "J\u030c", "Σ", "1", "²", "½", "'s", "'", "!", "«", "’", "日", "가", "😀", "\u0558", "\u208f", "\U00011de3", "<|endoftext|>", "<|", "_", "İ", "K"]
    texts = ["".join(random.choices(some, k=random.randint(0, 12))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        own = texts[at : at + 500]
        flat, ends = codec.encode(pa.array(own))
        flat5, ends5 = ids(pa.array(own))
        for i, t in enumerate(own):
            assert flat[ends[i] : ends[i + 1]].tolist() == want(t), repr(t)
            assert flat5[ends5[i] : ends5[i + 1]].tolist() == want5(t), repr(t)
        assert codec.decode(flat, ends).to_pylist() == own


def test_lexicon_has_the_most_frequent_words(spark):
    df = spark.createDataFrame([(i, "a b b c c c c " + "d " * 9) for i in range(5)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert X.frequent_words(df, path, 2) == [" c", " d"]
    assert X.frequent_words(df, path, 100) == [" ", " b", " c", " d", "a"]


def test_automaton_is_minimal_and_complete():
    random.seed(1)
    words = sorted({bytes(random.choice(b"abc") for _ in range(random.randint(1, 6))) for _ in range(300)})
    a = X.Automaton(np.frombuffer(X.Automaton.build({w: w.ljust(4 * -(-len(w) // 4), b"\0") for w in words}), np.uint8))
    assert a.find(words).tolist() == list(range(len(words)))
    assert a.ids_of(3).rstrip(b"\0") == words[3]
    assert (a.find([b"", b"zz", words[0] + b"zz", b"\xff"]) == -1).all()
    # States are as many as different right languages.
    rights = set()
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    for p in prefixes:
        rights.add(frozenset(w[len(p) :] for w in words if w.startswith(p)))
    assert len(a.final) == len(rights)
    assert len(X.Automaton(np.frombuffer(X.Automaton.build({}), np.uint8)).find([b"a"])) == 1


def test_op9_on_documents(spark):
    want = library("byte_bpe_50k.json")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = X.op9_bpe(spark, D).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(want(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_recode_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "a a"), (2, "b " * 50_000), (2, "b " * 50_000)], "doc_id long, text string")
    got = X.recode(df, lexicon=2).collect()
    assert [r.decoded for r in got] == ["", "", "a a", "b " * 50_000, "b " * 50_000]
    assert X.recode(df.where("false")).count() == 0


def lower_bound(counts, c):
    return -(-sum(k * n for k, n in counts.items()) // c)


@pytest.mark.parametrize("seed", range(12))
def test_plan_packs_all_and_is_near_the_bound(seed):
    random.seed(seed)
    c = random.choice([10, 50, 4096])
    counts = Counter(random.choice([random.randint(1, c), random.randint(1, max(1, c // 8)), c]) for _ in range(random.randint(1, 400)))
    plan = P.Plan(counts, c)
    room, placed = Counter(), Counter()
    for size, rank, bins, each, first, offset in plan.segments:
        assert rank == placed[size]
        placed[size] += bins * each
        for b in range(bins):
            assert room[first + b] == offset  # gapless
            room[first + b] += size * each
    assert placed == counts and max(room.values()) <= c and len(room) == plan.bins
    assert plan.bins <= best_fit(counts, c)


def best_fit(counts, c):
    room = []
    for s in sorted(counts.elements(), reverse=True):
        fits = [r for r in room if r >= s]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - s)
        else:
            room.append(c - s)
    return len(room)


def test_reduction_is_optimal_on_small_cases():
    def optimum(items, c):
        best = len(items)

        def go(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(items):
                best = len(rooms)
                return
            for k in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
            go(i + 1, [*rooms, c - items[i]])

        go(0, [])
        return best

    random.seed(4)
    for _ in range(300):
        items = sorted((random.randint(1, 20) for _ in range(random.randint(1, 8))), reverse=True)
        plan = P.Plan(Counter(items), 20)
        left = [s for s, n in plan.left.items() for _ in range(n)]
        spent = Counter(items)
        for size, _, bins, each, first, _ in plan.segments:
            if first < plan.fixed:
                spent[size] -= bins * each
        rest = sorted(spent.elements(), reverse=True)
        assert plan.fixed + (optimum(rest, 20) if rest else 0) == optimum(items, 20), (items, left)


def test_op5_on_documents(spark):
    want = library("word_bpe_49k.json")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = P.op5_packing(spark, D).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, text in texts.items():
        ids = [*want(text), 1]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 4096)) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        total += len(ids)
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(rows) <= -(-total // 4096) + 1


def test_pack_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 3), (1, "", 4), (1, "", 4), (None, "a", 5), (2, "word " * 9000, 6)], "doc_id long, text string, length long")
    got = P.pack(df).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 2), (1, 0, 1), (1, 0, 1), (1, 0, 1), (2, 0, 4096), (2, 1, 4096), (2, 2, 809)]
    assert P.pack(df.where("false")).count() == 0
