"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The most frequent words of the corpus (parts that the tokenizer's pattern splits off, counted over all documents) are compiled with their ids into
a minimal acyclic automaton: equal suffixes share states, and each transition carries how many words sort before those that take it, so that
the sum along a path numbers the word and finds its ids. The automaton is one file of flat arrays. It lies in the folder in spark.checkpoint.dir, goes
to executors as a Spark file and is memory-mapped there. A batch's different words walk through it side by side, a byte
a step; words that it lacks are merged exactly from the tokenizer's merges. Ids are kept by stretch between white space, over all tasks of a worker. The class of a
character beyond Latin letters is asked of the library once, so that words end where its Unicode version has them end; no text goes to the library.

Decoding joins the byte strings of the ids and reads them as UTF-8 with replacement of what is malformed.

Edge cases: null and empty texts have no ids and decode to the empty text. The tokenizer's special strings inside a text become their ids, as the library's do.
Equal texts get equal results; an empty table gives an empty one. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import _shared as S
from tracelab.llm.merges import Merges, byte_letters

LEXICON, COUNTED, CACHE, FINE = 50_000, 400_000, 800_000, 16
PLAIN = re.compile(r"[ \t\n\r!-~¡§°·¿«»À-ÖØ-öø-ÿ]*")
#: Words of plain characters.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


class Automaton:
    """Words and their ids; state 0 is the start. Built from sorted words, as in Daciuk et al. (2000)."""

    def __init__(self, data: np.ndarray):
        self.data = data
        head = data[:32].view(np.int64)
        at = 32
        parts = []
        for n, kind in ((head[0], np.int64), (head[0], np.int32), (head[0], np.int32), (head[1], np.uint8), (head[2] + 1, np.int64), (head[3], "<u4")):
            size = int(n) * np.dtype(kind).itemsize
            parts.append(data[at : at + size].view(kind))
            at += -(-size // 8) * 8
        self.keys, self.next, self.add, self.final, self.ends, self.ids = parts
        self.raw = memoryview(self.ids.view(np.uint8))

    @staticmethod
    def build(words: dict[bytes, bytes]) -> bytes:
        order = sorted(words)
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]  # states along the last word, not yet registered

        def settle(depth: int, word: bytes) -> None:
            for i in range(len(path) - 1, depth, -1):
                s = path.pop()
                key = (final[s], *edges[s].items())
                edges[path[-1]][word[i - 1]] = register.setdefault(key, s)

        last = b""
        for w in order:
            same = len(os.path.commonprefix([last, w]))
            settle(same, last)
            for byte in w[same:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][byte] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = w
        settle(0, last)
        number, stack, post = {0: 0}, [0], []
        while stack:  # the states that are left, numbered
            s = stack.pop()
            for t in edges[s].values():
                if t not in number:
                    number[t] = len(number)
                    stack.append(t)
        held: dict[int, int] = {}
        post = [(0, iter(edges[0].values()))]
        while post:  # words from each state on, from the last states up
            s, it = post[-1]
            for t in it:
                if t not in held:
                    post.append((t, iter(edges[t].values())))
                    break
            else:
                held[s] = final[s] + sum(held[t] for t in edges[s].values())
                post.pop()
        rows = []
        for s, n in number.items():
            before = int(final[s])
            for byte, t in sorted(edges[s].items()):
                rows.append((n << 8 | byte, number[t], before))
                before += held[t]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        ends = np.cumsum([0, *(len(words[w]) // 4 for w in order)])
        flags = np.array([final[s] for s in number], np.uint8)
        out = [np.array([len(table), len(flags), len(order), ends[-1]], np.int64), table[:, 0], table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), flags, ends.astype(np.int64), np.frombuffer(b"".join(words[w] for w in order), "<u4")]
        return b"".join(raw + bytes(-len(raw) % 8) for raw in (x.tobytes() for x in out))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, -1 where it lacks them."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        of = np.argsort(-size, kind="stable")
        start = (np.cumsum(size) - size)[of]
        state, number, size = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), size[of]
        step = 0
        while len(of):
            ended = size == step
            if ended.any():
                ok = ended & (self.final[state] > 0)
                out[of[ok]] = number[ok]
                of, start, state, number, size = (x[~ended] for x in (of, start, state, number, size))
                if not len(of):
                    break
            key = (state << 8) | raw[start + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            of, start, size, at = of[on], start[on], size[on], at[on]
            state, number = self.next[at].astype(np.int64), number[on] + self.add[at]
            step += 1
        return out

    def ids_of(self, number: int) -> bytes:
        return bytes(self.raw[4 * int(self.ends[number]) : 4 * int(self.ends[number + 1])])


class Words:
    """The words of a stretch, as the tokenizer's own pattern splits it."""

    def __init__(self, tokenizer):
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.stand_in = {chr(c): "!" if 28 <= c < 32 else chr(c) for c in range(128)}  # for each character a plain one of its class

    def _class(self, c: str) -> str:
        """Asked of the library, whose Unicode version says which characters are letters and numbers."""
        if re.match(f"[{S.SPACE}]", c):
            return "\n"
        cuts = [end for _, (_, end) in self.split(f"a{c}1")]
        return "a" if cuts == [2, 3] else "1" if cuts == [1, 3] else "!"

    def __call__(self, stretch: str) -> list[str]:
        if PLAIN.fullmatch(stretch):
            return PARTS.findall(stretch)
        known = self.stand_in
        for c in set(stretch).difference(known):
            known[c] = self._class(c)
        plain = "".join(map(known.__getitem__, stretch))
        return [stretch[m.start() : m.end()] for m in PARTS.finditer(plain)]


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class Codec:
    """Ids of stretches are kept, CACHE stretches at most, then afresh."""

    def __init__(self, path: str, automaton: Automaton):
        tokenizer = _tokenizer(path)
        self.words, self.merge, self.automaton = Words(tokenizer), Merges(path), automaton
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        tokens = model["model"]["vocab"] | added
        self.bytes = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.special, self.pattern = added, special_pattern(added)
        self.kept = S.Kept(CACHE, np.uint32)
        self.sizes = np.array([len(x) for x in self.bytes])
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.bytes), np.uint8)

    def _learn(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        of = [[w.encode() for w in self.words(s.decode())] for s in stretches]
        words = list(set().union(*of))
        number = self.automaton.find(words).tolist()
        ids_of = self.automaton.ids_of
        ids = {w: ids_of(n) for w, n in zip(words, number, strict=True) if n >= 0}
        rest = [w for w in words if w not in ids]
        ids.update(zip(rest, self.merge(rest), strict=True))
        found = [b"".join([ids[w] for w in own]) for own in of]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        different, which, before = S.stretched(texts, S.after_spaces)
        return self.kept.rows(self.kept.numbers(different, self._learn)[which], before)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin and the last one's end."""
        odd = [i for i in range(len(texts)) if texts[i].is_valid and self.pattern.search(texts[i].as_py())] if self.pattern and any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special) else []
        if not odd:
            return self._encode(texts)
        parts, place = [], [0]  # special strings are rows of their own
        for i in range(len(texts)):
            parts += self.pattern.split(texts[i].as_py()) if i in set(odd) else [texts[i].as_py()]
            place.append(len(parts))
        flat, ends = self._encode(pa.array(["" if p in self.special else p for p in parts], pa.string()))
        own = [np.array([self.special[p]], np.uint32) if p in self.special else flat[ends[k] : ends[k + 1]] for k, p in enumerate(parts)]
        return np.concatenate([*own, np.empty(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)[place]

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The text of each row of ids."""
        n = self.sizes[flat]
        data = self.flat[S.spread(self.starts[flat], n)]
        rows = S.rows_of(data, np.concatenate([[0], np.cumsum(n)])[ends])
        try:
            return rows.cast(pa.string())
        except pa.ArrowInvalid:  # an id sequence that ends within a character
            return pa.array([x.decode("utf-8", "replace") for x in rows.to_pylist()], pa.string())


def special_pattern(strings) -> re.Pattern | None:
    return re.compile("(" + "|".join(map(re.escape, sorted(strings, key=len, reverse=True))) + ")") if strings else None


def frequent_words(docs: DataFrame, path: str, size: int = LEXICON) -> list[str]:
    """The most frequent words over all texts (special strings count as their parts), at most ``size``. Counts are ranked by FINE steps for each doubling, and words of the first step that doesn't
    fit whole are left to merging, so that the driver gets no more words than it keeps."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        words = S.held(("words", path), lambda: Words(_tokenizer(path)))

        def flush() -> pa.RecordBatch:
            of: Counter[str] = Counter()
            for stretch, n in counts.items():
                for w in words(stretch.decode()):
                    of[w] += n
            return pa.RecordBatch.from_pydict({"word": pa.array([w.encode() for w in of], pa.binary()), "n": pa.array(list(of.values()), pa.int64())})

        for b in batches:
            for part in S.slices(b, 0):
                different, which, _ = S.stretched(part.column(0), S.after_spaces)
                for stretch, n in zip(different, np.bincount(which, minlength=len(different)).tolist(), strict=True):
                    counts[stretch] += n
                if len(counts) > COUNTED:
                    yield flush()
                    counts.clear()
        yield flush()

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = S.written(counted.withColumn("step", F.floor(F.log2("n") * FINE).cast("int")), "lexicon-counts")
    steps = {r["step"]: r["count"] for r in counted.groupBy("step").count().collect()}  # at most 64 * FINE rows
    total, least = 0, None
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > size:
            break
        least = step
    if least is None:
        return []
    return sorted(bytes(r["word"]).decode() for r in counted.where(F.col("step") >= least).select("word").collect())


def compiled(spark: SparkSession, words: list[str], path: str) -> str:
    """Name of the Spark file that holds the automaton of words."""
    merge = Merges(path)
    raw = [w.encode() for w in words]
    data = Automaton.build(dict(zip(raw, merge(raw), strict=True)))
    at = S.shared_path(spark, "lexicon")
    place = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(at)
    return at.rpartition("/")[2]


def recode(docs: DataFrame, path: str | None = None, lexicon: int = LEXICON) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded text of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    name = compiled(spark, frequent_words(docs, path, lexicon), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = S.held(("codec", name), lambda: Codec(path, Automaton(np.memmap(SparkFiles.get(name), np.uint8, "r"))))
        for b in batches:
            for part in S.slices(b, 1):
                ids, ends = codec.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), S.rows_of(ids.astype("<u4"), ends), codec.decode(ids, ends)], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recode(S.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


