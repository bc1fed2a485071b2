"""Chat formatting by columnar byte assembly.

A conversation becomes a header, the turns and a footer::

    <|chat|>                                  <|/chat|>
    <|turn|>ROLE<|text|>CONTENT<|end|>

Control strings are ``<|name|>`` with a name of CONTROL; ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``, of other templates, are
kept out of contents too. Escaping puts a backslash behind the first character of each control string inside a role or a text, and one more
behind that character where backslashes already stand before the rest of one; removing one backslash at each such place is its inverse.

A batch is assembled in numpy: lengths of all segments (header, role, divider, content, end) give offsets by a cumulative sum, scatter
indices copy constants, roles and contents to their places in one preallocated buffer, and the buffer with the conversations' offsets is the Arrow column.
Spans of the loss mask are byte ranges of assistant contents in that column.

Conversations are shuffled by id and sorted by turn, and stream: one too long for a batch comes out as several parts, and the reader carries
its digests from part to part. So no conversation needs to fit in memory, however hot its id; its turns are read by one task, as a
digest over them in order needs.

Edge cases: a null text or role is empty. A null conv_id is a conversation of its own. Turns with the same number are ordered by role, then text; null turns
come first. Repeated rows are turns each. An empty table gives only the added conversation. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import _shared as S

CONTROL = ("chat", "/chat", "turn", "text", "end")
_REST = "(?:" + "|".join(re.escape(x[1:]) for x in (*(f"<|{c}|>" for c in CONTROL), "<s>", "</s>", "[INST]", "[/INST]")) + ")"
#: The first character of what must be escaped, ahead of any backslashes and the rest.
ESCAPE = re.compile(rf"[<\[](?=\\*{_REST})".encode())
UNESCAPE = re.compile(rf"([<\[])\\(?=\\*{_REST})".encode())
OPEN, CLOSE, TURN, TEXT, END = b"<|chat|>", b"<|/chat|>", b"<|turn|>", b"<|text|>", b"<|end|>"
TURNS = re.compile(rb"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
FORMATTED = "conv_id long, part int, last boolean, formatted binary, loss array<struct<start:long,end:long>>"
PART_BYTES = 8 << 20


def _column(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The escaped UTF-8 of texts, one after another, and the length of each."""
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    joined = b"\n".join(raw)  # no control string holds a line end, so none spans two texts
    start = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(joined, np.uint8)
    at = np.fromiter((m.start() for m in ESCAPE.finditer(joined)), np.int64)
    keep = S.spread(start, size)
    data = data[keep]
    if len(at):
        owner = np.searchsorted(start, at, side="right") - 1
        data = np.insert(data, at - owner + 1, 0x5C)
        size = size + np.bincount(owner, minlength=len(size))
    return data, size


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, size: np.ndarray) -> None:
    out[S.spread(at, size)] = data


def assemble(roles: list[str], texts: list[str], first: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer for conversations whose turns begin at ``first``; offsets of the conversations; start and end of each turn's content in the buffer."""
    role, role_size = _column(roles)
    content, size = _column(texts)
    n = len(roles)
    head = np.zeros(n, np.int64)
    tail = np.zeros(n, np.int64)
    last = np.append(first[1:], n) - 1
    head[first] += len(OPEN) * opens
    tail[last] += len(CLOSE) * closes
    segments = np.column_stack([head, np.full(n, len(TURN)), role_size, np.full(n, len(TEXT)), size, np.full(n, len(END)), tail])
    ends = np.cumsum(segments.ravel()).reshape(n, 7)
    begin = ends - segments
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, const in ((1, TURN), (3, TEXT), (5, END)):
        out[begin[:, k][:, None] + np.arange(len(const))] = np.frombuffer(const, np.uint8)
    for k, const, of in ((0, OPEN, first[opens]), (6, CLOSE, last[closes])):
        out[begin[of, k][:, None] + np.arange(len(const))] = np.frombuffer(const, np.uint8)
    _scatter(out, begin[:, 2], role, role_size)
    _scatter(out, begin[:, 4], content, size)
    offsets = np.append(begin[first, 0], len(out))
    return out, offsets, np.column_stack([begin[:, 4], ends[:, 4]])


def format_chats(rows: DataFrame, part_bytes: int = PART_BYTES, learn: str = "assistant") -> DataFrame:
    """rows: conv_id, turn, role, text. FORMATTED rows, the parts of a conversation in order within one partition."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartition(S.partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        roles: list[str] = []
        texts: list[str] = []
        begun = False  # whether a part of the first conversation that waits is already out
        parts = 0

        def out(upto: int, whole: bool) -> pa.RecordBatch:
            """The first ``upto`` rows; whole: their last conversation ends there."""
            nonlocal begun, parts
            first = np.array([i for i in range(upto) if i == 0 or ids[i] != ids[i - 1]], np.int64)
            k = len(first)
            opens, closes = np.ones(k, bool), np.ones(k, bool)
            opens[0], closes[-1] = not begun, whole
            data, offsets, spans = assemble(roles[:upto], texts[:upto], first, opens, closes)
            wide = offsets.astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(wide), pa.py_buffer(data)])
            own = np.flatnonzero([r == learn for r in roles[:upto]])
            conv = np.searchsorted(first, own, side="right") - 1
            local = spans[own] - offsets[conv][:, None]
            loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(conv, np.arange(k + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(local[:, 0]), pa.array(local[:, 1])], ["start", "end"]))
            number = np.zeros(k, np.int32)
            number[0] = parts if begun else 0
            batch = pa.RecordBatch.from_arrays([pa.array([ids[i] for i in first], pa.int64()), pa.array(number), pa.array(closes), column, loss], names=["conv_id", "part", "last", "formatted", "loss"])
            parts = int(number[-1]) + 1 if not whole else 0
            begun = not whole
            del ids[:upto], roles[:upto], texts[:upto]
            return batch

        held = 0
        for b in batches:
            for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held > part_bytes:  # the last conversation may go on
                    yield out(len(ids), ids[-1] != i)
                    held = 0
                ids.append(i)
                roles.append(r)
                texts.append(t)
                held += len(t) + len(r) + 32
        if ids:
            yield out(len(ids), True)

    return rows.mapInArrow(run, FORMATTED)


def unescaped(data: bytes) -> bytes:
    return UNESCAPE.sub(rb"\1", data)


def read_chats(formatted: DataFrame) -> DataFrame:
    """Reads FORMATTED rows back: the columns of op6's contract. The parts of a conversation must be in order within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state = None
        for b in batches:
            for conv, part, last, data, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == 0:
                    state = [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                turns, learnt = state[:2]
                for role, text in TURNS.findall(data):
                    state[2] += 1
                    turns.update(unescaped(role) + b"\n" + unescaped(text) + b"\n")
                for span in loss:
                    text = unescaped(data[span["start"] : span["end"]])
                    learnt.update(text)
                    state[3] += len(text.decode())
                state[4] += len(data.decode())
                if last:
                    done.append((conv, state[2], turns.hexdigest(), state[3], learnt.hexdigest(), state[4]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
                done = []

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_chats(format_chats(rows.unionByName(added)))


OP6_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
shown AS (
  SELECT *, length(regexp_replace(role, e, '\1\\\2', 'g')) + length(regexp_replace(text, e, '\1\\\2', 'g')) + 23 AS n
  FROM said, (SELECT '([<\[])(\\*(?:\|chat\|>|\|/chat\|>|\|turn\|>|\|text\|>|\|end\|>|s>|/s>|INST\]|/INST\]))' AS e))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + 17)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
