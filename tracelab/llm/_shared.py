"""What the operators share: tables, the shared folder, written intermediate tables, word splitting and hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of letters.
LETTERS = re.compile(r"[^\W\d_]+")
#: White space by Unicode's property, for a character class; str.isspace() also has U+001C to U+001F.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Rows in one Arrow batch; with long texts the default of 10,000 would be too large for a Python worker.
BATCH_ROWS = 1000
#: Bytes in one Arrow batch, for rows that are long.
BATCH_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in local tests, a folder of the session's own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tracelab-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and later jobs read the same rows."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What make() gives, kept in this process until another key is asked for: tasks of one query that share a worker also share its caches."""
    if key not in _HELD:
        gc.set_threshold(50_000, 20, 100)  # else full collections walk what is kept again and again
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as it takes to be no column's, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes, in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_BLANK = np.isin(np.arange(256), [*range(9, 14), 32])


def after_spaces(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where stretches begin: at a space before anything but white space, so that white space before it is whole, and around a line end between
    printed characters. ends: where rows end in data, UTF-8."""
    following = np.append(data[1:], np.uint8(32))
    following[ends - 1] = 32
    at = np.flatnonzero(((data == 32) | (data == 10)) & ~_BLANK[following])
    a, b = following[at], data[np.minimum(at + 2, len(data) - 1)]
    other = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    at = at[~other]  # not before what may be white space beyond ASCII
    line = at[data[at] == 10]
    line = line[line > 0]
    line = line[(data[line - 1] > 32) & (data[line - 1] < 127)]
    return np.concatenate([at[data[at] == 32], line, line + 1])


def at_blanks(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where stretches begin: at white space of ASCII."""
    return np.flatnonzero(_BLANK[data])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty), one after another, and where each begins and the last one ends."""
    column = pc.fill_null(column.cast(pa.string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def stretched(column: pa.Array, begin: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The texts of column cut into stretches: the different ones, for each stretch which it is, and how many stretches end before each row and the last one's end."""
    column = pc.fill_null(column.cast(pa.string()), "")
    if not len(column):
        return [], np.empty(0, np.int64), np.zeros(1, np.int64)
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return [], np.empty(0, np.int64), np.zeros(len(column) + 1, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[begin(data, offsets[1:][offsets[1:] > offsets[:-1]])] = True
    at = np.flatnonzero(cut)
    own = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return own.dictionary.to_numpy(zero_copy_only=False).tolist(), own.indices.to_numpy().astype(np.int64), np.searchsorted(at, offsets)


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most so many bytes of text (or one row) and rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        stop = min(max(stop, at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def rows_of(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array with the bytes of flat between ends."""
    size = flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


class Kept:
    """What is known of stretches: a row number for each, and values of different lengths, row after row; about ``most`` rows, then afresh."""

    def __init__(self, most: int, kind: type):
        self.most, self.kind = most, kind
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, self.kind), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def numbers(self, stretches: list[bytes], learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Row numbers; learn gives the values of those that are new, one after another, and how many each has."""
        if len(self.number) > self.most:
            self.clear()
        out = np.fromiter((self.number.get(s, -1) for s in stretches), np.int64, len(stretches))
        new = np.flatnonzero(out < 0)
        if len(new):
            keys = [stretches[i] for i in new.tolist()]
            values, lengths = learn(keys)
            had, have = len(self.number), len(self.number) + len(keys)
            while self.used + len(values) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while have > len(self.start):
                self.start, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length))
            self.flat[self.used : self.used + len(values)] = values
            self.start[had:have] = self.used + np.cumsum(lengths) - lengths
            self.length[had:have] = lengths
            self.used += len(values)
            self.number.update(zip(keys, range(had, have)))
            out[new] = np.arange(had, have)
        return out

    def rows(self, which: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of rows, one after another, and where the values of each group of rows end; before: rows before each group and its end."""
        n = self.length[which]
        return self.flat[spread(self.start[which], n)], np.concatenate([[0], np.cumsum(n)])[before]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
