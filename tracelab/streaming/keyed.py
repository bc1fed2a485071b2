"""Context memory as keyed state: each session's context, last turn and waiting turns live in a state store, by shards of sessions, not in tables that every batch reads again.

Turns are numbered from ``first`` without gaps. A turn that follows the last one is folded in at once. One that comes too early waits in the session's state for those before it, until
``patience`` has passed since the first of the waiting ones came; then the gap is given up and the waiting turns are folded in order. Turns that repeat, or come after their gap was
given up, are left out. A session that hasn't had a turn for ``idle`` is forgotten; one that comes back begins afresh.

A batch that runs again after a failure begins from the state before it, so what it gives is the same."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracelab.operators.context import EMPTY_CONTEXT
from tracelab.schemas import CONTEXT_FIELDS
from tracelab.sources.staging import shared_folder

OUT = T.StructType([T.StructField("session", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("context", EMPTY_CONTEXT), T.StructField("errors", T.ArrayType(T.StringType()))])
#: What the processor gives: a context is JSON of the fields that have facts.
FOLDED = "session string, turn long, context string, errors array<string>"
#: Sessions are dealt into so many shards, each a key of the state store: what a key costs (a call for each read and write, an Arrow batch) is shared by its sessions.
SHARDS = 4096
#: So many waiting turns of a session are kept beside its context; more of them are entries of a map.
BESIDE = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_facts(field: str, facts: list[str], patch: dict) -> tuple[list[str], list[str]]:
    """One field's facts after a patch, and errors: the rules of ``operators.context.merge_field``."""
    add, remove = ((patch.get(k) or {}).get(field) or [] for k in ("add", "remove"))
    replace = (patch.get("replace") or {}).get(field) or []
    facts, errors, gone = list(facts), [], {p["old"] for p in replace}
    for p in replace:
        if p["old"] in remove:
            errors.append(f"{field}: replace/remove conflict: {p['old']}")
        elif p["old"] not in facts:
            errors.append(f"{field}: replace.old not found: {p['old']}")
        else:
            facts[facts.index(p["old"])] = p["new"]
    for fact in remove:
        if fact in gone:
            continue
        if fact in add:
            errors.append(f"{field}: add/remove conflict: {fact}")
        elif fact in facts:
            facts.remove(fact)
    return list(dict.fromkeys(facts + [x for x in add if x not in remove])), errors


def _merged(context: dict, patch: dict) -> tuple[dict, list[str]]:
    """A context, without its empty fields, after a patch, and errors."""
    named = {f for part in patch.values() if part for f, v in part.items() if v}
    parts = {f: merge_facts(f, context.get(f, []), patch) for f in CONTEXT_FIELDS if f in named}
    context = context | {f: v for f, (v, _) in parts.items()}
    return {f: v for f, v in context.items() if v}, [e for _, own in parts.values() for e in own]


@dataclass
class Session:
    """The last turn, the context, waiting turns (patch and committed by turn), how many more wait in the map, and when the gap and the time without turns end, or 0."""

    last: int
    context: dict = field(default_factory=dict)
    waiting: dict = field(default_factory=dict)
    more: int = 0
    gap: int = 0
    idle: int = 0

    def waits(self) -> bool:
        return bool(self.waiting or self.more)


class Contexts(StatefulProcessor):
    """A key is a shard of sessions, its state one value: JSON of its sessions, and the one timer, for the first of their ends."""

    def __init__(self, first: int, patience_ms: int | None, idle_ms: int | None):
        self.first, self.patience, self.idle = first, patience_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "sessions string, timer long")
        self.more = handle.getMapState("more", "session string, turn long", "patch string, committed boolean")

    def _load(self) -> tuple[dict[str, Session], int]:
        if not self.known.exists():
            return {}, 0
        sessions, timer = self.known.get()
        own = {k: Session(*x) for k, x in json.loads(sessions).items()}
        for s in own.values():
            s.waiting = {int(t): x for t, x in s.waiting.items()}
        return own, timer

    def _save(self, sessions: dict[str, Session], timer: int) -> None:
        """Writes the state and sets the timer."""
        at = min((t for s in sessions.values() for t in (s.gap, s.idle) if t), default=0)
        if timer and at != timer:
            self.handle.deleteTimer(timer)
        if at and at != timer:
            self.handle.registerTimer(at)
        self.known.update((json.dumps({k: astuple(s) for k, s in sessions.items()}, ensure_ascii=False), at))

    def _take(self, key: str, s: Session, turn: int) -> tuple | None:
        """A waiting turn, which waits no longer."""
        if turn in s.waiting:
            return s.waiting.pop(turn)
        if s.more and self.more.containsKey((key, turn)):
            found = self.more.getValue((key, turn))
            self.more.removeKey((key, turn))
            s.more -= 1
            return found
        return None

    def _fold(self, key: str, s: Session, over_gaps: bool) -> list[tuple]:
        """Folds in the waiting turns that follow the last one; with over_gaps, all."""
        rows = []
        ahead = iter(sorted([*s.waiting, *(t for k, t in (self.more.keys() if s.more else ()) if k == key)])) if over_gaps else None
        while (turn := next(ahead, None) if over_gaps else s.last + 1) is not None:
            found = self._take(key, s, turn)
            if found is None:
                break
            patch, committed = found
            errors: list[str] = []
            if committed:
                s.context, errors = _merged(s.context, json.loads(patch) or {})
            rows.append((key, turn, json.dumps(s.context, ensure_ascii=False), errors))
            s.last = turn
        return rows

    def _settle(self, key: str, s: Session, now: int) -> None:
        """The ends of the gap and of the time without turns, after rows; waiting turns beyond BESIDE go to the map."""
        for turn in sorted(s.waiting)[BESIDE:]:
            self.more.updateValue((key, turn), tuple(s.waiting.pop(turn)))
            s.more += 1
        s.gap = 0 if not s.waits() or self.patience is None else s.gap or now + self.patience
        s.idle = 0 if self.idle is None else now + self.idle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.patience or self.idle else 0
        sessions, timer = self._load()
        seen: set[str] = set()
        for frame in rows:
            for k, turn, patch, committed in zip(frame["session"], frame["turn"].tolist(), frame["patch"], frame["committed"].tolist(), strict=True):
                s = sessions.get(k) or sessions.setdefault(k, Session(self.first - 1))
                seen.add(k)
                if turn > s.last and turn not in s.waiting and not (s.more and self.more.containsKey((k, turn))):
                    s.waiting[turn] = (patch or "null", committed)
        out = []
        for k in seen:
            out += self._fold(k, sessions[k], False)
            self._settle(k, sessions[k], now)
        self._save(sessions, timer)
        yield pd.DataFrame(out, columns=OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        sessions, timer = self._load()
        out = []
        for k, s in list(sessions.items()):
            if (s.gap and now >= s.gap) or (s.idle and now >= s.idle):
                out += self._fold(k, s, True)
                s.gap = 0
            if s.idle and now >= s.idle:
                del sessions[k]
        self._save(sessions, 0 if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)  # one that has fired goes by itself
        yield pd.DataFrame(out, columns=OUT.names)

    def close(self) -> None:
        pass


def _short(patch: Column) -> Column:
    """JSON of a patch without the fields that change nothing."""
    part = lambda k: F.struct(*(F.when(F.size(patch[k][f]) > 0, patch[k][f]).alias(f) for f in CONTEXT_FIELDS)).alias(k)
    return F.when(patch.isNotNull(), F.to_json(F.struct(*map(part, ("add", "replace", "remove")))))


def remembered(patches: DataFrame, first: int = 1, patience: str | None = "10 minutes", idle: str | None = "1 day", shards: int = SHARDS) -> DataFrame:
    """patches: a stream of session, turn, patch and committed (``sessions.PATCHES``). A stream of OUT rows, one for each turn, with the context after it. Needs the state store on disk:
    spark.sql.streaming.stateStore.providerClass must name RocksDB's. Rows without session or turn are left out. A batch reads and writes
    the shards that it has rows of, so that with far more than a thousand sessions for each shard more shards are due; a checkpoint keeps its number.

    With a time to be patient or idle the query has timers and runs batches for them without end. Without either it has none: gaps are waited for, sessions kept, and a query over what is
    available now ends."""
    if patches.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    ms = lambda text: None if text is None else int(pd.Timedelta(text).total_seconds() * 1000)
    mode = "None" if patience is None and idle is None else "ProcessingTime"
    own = patches.where("session IS NOT NULL AND turn IS NOT NULL").select(F.pmod(F.xxhash64("session"), F.lit(shards)).alias("shard"), "session", "turn", _short(F.col("patch")).alias("patch"), F.coalesce("committed", F.lit(False)).alias("committed"))
    folded = own.groupBy("shard").transformWithStateInPandas(Contexts(first, ms(patience), ms(idle)), FOLDED, "Append", mode)
    found = F.from_json("context", EMPTY_CONTEXT)
    context = F.struct(*(F.coalesce(found[f], F.array().cast("array<string>")).alias(f) for f in CONTEXT_FIELDS))
    return folded.select("session", "turn", context.alias("context"), "errors")


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """RocksDB's state store for queries that are started here; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold_files(patches: DataFrame, batches: int = 2) -> DataFrame:
    """patches, a table of ``sessions.PATCHES`` rows, folded as a stream of so many batches of files in no order: written, streamed through the state store to its end, and read again.
    The number of files follows ``spark.sql.shuffle.partitions``."""
    spark = patches.sparkSession
    folder = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    each = max(2, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches))
    patches.repartition(batches * each).write.parquet(f"{folder}/in")
    with state_on_disk(spark):
        stream = remembered(spark.readStream.schema(patches.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/in"), patience=None, idle=None)
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
