import random
import time

import pytest
from pyspark.sql import functions as F

from tracelab.operators import context as C
from tracelab.schemas import CONTEXT_FIELDS, PATCH
from tracelab.streaming import keyed, sessions


@pytest.fixture
def rocks(spark):
    with keyed.state_on_disk(spark):
        yield spark


def patches(n_sessions, n_turns, seed):
    random.seed(seed)
    pick = lambda n: [random.choice("abcdef") for _ in range(random.randint(0, n))]
    pairs = lambda: [{"old": x, "new": y} for x, y in zip(pick(2), pick(2), strict=False)]
    empty = {f: [] for f in CONTEXT_FIELDS}
    each = lambda make: empty | {f: make() for f in random.sample(CONTEXT_FIELDS, 3)}
    make = lambda: None if random.random() < 0.05 else {"add": each(lambda: pick(3)), "replace": each(pairs), "remove": each(lambda: pick(2))}
    return [(f"s{k}", t, make(), random.random() < 0.8) for k in range(n_sessions) for t in range(1, n_turns + 1)]


def test_merge_equals_the_columns(spark):
    """The rule as Python and as columns, on random patches of one field."""
    random.seed(8)
    pick = lambda n: [random.choice("abcd") for _ in range(random.randint(0, n))]
    rows = [(pick(3), pick(3), [{"old": x, "new": y} for x, y in zip(pick(3), pick(3), strict=False)], pick(3)) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, values array<string>, add array<string>, replace array<struct<old:string,new:string>>, remove array<string>")
    got = df.select("i", C.merge_field("x", *(F.col(c) for c in ("values", "add", "replace", "remove"))).alias("m")).orderBy("i").collect()
    for r, (facts, add, replace, remove) in zip(got, rows, strict=True):
        assert keyed.merge_facts("x", facts, {"add": {"x": add}, "replace": {"x": replace}, "remove": {"x": remove}}) == (r.m["values"], r.m["errors"])


def test_late_and_repeated_turns_over_a_restart(rocks, tmp_path):
    """Turns out of order, twice, and in files that come after a restart: what batch folding gives."""
    spark, rows = rocks, patches(4, 6, 9)
    order = random.sample(rows, len(rows))
    parts = [order[:8] + order[:2], order[8:16] + order[3:6], order[16:] + order[:4]]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in parts:  # each time a query of its own, from the checkpoint
        spark.createDataFrame(part, sessions.PATCHES).coalesce(1).write.mode("append").json(src)
        stream = keyed.remembered(spark.readStream.schema(sessions.PATCHES).json(src), patience=None, idle=None)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    read = lambda df: sorted((r.session, r.turn, r.context, r.errors) for r in df.select("session", "turn", "context", "errors").collect())
    assert read(spark.read.parquet(out)) == read(C.fold_contexts(spark.createDataFrame(rows, sessions.PATCHES), "session", "turn"))


def test_gaps_are_given_up_and_idle_sessions_forgotten(rocks, tmp_path):
    spark = rocks
    fact = lambda x: {"add": {f: [x] if f == CONTEXT_FIELDS[0] else [] for f in CONTEXT_FIELDS}, "replace": None, "remove": None}
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([], sessions.PATCHES).write.json(src)
    stream = keyed.remembered(spark.readStream.schema(sessions.PATCHES).json(src), patience="2 seconds", idle="9 seconds")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="500 milliseconds").start()
    seen = lambda: {(r.session, r.turn): r.context[CONTEXT_FIELDS[0]] for r in spark.read.schema(keyed.OUT).parquet(out).collect()} if query.lastProgress else {}

    def until(key):
        end = time.time() + 60
        while key not in (now := seen()) and time.time() < end:
            assert query.isActive
            time.sleep(0.5)
        return now

    put = lambda *rows: spark.createDataFrame(rows, sessions.PATCHES).coalesce(1).write.mode("append").json(src)
    try:
        put(("s", 1, fact("a"), True), ("s", 3, fact("c"), True))
        assert until(("s", 1)) == {("s", 1): ["a"]}
        assert until(("s", 3))["s", 3] == ["a", "c"]  # the gap was given up
        put(("s", 2, fact("b"), True), ("s", 4, fact("d"), True))  # 2 is too late now
        now = until(("s", 4))
        assert now["s", 4] == ["a", "c", "d"] and ("s", 2) not in now
        time.sleep(11)
        put(("other", 1, fact("x"), True))  # a batch in which the timer of the idle session has passed
        until(("other", 1))
        time.sleep(3)
        put(("s", 1, fact("again"), True))
        end = time.time() + 60
        while time.time() < end and not spark.read.schema(keyed.OUT).parquet(out).where(f"turn = 1 AND array_contains(context.{CONTEXT_FIELDS[0]}, 'again')").count():
            time.sleep(0.5)
        assert spark.read.schema(keyed.OUT).parquet(out).where(f"turn = 1 AND context.{CONTEXT_FIELDS[0]} = array('again')").count() == 1
    finally:
        query.stop()


def test_the_state_store_must_be_on_disk(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'s' AS session", "value AS turn", f"CAST(NULL AS {PATCH.simpleString()}) AS patch", "true AS committed")
    with pytest.raises(ValueError, match="providerClass"):
        keyed.remembered(stream)


def test_a_key_of_the_store_holds_many_sessions(rocks, tmp_path):
    """What a key costs, calls and a batch, is shared: 3,000 sessions are at most as many keys as there are shards; turns that wait beyond those beside a context keep their order."""
    spark, rows = rocks, [(f"s{k}", t, None, True) for k in range(3000) for t in (2, 1)]
    fact = lambda x: {"add": {f: [x] for f in CONTEXT_FIELDS}, "replace": None, "remove": None}
    late = [("long", t, fact(str(t % 7)), True) for t in range(keyed.BESIDE * 2, 0, -1)]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    held = []
    for part in (rows[::2] + late[:-1], rows[1::2] + late[-1:] + late[:3]):  # every session's second turn comes first
        spark.createDataFrame(part, sessions.PATCHES).coalesce(1).write.mode("append").json(src)
        stream = keyed.remembered(spark.readStream.schema(sessions.PATCHES).json(src), patience=None, idle=None, shards=16)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(sum(o["numRowsTotal"] for p in query.recentProgress[-1:] for o in p["stateOperators"]))
    assert held[0] <= 16 + len(late) and held[1] <= 16
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.where("session <> 'long'").select("session", "turn").collect())) == sorted(x[:2] for x in rows)
    read = lambda df: sorted((r.turn, r.context, r.errors) for r in df.select("turn", "context", "errors").collect())
    assert read(got.where("session = 'long'")) == read(C.fold_contexts(spark.createDataFrame(late, sessions.PATCHES), "session", "turn"))
