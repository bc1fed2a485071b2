import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracelab.operators import generation, rounds
from tracelab.sources import backends, memo, published


def counting(log, dies_in=None, flag=None):
    """A backend that writes each call to a file and, in a round, takes its worker down while the flag is there."""
    import json
    import os

    class Talker:
        def complete(self, role, messages, seed):
            m = json.loads(messages)
            if m["round"] == dies_in and os.path.exists(flag):
                os._exit(7)
            with open(log, "a") as f:
                f.write(json.dumps([role, m["conversation"], m["round"]]) + "\n")
            if role == "seeker_simulator" and m["conversation"] == "fail" and m["round"] == 2:
                raise OSError("down")
            if role == "dialogue_manager":
                return json.dumps({"mode": "closing" if m["conversation"] == "short" and m["round"] == 2 else "supporting"})
            return json.dumps({"text": f"{m['conversation']} {m['round']} {len(m['public'])}", "strategy": "Question"})

    return lambda: Talker()


def test_whole_rounds_are_asked_for_once(spark, tmp_path):
    log, flag = str(tmp_path / "log"), str(tmp_path / "flag")
    Path(flag).touch()
    own = spark.createDataFrame([("short",), ("long",), ("fail",)], "conversation_id string").repartition(2)
    told = []
    folder = str(tmp_path / "out")
    with pytest.raises(Exception, match="."):
        rounds.converse(own, counting(log, 3, flag), folder, (1, 3, 5), on_round=told.append)
    assert [(t["round"], t["open"], t["completed"], t["failed"]) for t in told] == [(1, 3, 0, 0), (2, 1, 1, 1)]
    Path(flag).unlink()
    with pytest.raises(FileExistsError):
        rounds.converse(own, counting(log), folder, (1, 3, 5))
    with pytest.raises(ValueError, match="limits"):
        rounds.converse(own, counting(log), folder, (1, 3, 6), resume=True)
    got = rounds.converse(own, counting(log), folder, (1, 3, 5), resume=True, on_round=told.append)
    asked = [json.loads(x) for x in Path(log).read_text().splitlines()]
    assert all(asked.count(x) == 1 for x in asked if x[2] < 3) and {x[2] for x in asked} == {1, 2, 3, 4, 5}
    assert [t["round"] for t in told] == [1, 2, 3, 4, 5]
    # the same rows as the loop that runs a conversation in one go
    want = generation.generate(own, counting(str(tmp_path / "other")), (1, 3, 5))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    again = rounds.converse(own, counting(log), folder, (1, 3, 5), resume=True)
    assert again.count() == 3 and len(Path(log).read_text().splitlines()) == len(asked)


def test_rounds_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "conversation_id string")
    assert rounds.converse(none, backends.Scripted, str(tmp_path / "a")).count() == 0


def echo(log):
    import json

    class Echo:
        def complete(self, role, messages, seed):
            with open(log, "a") as f:
                f.write(f"{messages}\n")
            if messages == "[3]":
                raise OSError("down")
            return json.dumps({"text": f"{role}{messages}{seed}"})

    return lambda: Echo()


def test_equal_requests_make_one_call_and_a_second_run_none(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "cache")
    asked = spark.range(40).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit("judge").alias("role"), F.concat(F.lit("["), (F.col("id") % 4).cast("string"), F.lit("]")).alias("messages"), F.lit(None).cast("long").alias("seed"))
    first = {r.request_id: r for r in memo.memoised(asked, echo(log), folder, attempts=1).collect()}
    calls = Path(log).read_text().split()
    assert len(first) == 40 and sorted(calls) == ["[0]", "[1]", "[2]", "[3]"]
    assert first["r1"].reply == first["r5"].reply and not first["r1"].cached
    assert first["r3"].reply is None and "down" in first["r3"].error
    second = {r.request_id: r for r in memo.memoised(asked.where("messages <> '[3]'"), echo(log), folder).collect()}
    assert Path(log).read_text().split() == calls  # no call
    assert all(r.cached and r.reply == first[k].reply for k, r in second.items()) and len(second) == 30
    memo.memoised(asked, echo(log), folder, attempts=1).count()
    assert Path(log).read_text().split() == [*calls, "[3]"]  # what failed is tried again
    more = asked.limit(1).select("request_id", F.lit("writer").alias("role"), "messages", "seed")
    memo.memoised(more, echo(log), folder).count()
    before = sorted(map(tuple, memo.cached(spark, folder).collect()))
    assert memo.compact(spark, folder) == 2 and memo.compact(spark, folder) == 0
    assert sorted(map(tuple, memo.cached(spark, folder).collect())) == before and len(before) == 4
    assert memo.cached(spark, str(tmp_path / "none")).count() == 0


def test_cache_parts_without_a_record_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "cache")
    row = spark.createDataFrame([("k", "b")], "call_key string, payload string")
    memo.keep(row, folder)
    row.select("call_key", F.lit("a").alias("payload"), F.lit(0).alias("bucket")).write.parquet(f"{folder}/part-unfinished")
    assert [tuple(r) for r in memo.cached(spark, folder).collect()] == [("k", "b")]
    memo.keep(row.withColumn("payload", F.lit("a")), folder)  # two writers made the same call
    assert [tuple(r) for r in memo.cached(spark, folder).collect()] == [("k", "a")]


@pytest.mark.parametrize("lines", [False, True])
def test_published_once_and_checked(spark, tmp_path, lines):
    path = str(tmp_path / "out")
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("x"), "id")).alias("text")).repartition(3)
    record = published.publish(df, path, lines, {"seed": 4})
    assert record["rows"] == 100 and len(record["files"]) == 3 and published.commit_of(spark, path)["seed"] == 4
    assert published.read_published(spark, path).exceptAll(df).isEmpty() and published.problems(spark, path) == []
    with pytest.raises(FileExistsError):
        published.publish(df, path, lines)
    folder = Path(path) / f"data-{record['writer']}"
    (Path(path) / "data-other").mkdir()
    name = sorted(record["files"])[1]
    whole = (folder / name).read_bytes()
    (folder / name).write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    assert published.problems(spark, path) == [f"{name} was changed"]
    (folder / name).unlink()
    (folder / "part-zz").write_bytes(b"x")
    assert published.problems(spark, path) == [f"{name} is gone", "part-zz was added"]
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, str(tmp_path / "no"))


def test_of_writers_that_race_one_wins(spark, tmp_path):
    path, won, lost = str(tmp_path / "out"), [], []
    barrier = threading.Barrier(4)

    def write(i):
        barrier.wait()
        try:
            won.append(published.publish(spark.range(i + 1), path)["rows"])
        except FileExistsError:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3
    assert published.read_published(spark, path).count() == won[0] and published.problems(spark, path) == []


def test_table_digest_takes_no_notice_of_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    same = a.repartition(3).orderBy(F.desc("a")).select("b", "a")
    assert published.table_digest(a) == published.table_digest(same)
    for other in (a.distinct(), a.where("a = 2"), a.withColumn("b", F.lit("")), a.limit(0)):
        assert published.table_digest(other) != published.table_digest(a)
