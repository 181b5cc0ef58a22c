"""The ordered fold on a stream: events in any order, gaps, late and repeated events."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tracewright.streaming import event_log

LOG = "seq long, kind string, object_id string, version long, ts timestamp"


def fold():
    def remember(state, event):
        state["seen"] = state["seen"] + [event["seq"]]
        state["text"] = ",".join(map(str, state["seen"]))

    return {"set": remember}, lambda: {"seen": [], "text": ""}, "object_id string, text string"


FOLD = fold()


def streamed(spark, folder, batches, patience=None):
    """The final rows of a stream whose micro-batches are the given rows, in order."""
    for k, rows in enumerate(batches):
        timed = [(*r[:4], datetime.fromtimestamp(r[4] if len(r) > 4 else 0, UTC)) for r in rows]
        spark.createDataFrame(timed, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        stream = event_log.read_stream(spark, f"{folder}/log", LOG)
        got = event_log.final_states(event_log.ordered_replay(stream, *FOLD, patience), str(folder))
    return {r["object_id"]: (r["text"], r["folded"], r["waiting"], r["late"], r["skipped"]) for r in got.collect()}


def test_shuffled_batches_fold_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(10 * v, rng.choice(["set", "set", "other"]), o, v) for o in ("a", "b", "c") for v in range(1, 40)]
    expected = {o: ",".join(str(s) for s, kind, p, _ in rows if p == o and kind == "set") for o in ("a", "b", "c")}
    rng.shuffle(rows)
    got = streamed(spark, tmp_path, [rows[:70], rows[70:]])
    assert got == {o: (t, 39, 0, 0, 0) for o, t in expected.items()}
    batch = event_log.replay(spark.createDataFrame(rows, LOG.rpartition(", ")[0]), *FOLD).collect()
    assert {r["object_id"]: r["text"] for r in batch} == expected


def test_gaps_wait_and_late_events_are_counted(spark, tmp_path):
    first = [(1, "set", "a", 1), (3, "set", "a", 3), (3, "set", "a", 3), (9, "set", "b", 2), (8, "set", None, 1)]
    assert streamed(spark, tmp_path, [first]) == {"a": ("1", 1, 1, 1, 0), "b": ("", 0, 1, 0, 0)}
    assert streamed(spark, tmp_path, [[(2, "set", "a", 2), (1, "set", "a", 1)]])["a"] == ("1,2,3", 3, 0, 2, 0)


def test_patience_passes_a_gap(spark, tmp_path):
    got = streamed(spark, tmp_path, [[(1, "set", "a", 1, 1000), (4, "set", "a", 4, 1001), (9, "set", "a", 9, 1300)]], patience="10 seconds")
    assert got["a"] == ("1,4", 2, 1, 0, 2)  # the event of 1300 s moves the watermark, but waits for its own time
    got = streamed(spark, tmp_path, [[(2, "set", "a", 2, 1295), (7, "set", "b", 1, 1299)]], patience="10 seconds")
    assert got["a"] == ("1,4", 2, 1, 1, 2) and got["b"] == ("7", 1, 0, 0, 0)


def test_the_setting_of_the_session_stays(spark):
    before = spark.conf.get(event_log.PROVIDER)
    with pytest.raises(RuntimeError), event_log.with_rocksdb(spark):
        assert spark.conf.get(event_log.PROVIDER) == event_log.ROCKSDB
        raise RuntimeError
    assert spark.conf.get(event_log.PROVIDER) == before


def test_a_long_history_is_read_in_parts(spark):
    log = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("seq"), F.lit("set").alias("kind"), F.lit("a").alias("object_id"))

    def last(state, event):
        assert event["seq"] == state["n"]
        state["n"] += 1

    assert [tuple(r) for r in event_log.replay(log, {"set": last}, lambda: {"n": 0}, "object_id string, n long").collect()] == [("a", 200_000)]


class Store:
    """A state variable that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        acts = {
            "exists": lambda: None in self.held, "get": lambda: self.held[None], "update": lambda value: self.held.update({None: value}), "keys": lambda: iter(list(self.held)),
            "containsKey": self.held.__contains__, "getValue": self.held.get, "updateValue": self.held.__setitem__, "removeKey": self.held.pop,
        }

        def call(*args):
            self.calls += 1
            return acts[name](*args)

        return call


def test_waiting_events_are_stored_in_blocks():
    """A thousand events that wait take few calls to the store, each of which crosses from Python to the JVM."""
    import json

    from pyspark.sql import Row

    process = event_log.OrderedFold(*FOLD, False)
    process.fold, process.waiting = Store(), Store()
    rows = [(v, json.dumps({"seq": 10 * v, "kind": "set"}), 0) for v in range(1, 1001)]
    random.Random(6).shuffle(rows)
    rows = [*[r for r in rows if r[0] > 1], rows[5], *[r for r in rows if r[0] == 1]]
    for part in (rows[:300], rows[300:-1], rows[-1:]):
        (got,) = process.handleInputRows(("a",), iter([Row(version=v, event=e, at=at) for v, e, at in part]), None)
    assert list(got) == ["a", ",".join(str(10 * v) for v in range(1, 1001)), 1000, 0, 1, 0]
    assert process.waiting.held == {} and process.waiting.calls < 60
