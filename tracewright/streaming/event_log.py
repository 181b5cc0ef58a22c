"""Append-only event logs: tails, queries, ordered folds, windows; the same functions serve batches and streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType


def from_events(events: DataFrame) -> DataFrame:
    """The events table as a log: seq, kind, message, source, object_id, data."""
    return events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("event_type").alias("message"), F.lit("table").alias("source"), F.col("user_id").cast("string").alias("object_id"), F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("props"), F.col("props")).alias("data"))


def since(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") > seq)


def query(log: DataFrame, kind: str | None = None, source: str | None = None, object_id: str | None = None, text: str = "") -> DataFrame:
    out = log
    for name, value in (("kind", kind), ("source", source), ("object_id", object_id)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.where(F.contains(F.lower("message"), F.lit(text.lower()))) if text else out


def metrics(log: DataFrame) -> DataFrame:
    return log.groupBy("kind").agg(F.count("*").alias("n"))


def latest(log: DataFrame) -> DataFrame:
    """(object_id, events, kind, seq): how often each object was touched, and its last event."""
    last = F.max(F.struct("seq", "kind"))
    return log.groupBy("object_id").agg(F.count("*").alias("events"), last.alias("l")).select("object_id", "events", "l.kind", "l.seq")


def issues(log: DataFrame) -> DataFrame:
    tests = [(F.col("seq") <= 0, "EVENT_BAD_SEQUENCE"), (F.trim("kind") == "", "EVENT_EMPTY_KIND"), (F.trim("message") == "", "EVENT_EMPTY_MESSAGE")]
    return log.select("seq", F.explode(F.array_compact(F.array(*[F.when(t, c) for t, c in tests]))).alias("code"))


Handlers = dict[str, Callable[[dict, dict], None]]


def replay(log: DataFrame, handlers: Handlers, start: Callable[[], dict], schema: str) -> DataFrame:
    """Fold the events of each object in order of seq; the final state, as a row of schema, per object.

    Handlers change the state in place; events without a handler are skipped. A task reads the events of its objects one after another,
    sorted by Spark, and holds one state, however long a history is.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, done = None, None, []
        result = lambda: [at if n == "object_id" else state.get(n) for n in names]
        for part in parts:
            for event in part.to_dict("records"):
                if state is None or event["object_id"] != at:
                    if state is not None:
                        done.append(result())
                    at, state = event["object_id"], start()
                if (handle := handlers.get(event["kind"])) is not None:
                    handle(state, event)
            if done:
                yield pd.DataFrame(done, columns=names)
                done = []
        if state is not None:
            yield pd.DataFrame([result()], columns=names)

    return log.where("object_id is not null").repartition("object_id").sortWithinPartitions("object_id", "seq").mapInPandas(run, schema)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the ordered fold tells about itself besides the state.
PROGRESS = "folded long, waiting long, late long, skipped long"


class OrderedFold(StatefulProcessor):
    """Folds the events of an object in order of their versions 1, 2, 3, ..., in whatever order they come.

    An event that comes too early waits in the state store until those before it are there, with those of versions near its own: a block of
    them is read and written at once, as a call to the store costs far more than a fold. Timed, a gap is passed over when the watermark
    has reached the first event behind it; what comes after its turn, a repeated event as well, is counted as late and not folded.
    """

    BLOCK = 256  # versions
    ROWS = 2_000  # sorted at once

    def __init__(self, handlers: Handlers, start: Callable[[], dict], schema: str, timed: bool):
        self.handlers, self.start, self.timed = handlers, start, timed
        self.names = [f.split()[0] for f in schema.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "next long, waiting long, late long, skipped long, folded long, state string, timer long")
        self.waiting = handle.getMapState("waiting", "block long", "events string")

    def _load(self) -> None:
        self.next, self.n_waiting, self.late, self.skipped, self.folded, state, self.timer = self.fold.get() if self.fold.exists() else (1, 0, 0, 0, 0, None, 0)
        self.state = json.loads(state) if state else self.start()
        self.at, self.events, self.stored, self.changed = None, {}, False, False

    def _block(self, version: int) -> dict[str, list]:
        """The waiting events, by version, of the block that holds a version; one block is in memory at a time."""
        block = version // self.BLOCK
        if block != self.at:
            self._save()
            told = self.waiting.getValue((block,)) if self.n_waiting and self.waiting.containsKey((block,)) else None
            self.at, self.events, self.stored, self.changed = block, json.loads(told[0]) if told else {}, told is not None, False
        return self.events

    def _save(self) -> None:
        if self.changed and self.events:
            self.waiting.updateValue((self.at,), (json.dumps(self.events),))
            self.stored = True
        elif self.changed and self.stored:
            self.waiting.removeKey((self.at,))
            self.stored = False
        self.changed = False

    def _apply(self, event: str) -> None:
        told = json.loads(event)
        if (handle := self.handlers.get(told.get("kind"))) is not None:
            handle(self.state, told)
        self.next, self.folded = self.next + 1, self.folded + 1

    def _drain(self) -> None:
        while self.n_waiting and (told := self._block(self.next).pop(str(self.next), None)) is not None:
            self.changed = True
            self.n_waiting -= 1
            self._apply(told[0])

    def _done(self, key: tuple) -> Iterator[Row]:
        self._save()
        self.fold.update((self.next, self.n_waiting, self.late, self.skipped, self.folded, json.dumps(self.state), self.timer))
        told = {"object_id": key[0], "folded": self.folded, "waiting": self.n_waiting, "late": self.late, "skipped": self.skipped}
        yield Row(**{n: key[0] if n == "object_id" else self.state.get(n) for n in self.names}, **{n: told[n] for n in (p.split()[0] for p in PROGRESS.split(", "))})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        self._load()
        while part := list(islice(rows, self.ROWS)):
            for version, event, at in sorted((r["version"], r["event"], r["at"]) for r in part):
                if version < self.next:
                    self.late += 1
                elif version == self.next:
                    self._apply(event)
                    self._drain()
                elif str(version) in self._block(version):
                    self.late += 1
                else:
                    self._block(version)[str(version)] = event, at
                    self.changed = True
                    self.n_waiting += 1
        self._wait()
        yield from self._done(key)

    def _first(self) -> tuple[int, int]:
        """The version and the time of the first waiting event."""
        self._save()
        version = min(map(int, self._block(min(block for (block,) in self.waiting.keys()) * self.BLOCK)))
        return version, self.events[str(version)][1]

    def _wait(self) -> None:
        """Have the gap before the first waiting event passed over in time."""
        if self.timed and self.n_waiting and not self.timer:
            self.timer = max(1, self._first()[1])
            self.handle.registerTimer(self.timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self._load()
        self.timer = 0
        if self.n_waiting:
            first, at = self._first()
            if at <= expiredTimerInfo.getExpiryTimeInMs():  # else the gap has been closed meanwhile
                self.skipped, self.next = self.skipped + first - self.next, first
                self._drain()
        self._wait()
        yield from self._done(key)

    def close(self) -> None:
        pass


def ordered_replay(log: DataFrame, handlers: Handlers, start: Callable[[], dict], schema: str, patience: str | None = None, time: str = "ts") -> DataFrame:
    """replay() on a stream whose rows bear a version, from 1 in each object: a row of schema and of PROGRESS whenever an object changes.

    The state must be plain values that JSON holds. Needs the RocksDB state store, see with_rocksdb(); memory holds one state, one
    block and 2,000 rows, what else waits is in the store. With patience, an interval, a gap is passed over when events that much later than the one behind
    it (by the column time) have come; events that come later than that are Spark's late data and dropped. Events without an object or a
    version can't be placed and are left out.
    """
    placed = log.where("object_id is not null and version is not null")
    event = F.to_json(F.struct(*log.columns)).alias("event")
    if patience is None:
        coded = placed.select("object_id", F.col("version").cast("bigint").alias("version"), event, F.lit(0).cast("bigint").alias("at"))
    else:
        coded = placed.withWatermark(time, patience).select("object_id", F.col("version").cast("bigint").alias("version"), event, F.unix_millis(time).alias("at"), time)
    fold = OrderedFold(handlers, start, schema, patience is not None)
    return coded.groupBy("object_id").transformWithState(fold, f"{schema}, {PROGRESS}", "Update", "None" if patience is None else "EventTime")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's setting is as before afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def final_states(stream: DataFrame, folder: str, key: str = "object_id", order: str = "folded") -> DataFrame:
    """Run a stream of updates until its source has no more, and give the last row of each key: that of the greatest order."""
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch}")

    with with_rocksdb(spark):
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch", IntegerType())])).parquet(f"{folder}/updates")
    last = F.max_by(F.struct(*stream.columns), F.struct(order, "batch"))
    return rows.groupBy(key).agg(last.alias("last")).select("last.*")


def versions(log: DataFrame) -> DataFrame:
    """log with version: the place, from 1, of each event in its object's history."""
    from pyspark.sql import Window

    return log.withColumn("version", F.row_number().over(Window.partitionBy("object_id").orderBy("seq")))


def replay_stream(log: DataFrame) -> DataFrame:
    """The fold of latest() on a stream: one row for each object whenever it changes, with state kept per object."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events, seq, kind = state.get if state.exists else (0, -1, None)
        for part in parts:
            events += len(part)
            top = part.loc[part["seq"].idxmax()]
            if int(top["seq"]) > seq:
                seq, kind = int(top["seq"]), str(top["kind"])
        state.update((events, seq, kind))
        yield pd.DataFrame([(key[0], events, kind, seq)], columns=["object_id", "events", "kind", "seq"])

    return log.groupBy("object_id").applyInPandasWithState(run, "object_id string, events long, kind string, seq long", "events long, seq long, kind string", "update", GroupStateTimeout.NoTimeout)


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events with a zoned time (session zone), and a watermark for streams."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if late else out


def tumbling(events: DataFrame, size: str, slide: str | None = None, late: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(keys, start, n, total) for each window of fixed size; with slide the windows overlap."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return timed(events, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, key: str = "user_id") -> DataFrame:
    """(key, start, end, n): runs of events with no pause as long as the gap."""
    return timed(events, late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
