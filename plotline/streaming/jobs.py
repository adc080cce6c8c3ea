"""The histories as streams: changes, states, windows of spending, queues.

State by key lives in value states of the RocksDB store, which keeps on disk what does not fit into memory and writes only what has changed to the
checkpoint; so a batch costs what its keys cost, however many keys there are. A restart goes on from the checkpoint.
"""

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


def _by_key(df: DataFrame, key: str):
    df.sparkSession.conf.set(STORE, ROCKSDB)
    return df.groupBy(key)


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _counted(df: DataFrame) -> DataFrame:
    """df with times as microseconds, which processors compare and keep without a time zone."""
    return df.select(*(F.unix_micros(f.name).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema))


def _timed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.timestamp_micros(c) for c in columns})


def _times(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if df.schema[c].dataType.typeName() == "timestamp"]


class PriceChanges(StatefulProcessor):
    """A key's last row taken; rows whose state differs from the one before go on."""

    def __init__(self, key: str, at: str, state: list[str], held: str, forget_ms: int | None):
        self.at, self.columns, self.held, self.forget_ms = at, state, held, forget_ms
        self.row = Row(key, at, *state)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.held, self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        order = lambda r: (r[self.at], *((r[c] is not None, r[c]) for c in self.columns))
        for r in sorted((r for r in rows if r[self.at] is not None), key=order):
            now = (r[self.at], *(r[c] for c in self.columns))
            if last is not None and now[0] < last[0]:
                continue
            if last is None or now[1:] != tuple(last[1:]):
                yield self.row(*key, *now)
            last = now
        if last is not None:
            self.last.update(tuple(last))

    def close(self) -> None:
        pass


def price_changes(events: DataFrame, key: str, at: str, state: list[str], forget: dt.timedelta | None = None) -> DataFrame:
    """A stream of the rows whose state differs from that of their key's row before.

    Rows of a batch are taken in the order of their time; a row older than the last one taken of its key is dropped, as the change it tells is past, and
    so is one without a time. forget: a key that has had no row for so long begins anew.
    """
    rows = _counted(events.select(key, at, *state))
    kept = _kinds(rows, [at, *state])
    processor = PriceChanges(key, at, state, kept, None if forget is None else int(forget.total_seconds() * 1000))
    got = _by_key(rows, key).transformWithState(processor, f"{_kinds(rows, [key])}, {kept}", "append", "none" if forget is None else "processingTime")
    return _timed(got, _times(events, [at, *state]))


class LastStates(StatefulProcessor):
    """For each column of a state the last known value and its place in the order; when the key was first and last heard of."""

    def __init__(self, key: str, order: list[str], state: list[str], places: str, kinds: dict[str, str]):
        self.order, self.columns, self.places, self.kinds = order, state, places, kinds
        self.row = Row(key, "created_at", "updated_at", *state)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.span = handle.getValueState("span", "created long, updated long")
        self.known = {c: handle.getValueState(f"known_{k}", f"{self.places}, value {self.kinds[c]}") for k, c in enumerate(self.columns)}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, last = self.span.get() if self.span.exists() else (None, None)
        held = {c: (tuple(s.get()) if s.exists() else None) for c, s in self.known.items()}
        before = (first, last, dict(held))
        rank = lambda place: tuple((x is not None, x) for x in place)
        for r in rows:
            place = tuple(r[c] for c in self.order)
            if place[0] is not None:
                first, last = (place[0], place[0]) if first is None else (min(first, place[0]), max(last, place[0]))
            for c in self.columns:
                if r[c] is not None and (held[c] is None or rank(place) >= rank(held[c][:-1])):
                    held[c] = (*place, r[c])
        if (first, last, held) == before:
            return  # a row that is late in everything changes nothing
        self.span.update((first, last))
        for c, value in held.items():
            if value is not None:
                self.known[c].update(value)
        yield self.row(*key, first, last, *(None if held[c] is None else held[c][-1] for c in self.columns))

    def close(self) -> None:
        pass


def last_states(events: DataFrame, key: str, at: list[str], state: list[str]) -> DataFrame:
    """A stream of key, created_at, updated_at and the last known value of each column of the state, of the keys that a batch has changed.

    at: the time and what decides between rows of one time. Late rows count where nothing later is known.
    """
    rows = _counted(events.select(key, *at, *state))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in state}
    shown = f"{_kinds(rows, [key])}, created_at long, updated_at long, {_kinds(rows, state)}"
    got = _by_key(rows, key).transformWithState(LastStates(key, at, state, _kinds(rows, at), kinds), shown, "update", "none")
    return _timed(got, ["created_at", "updated_at", *_times(events, state)])


def spending(calls: DataFrame, at: str, cost: str, window: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Cost in sliding windows; a window is final when the watermark has passed it."""
    w = calls.withWatermark(at, delay).groupBy(F.window(at, window, slide)).agg(F.sum(cost).alias("cost"), F.count("*").alias("calls"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "cost", "calls")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    w = events.withWatermark(at, delay).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class Silence(StatefulProcessor):
    """A timer for each service, set anew by every beat (_micros)."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _rings(self, at: int) -> int:
        return (at + self.micros) // 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max((r["_micros"] for r in rows if r["_micros"] is not None), default=None)
        if newest is not None:
            if self.last.exists():
                (before,) = self.last.get()
                self.handle.deleteTimer(self._rings(before))
                newest = max(newest, before)
            self.last.update((newest,))
            self.handle.registerTimer(self._rings(newest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (last,) = self.last.get()
        self.last.clear()
        yield Row(service=key[0], last_seen=last)

    def close(self) -> None:
        pass


def silent_services(beats: DataFrame, at: str = "updated_at", seconds: int = 180) -> DataFrame:
    """A row for each service when its heartbeats stop for longer than allowed, in event time."""
    rows = beats.select("service", at, F.unix_micros(at).alias("_micros")).withWatermark(at, "0 seconds")
    return _timed(_by_key(rows, "service").transformWithState(Silence(seconds), "service string, last_seen long", "append", "eventTime"), ["last_seen"])


def drain(requests: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Hands a queue over batch by batch: of what is there now, or every interval. The checkpoint makes a restart go on where it stopped."""
    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def state_log(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that keeps each batch of changed keys (as last_states gives) in a folder of its own. A batch that comes again takes the place of itself."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return keep


def logged_states(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The state of each key as of the newest batch that has it."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (key, "batch")]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(key, *(f"_s.{c}" for c in rest))


def compacted(spark: SparkSession, path: str, key: str, into: str) -> None:
    """Writes what the log says now as a log of one batch, named as the newest, to go on from in another folder."""
    newest = spark.read.parquet(path).agg(F.max("batch")).head()[0]
    logged_states(spark, path, key).write.parquet(f"{into}/batch={newest:012d}")
