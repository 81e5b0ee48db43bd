"""Keyed state with timers: a sliding request counter, and job status with a stalled-job alarm and expiry.

A key's state is one row (of the job tracker's, that of a bucket of entities). Timers run on event time, so that a replay of old events gives what the live stream gave. Both processors need the
RocksDB state store, which ``keyed_state`` sets for the streams started inside it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import ref
from ..session import new_folder
from ..sources.files import stream_dataset
from .events import STATUS_OF, append_to, mapped

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

COUNTED = "client string, second long, requests long, in_window long"
TRACKED = "kind string, entity string, status string, at timestamp"

#: Entities are kept in so many buckets; a bucket's state is read and written whole when one of its entities moves.
BUCKETS = 1_024


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


class SlidingCounter(StatefulProcessor):
    """Requests of a client in the trailing window of every second, given out once no request of that second can come any more.

    The state holds the counted seconds that a later window still sees, and the last second given out.
    """

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window = limit, window_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "seconds array<bigint>, counts array<bigint>, done bigint")

    def _load(self):
        if not self.kept.exists():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.iinfo(np.int64).min
        seconds, counts, done = self.kept.get()
        return np.array(seconds, np.int64), np.array(counts, np.int64), done

    def _finish(self, key, seconds, counts, done, watermark) -> Iterator[pd.DataFrame]:
        closed = watermark // 1000 - 1  # the last second that lies before the watermark
        now = (seconds > done) & (seconds <= closed)
        if now.any():
            total = np.concatenate(([0], np.cumsum(counts)))
            first = np.searchsorted(seconds, seconds - self.window + 1)
            within = total[1:] - total[first]
            over = now & (within > self.limit)
            done = int(seconds[now].max())
            if over.any():
                yield pd.DataFrame({"client": key[0], "second": seconds[over], "requests": counts[over], "in_window": within[over]})
        waiting = seconds[seconds > done]
        seen = seconds > max(closed, done) - self.window  # what a window of a later second still reaches
        kept = seen | (seconds > done)
        if kept.any():
            self.kept.update(([int(s) for s in seconds[kept]], [int(c) for c in counts[kept]], int(done)))
        else:
            self.kept.clear()
        # one timer: when the next second is closed, else when the last one kept is out of reach
        wanted = (int(waiting[0]) + 1) * 1000 if len(waiting) else (int(seconds[kept][-1]) + self.window + 1) * 1000 if kept.any() else None
        for timer in list(self.handle.listTimers()):
            if timer != wanted:
                self.handle.deleteTimer(timer)
        if wanted is not None:
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seconds, counts, done = self._load()
        for chunk in rows:
            seconds, counts = np.concatenate((seconds, chunk["second"].to_numpy(np.int64))), np.concatenate((counts, chunk["n"].to_numpy(np.int64)))
            seconds, place = np.unique(seconds, return_inverse=True)  # a second is one number, however many requests come in it
            counts = np.bincount(place, counts, len(seconds)).astype(np.int64)
        yield from self._finish(key, seconds, counts, done, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._finish(key, *self._load(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class JobTracker(StatefulProcessor):
    """The status of an entity: ``status`` rows as it changes, ``stalled`` when a running one stays for too long, ``expired`` when nothing came for long.

    A key is a bucket of entities (or one entity, if rows do not name theirs), as every call to the state is a round trip, however little it holds. The state is a table with the last status of
    each entity, its time and event; an entity's row goes with its expiry. An event older than the last one changes nothing.
    """

    KEPT = pa.schema([("entity", pa.string()), ("status", pa.string()), ("at", pa.int64()), ("event", pa.string()), ("alarmed", pa.bool_())])

    def __init__(self, running: Sequence[str], stall_ms: int, keep_ms: int):
        self.running, self.stall, self.keep = tuple(running), stall_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("bucket", "due bigint, kept binary")

    def _load(self) -> tuple[int | None, pa.Table]:
        """When the bucket's timer goes off, and its table."""
        due, kept = self.last.get() or (None, None)
        return due, self.KEPT.empty_table() if kept is None else pa.ipc.open_stream(pa.py_buffer(bytes(kept))).read_all()

    def _save(self, kept: pa.Table, before: int | None) -> None:
        """Keeps the table and sets its one timer: when the first alarm or expiry of an entity is due. ``before`` is the timer still set."""
        due = None
        if len(kept):
            wait = np.where(self._waiting(kept), min(self.stall, self.keep), self.keep)
            due = int((kept["at"].to_numpy() // 1000 + wait + 1).min())
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, kept.schema) as writer:
                writer.write_table(kept.combine_chunks())
            self.last.update((due, out.getvalue().to_pybytes()))
        else:
            self.last.clear()
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def _waiting(self, rows: pa.Table) -> np.ndarray:
        """Which rows an alarm may still come for."""
        return pc.and_not(pc.is_in(rows["status"], value_set=pa.array(self.running, pa.string())), rows["alarmed"]).to_numpy()

    @staticmethod
    def _rows(table: pa.Table, **found: np.ndarray) -> Iterator[pd.DataFrame]:
        """The found places of the table, a kind after another."""
        place = np.concatenate(list(found.values()))
        if len(place):
            rows = table.select(["entity", "status", "at"]).take(pa.array(place)).to_pandas()
            kinds = np.repeat(np.array(list(found), object), [len(p) for p in found.values()])
            at = rows["at"].to_numpy(np.int64).astype("datetime64[us]").astype("datetime64[ns]")
            yield pd.DataFrame({"kind": kinds, "entity": rows["entity"], "status": rows["status"], "at": at})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, kept = self._load()
        came = [
            pa.table(
                [chunk["entity"] if "entity" in chunk else [key[0]] * len(chunk), chunk["status"], chunk["at"].fillna(np.iinfo(np.int64).min).astype(np.int64), chunk["event_id"], np.zeros(len(chunk), bool)],
                schema=self.KEPT,
            )
            for chunk in rows
        ]
        both = pa.concat_tables([kept, *came]).combine_chunks()
        code = both["entity"].chunk(0).dictionary_encode(null_encoding="encode").indices
        # the kept row of an entity stands before new ones of its time and event, as the order is stable
        order = pc.sort_indices(pa.table([code, both["at"], both["event"]], names=["code", "at", "event"]), sort_keys=[(c, "ascending") for c in ("code", "at", "event")])
        both, place, code = both.take(order), order.to_numpy(), code.take(order).to_numpy()
        old, at = place < len(kept), both["at"].to_numpy()
        latest = np.full(code.max(initial=0) + 1, -1)
        latest[code[old]] = np.flatnonzero(old)
        moves = np.arange(len(code)) >= latest[code]
        same = np.flatnonzero((code[1:] == code[:-1]) & (at[1:] == at[:-1])) + 1
        event = both["event"].take(pa.array(same)).to_pylist(), both["event"].take(pa.array(same - 1)).to_pylist()
        moves[same[[a == b for a, b in zip(*event)]]] = False  # a repeated event changes nothing either
        both, code, old, at = both.filter(pa.array(moves)), code[moves], old[moves], at[moves]
        if old.all():
            return
        follows = code[1:] == code[:-1]
        gap = at[1:].view(np.uint64) - at[:-1].view(np.uint64)  # in time order, so that it is never negative
        stalled = np.flatnonzero(follows & self._waiting(both)[:-1] & (gap > self.stall * 1000))  # in time order nobody had seen it move
        expired = np.flatnonzero(follows & (gap > self.keep * 1000))
        self._save(both.filter(pa.array(np.append(~follows, True))), due)
        yield from self._rows(both, stalled=stalled, expired=expired, status=np.flatnonzero(~old))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, kept = self._load()
        if not len(kept):
            return
        now, at = timerValues.getCurrentWatermarkInMs() * 1000, kept["at"].to_numpy()
        stalled = self._waiting(kept) & (at < now - self.stall * 1000)
        expired = at < now - self.keep * 1000
        alarmed = kept.set_column(4, "alarmed", pc.or_(kept["alarmed"], pa.array(stalled)))
        self._save(alarmed.filter(pa.array(~expired)), None)  # the timer that went off goes by itself
        yield from self._rows(kept, stalled=np.flatnonzero(stalled), expired=np.flatnonzero(expired))

    def close(self) -> None:
        pass


def sliding_counts(requests: DataFrame, client: str, ts: str, limit: int = 60, window_seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Every (client, second) of a stream whose trailing window exceeds the limit: ``client, second, requests, in_window``."""
    second = F.unix_seconds(ref(ts))
    marked = requests.withWatermark(ts, delay).select(ref(client).cast("string").alias("client"), second.alias("second"), F.lit(1).cast("long").alias("n"), ref(ts))
    return marked.groupBy("client").transformWithStateInPandas(SlidingCounter(limit, window_seconds), COUNTED, "append", "eventTime")


def tracked_jobs(
    events: DataFrame, entity: str, status: str, ts: str, event_id: str, running: Sequence[str] = ("profiling", "cleaning"),
    stall_hours: float = 2.0, keep_hours: float = 24.0 * 7, delay: str = "1 hour", buckets: int | None = None,
) -> DataFrame:
    """Status changes, stalled-job alarms and expiries of a stream of status events: ``kind, entity, status, at``.

    ``at`` is when the status began. A job is stalled when nothing came for more than ``stall_hours`` while it was running. ``buckets`` (``BUCKETS``) stays
    the same as long as a checkpoint is used; more of them suit many millions of entities.
    """
    marked = events.withWatermark(ts, delay).select(
        ref(entity).cast("string").alias("entity"), ref(status).alias("status"), F.unix_micros(ref(ts)).alias("at"),
        F.lpad(ref(event_id).cast("string"), 20, "0").alias("event_id"), ref(ts),
        F.pmod(F.xxhash64(ref(entity).cast("string")), F.lit(buckets or BUCKETS)).cast("int").alias("bucket"),
    )
    tracker = JobTracker(running, int(stall_hours * 3_600_000), int(keep_hours * 3_600_000))
    return marked.groupBy("bucket").transformWithStateInPandas(tracker, TRACKED, "append", "eventTime")


# ── replays of event files ──────────────────────────────────────────────────


def _replayed(spark: SparkSession, folder: str, build, key: str, slices: int = 4) -> DataFrame:
    """The events written in slices of time, one after another, then a tick far behind them; what ``build(stream, delay)`` gives out in the end.

    A slice is as many files as there are tasks, each with all events of its keys, and a batch reads so many: a key's events come in order of time even where
    a batch ends inside a slice, and the number of batches does not grow with the files. Keys are in any order, so the watermark stays back by the length of one slice.
    """
    events = spark.read.parquet(f"{folder.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    span = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    first, step = span.a or 0, ((span.b or 0) - (span.a or 0)) // slices + 1
    source, out, files = new_folder(spark, "replay"), new_folder(spark, "replayed"), spark.sparkContext.defaultParallelism
    at = F.floor((F.unix_micros("ts") - first) / step)
    for k in range(slices):
        events.where(at == k).repartition(files, ref(key)).write.mode("append").parquet(f"{source}/{k}")
    tick = F.timestamp_micros(F.lit(first + 3 * slices * step + 10**15 // 10**3))
    empty = [tick.alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*empty).write.parquet(f"{source}/tick")
    stream = stream_dataset(spark, f"{source}/*", events.schema, max_files=files)
    with keyed_state(spark):
        append_to(build(stream, f"{step // 1_000_000 + 1} seconds"), out)
    return spark.read.parquet(f"{out}/data")


def run_sliding_counts(spark: SparkSession, folder: str, limit: int, window_seconds: int) -> DataFrame:
    found = _replayed(spark, folder, lambda s, delay: sliding_counts(s, "event_type", "ts", limit, window_seconds, delay), "event_id")
    return found.where(F.col("client").isNotNull())


def run_tracked_jobs(spark: SparkSession, folder: str, stall_hours: float = 2.0, keep_hours: float = 24.0) -> DataFrame:
    status = mapped("event_type", STATUS_OF, "failed")
    found = _replayed(
        spark, folder,
        lambda s, delay: tracked_jobs(s.withColumn("status", status), "user_id", "status", "ts", "event_id", stall_hours=stall_hours, keep_hours=keep_hours, delay=delay),
        "user_id",
    )
    return found.where(F.col("entity").isNotNull())
