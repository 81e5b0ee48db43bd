import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import operations
from siftstone.streaming import events as streams
from siftstone.streaming import stateful


def replay(spark, tmp_path, batches, schema, build):
    """One file per batch, read one at a time; what the stream gives out in the end."""
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"{i:03}"))
    stream = streams.stream_dataset(spark, str(source) + "/*", schema, max_files=1)
    with stateful.keyed_state(spark):
        streams.append_to(build(stream), str(tmp_path / "out"))
    return spark.read.parquet(str(tmp_path / "out" / "data"))


def at(seconds):
    return f"TIMESTAMP_SECONDS({seconds})"


def stamped(rows):
    import datetime

    return [(c, datetime.datetime.fromtimestamp(s, datetime.timezone.utc).replace(tzinfo=None)) for c, s in rows]


def test_sliding_counter(spark, tmp_path):
    random_ = random.Random(3)
    rows = sorted(((random_.choice("aab"), 7200 + int(random_.gauss(300, 120))) for _ in range(600)), key=lambda r: r[1])
    # a batch's rows in any order, and some that are late by less than the delay
    late = rows[50:60]
    batches = [rows[:50] + rows[60:200], rows[200:260] + late, rows[260:], [("", 100_000)]]
    for b in batches:
        random_.shuffle(b)
    got = replay(spark, tmp_path, [stamped(b) for b in batches], "c string, t timestamp", lambda s: stateful.sliding_counts(s, "c", "t", 12, 30, "10 minutes"))
    whole = spark.createDataFrame(stamped(rows), "c string, t timestamp")
    want = operations.requests_over_limit(whole, "c", "t", 12, 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20


def test_job_tracker(spark, tmp_path):
    hour, schema = 3600, "d string, s string, t timestamp, e long"

    def rows(*events):
        return [(d, s, t, e) for (d, s, e), (_, t) in zip([x[:3] for x in events], stamped([("", x[3] * hour) for x in events]))]

    batches = [
        rows(("a", "profiling", 1, 1), ("b", "profiling", 2, 1), ("c", "cleaning", 3, 1), ("c", "ready", 4, 5)),  # c stalls in between
        rows(("a", "cleaning", 5, 2), ("b", "uploaded", 6, 0.5), ("d", "profiling", 7, 4)),  # b: late, changes nothing
        rows(("b", "ready", 8, 9), ("e", "cleaning", 9, 10), ("", "tick", 10, 10)),
        rows(("", "tick", 11, 200)),
    ]
    got = replay(spark, tmp_path, batches, schema, lambda s: stateful.tracked_jobs(s, "d", "s", "t", "e", stall_hours=2, keep_hours=24, delay="6 hours"))
    found = sorted((r.kind, r.entity, r.status, r.hour) for r in got.where("entity <> ''").withColumn("hour", F.unix_seconds("at") / 3600).collect())
    assert [r for r in found if r[0] == "stalled"] == sorted(
        [("stalled", "c", "cleaning", 1.0), ("stalled", "a", "cleaning", 2.0), ("stalled", "b", "profiling", 1.0), ("stalled", "d", "profiling", 4.0), ("stalled", "e", "cleaning", 10.0)]
    )
    assert [r[1:] for r in found if r[0] == "expired"] == [("a", "cleaning", 2.0), ("b", "ready", 9.0), ("c", "ready", 5.0), ("d", "profiling", 4.0), ("e", "cleaning", 10.0)]
    assert len([r for r in found if r[0] == "status"]) == 8


def test_the_sessions_store_comes_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with pytest.raises(RuntimeError), stateful.keyed_state(spark):
        raise RuntimeError
    assert spark.conf.get(key, None) == before


class OneKey:
    """Stands in for the state and the timers of one key; counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def followed(batches, stall, keep):
    """Entity by entity and event by event: what the tracker should give out, with the watermark behind each batch (all in milliseconds)."""
    last, found = {}, []
    for rows, mark in batches:
        for d, s, t, e in sorted(rows, key=lambda r: (r[2], r[3] is None, r[3] or "")):
            if d in last:
                status, at, event, alarmed = last[d]
                if (t, e is None, e or "") <= (at, event is None, event or ""):
                    continue
                if status == "profiling" and not alarmed and t - at > stall:
                    found.append(("stalled", d, status, at))
                if t - at > keep:
                    found.append(("expired", d, status, at))
            last[d] = (s, t, e, False)
            found.append(("status", d, s, t))
        for d, (status, at, event, alarmed) in list(last.items()):
            if status == "profiling" and not alarmed and mark - at > stall:
                found.append(("stalled", d, status, at))
                last[d] = (status, at, event, True)
            if mark - at > keep:
                found.append(("expired", d, status, at))
                del last[d]
    return found


def test_a_bucket_of_entities_costs_a_few_calls_to_the_state(monkeypatch):
    import types

    import pandas as pd

    random_, hour, handle, got, batches = random.Random(8), 3_600_000, OneKey(), [], []
    tracker = stateful.JobTracker(("profiling",), 2 * hour, 24 * hour)
    tracker.init(handle)
    for k in range(7):
        # the last batches have few rows, with long silences before them; the watermark lies behind some rows and before others
        start = (0, 6, 12, 18, 60, 61, 200)[k] * hour
        rows = [
            (random_.choice([None, "", *map(str, range(300))]), random_.choice(["profiling", "profiling", "ready", None]), start + random_.randrange(6 * hour) - random_.choice([0, 4 * hour]),
             random_.choice([None, *"abcdef"]))
            for _ in range(900 if k < 4 else 60)
        ]
        rows = list({(r[0], r[2], r[3]): r for r in rows + [(d, s, t, e) for d, s, t, e in rows[:20]]}.values())
        mark = start + hour if k < 6 else 10**12
        batches.append((rows, mark))
        times, calls = types.SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), handle.calls
        frame = pd.DataFrame([(d, s, t * 1000, e) for d, s, t, e in rows], columns=["entity", "status", "at", "event_id"])
        got += tracker.handleInputRows((1,), iter([frame[: len(frame) // 2], frame[len(frame) // 2 :]]), times)
        assert len(handle.timers) <= 1
        due = [t for t in handle.timers if t <= mark]
        for t in due:
            got += tracker.handleExpiredTimer((1,), times, types.SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))
            handle.timers.discard(t)
        assert handle.calls - calls <= 8 and all(t > mark for t in handle.timers)
    assert handle.value is None and not handle.timers
    found = [(r.kind, r.entity, r.status, int(r.at.value // 10**6)) for frame in got for r in frame.itertuples()]
    want = followed(batches, 2 * hour, 24 * hour)
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {k: sum(r[0] == k for r in want) > 50 for k in ("status", "stalled", "expired")} == {"status": True, "stalled": True, "expired": True}


def test_a_replay_of_many_files_keeps_the_order_of_a_keys_events(spark, tmp_path, monkeypatch):
    import datetime

    random_, start = random.Random(4), datetime.datetime(2024, 1, 1)
    kinds = {"view": "profiling", "click": "ready"}
    rows = [(i, start + datetime.timedelta(minutes=random_.randrange(6000)), random_.randrange(12), random_.choice(list(kinds)), 1.0, "") for i in range(900)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(6, "event_id").write.parquet(str(tmp_path / "events.parquet"))  # a user's events lie in all files
    monkeypatch.setattr(stateful, "STATUS_OF", kinds)
    batches, append_to = [], stateful.append_to

    def appended(stream, folder):
        append_to(stream, folder)
        batches.extend(p.name for p in (tmp_path.__class__(folder) / "checkpoint" / "commits").iterdir() if p.name.isdigit())

    monkeypatch.setattr(stateful, "append_to", appended)
    found = stateful.run_tracked_jobs(spark, str(tmp_path), 2.0, 24.0).select("kind", "entity", "status", F.unix_micros("at").alias("at")).collect()
    utc = datetime.timezone.utc
    each = [(str(u), kinds[e], int(t.replace(tzinfo=utc).timestamp() * 1000), f"{i:020}") for i, t, u, e, *_ in rows]
    want = followed([(each, 10**15)], 2 * 3_600_000, 24 * 3_600_000)
    assert sorted((r.kind, r.entity, r.status, r.at // 1000) for r in found) == sorted(want)
    assert len([r for r in found if r.kind == "status"]) == 900 and len(batches) <= 8
    windows = stateful.run_sliding_counts(spark, str(tmp_path), 2, 7200)
    expected = operations.requests_over_limit(events, "event_type", "ts", 2, 7200)
    assert sorted(map(tuple, windows.collect())) == sorted(map(tuple, expected.collect())) and windows.count() > 50
