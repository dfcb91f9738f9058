"""Session spans by keyed state: ends by summary and by timer, in any batches, late rows, replays."""

import random

import pytest
from pyspark.sql import functions as F

from memspark.streaming import jobs, sessions

MINUTE = 60


def spans(rows, watermark, gap=30 * MINUTE):
    """Spans of (session, second, kind) that are over at the watermark."""
    out = []
    for name in {r[0] for r in rows if r[0] is not None}:
        span = None
        for at, kind in sorted((t, k == "summary") for s, t, k in rows if s == name and t is not None):
            if span and at - span[1] >= gap:
                out.append((name, span[0], span[1] + gap, span[2], "timeout"))
                span = None
            if kind:
                if span:
                    out.append((name, span[0], at, span[2], "summary"))
                span = None
            else:
                span = (span[0], at, span[2] + 1) if span else (at, at, 1)
        if span:
            out.append((name, span[0], span[1] + gap, span[2], "timeout"))
    return sorted(x for x in out if x[2] <= watermark)


def run(spark, tmp, batches, name):
    root = tmp / name
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "session_id string, second long, kind string").select(
            "session_id", F.timestamp_seconds("second").alias("ts"), "kind")
        df.coalesce(1).write.parquet(str(root / f"in/batch={i:03d}"))
    reader = spark.readStream.schema("session_id string, ts timestamp, kind string, batch int").option("maxFilesPerTrigger", 1)
    stream = sessions.stream_session_ends(reader.parquet(str(root / "in")).drop("batch"))
    q = jobs.append_parquet(stream, str(root / "out"), str(root / "cp"))
    q.awaitTermination()
    assert q.exception() is None
    got = spark.read.parquet(str(root / "out")).select("session_id", F.unix_seconds("started_at"), F.unix_seconds("ended_at"), "events", "ended_by")
    return sorted(map(tuple, got.collect()))


@pytest.fixture()
def keyed_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, sessions.STORE)
    yield
    spark.conf.set(key, before)


def test_ends_in_any_batches(spark, tmp_path, keyed_store):
    r = random.Random(2)
    rows = sorted(((r.choice("abc"), r.randrange(0, 20 * 60) * 30, "summary" if r.random() < 0.1 else "event") for _ in range(160)), key=lambda x: x[1])
    rows += [(None, 5, "event"), ("a", None, "event"), ("c", 40 * 3600, "event")]
    want = spans(rows, 40 * 3600 - 10 * MINUTE)
    assert {x[4] for x in want} == {"summary", "timeout"}
    for name, size in (("one", len(rows)), ("four", 41)):
        assert run(spark, tmp_path, [rows[i:i + size] for i in range(0, len(rows), size)], name) == want


def test_out_of_order_and_late_rows(spark, tmp_path, keyed_store):
    first = [("a", 1000, "event"), ("a", 1400, "event"), ("b", 1500, "event")]
    second = [("a", 1200, "summary"), ("a", 1100, "event"), ("a", 9000, "event")]  # out of order, within the lateness
    late = [("a", 2000, "event"), ("b", 20_000, "event")]  # the first one comes after the watermark has passed it
    got = run(spark, tmp_path, [first, second, late, [("b", 60_000, "event")]], "x")
    kept = first + second + late[1:] + [("b", 60_000, "event")]
    assert got == spans(kept, 60_000 - 10 * MINUTE)


class _Held:
    """State of one key in a dict, counting what is written and read."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, 0, []

    def getValueState(self, name, schema):
        return _Value(self, name)

    def getMapState(self, name, key, value):
        return _Value(self, name)

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class _Value:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def _at(self, key=()):
        self.held.calls += 1
        return (self.name, key)

    def exists(self):
        return self._at() in self.held.values

    def containsKey(self, key):
        return self._at(key) in self.held.values

    def get(self):
        return self.held.values[self._at()]

    def getValue(self, key):
        return self.held.values[self._at(key)]

    def update(self, value):
        self.held.values[self._at()] = value

    def updateValue(self, key, value):
        self.held.values[self._at(key)] = value

    def clear(self):
        self.held.values.pop(self._at(), None)

    def removeKey(self, key):
        self.held.values.pop(self._at(key))

    def iterator(self):
        self.held.calls += 1
        return iter([(k[1], v) for k, v in self.held.values.items() if k[0] == self.name])


def test_rows_of_a_busy_session_are_not_state_calls_of_their_own():
    import pandas as pd

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    held, spans_ = _Held(), sessions.SessionSpans(1800 * 1_000_000)
    spans_.init(held)
    n = 5000
    for part in (0, 1):  # every second row arrives later
        frame = pd.DataFrame({"at": [i * 1_000_000 for i in range(part, n, 2)], "is_summary": False, "times": 2})
        assert list(spans_.handleInputRows(("s",), iter([frame]), At(0))) == []
    assert held.timers == [1000]  # the row at 0 has been passed, the next one is a second later
    half = list(spans_.handleExpiredTimer(("s",), At(4000 * 1000), None))
    assert half == [] and held.timers == [4001 * 1000]
    (end,) = spans_.handleExpiredTimer(("s",), At((n + 1800) * 1000), None)
    assert end["events"].tolist() == [2 * n] and end["ended_by"].tolist() == ["timeout"]
    assert held.calls < 100 and not held.values
