"""Session spans as keyed state with timers: a session ends with its summary, or when nothing happened for a while.

Each session's state is what has happened in its open span, and the rows that the watermark has not passed yet, packed by the hour. Once it has, no
earlier row can come, so rows enter the span in the order of their times, whatever the batches were. A timer is set for the next
row to enter or the end of the quiet time; a closed span leaves no state behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT, SUMMARY = "event", "summary"
ENDED = "session_id string, started_at timestamp, ended_at timestamp, events long, ended_by string"
#: The state store that keyed processors need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Time that one entry of the waiting rows spans, and the shape of a row in it.
BUCKET_US = 3_600_000_000
_ROW = np.dtype([("at", "<i8"), ("is_summary", "?"), ("times", "<i8")])


def _counted(rows: np.ndarray) -> np.ndarray:
    """Rows in the order of their times, events before summaries, with the counts of equal ones added up."""
    rows = rows[np.lexsort((rows["is_summary"], rows["at"]))]
    first = np.flatnonzero(np.append(True, (np.diff(rows["at"]) != 0) | (rows["is_summary"][1:] != rows["is_summary"][:-1])))
    out = rows[first]
    out["times"] = np.add.reduceat(rows["times"], first)
    return out


class SessionSpans(StatefulProcessor):
    """State per session, in microseconds: ``span`` (start, last, events) and ``waiting``, the rows that the watermark has not passed,
    as one packed array per BUCKET_US of time, so that a batch reads and writes its buckets and not its rows."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "start long, last long, events long")
        self.waiting = handle.getMapState("waiting", "bucket long", "first long, rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        came = []
        for frame in rows:
            frame = frame[frame["at"] >= passed]
            packed = np.empty(len(frame), _ROW)
            for name in _ROW.names:
                packed[name] = frame[name].to_numpy()
            if len(packed):
                came.append(_counted(packed))
        if came:
            came = _counted(np.concatenate(came))
            buckets, first = np.unique(came["at"] // BUCKET_US, return_index=True)
            for bucket, some in zip(buckets.tolist(), np.split(came, first[1:]), strict=True):
                if self.waiting.containsKey((bucket,)):
                    some = _counted(np.concatenate([np.frombuffer(self.waiting.getValue((bucket,))[1], _ROW), some]))
                self.waiting.updateValue((bucket,), (int(some["at"][0]), some.tobytes()))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _passed(self, passed: int) -> tuple[np.ndarray, int | None]:
        """Rows that the watermark has passed, taken out of the state in the order of their times, and the time of the next one."""
        out, following = [np.empty(0, _ROW)], None
        for bucket, at in sorted((bucket, first) for (bucket,), (first, _) in self.waiting.iterator()):
            if at > passed:
                return np.concatenate(out), at
            rows = np.frombuffer(self.waiting.getValue((bucket,))[1], _ROW)
            cut = int(np.searchsorted(rows["at"], passed, side="right"))
            out.append(rows[:cut])
            if cut < len(rows):
                following = int(rows["at"][cut])
                self.waiting.updateValue((bucket,), (following, rows[cut:].tobytes()))
                break
            self.waiting.removeKey((bucket,))
        return np.concatenate(out), following

    def _advance(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Let rows that the watermark has passed enter the span, and set one timer for what comes next."""
        passed = watermark_ms * 1000
        now, waits = self._passed(passed)
        span = tuple(self.span.get()) if self.span.exists() else None
        done = []
        for at, is_summary, times in now.tolist():
            if span and at - span[1] >= self.gap:
                done.append((span[0], span[1] + self.gap, span[2], "timeout"))
                span = None
            if is_summary:
                if span:
                    done.append((span[0], at, span[2], "summary"))
                span = None
            else:
                span = (span[0], at, span[2] + times) if span else (at, at, times)
        if span and span[1] + self.gap <= passed:
            done.append((span[0], span[1] + self.gap, span[2], "timeout"))
            span = None
        if span:
            self.span.update(span)
        else:
            self.span.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        following = min([x for x in (waits, span[1] + self.gap if span else None) if x is not None], default=None)
        if following is not None:
            self.handle.registerTimer(max(-(-following // 1000), watermark_ms + 1))
        if done:
            yield pd.DataFrame({"session_id": key[0], "started_at": pd.to_datetime([d[0] for d in done], unit="us"),
                                "ended_at": pd.to_datetime([d[1] for d in done], unit="us"), "events": [d[2] for d in done],
                                "ended_by": [d[3] for d in done]})


def stream_session_ends(events: DataFrame, gap_minutes: int = 30, lateness: str = "10 minutes") -> DataFrame:
    """Ended spans of (session_id, ts, kind): started_at, ended_at, events, ended_by (``summary`` or ``timeout``).

    A span ends at its summary, or ``gap_minutes`` after its last event. A summary outside a span ends nothing. At one time events
    come before summaries. Rows older than the watermark at the start of their batch are late and left out, as are rows with a null session or time. Rows of
    one session and time are counted before they meet the state, so a busy session reaches it as few rows.
    """
    rows = events.filter(F.col("session_id").isNotNull() & F.col("ts").isNotNull()).select(
        "session_id", "ts", F.unix_micros("ts").alias("at"), (F.col("kind") == SUMMARY).alias("is_summary"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.groupby(["session_id", "ts", "at", "is_summary"], as_index=False).size().rename(columns={"size": "times"})

    rows = rows.mapInPandas(counted, "session_id string, ts timestamp, at long, is_summary boolean, times long")
    return rows.withWatermark("ts", lateness).groupBy("session_id").transformWithStateInPandas(
        SessionSpans(gap_minutes * 60_000_000), ENDED, "append", "EventTime")
