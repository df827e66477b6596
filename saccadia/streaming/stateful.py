"""Stateful operators on gaze streams: sliding buffers and event runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saccadia.functions.ordered import lay_out
from saccadia.operators.events import label_samples
from saccadia.operators.features import extract_features
from saccadia.schema import KEY

SAMPLE_FIELDS = [
    T.StructField("timestamp_ms", T.DoubleType()),
    T.StructField("sample_seq", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("pupil", T.DoubleType()),
    T.StructField("valid", T.BooleanType()),
]
SAMPLE = T.StructType(SAMPLE_FIELDS)
NAMES = [f.name for f in SAMPLE_FIELDS]
MIN_BUFFERED = 5
IDLE_MS = 3_600_000
#: A run without a sample for so long, by the watermark, has ended.
END_MS = 10_000


def _sorted_rows(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch in time order; micro-batches are bounded by the source's rate limit."""
    return pd.concat(list(rows)).sort_values(["timestamp_ms", "sample_seq"])


def _values(row) -> tuple:
    def clean(v):
        return None if v is None or v != v else v

    t, seq, x, y, pupil, valid = (clean(getattr(row, n)) for n in NAMES)
    return (float(t), int(seq), x, y, pupil, bool(valid))


def _restart_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(at_ms)


class SlidingBuffer(StatefulProcessor):
    """Keeps the last ``window_ms`` of a recording and emits the buffer every ``step_ms``.

    A sample exactly ``window_ms`` old stays. A late sample joins the buffer if it is young
    enough and is ignored otherwise. Buffers of idle recordings expire.
    """

    def __init__(self, window_ms: float, step_ms: float):
        self.window_ms, self.step_ms = window_ms, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", SAMPLE)
        self.last_emit = handle.getValueState("last_emit", T.StructType([T.StructField("ms", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buffer = sorted((tuple(r) for r in self.buffer.get()), key=lambda s: s[:2]) if self.buffer.exists() else []
        last = self.last_emit.get()[0] if self.last_emit.exists() else float("-inf")
        out = []
        for row in _sorted_rows(rows).itertuples(index=False):
            sample = _values(row)
            newest = max(buffer[-1][0], sample[0]) if buffer else sample[0]
            if newest - sample[0] > self.window_ms:
                continue
            in_order = not buffer or buffer[-1][:2] <= sample[:2]
            buffer.append(sample)
            if not in_order:
                buffer.sort(key=lambda s: s[:2])
            old = next(k for k, s in enumerate(buffer) if newest - s[0] <= self.window_ms)
            del buffer[:old]
            if newest - last >= self.step_ms and len(buffer) >= MIN_BUFFERED:
                last = newest
                out += [(key[0], newest, *s) for s in buffer]
        self.buffer.put(buffer)
        self.last_emit.update((last,))
        _restart_timer(self.handle, int(buffer[-1][0]) + IDLE_MS)
        yield pd.DataFrame(out, columns=[KEY, "emit_ms", *NAMES])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.buffer.clear()
        self.last_emit.clear()
        yield pd.DataFrame([], columns=[KEY, "emit_ms", *NAMES])

    def close(self) -> None:
        pass


BUFFER_ROWS = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("emit_ms", T.DoubleType()), *SAMPLE_FIELDS])


def sliding_buffers(timed: DataFrame, window_ms: float = 1500.0, step_ms: float = 250.0) -> DataFrame:
    """Samples of every emitted buffer of a stream with ``event_time``, marked with the time of emission."""
    return timed.select(KEY, "event_time", *NAMES).groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=SlidingBuffer(window_ms, step_ms), outputStructType=BUFFER_ROWS, outputMode="Append", timeMode="EventTime"
    )


def buffer_features(buffers: DataFrame, **options) -> DataFrame:
    """Features of each emitted buffer: a buffer is a short recording of its own."""
    keyed = buffers.withColumns(
        {
            KEY: F.to_json(F.struct(F.col(KEY).alias("k"), F.col("emit_ms").alias("t"))),
            **{c: F.lit(None).cast("string") for c in ("marker", "event_label", "label", "trial")},
        }
    )
    laid = lay_out(keyed.drop("emit_ms"))
    found = extract_features(laid, label_samples(laid, "thresholds"), **options)
    parts = F.from_json(KEY, "k string, t double")
    return found.withColumn("_parts", parts).withColumns({"emit_ms": F.col("_parts.t"), KEY: F.col("_parts.k")}).drop("_parts")


RUN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start_ms", T.DoubleType()),
        T.StructField("end_ms", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("first_x", T.DoubleType()),
        T.StructField("first_y", T.DoubleType()),
        T.StructField("last_x", T.DoubleType()),
        T.StructField("last_y", T.DoubleType()),
        T.StructField("peak", T.DoubleType()),
    ]
)
EVENT = T.StructType(
    [
        T.StructField(KEY, T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start_time_ms", T.DoubleType()),
        T.StructField("end_time_ms", T.DoubleType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("sample_count", T.LongType()),
        T.StructField("amplitude", T.DoubleType()),
        T.StructField("peak_velocity", T.DoubleType()),
    ]
)


class OpenRun(StatefulProcessor):
    """Keeps the running event of a recording and emits it when the label changes or, by a timer, when it has ended."""

    def __init__(self, threshold: float, min_fixation_ms: float, min_blink_ms: float, end_ms: int):
        self.threshold, self.end_ms = threshold, end_ms
        self.least = {"fixation": min_fixation_ms, "blink": min_blink_ms}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)
        self.before = handle.getValueState("before", SAMPLE)

    def _event(self, key, run):
        kind, start, end, n, ax, ay, bx, by, peak = run
        if end - start < self.least.get(kind, 0.0):
            return []
        known = kind != "blink" and None not in (ax, ay, bx, by)
        amplitude = float(np.hypot(bx - ax, by - ay)) if known else (0.0 if kind == "blink" else None)
        return [(key[0], kind, start, end, end - start, n, amplitude, peak)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # a filter would be moved below the watermark, which is to see these rows
            yield pd.DataFrame([], columns=[f.name for f in EVENT.fields])
            return
        run = tuple(self.run.get()) if self.run.exists() else None
        before = tuple(self.before.get()) if self.before.exists() else None
        out = []
        for row in _sorted_rows(rows).itertuples(index=False):
            t, seq, x, y, pupil, valid = sample = _values(row)
            if before is not None and (t, seq) <= before[:2]:
                continue
            speed = 0.0
            if valid and before is not None and None not in (x, y, before[2], before[3]) and t > before[0]:
                speed = float(np.hypot(x - before[2], y - before[3])) / ((t - before[0]) / 1000.0)
            kind = "blink" if not valid else ("saccade" if speed >= self.threshold else "fixation")
            if run is not None and run[0] == kind:
                run = (kind, run[1], t, run[3] + 1, run[4], run[5], x, y, max(run[8], speed))
            else:
                if run is not None:
                    out += self._event(key, run)
                run = (kind, t, t, 1, x, y, x, y, speed)
            before = sample
        self.run.update(run)
        self.before.update(before)
        _restart_timer(self.handle, int(before[0]) + self.end_ms)
        yield pd.DataFrame(out, columns=[f.name for f in EVENT.fields])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._event(key, tuple(self.run.get())) if self.run.exists() else []
        self.run.clear()
        self.before.clear()
        yield pd.DataFrame(out, columns=[f.name for f in EVENT.fields])

    def close(self) -> None:
        pass


def stream_events(
    timed: DataFrame, threshold: float = 850.0, min_fixation_ms: float = 60.0, min_blink_ms: float = 75.0, end_ms: int = END_MS
) -> DataFrame:
    """Velocity-threshold events of a stream with ``event_time``.

    A run ends with a change of label, or ``end_ms`` after its last sample, when the watermark has passed that time: a timer then
    closes it, and a sample after such a pause begins a new run. Rows without a recording only move the watermark.
    """
    return timed.select(KEY, "event_time", *NAMES).groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=OpenRun(threshold, min_fixation_ms, min_blink_ms, end_ms),
        outputStructType=EVENT,
        outputMode="Append",
        timeMode="EventTime",
    )
