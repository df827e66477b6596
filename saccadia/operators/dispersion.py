"""Fixations by the dispersion threshold, block by block.

The method is a greedy scan: a sample starts a fixation if its window of the minimum duration is tight enough (x range + y range);
the window then grows while it stays so, and the scan goes on behind it. Where a scan that stands at a sample goes next depends
on the samples behind it alone, so a block's scans from all its samples are found at once, by tables of ranges over 1, 2, 4, ...
samples; they soon meet one another, which leaves a block's outcome as a short table (from which sample on, which state at the
end). What crosses an edge is an open fixation, of which only the extent matters, or the samples of a window still too short.
The outcomes of a recording's blocks are chained in order, and each block then lists the fixations from the sample where the
scan of the block before it ends.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.functions.ordered import is_split, settle, shift
from saccadia.functions.storage import materialize
from saccadia.operators.entropy import group_edges
from saccadia.schema import BLOCK, INDEX, KEY

#: Samples analysed at once where a recording is one stream.
STREAM_ROWS = 1 << 16
COLUMNS = [INDEX, "timestamp_ms", "x", "y", "_breaks"]
NAMES = [KEY, "start_index", "end_index", "start_time_ms", "end_time_ms", "duration_ms", "amplitude"]
SCHEMA = f"{KEY} string, start_index long, end_index long, start_time_ms double, end_time_ms double, duration_ms double, amplitude double"

Row = tuple[int, float, float, float]  # index, time, x, y
Box = tuple[float, float, float, float]


def _spread(box) -> float:
    return (box[1] - box[0]) + (box[3] - box[2])


def _joined(a, b) -> Box:
    return min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])


@dataclass
class State:
    """What a scan carries over an edge: an open fixation (first sample, extent, last sample), or samples of a short window."""

    first: Row | None = None
    box: Box | None = None
    last: Row | None = None
    waiting: list[Row] | None = None


class Ranges:
    """Least and greatest x and y over runs of 1, 2, 4, ... samples."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.levels = [(x, x, y, y)]
        size = 1
        while 2 * size <= len(x):
            a = self.levels[-1]
            pick = (np.minimum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f(v[:-size], v[size:]) for f, v in zip(pick, a)))
            size *= 2

    def box(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Extents of samples a to b."""
        level = np.frexp(b - a + 1)[1] - 1
        out = np.empty((4, len(a)))
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            low, high = a[at], b[at] - (1 << k) + 1
            for c, (f, v) in enumerate(zip((np.minimum, np.maximum) * 2, self.levels[k])):
                out[c, at] = f(v[low], v[high])
        return out

    def grown(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, limit: float) -> np.ndarray:
        """The last sample, ``most`` at the latest, to which tight windows from a to b can be widened."""
        place, box = b.copy(), self.box(a, b)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(place + (1 << k) <= most)
            after = place[fits] + 1
            x0, x1, y0, y1 = (f(box[c, fits], v[after]) for c, (f, v) in enumerate(zip((np.minimum, np.maximum) * 2, self.levels[k])))
            tight = (x1 - x0) + (y1 - y0) <= limit
            fits = fits[tight]
            place[fits] += 1 << k
            box[:, fits] = np.stack([x0, x1, y0, y1])[:, tight]
        return place


class Analysis:
    """All scans of a block of samples: for each sample the next start of a fixation, and each start's end."""

    def __init__(self, index, t, x, y, breaks, limit: float, least: float):
        n = len(t)
        self.n, self.index, self.t, self.x, self.y, self.limit, self.least = n, index, t, x, y, limit, least
        self.breaks = breaks
        edges = np.flatnonzero(breaks)
        nth = np.searchsorted(edges, np.arange(n), "right")
        stop = np.append(edges, n)[nth] - 1  # the island's last sample
        self.last_island = int(edges[-1]) if len(edges) else 0
        enough = np.searchsorted(t, t + least, "left")
        for _ in range(n):  # the same subtraction as in the definition, whatever the sum was rounded to
            back = (enough > np.arange(n)) & (t[np.maximum(enough - 1, 0)] - t >= least)
            on = (enough < n) & (t[np.minimum(enough, n - 1)] - t < least) & ~back
            enough = enough - back + on
            if not (back | on).any():
                break
        ranges = Ranges(x, y)
        whole = np.flatnonzero(enough <= stop)
        box = ranges.box(whole, enough[whole])
        starts = whole[(box[1] - box[0]) + (box[3] - box[2]) <= limit]
        self.end = np.full(n, -1, np.int64)
        self.end[starts] = ranges.grown(starts, enough[starts], stop[starts], limit)
        following = np.full(n + 1, n, np.int64)
        following[starts] = starts
        self.next = np.minimum.accumulate(following[::-1])[::-1]
        self.ranges = ranges

    def row(self, k: int) -> Row:
        return int(self.index[k]), float(self.t[k]), float(self.x[k]), float(self.y[k])

    def fixations(self, entry: int) -> Iterator[tuple[Row, Row]]:
        """Fixations of the scan from sample ``entry`` that end before the block does."""
        start = int(self.next[entry])
        while start < self.n and (end := int(self.end[start])) < self.n - 1:
            yield self.row(start), self.row(end)
            start = int(self.next[end + 1])

    def summary(self) -> dict:
        """What the chain needs to know of the block."""
        n = self.n
        start = self.next[:n]
        end = self.end[np.minimum(start, n - 1)]
        stays = (start == n) | (end == n - 1)
        goal = np.where(stays, np.arange(n), np.minimum(end + 1, n - 1))
        while not np.array_equal(onward := goal[goal], goal):
            goal = onward
        open_ = start[goal] < n
        short = max(self.last_island, int(np.argmax(self.t[n - 1] - self.t < self.least)) if self.least > 0 else n - 1)
        state = np.where(open_, start[goal], np.maximum(goal, short))
        new = np.flatnonzero(np.append(True, (state[1:] != state[:-1]) | (open_[1:] != open_[:-1])))
        opened = state[new][open_[new]]
        last = np.full(len(opened), n - 1)
        # the extent of a fixation that crosses into the block changes where its first samples do
        inner = np.flatnonzero(self.breaks[1:])
        reach = int(inner[0]) + 1 if len(inner) else n
        extents = np.stack([f.accumulate(v[:reach]) for f, v in zip((np.minimum, np.maximum) * 2, (self.x, self.x, self.y, self.y))])
        change = np.append(True, (extents[:, 1:] != extents[:, :-1]).any(axis=0))
        wide = (extents[1] - extents[0]) + (extents[3] - extents[2]) > self.limit
        upto = int(np.argmax(wide)) + 1 if wide.any() else reach
        at = np.flatnonzero(change[:upto])
        late = np.flatnonzero(self.t[:reach] - self.t[0] >= self.least)
        head = int(late[0]) + 1 if len(late) else reach
        rows = lambda which: [self.row(int(k)) for k in which]
        return {
            "begins": bool(self.breaks[0]), "reach": reach, "n": n, "first": int(self.index[0]),
            "from": new, "open": open_[new], "starts": rows(state[new]), "boxes": dict(zip(opened.tolist(), self.ranges.box(opened, last).T.tolist())),
            "state": state[new], "change": at, "extents": extents[:, at].T.tolist(), "before": rows(at[at > 0] - 1), "edge": self.row(reach - 1),
            "head": rows(range(head)), "tail": rows(range(short, n)), "tail_from": short, "last": self.row(n - 1),
        }


def _outcome(s: dict, entry: int) -> State:
    """The state at the block's end of a scan from sample ``entry``."""
    k = int(np.searchsorted(s["from"], entry, "right")) - 1
    at = int(s["state"][k])
    if s["open"][k]:
        return State(s["starts"][k], tuple(s["boxes"][at]), s["last"])
    return State(waiting=s["tail"][max(at, entry) - s["tail_from"]:])


def step(s: dict, state: State | None, limit: float, least: float) -> tuple[list[tuple[Row, Row]], int | None, State]:
    """One block of the chain: fixations that end in it but began before, where the block's own scan begins (if it does), and
    the state at its end."""
    found: list[tuple[Row, Row]] = []
    if state is not None and s["begins"]:
        if state.first:
            found.append((state.first, state.last))
        state = None
    if state is None:
        return found, 0, _outcome(s, 0)
    if state.waiting is not None:
        entry, state = _waited(s, state.waiting, limit, least)
        if state is None:
            return found, entry, _outcome(s, entry)
        if state.waiting is not None:
            return found, None, state
    box = state.box
    for k, (at, extent) in enumerate(zip(s["change"].tolist(), s["extents"])):
        box = _joined(state.box, extent)
        if _spread(box) > limit:
            found.append((state.first, s["before"][k - 1] if at else state.last))
            return found, at, _outcome(s, at)
    if s["reach"] < s["n"]:
        found.append((state.first, s["edge"]))
        return found, s["reach"], _outcome(s, s["reach"])
    return found, None, State(state.first, box, s["last"])


def _waited(s: dict, waiting: list[Row], limit: float, least: float) -> tuple[int | None, State | None]:
    """A short window goes on into the block: to a sample of the block itself, or to an open fixation, or it stays short."""
    rows, first = list(waiting), 0
    for row in s["head"]:
        rows.append(row)
        while row[1] - rows[first][1] >= least:
            part = rows[first:]
            box = (min(r[2] for r in part), max(r[2] for r in part), min(r[3] for r in part), max(r[3] for r in part))
            if _spread(box) <= limit:
                return None, State(rows[first], box, row)
            first += 1
            if first == len(waiting):
                return 0, None
    if s["reach"] < s["n"]:
        return s["reach"], None
    return None, State(waiting=rows[first:])


def _events(key: str, found: list[tuple[Row, Row]]) -> list[tuple]:
    return [(key, a[0], b[0], a[1], b[1], b[1] - a[1], ((b[2] - a[2]) ** 2 + (b[3] - a[3]) ** 2) ** 0.5) for a, b in found]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
    columns = list(zip(*rows)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)


def _analysis(table: pa.Table, limit: float, least: float) -> Analysis:
    return Analysis(*[table.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS], limit, least)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Groups of a sorted stream, in parts of ``most`` rows if it is given."""
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
        edges = group_edges(table, keys)
        if len(edges) < 2:
            continue
        for a, b in zip(edges, edges[1:-1]):
            yield table.slice(a, b - a)
        waiting = table.slice(edges[-2])
        if most and waiting.num_rows >= most:
            yield waiting
            waiting = None
    if waiting is not None and waiting.num_rows:
        yield waiting


def _streamed(limit: float, least: float, most: int):
    """Whole recordings in a sorted stream: each part of one is entered in the state the part before it left."""
    def run(batches):
        key, state = None, None
        for part in _groups(batches, [KEY], most):
            now, rows = part.column(KEY)[0].as_py(), []
            if now != key:
                rows += _events(key, [(state.first, state.last)]) if state and state.first else []
                key, state = now, None
            a = _analysis(part, limit, least)
            found, entry, state = step(a.summary(), state, limit, least)
            rows += _events(key, found + (list(a.fixations(entry)) if entry is not None else []))
            yield _batch(rows)
        if state and state.first:
            yield _batch(_events(key, [(state.first, state.last)]))

    return run


def _summaries(limit: float, least: float):
    def run(batches):
        for part in _groups(batches, [KEY, BLOCK]):
            raw = pickle.dumps(_analysis(part, limit, least).summary())
            yield pa.RecordBatch.from_arrays([part.column(KEY).slice(0, 1).combine_chunks(), part.column(BLOCK).slice(0, 1).combine_chunks(),
                                              pa.array([raw], pa.binary())], names=[KEY, BLOCK, "summary"])

    return run


def _chained(limit: float, least: float):
    """Recordings' blocks in order: the fixations that cross edges, and each block's entry (``start_index`` null)."""
    def run(batches):
        key, state = None, None
        for batch in batches:
            rows: list[tuple] = []
            for now, block, raw in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if now != key:
                    rows += [(None, None, *e) for e in _events(key, [(state.first, state.last)])] if state and state.first else []
                    key, state = now, None
                found, entry, state = step(pickle.loads(raw), state, limit, least)
                rows += [(None, None, *e) for e in _events(key, found)]
                if entry is not None:
                    rows.append((block, entry, key, *[None] * 6))
            yield out(rows)
        if state and state.first:
            yield out([(None, None, *e) for e in _events(key, [(state.first, state.last)])])

    def out(rows):
        blocks, entries, *rest = list(zip(*rows)) or [()] * 9
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(entries, pa.int64()), *[pa.array(c, k) for c, k in zip(rest, kinds)]],
                                          names=["block", "entry", *NAMES])

    return run


def _entered(limit: float, least: float):
    def run(batches):
        for part in _groups(batches, [KEY, BLOCK]):
            entry = part.column("entry")[0].as_py()
            yield _batch(_events(part.column(KEY)[0].as_py(), list(_analysis(part, limit, least).fixations(entry))))

    return run


def dispersion_fixations(samples: DataFrame, max_dispersion: float = 100.0, min_duration_ms: float = 100.0) -> DataFrame:
    """Fixations by the dispersion-threshold method (x range + y range of a growing window).

    Samples without a position end a window. A recording that is laid out in blocks is analysed block by block in parallel;
    others are streamed in parts, each entered in the state that the part before it left.
    """
    limit, least = float(max_dispersion), float(min_duration_ms)
    usable = samples.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    df = shift(usable, {"_pi": F.col(INDEX)})
    df = df.withColumn("_breaks", F.col("_pi").isNull() | (F.col("_pi") != F.col(INDEX) - 1))
    if not is_split(df):
        rows = df.select(KEY, *COLUMNS).repartition(KEY).sortWithinPartitions(KEY, INDEX)
        return rows.mapInArrow(_streamed(limit, least, STREAM_ROWS), SCHEMA)
    rows = settle(df.select(KEY, F.col(BLOCK).cast("long").alias(BLOCK), *COLUMNS))
    dealt = rows.repartition(KEY, BLOCK).sortWithinPartitions(KEY, BLOCK, INDEX)
    summaries = dealt.mapInArrow(_summaries(limit, least), f"{KEY} string, {BLOCK} long, summary binary")
    chain = summaries.repartition(KEY).sortWithinPartitions(KEY, BLOCK).mapInArrow(_chained(limit, least), f"block long, entry long, {SCHEMA}")
    chain = materialize(chain, "chain")
    entries = chain.filter("block IS NOT NULL").select(KEY, F.col("block").alias(BLOCK), "entry")
    inner = rows.join(entries, [KEY, BLOCK]).select(KEY, BLOCK, *COLUMNS, "entry")
    inner = inner.repartition(KEY, BLOCK).sortWithinPartitions(KEY, BLOCK, INDEX).mapInArrow(_entered(limit, least), SCHEMA)
    return inner.union(chain.filter("block IS NULL").select(*NAMES))
