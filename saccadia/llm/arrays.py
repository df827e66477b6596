"""Texts as byte arrays: words, word hashes and repeated keys for a whole Arrow batch at once.

A batch is cut into slices of about one megabyte of text, so memory does not depend on how many rows
Spark puts in a batch; one longer text makes a slice of its own. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 513, dtype=np.uint64) * _STEP).reshape(2, 256)


@dataclass
class Texts:
    """Consecutive rows of a text column: row r is ``data[bounds[r]:bounds[r + 1]]``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.bounds[row]:self.bounds[row + 1]].tobytes()


def texts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column in slices of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield Texts(row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
        row = end


@dataclass
class Words:
    """Words of a slice in order: bytes ``starts[i]:ends[i]``; row r has words ``bounds[r]:bounds[r + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(t: Texts, outside: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are not in ``outside``, within a row."""
    n = len(t.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(t.rows + 1, np.int64))
    out = outside[t.data]
    cut = np.zeros(n + 1, bool)
    cut[t.bounds] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = out[:-1]
    starts = np.flatnonzero(~out & (before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = out[1:]
    ends = np.flatnonzero(~out & (after | cut[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, t.bounds))


def _span_sums(values: np.ndarray, place: np.ndarray, stops: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A byte's share depends on the byte and its place in no linear way, so shares of different strings don't cancel out."""
    x = codes[values] + place
    x = (x ^ (x >> np.uint64(29))) * _TURN
    x ^= x >> np.uint64(32)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return mix(total[stops] - total[stops - lengths] + lengths.astype(np.uint64) * codes[7])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; ``which`` (0 or 1) picks one of two independent ones."""
    return _hashes(data, starts, ends, (which,))[0]


def span_hash_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of each span."""
    return _hashes(data, starts, ends, (0, 1))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    lengths = np.asarray(ends - starts, np.int64)
    stops = np.cumsum(lengths)
    place = np.arange(int(stops[-1]) if len(stops) else 0) - np.repeat(stops - lengths, lengths)
    if len(starts) and np.array_equal(starts[1:], ends[:-1]):  # spans that follow one another without gaps
        values = data[starts[0]:ends[-1]]
    else:
        values = data[place + np.repeat(starts, lengths)]
    place = place.astype(np.uint64) * _STEP
    return tuple(_span_sums(values, place, stops, lengths, _CODES[k]) for k in which)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values; runs that cross a row's end are the caller's to drop.

    Runs of 1, 2, 4, ... values are mixed from two halves, the last step from two runs that may overlap.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, size = mix(h.astype(np.uint64)), 1
    while size < k:
        step = min(size, k - size)
        run = mix(run[:len(run) - step] * _TURN + run[step:] + np.uint64(size + step))
        size += step
    return run[:n]


def run_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of any length: each is mixed from the two runs of the same power of two that cover it."""
    lengths = np.asarray(ends - starts, np.int64)
    level = np.frexp(lengths)[1] - 1
    out, run, size = np.zeros(len(lengths), np.uint64), mix(h.astype(np.uint64)), 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = mix(run[starts[at]] * _TURN + run[ends[at] - size] + lengths[at].astype(np.uint64))
        run = mix(run[:max(0, len(run) - size)] * _TURN + run[size:] + np.uint64(2 * size))
        size *= 2
    return out


def gram_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Which positions start k values within one row."""
    n = int(bounds[-1])
    ok = np.zeros(n, bool)
    if n:
        rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        ok = np.arange(n) + k <= bounds[1:][rows]
    return ok


def repeats(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys (a, b) of rows: which occur before in the same row, and which occur more than once there."""
    key = mix(a ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    k, second, r = key[order], b[order], row[order]
    same = np.zeros(len(key), bool)
    same[1:] = (k[1:] == k[:-1]) & (second[1:] == second[:-1]) & (r[1:] == r[:-1])
    many = same.copy()
    many[:-1] |= same[1:]
    again, often = np.empty_like(same), np.empty_like(same)
    again[order], often[order] = same, many
    return again, often


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in a span."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.astype(np.uint64).view(np.int64)


def python_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")
