"""Pre-tokens of whole slices of text, found with array operations instead of a regular expression per text.

The rule is that of public byte-level tokenizers: English contractions, runs of letters, runs of digits, runs of other
marks, and white space; ``Style.spaces`` says whether a blank joins the run behind it (else white space is dropped),
``Style.single_digits`` whether each digit stands alone. Special strings are cut out first. The letter, digit and space
classes of a code point are those of the tokenizers library itself: it is asked once for each code point met.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from tokenizers import Regex, pre_tokenizers

from saccadia.llm import arrays

OTHER, LETTER, DIGIT, WHITE, UNKNOWN = range(5)
_CLASS = np.full(0x110000, UNKNOWN, np.uint8)


@dataclass(frozen=True)
class Style:
    spaces: bool
    single_digits: bool


BYTE_LEVEL = Style(spaces=True, single_digits=False)
WORD_LEVEL = Style(spaces=False, single_digits=True)


@functools.cache
def _tests():
    return [(k, pre_tokenizers.Split(Regex(p), "removed")) for k, p in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (WHITE, r"\s"))]


def _learn(points: np.ndarray) -> None:
    """Ask the library for the classes of code points not met before."""
    for c in points.tolist():
        alone = not 0xD800 <= c < 0xE000
        _CLASS[c] = next((k for k, test in _tests() if not test.pre_tokenize_str(chr(c))), OTHER) if alone else OTHER


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of valid UTF-8, and the byte each starts at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    points = lead.copy()
    if len(at) < len(data):
        n = len(data)
        byte = lambda k: data[np.minimum(at + k, n - 1)].astype(np.int32) & 0x3F
        for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            here = (lead >= low) & (lead < high)
            if here.any():
                value = lead & mask
                for k in range(1, more + 1):
                    value = (value << 6) | byte(k)
                points = np.where(here, value, points)
    return points, at


def classes(points: np.ndarray) -> np.ndarray:
    kinds = _CLASS[points]
    if (kinds == UNKNOWN).any():
        _learn(np.unique(points[kinds == UNKNOWN]))
        kinds = _CLASS[points]
    return kinds


@dataclass
class Pieces:
    """Pre-tokens of a slice: bytes ``starts[i]:ends[i]``; ``special[i]`` is the id of a special string or -1."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    special: np.ndarray


def _specials(t: arrays.Texts, specials: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Places of special strings: leftmost first, the longest of several at one place, never across rows."""
    found = []
    raw = t.data.tobytes() if specials else b""
    for s, i in specials.items():
        at = raw.find(s)
        while at >= 0:
            row = int(np.searchsorted(t.bounds, at, "right")) - 1
            if at + len(s) <= t.bounds[row + 1]:
                found.append((at, at + len(s), i))
            at = raw.find(s, at + 1)
    kept, end = [], 0
    for a, b, i in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end:
            kept.append((a, b, i))
            end = b
    return kept


def pieces(t: arrays.Texts, style: Style, specials: dict[bytes, int]) -> Pieces:
    none = np.zeros(0, np.int64)
    if len(t.data) == 0:
        return Pieces(none, none, np.zeros(t.rows + 1, np.int64), none)
    marks = _specials(t, specials)
    points, at = code_points(t.data)
    n = len(points)
    kinds = classes(points)
    edges = np.concatenate([t.bounds, *[np.array(m[:2]) for m in marks]])
    cut = np.zeros(n + 1, bool)  # a part that is cut on its own begins here
    cut[np.searchsorted(at, edges)] = True
    cut[0] = cut[n] = True
    prev_same = np.zeros(n, bool)
    prev_same[1:] = (kinds[1:] == kinds[:-1]) & ~cut[1:n]
    run = ~prev_same
    white = kinds == WHITE
    last = np.zeros(n, bool)  # the last of a white run that something follows in the same part
    last[:-1] = white[:-1] & ~white[1:] & ~cut[1:n]
    start = run.copy()
    joined = np.zeros(n, bool)
    if style.spaces:
        start |= last
        joined[1:] = last[:-1] & (points[:-1] == 32)
        start &= ~joined
    if style.single_digits:
        start |= kinds == DIGIT
    quote = np.flatnonzero((points == 39) & run & ~joined)
    if len(quote):
        _contractions(points, cut, quote, start)
    if marks:
        inside = np.searchsorted(at, [m[0] for m in marks]), np.searchsorted(at, [m[1] for m in marks])
        start &= ~arrays.covered(n, *inside)
        start[inside[0]] = True
    first = np.flatnonzero(start)
    starts = at[first]
    ends = np.append(starts[1:], len(t.data))
    special = np.full(len(first), -1, np.int64)
    if marks:
        special[np.searchsorted(starts, [m[0] for m in marks])] = [m[2] for m in marks]
    if not style.spaces:
        keep = ~white[first] | (special >= 0)
        starts, ends, special = starts[keep], ends[keep], special[keep]
    return Pieces(starts, ends, np.searchsorted(starts, t.bounds), special)


def _contractions(points: np.ndarray, cut: np.ndarray, quote: np.ndarray, start: np.ndarray) -> None:
    """A mark of elision that begins a run takes the letters behind it: s, t, m, d, re, ve or ll."""
    n = len(points)
    padded = np.append(points, [0, 0])
    open_ = ~np.append(cut, [True, True])
    one = np.where(open_[quote + 1], padded[quote + 1], 0)
    two = np.where(open_[quote + 1] & open_[quote + 2], padded[quote + 2], 0)
    length = np.zeros(len(quote), np.int64)
    length[np.isin(one, [ord(c) for c in "stmd"])] = 2
    for pair in ("re", "ve", "ll"):
        length[(one == ord(pair[0])) & (two == ord(pair[1]))] = 3
    hit = length > 0
    quote, length = quote[hit], length[hit]
    start[quote + 1] = False
    rest = quote + length
    start[rest[rest < n]] = True


def span_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> list:
    """The spans as a list of texts or of bytes."""
    lengths = ends - starts
    stops = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    raw = np.ascontiguousarray(data[arrays.expand(starts, lengths)])
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(raw.tobytes())]).to_pylist()


#: Bytes that begin no white space: printable ASCII, and first bytes of longer code points but for those of U+0080 to U+00BF and U+1000 to U+3FFF.
_NO_WHITE = np.zeros(256, bool)
_NO_WHITE[0x21:0x7F] = _NO_WHITE[0xC3:0xF5] = True
_NO_WHITE[0xE1:0xE4] = False


def stand_apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which pre-tokens are a blank and something that is not white: one behind the other, they are cut apart again at these blanks."""
    second = data[np.minimum(starts + 1, len(data) - 1)]
    return (ends - starts > 1) & (data[starts] == 32) & _NO_WHITE[second]


class Vocabulary:
    """What each distinct pre-token met by this process stands for, in flat arrays.

    Pre-tokens are found by one hash and held against a second, independent one; what differs there is encoded by itself.
    When there are more than ``most``, those that were not met again are forgotten.

    ``encode`` takes a list of pre-tokens (of Arrow type ``kind``) and returns the ids of each; ``label``, if given, makes a
    text of an entry's ids. ``encode_row``, if given, takes pre-tokens that ``stand_apart`` as one text with the length of
    each, and returns all ids and how many each has.
    """

    def __init__(self, encode, label=None, kind: pa.DataType = pa.string(), most: int = 800_000, encode_row=None):  # noqa: B008
        self.encode, self.label, self.kind, self.most, self.encode_row = encode, label, kind, most, encode_row
        self.again, self.stored = np.zeros(0, bool), 0
        self.keys, self.entries = self._slots(1 << 12)
        self.labels: list[str] = []
        self.checks = np.zeros(0, np.uint64)
        self.lengths, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.room, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _slots(n: int) -> tuple[np.ndarray, np.ndarray]:
        """``n`` (a power of two) free places for a key and its entry. A key is at its lowest bits or in the next places behind."""
        return np.zeros(n, np.uint64), np.full(n, -1, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        last = np.uint64(len(self.keys) - 1)
        slot = (keys & last).astype(np.int64)
        entry = self.entries[slot]
        other = (self.keys[slot] != keys) & (entry >= 0)
        entry[other] = -1
        open_, slot = np.flatnonzero(other), slot[other]
        while len(open_):
            slot = (slot + 1) & int(last)
            found = self.entries[slot]
            hit = (found >= 0) & (self.keys[slot] == keys[open_])
            entry[open_[hit]] = found[hit]
            rest = (found >= 0) & ~hit
            open_, slot = open_[rest], slot[rest]
        return entry

    def _store(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Let distinct keys that are not there yet lead to their entries; half of the places stay free."""
        if 2 * (self.stored + len(keys)) > len(self.keys):
            used = self.entries >= 0
            keys, entries = np.concatenate([self.keys[used], keys]), np.concatenate([self.entries[used], entries])
            self.keys, self.entries = self._slots(1 << (2 * len(keys)).bit_length())
            self.stored = 0
        self.stored += len(keys)
        last = len(self.keys) - 1
        slot = (keys & np.uint64(last)).astype(np.int64)
        while len(keys):
            free = self.entries[slot] < 0
            self.keys[slot[free]], self.entries[slot[free]] = keys[free], entries[free]  # of several at one place the last one has it
            rest = self.entries[slot] != entries
            keys, entries, slot = keys[rest], entries[rest], (slot[rest] + 1) & last

    def _forget(self) -> None:
        """Keep what was met again since the last time, or nothing if that is still too much."""
        keep = np.flatnonzero(self.again) if self.again.sum() <= self.most // 2 else np.zeros(0, np.int64)
        lengths = self.lengths[keep]
        ids = self.room[arrays.expand(self.starts[keep], lengths)]
        self.room[:len(ids)] = ids
        self.used, self.lengths, self.starts, self.checks = len(ids), lengths, np.cumsum(lengths) - lengths, self.checks[keep]
        if self.label:
            self.labels = [self.labels[k] for k in keep.tolist()]
        number = np.full(len(self.again), -1, np.int64)
        number[keep] = np.arange(len(keep))
        used = self.entries >= 0
        keys, entries = self.keys[used], number[self.entries[used]]
        self.keys, self.entries = self._slots(len(self.keys))
        self.again, self.stored = np.zeros(len(keep), bool), 0
        self._store(keys[entries >= 0], entries[entries >= 0])

    def _append(self, checks: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """New entries, which no key leads to yet."""
        total = len(ids)
        while self.used + total > len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.used:self.used + total] = ids
        entries = np.arange(len(self.lengths), len(self.lengths) + len(lengths))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += total
        self.again = np.concatenate([self.again, np.zeros(len(lengths), bool)])
        self.checks = np.concatenate([self.checks, checks])
        if self.label:
            stops = np.cumsum(lengths).tolist()
            listed = ids.tolist()
            self.labels.extend([self.label(listed[a:b]) for a, b in zip([0, *stops], stops)])
        return entries

    def _encoded(self, t: arrays.Texts, p: Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some pre-tokens, and how many each has."""
        special, starts, ends = p.special[which], p.starts[which], p.ends[which]
        lengths = np.ones(len(which), np.int64)
        in_row = stand_apart(t.data, starts, ends) & (special < 0) if self.encode_row else np.zeros(len(which), bool)
        alone = (special < 0) & ~in_row
        found = self.encode(span_values(t.data, starts[alone], ends[alone], self.kind))
        lengths[alone] = np.fromiter(map(len, found), np.int64, len(found))
        row_ids = np.zeros(0, np.uint32)
        if in_row.any():
            sizes = ends[in_row] - starts[in_row]
            row_ids, lengths[in_row] = self.encode_row(t.data[arrays.expand(starts[in_row], sizes)].tobytes(), sizes)
        ids, first = np.empty(int(lengths.sum()), np.uint32), np.cumsum(lengths) - lengths
        ids[first[special >= 0]] = special[special >= 0]
        ids[arrays.expand(first[in_row], lengths[in_row])] = row_ids
        ids[arrays.expand(first[alone], lengths[alone])] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths[alone].sum()))
        return ids, lengths

    def lookup(self, t: arrays.Texts, p: Pieces) -> np.ndarray:
        """The entry of each pre-token."""
        if self.stored > self.most:
            self._forget()
        keys, checks = arrays.span_hash_pairs(t.data, p.starts, p.ends)
        special = p.special >= 0
        if special.any():
            keys, checks = (np.where(special, p.special.astype(np.uint64), x) for x in (keys, checks))
        entry = self._find(keys)
        missing = np.flatnonzero(entry < 0)
        self.again[entry[entry >= 0]] = True
        if len(missing):
            new, first, where = np.unique(keys[missing], return_index=True, return_inverse=True)
            which = missing[first]
            made = self._append(checks[which], *self._encoded(t, p, which))
            self._store(new, made)
            entry[missing] = made[where]
        other = np.flatnonzero(self.checks[entry] != checks)
        if len(other):
            entry[other] = self._append(checks[other], *self._encoded(t, p, other))
        return entry

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, and each entry's start and length."""
        return self.room, self.starts, self.lengths
