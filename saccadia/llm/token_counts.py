"""Token counts from pre-token frequencies.

Texts are cut into pre-tokens. Each block of texts (a few megabytes of one task's input) sends one row per distinct pre-token:
which of its texts hold it, and how often. Pieces are counted once per distinct pre-token, the counts join these rows, and
frequency times pieces is summed per text (first by block in each task, as arrays). No list of ids is made for a text. Pre-tokens that are entries of the vocabulary
itself, a table of fixed size, are counted once per process and summed where the text is read, so the most frequent ones
are not sent; the rest has one row a block, however frequent, and Spark splits a key that is still too large.

Defined cases: a null or empty text has no tokens. Repeated rows are counted each on its own, null keys too. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.llm import arrays, pretokens, storage, tokenizer_files

TOKENIZER = "byte_bpe_50k.json"
#: Texts are gathered in blocks of about this size; members of a block are numbered in 15 bits.
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 1 << 15
#: Memberships held by a task before it passes on their sums.
HELD = 1 << 21
#: Hashes of pre-tokens that a task remembers, so as not to pass them on twice.
REMEMBERED = 1 << 20


@functools.cache
def _entries(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the vocabulary's own entries, sorted, and how many pieces each has as a pre-token."""
    lib = tokenizer_files.library(tokenizer)
    tokens = [lib.decode([i], skip_special_tokens=False) for i in range(lib.get_vocab_size())]
    tokens = sorted({t for t in tokens if t and "�" not in t} - {s.decode() for s in tokenizer_files.specials(tokenizer)})
    alone = [t for t in tokens if len(lib.pre_tokenizer.pre_tokenize_str(t)) == 1]
    counts = [len(e.ids) for e in lib.encode_batch_fast(alone, add_special_tokens=False)]
    t = next(arrays.texts(pa.array(alone), 1 << 30))
    keys = arrays.span_hashes(t.data, t.bounds[:-1], t.bounds[1:])
    order = np.argsort(keys)
    return keys[order], np.array(counts, np.int64)[order]


def _known(t: arrays.Texts, tokenizer: str):
    """A slice's pre-tokens, their hashes, the pieces of those that are vocabulary entries or special strings, and which are not."""
    entries, pieces_of = _entries(tokenizer)
    p = pretokens.pieces(t, pretokens.BYTE_LEVEL, tokenizer_files.specials(tokenizer))
    key = arrays.span_hashes(t.data, p.starts, p.ends)
    place = np.minimum(np.searchsorted(entries, key), len(entries) - 1)
    own = (entries[place] == key) & (p.special < 0)
    return p, key, np.where(own, pieces_of[place], (p.special >= 0).astype(np.int64)), ~own & (p.special < 0)


def _block(part: list[arrays.Texts], tokenizer: str):
    """The block's other pre-tokens: hashes and members in order, frequencies, and the text of each hash."""
    keys, rows, samples, base = [], [], {}, 0
    for t in part:
        p, key, _, rest = _known(t, tokenizer)
        row = np.repeat(np.arange(t.rows), np.diff(p.bounds))[rest]
        distinct, first = np.unique(key[rest], return_index=True)
        new = [j for j, k in enumerate(distinct.tolist()) if k not in samples]
        spans = first[new]
        samples.update(zip(distinct[new].tolist(), pretokens.span_values(t.data, p.starts[rest][spans], p.ends[rest][spans], pa.string())))
        keys.append(key[rest])
        rows.append(row + base)
        base += t.rows
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    change = np.ones(len(key), bool)
    change[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(change)
    return key[at], row[at], np.diff(np.append(at, len(key))), samples


def _postings(row: np.ndarray, freq: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Members and frequencies as 16-bit numbers, one binary value per pre-token.

    A member that holds the pre-token once is its number alone; otherwise the high bit is set and the frequency follows.
    A frequency above 16 bits is written as several entries.
    """
    over = freq > 0xFFFF
    if over.any():
        times = np.where(over, -(-freq // 0xFFFF), 1)
        entry = np.repeat(np.arange(len(row)), times)
        nth = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
        bounds = np.concatenate([[0], np.cumsum(times)])[bounds]
        row, freq = row[entry], np.minimum(freq[entry] - nth * 0xFFFF, 0xFFFF)
    odd = freq > 1
    at = np.arange(len(row)) + np.cumsum(odd) - odd
    out = np.empty(len(row) + int(odd.sum()), "<u2")
    out[at] = row | (odd.astype(np.int64) << 15)
    out[at[odd] + 1] = freq[odd]
    stops = np.append(at, len(out))[bounds]
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((stops * 2).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _unpacked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, frequencies and the places at which the members stand; a frequency can itself have the high bit set."""
    flag = values >> 15 == 1
    # a value is a frequency if the value before it is a flagged member: within a run of flagged values every second one is
    start = flag & ~np.concatenate([[False], flag[:-1]])
    run_at = np.maximum.accumulate(np.where(start, np.arange(len(values)), 0))
    odd_place = (np.arange(len(values)) - run_at) % 2 == 1
    in_run = flag | np.concatenate([[False], flag[:-1]])
    is_freq = in_run & odd_place
    at = np.flatnonzero(~is_freq)
    member = values[at]
    odd = member >> 15 == 1
    freq = np.ones(len(at), np.int64)
    freq[odd] = values[at[odd] + 1]
    return member & 0x7FFF, freq, at


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return storage.numbered(docs, F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def known_counts(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(row, key, n_bytes, known): the pieces of a text's pre-tokens that are vocabulary entries."""
    def run(batches):
        for batch in batches:
            for t in arrays.texts(batch.column(2)):
                p, _, pieces, _ = _known(t, tokenizer)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.rows), batch.column(1).slice(t.first, t.rows), pa.array(np.diff(t.bounds)),
                     pa.array(arrays.sums(pieces, p.bounds))], names=["row", "key", "n_bytes", "known"])

    schema = rows.select("row", "key").schema.add("n_bytes", "long").add("known", "long")
    return rows.mapInArrow(run, schema)


def _among(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among sorted ones; ``np.isin`` would sort all of these again each time."""
    if not len(seen):
        return np.zeros(len(keys), bool)
    return seen[np.minimum(np.searchsorted(seen, keys), len(seen) - 1)] == keys


def other_pretokens(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pre-tokens that are no vocabulary entries, each once."""
    def run(batches):
        seen, held = np.zeros(0, np.uint64), []
        for batch in batches:
            for t in arrays.texts(batch.column(0)):
                p, key, _, rest = _known(t, tokenizer)
                distinct, first = np.unique(key[rest], return_index=True)
                new = ~_among(seen, distinct)
                first = first[new]
                held.append(distinct[new])
                if len(seen) + sum(map(len, held)) > REMEMBERED:
                    seen, held = np.zeros(0, np.uint64), []
                elif len(held) > 20 or not len(seen):
                    seen, held = np.sort(np.concatenate([seen, *held]), kind="stable"), []
                strings = pretokens.span_values(t.data, p.starts[rest][first], p.ends[rest][first], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string())], names=["pretoken"])

    return rows.select("text").mapInArrow(run, "pretoken string").distinct()


def _followed(ids: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of runs of numbers that follow one another, of half a block at most."""
    edges = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)]
    return [(k, min(k + BLOCK_ROWS // 2, b)) for a, b in zip(edges, edges[1:]) for k in range(a, b, BLOCK_ROWS // 2)]


def frequencies(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (block, pre-token, texts and frequencies) of all pre-tokens that are no vocabulary entries."""
    def run(batches):
        part: list[tuple[arrays.Texts, int]] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for k, stop in _followed(ids):
                for t in arrays.texts(batch.column(1).slice(k, stop - k)):
                    size, n = sum(len(x.data) for x, _ in part), sum(x.rows for x, _ in part)
                    other_file = part and int(ids[k + t.first]) != part[0][1] + n
                    if part and (other_file or size + len(t.data) > BLOCK_BYTES or n + t.rows > BLOCK_ROWS):
                        yield out(part)
                        part = []
                    part.append((t, int(ids[k + t.first])))
        if part:
            yield out(part)

    def out(part):
        k, row, freq, samples = _block([t for t, _ in part], tokenizer)
        change = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        strings = pa.array([samples[x] for x in k[change].tolist()], pa.string())
        block = pa.array(np.full(len(change), part[0][1]))  # a block's rows are numbered without gaps
        return pa.RecordBatch.from_arrays([block, strings, _postings(row, freq, np.append(change, len(k)))], names=["block", "pretoken", "postings"])

    return rows.select("row", "text").mapInArrow(run, "block long, pretoken string, postings binary")


def piece_counts(pretoken: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of each pre-token of a table of distinct ones."""
    def run(batches):
        lib = tokenizer_files.library(tokenizer)
        for batch in batches:
            found = batch.column(0).to_pylist()
            n = [len(e.ids) for e in lib.encode_batch_fast(found, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["pretoken", "pieces"])

    return pretoken.mapInArrow(run, "pretoken string, pieces long")


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binary values, and each value's bounds among them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    values = np.frombuffer(data[offsets[0]:offsets[-1]].tobytes(), kind).astype(np.int64)
    return values, (offsets - offsets[0]) // np.dtype(kind).itemsize


def _block_sums(batches):
    """(block, members, sums): a task's rows summed for each block and member, as many as are held at once."""
    blocks, members, values, held = [], [], [], 0

    def out():
        key = np.concatenate(blocks) * BLOCK_ROWS + np.concatenate(members)
        distinct, where = np.unique(key, return_inverse=True)
        total = np.bincount(where, np.concatenate(values), len(distinct)).astype(np.int64)
        block, member = distinct // BLOCK_ROWS, distinct % BLOCK_ROWS
        at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        stops = np.append(at, len(block)).tolist()
        cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(stops, stops[1:])], pa.binary())
        names = [real[b] for b in block[at].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), cut(member, "<u2"), cut(total, "<u4")], names=["block", "members", "sums"])

    real, number = [], {}
    for batch in batches:
        place = np.array([number.setdefault(b, len(number)) for b in batch.column(0).to_pylist()], np.int64)
        real = list(number)
        packed, bounds = _numbers(batch.column(1), "<u2")
        member, freq, at = _unpacked(packed)
        row = np.searchsorted(bounds, at, "right") - 1
        blocks.append(place[row])
        members.append(member)
        values.append(freq * batch.column(2).to_numpy()[row])
        held += len(member)
        if held > HELD:
            yield from out()
            blocks, members, values, held = [], [], [], 0
    if held:
        yield from out()


def _row_sums(batches):
    """(row, tokens) from a block's sums, which follow one another; a block has a bounded number of members."""
    now, total = None, None

    def out():
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(now + at), pa.array(total[at])], names=["row", "tokens"])

    for batch in batches:
        members, bounds = _numbers(batch.column(1), "<u2")
        sums, _ = _numbers(batch.column(2), "<u4")
        for k, block in enumerate(batch.column(0).to_pylist()):
            if block != now:
                if now is not None:
                    yield out()
                now, total = block, np.zeros(BLOCK_ROWS, np.int64)
            mine = slice(bounds[k], bounds[k + 1])
            total[members[mine]] += sums[mine]
    if now is not None:
        yield out()


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, limit: int = 1024) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and whether these are more than ``limit``."""
    rows = numbered(storage.stable(docs), key, text)
    counts = piece_counts(other_pretokens(rows, tokenizer), tokenizer)
    joined = frequencies(rows, tokenizer).join(counts, "pretoken").select("block", "postings", "pieces")
    partial = joined.mapInArrow(_block_sums, "block long, members binary, sums binary")
    total = partial.repartition("block").sortWithinPartitions("block").mapInArrow(_row_sums, "row long, tokens long")
    n = F.col("known") + F.coalesce("tokens", F.lit(0))
    return known_counts(rows, tokenizer).join(total, "row", "left").select(F.col("key").alias(key), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
