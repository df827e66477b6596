"""Alignment of two tokenizers' tokens by merging the byte offsets at which they end.

Both token sequences of a text cover the same bytes, so two tokens overlap just where the sorted merge of all ends of A and
B has a distinct end: the one token that ends there and the other one that is open. Texts are gathered in blocks of a few
megabytes, and the merge of a block's ends is cut into pieces of equal work: a binary search along each diagonal of the grid
(ends of A) x (ends of B) says how many ends of either side come before it (of equal ends that of A is first). Pieces are
merged independently, by array operations. A piece knows of the one before it only the last end of A, which stitches the
group that two pieces share. Every text's last ends are equal, so no group reaches into the next text.

A block writes one row: for each text its counts and digest, a dictionary of the block's distinct id pairs with the number
of its texts that hold each, and for each text the dictionary numbers of its pairs. Dictionaries are summed up by pair over
all blocks, and the sums go back to the blocks; a frequent pair has one row for each block, and an id of A has no more pairs
than B has ids.

Defined cases: a null or empty text, and one whose tokens don't spell out the bytes of a blank and the text (it holds U+2581),
has no tokens, zeros, and an empty digest. Repeated rows count each on their own, null keys too. Other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from saccadia.llm import arrays, pretokens, storage, tokenizer_files

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20
#: Ends in a piece.
PIECE = 1 << 16
#: Distinct pre-tokens that a process remembers for each tokenizer.
MOST = 250_000
#: In place of ids, for a pre-token whose tokens don't spell it out.
UNSPELT = 0xFFFFFFFF
BLANK = "▁".encode()


@dataclass(frozen=True)
class Side:
    """One tokenizer: what its pre-tokens stand for, and the bytes of each id's token."""

    known: pretokens.Vocabulary
    lengths: np.ndarray


def _spelt(found: list[str], ids: list[list[int]], token_bytes: list[bytes]) -> list[list[int]]:
    return [x if b"".join([token_bytes[i] for i in x]) == s.encode() else [UNSPELT] for s, x in zip(found, ids)]


@functools.cache
def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as it is and the other bytes from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {chr(b) if b in shown else chr(next(rest)): b for b in range(256)}


@functools.cache
def side_a(name: str) -> Side:
    """A byte-level file; special strings in texts are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_files.path(name))
    lib.no_padding()
    lib.no_truncation()
    lib.encode_special_tokens = True
    letters = _byte_of_letter()
    token_bytes = [b""] * lib.get_vocab_size()
    for token, i in lib.get_vocab().items():
        token_bytes[i] = bytes([letters[c] for c in token]) if set(token) <= letters.keys() else token.encode()

    def encode(found):
        return _spelt(found, [e.ids for e in lib.encode_batch_fast(found, add_special_tokens=False)], token_bytes)

    return Side(pretokens.Vocabulary(encode, most=MOST), np.array([len(b) for b in token_bytes], np.int64))


@functools.cache
def side_b(name: str) -> Side:
    """A sentencepiece file that puts a blank in front of a text and leaves white space as it is.

    No piece holds a blank behind another letter, so blanks and the letters behind them are encoded by themselves.
    """
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=tokenizer_files.path(name))
    token_bytes = []
    for i in range(lib.get_piece_size()):
        piece = lib.id_to_piece(i)
        coded = re.fullmatch("<0x([0-9A-F]{2})>", piece) if lib.is_byte(i) else None
        token_bytes.append(bytes([int(coded[1], 16)]) if coded else piece.replace("▁", " ").encode())
    if any(b" " in b.lstrip(b" ") for b in token_bytes):
        raise ValueError(f"{name}: pieces with blanks inside are not supported")
    blank = lib.piece_to_id("▁")

    def encode(found):
        ids = lib.encode([s[1:] for s in found], num_threads=1)
        return _spelt(found, [x if s != " " else [blank] for s, x in zip(found, ids)], token_bytes)

    return Side(pretokens.Vocabulary(encode, most=MOST), np.array([len(b) for b in token_bytes], np.int64))


def with_blank(t: arrays.Texts) -> arrays.Texts:
    """The same texts with a blank in front of each."""
    return arrays.Texts(t.first, np.insert(t.data, t.bounds[:-1], 32), t.bounds + np.arange(len(t.bounds)))


def blank_pieces(t: arrays.Texts) -> pretokens.Pieces:
    """Runs of blanks with what follows up to the next blank; each text begins with a blank."""
    blank = t.data == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[t.bounds[:-1]] = True
    starts = np.flatnonzero(begins)
    return pretokens.Pieces(starts, np.append(starts[1:], len(t.data)), np.searchsorted(starts, t.bounds), np.full(len(starts), -1, np.int64))


def _ids(t: arrays.Texts, p: pretokens.Pieces, side: Side) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the bounds of each text's."""
    entry = side.known.lookup(t, p)
    flat, starts, lengths = side.known.arrays()
    ids = flat[arrays.expand(starts[entry], lengths[entry])]
    return ids, np.concatenate([[0], np.cumsum(arrays.sums(lengths[entry], p.bounds))])


def _without(ids: np.ndarray, bounds: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts when the texts that are ``bad`` have none."""
    counts = np.diff(bounds)
    if bad.any():
        ids = ids[np.repeat(~bad, counts)]
        counts = np.where(bad, 0, counts)
    return ids, counts


def tokens(t: arrays.Texts, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and how many each text has, ids of B and how many."""
    spaced = with_blank(t)
    ids_a, bounds_a = _ids(spaced, pretokens.pieces(spaced, pretokens.BYTE_LEVEL, {}), a)
    ids_b, bounds_b = _ids(spaced, blank_pieces(spaced), b)
    bad = np.diff(t.bounds) == 0
    for ids, bounds in ((ids_a, bounds_a), (ids_b, bounds_b)):
        bad[np.searchsorted(bounds, np.flatnonzero(ids == UNSPELT), "right") - 1] = True
    raw = t.data.tobytes()
    at = raw.find(BLANK)
    while at >= 0:
        bad[np.searchsorted(t.bounds, at, "right") - 1] = True
        at = raw.find(BLANK, at + 1)
    return *_without(ids_a, bounds_a, bad), *_without(ids_b, bounds_b, bad)


def diagonals(ends_a: np.ndarray, ends_b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first ``at`` ends of the merge are of A, for all diagonals at once."""
    low, high = np.maximum(at - len(ends_b), 0), np.minimum(at, len(ends_a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # the end of A comes first if it is not behind the end of B that would have to follow it
        first = open_ & (ends_a[np.minimum(middle, len(ends_a) - 1)] <= ends_b[np.clip(at - 1 - middle, 0, len(ends_b) - 1)])
        low = np.where(first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low


@dataclass(frozen=True)
class Piece:
    """Ends ``i0:i1`` of A and ``j0:j1`` of B, and the end of A before them (-1 if there is none)."""

    i0: int
    j0: int
    ends_a: np.ndarray
    ends_b: np.ndarray
    before: int


def cut(ends_a: np.ndarray, ends_b: np.ndarray, size: int = PIECE) -> Iterator[Piece]:
    """The merge in pieces of ``size`` ends."""
    total = len(ends_a) + len(ends_b)
    if not total:
        return
    at = np.append(np.arange(0, total, size), total)
    i = diagonals(ends_a, ends_b, at)
    j = at - i
    for i0, i1, j0, j1 in zip(i.tolist(), i[1:].tolist(), j.tolist(), j[1:].tolist()):
        yield Piece(i0, j0, ends_a[i0:i1], ends_b[j0:j1], int(ends_a[i0 - 1]) if i0 else -1)


def overlaps(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The piece's links as places in A and B, and the groups that end in it as counts of tokens of A and B so far."""
    open_b = np.searchsorted(p.ends_b, p.ends_a, "left")
    done_a = np.searchsorted(p.ends_a, p.ends_b, "right")
    last_a = np.concatenate([[p.before], p.ends_a])[done_a]
    both = last_a == p.ends_b
    alone = np.flatnonzero(~both)
    meet = np.flatnonzero(both)
    return (np.concatenate([p.i0 + np.arange(len(p.ends_a)), p.i0 + done_a[alone]]), np.concatenate([p.j0 + open_b, p.j0 + alone]),
            p.i0 + done_a[meet], p.j0 + meet + 1)


def merged(ends_a: np.ndarray, ends_b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links and groups of all pieces, one after another."""
    found = [overlaps(p) for p in cut(ends_a, ends_b, size)]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([x[k] for x in found]) if found else none for k in range(4))


@functools.cache
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all numbers below ``size``, with room for one mark behind them, and how many digits each has."""
    width = len(str(size))
    text = np.char.ljust(np.arange(size).astype(f"S{width + 1}"), width + 1)
    return text.view(np.uint8).reshape(size, width + 1), np.char.str_len(np.char.rstrip(text)).astype(np.int64)


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups as ``a1,a2|b1;a3|b2,b3``; groups that are ``last`` of a text have no mark behind. Also the bytes up to each group's end."""
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    marks = np.full(len(order), ord(","), np.uint8)
    order[np.arange(len(ids_a)) + np.repeat(cut_b - n_b, n_a)] = ids_a
    order[np.arange(len(ids_b)) + np.repeat(cut_a, n_b)] = ids_b
    ends = cut_a + cut_b - 1
    marks[ends - n_b] = ord("|")
    marks[ends] = np.where(last, 0, ord(";"))
    table, lengths = _digits(1 << max(16, int(order.max(initial=0)).bit_length()))
    text, size = table[order], lengths[order]
    text[np.arange(len(order)), size] = marks
    used = np.arange(table.shape[1]) <= size[:, None]
    used[ends[last], size[ends[last]]] = False
    return text[used], np.cumsum(used.sum(axis=1))[ends]


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.uint64(len(numbers)).tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, "zstd", asbytes=True) if n else b"", np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n).astype(np.int64)


def _block(parts: list[tuple], size: int, a: Side, b: Side) -> dict:
    """All columns of a block but its number and keys, from the tokens of its slices."""
    ids_a, ids_b = (np.concatenate([x[k] for x in parts]).astype(np.int64) for k in (0, 2))
    n_a, n_b = (np.concatenate([x[k] for x in parts]) for k in (1, 3))
    link_a, link_b, cut_a, cut_b = merged(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]), size)
    rows = len(n_a)
    after = np.cumsum(n_a)
    row_of_cut = np.searchsorted(after, cut_a, "left")
    n_groups = np.bincount(row_of_cut, minlength=rows)
    last = np.append(row_of_cut[1:] != row_of_cut[:-1], True) if len(cut_a) else np.zeros(0, bool)
    text, stops = group_texts(ids_a, ids_b, cut_a, cut_b, last)
    digests, raw, begin = [""] * rows, memoryview(text), 0
    for row, end in zip(row_of_cut[last].tolist(), stops[last].tolist()):
        digests[row] = hashlib.sha256(raw[begin:end]).hexdigest()
        begin = end
    del text, raw
    pair, number = np.unique((ids_a[link_a] << 32) | ids_b[link_b], return_inverse=True)
    held, times = np.unique((np.searchsorted(after, link_a, "right") << 32) | number, return_counts=True)
    row, number = held >> 32, held & 0xFFFFFFFF
    docs = np.bincount(number, minlength=len(pair))
    # frequent pairs get the small numbers
    order = np.argsort(-docs, kind="stable")
    place = np.empty(len(pair), np.int64)
    place[order] = np.arange(len(pair))
    held = np.argsort((row << 32) | place[number], kind="stable")
    row, number, times = row[held], place[number[held]], times[held]
    first = np.append(True, row[1:] != row[:-1])[:len(row)]
    steps = np.where(first, number, np.diff(number, prepend=0))
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups, "groups_sha256": digests,
            "pair": pair[order], "docs": docs[order], "held": np.bincount(row, minlength=rows), "steps": _packed(steps), "times": _packed(times)}


def blocks(docs: DataFrame, key: str, text: str, tokenizer_a: str, tokenizer_b: str, size: int = PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block."""
    read = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        task, n, parts, keys, held = TaskContext.get().partitionId(), 0, [], [], 0
        a, b = side_a(tokenizer_a), side_b(tokenizer_b)

        def out():
            found = _block(parts, size, a, b)
            columns = [pa.array([(task << 32) + n], pa.int64()), _list(pa.concat_arrays(keys))]
            for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "docs", "held"):
                columns.append(_list(pa.array(found[name], pa.string() if name == "groups_sha256" else pa.int64())))
            columns += [pa.array([found[name]], pa.binary()) for name in ("steps", "times")]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            for t in arrays.texts(batch.column(1)):
                if parts and held + len(t.data) > block_bytes:
                    yield out()
                    n, parts, keys, held = n + 1, [], [], 0
                parts.append(tokens(t, a, b))
                keys.append(batch.column(0).slice(t.first, t.rows))
                held += len(t.data)
        if parts:
            yield out()

    schema = read.select(F.array("key").alias("keys")).schema
    schema = read.sparkSession.createDataFrame([], "block long").schema.add(schema[0])
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, ArrayType(LongType()))
    schema = schema.add("groups_sha256", ArrayType(StringType()))
    for name in ("pair", "docs", "held"):
        schema = schema.add(name, ArrayType(LongType()))
    return read.mapInArrow(run, schema.add("steps", "binary").add("times", "binary"))


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pair_counts(stored: DataFrame) -> DataFrame:
    """(``pair``, ``count``, ``best``): how many texts hold an id pair (A's id in the high half), and whether none of A's id has more."""
    each = stored.select(F.explode(F.arrays_zip("pair", "docs")).alias("p")).select("p.*")
    counts = each.groupBy("pair").agg(F.sum("docs").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("count") == most)


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """The block's texts with the sums over their links; ``right`` has the counts of its dictionary."""
    counts, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
    at = right.column("at").to_numpy()
    counts[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    one = {name: left.column(name).combine_chunks() for name in left.column_names}
    steps, times = (_unpacked(one[name][0].as_buffer().to_pybytes()) for name in ("steps", "times"))
    bounds = np.concatenate([[0], np.cumsum(one["held"].values.to_numpy())])
    total = np.cumsum(steps)
    before = np.concatenate([[0], total])[bounds[:-1]]
    number = total - np.repeat(before, np.diff(bounds))
    columns = [one[name].flatten() for name in ("keys", "n_a", "n_b", "n_groups", "n_links")]
    sums = [pa.array(arrays.sums(times * x[number], bounds)) for x in (best, counts)]
    return pa.table([*columns, *sums, one["groups_sha256"].flatten()], names=["key", *SUMS, "groups_sha256"])


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """One row per text: its tokens, groups and links, what its links weigh in the corpus, and the digest of its groups."""
    stored = storage.written(blocks(docs, key, text, tokenizer_a, tokenizer_b), "alignment", compression="zstd")
    asked = stored.select(F.col("block").alias("asking"), F.posexplode("pair").alias("at", "pair"))
    answers = asked.join(pair_counts(stored), "pair").select("asking", F.col("at").cast("long").alias("at"), "count", "best")
    told = stored.select("block", "keys", *SUMS[:4], "groups_sha256", "held", "steps", "times")
    schema = docs.select(F.col(f"`{key}`").alias("key")).schema
    for name in SUMS:
        schema = schema.add(name, "long")
    scored = told.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(_scored, schema.add("groups_sha256", "string"))
    return scored.withColumnRenamed("key", key)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> DataFrame:
    """The groups themselves: ``key`` and for each text a list of (ids of A, ids of B)."""
    read = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        a, b = side_a(tokenizer_a), side_b(tokenizer_b)
        for batch in batches:
            for t in arrays.texts(batch.column(1)):
                ids_a, n_a, ids_b, n_b = tokens(t, a, b)
                _, _, cut_a, cut_b = merged(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]))
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, c), pa.int32()), pa.array(ids.astype(np.int32)))
                         for c, ids in ((cut_a, ids_a), (cut_b, ids_b))]
                bounds = np.append(0, np.searchsorted(cut_a, np.cumsum(n_a), "right"))
                pairs = pa.StructArray.from_arrays(lists, names=["a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.rows), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)], names=["key", "groups"])

    pairs = docs.sparkSession.createDataFrame([], "g struct<a: array<int>, b: array<int>>").schema[0].dataType
    schema = read.select("key").schema.add("groups", ArrayType(pairs))
    return read.mapInArrow(run, schema).withColumnRenamed("key", key)
