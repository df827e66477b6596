"""Packing by concatenating and cutting.

Pass one encodes each text, closes it with an end id and writes ids, the task's number and the tokens before the text in
that task to shared storage. The tasks' totals (one row a task) are summed up to each task's first global position. Pass two
places every text at its global position and cuts it at multiples of the sequence length, so a text is cut only where a
sequence ends, each id lies in one piece, and all sequences but the last are full.

Defined cases: a null or empty text is its end id alone. Repeated rows are packed once each; a null key is kept as it is.
Columns other than key and text are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.llm import arrays, pretokens, storage, tokenizer_files

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE = 1024
END_ID = 0
#: Pre-tokens that the library encodes at once.
AT_ONCE = 1000


@functools.cache
def token_bytes(tokenizer: str) -> np.ndarray:
    """How many bytes each id stands for: byte-level vocabularies write a letter for a byte."""
    vocab = tokenizer_files.library(tokenizer).get_vocab()
    sizes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
    for token, i in vocab.items():
        sizes[i] = len(token)
    return sizes


@functools.cache
def vocabulary(tokenizer: str, most: int = 800_000) -> pretokens.Vocabulary:
    """The ids of pre-tokens as the library gives them; ``most`` are remembered."""
    lib = tokenizer_files.library(tokenizer)

    def encode(found: list[str]) -> list[list[int]]:
        """The library's results take about a kilobyte each, so only a few are held at once."""
        parts = (found[k:k + AT_ONCE] for k in range(0, len(found), AT_ONCE))
        return [e.ids for part in parts for e in lib.encode_batch_fast(part, add_special_tokens=False)]

    def encode_row(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many pre-tokens in one text cost the library half of what each alone does. No id reaches over a place where it cuts
        pre-tokens, so the bytes of the ids tell which are whose; texts where they don't are encoded one by one.
        """
        size, stops = token_bytes(tokenizer), np.concatenate([[0], np.cumsum(lengths)])
        found, counts = [], []
        for k in range(0, len(lengths), AT_ONCE):
            bounds = stops[k:k + AT_ONCE + 1]
            text = raw[bounds[0]:bounds[-1]]
            ids = np.array(lib.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.concatenate([[0], np.cumsum(size[ids])])
            bounds = bounds - bounds[0]
            place = np.searchsorted(ends, bounds)
            if ends[-1] != len(text) or not np.array_equal(ends[place], bounds):
                each = encode([text[a:b].decode() for a, b in zip(bounds.tolist(), bounds[1:].tolist())])
                ids = np.array([i for part in each for i in part], np.uint32)
                place = np.cumsum([0, *map(len, each)])
            found.append(ids)
            counts.append(np.diff(place))
        return np.concatenate(found), np.concatenate(counts)

    blank_inside = any(b" " in s for s in tokenizer_files.specials(tokenizer))
    return pretokens.Vocabulary(encode, most=most, encode_row=None if blank_inside else encode_row)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``key``, ids as little-endian 32-bit integers, ``n_tokens``, the task's number and the tokens before in it."""
    def run(batches):
        task, before = TaskContext.get().partitionId(), 0
        special = tokenizer_files.specials(tokenizer)
        for batch in batches:
            for t in arrays.texts(batch.column(1)):
                p = pretokens.pieces(t, pretokens.BYTE_LEVEL, special)
                known = vocabulary(tokenizer)
                entry = known.lookup(t, p)
                flat, starts, lengths = known.arrays()
                ids = flat[arrays.expand(starts[entry], lengths[entry])]
                counts = arrays.sums(lengths[entry], p.bounds)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
                stops = np.concatenate([[0], np.cumsum(counts + 1)])
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), t.rows, [None, pa.py_buffer((stops * 4).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.rows), binary, pa.array(counts + 1), pa.array(np.full(t.rows, task)),
                     pa.array(before + stops[:-1])],
                    names=[key, "ids", "n_tokens", "task", "before"],
                )
                before += int(stops[-1])

    schema = docs.select(F.col(f"`{key}`")).schema.add("ids", "binary").add("n_tokens", "long").add("task", "long").add("before", "long")
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def first_positions(tokens: DataFrame) -> dict[int, int]:
    """The global position of each task's first token; one number a task of the write."""
    totals = sorted((r["task"], r["n"]) for r in tokens.groupBy("task").agg(F.sum("n_tokens").alias("n")).collect())
    first, place = {}, 0
    for task, n in totals:
        first[task] = place
        place += n
    return first


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, length: int = SEQUENCE,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its ids.

    ``start`` counts the text's ids before the piece, ``offset`` the ids before it in sequence ``sequence_id``.
    """
    spark = docs.sparkSession
    tokens = storage.written(encoded(docs, key, text, tokenizer, end_id), "packing")
    first = spark.sparkContext.broadcast(first_positions(tokens))

    def run(batches):
        for batch in batches:
            n = batch.column(2).to_numpy()
            place = np.array([first.value[k] for k in batch.column(3).to_numpy().tolist()], np.int64) + batch.column(4).to_numpy()
            pieces = (place + n - 1) // length - place // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = place[row] // length + nth
            begin = np.maximum(sequence * length, place[row])
            end = np.minimum((sequence + 1) * length, (place + n)[row])
            start = begin - place[row]
            views = [memoryview(x.as_buffer()) for x in batch.column(1)]
            cuts = [views[r][4 * a:4 * b] for r, a, b in zip(row.tolist(), start.tolist(), (end - place[row]).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - begin),
                 pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length),
                 pa.array([c.tobytes() for c in cuts], pa.binary())],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    schema = docs.select(F.col(f"`{key}`")).schema
    for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(c, "long")
    return tokens.mapInArrow(run, schema.add("ids", "binary"))


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces without their ids."""
    return pieces.drop("ids")


def sequences(pieces: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """One row per sequence: its ids in order, as one array; at most ``length`` ids are gathered for each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids")).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
