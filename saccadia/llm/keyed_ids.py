"""Token ids in binary shards, found by key through a minimal perfect hash.

Writing deals the rows out by ranges of the key (rows with one key by a hash of their text and by their place, so a frequent
key is spread too), sorts each range, encodes it and writes it as one shard. Key hashes are then grouped by part of the
index, and a part is built for a bounded number of keys. Reading asks the parts for the places of the wanted keys, and
reads these from the shards, neighbours at once.

A shard file:   ids, little-endian, 2 or 4 bytes each; ``records + 1`` offsets counted in ids (64 bits);
                a footer of five 64-bit numbers: format, bytes an id, records, ids, first bytes of the name ``IDSHARD``.
An index part:  a header of 64-bit numbers (format, keys, levels, bits of each level), the bits of all levels, the number
                of set bits before each 64-bit word, and for each key in the order of its bit: fingerprint (32 bits), shard
                (32 bits), first record in the shard (64 bits), and records (64 bits).

The hash is a cascade of bit arrays: a key whose place in a level is nobody else's sets that bit, the others go to the next
level; a key's number is the number of bits before its own one. So a key is found in constant time, with about four bits a key.
A fingerprint of another 32 bits tells keys that are not stored, but for one in four thousand million.

Files are named anew in each attempt of a task and listed in ``manifest.json``, which is written last, so lost or repeated tasks
leave no wrong ones. They go to any file system that pyarrow opens by its address.

Defined cases: a null or empty text is its end id alone. A null key is a key like others and comes first. Rows with equal
keys follow one another, by a hash of their text; reading a key gives all of them. Other columns are not read. An empty
table gives a manifest without shards.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saccadia.llm import arrays, packing, pretokens, storage, tokenizer_files

FORMAT, NAME = 1, int.from_bytes(b"IDSHARD\0", "little")
#: Keys in a part of the index, on average.
PART_KEYS = 200_000
#: Bits of a level for each key that comes to it.
ROOM = 2
#: Far more levels than distinct hashes ever need.
MOST_LEVELS = 100
#: Ids that are read or passed on at once.
READ_IDS = 1 << 20
#: Bytes of text that are encoded at once, and pre-tokens that a process remembers: tasks of a machine share its memory with Spark's sort.
ENCODE_BYTES, MOST_PRETOKENS = 1 << 18, 400_000


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


# The hash


def _level_places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    turned = arrays.mix(keys ^ arrays.mix(np.full(1, level + 1, np.uint64)))
    return (turned % np.uint64(bits)).astype(np.int64)


def _bit_words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little").view("<u8")


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The bits of each level and the words of all, for distinct 64-bit keys."""
    sizes, words, rest = [], [np.zeros(0, "<u8")], keys
    while len(rest):
        if len(sizes) > MOST_LEVELS:
            raise ValueError("two keys have the same hashes")
        bits = -(-ROOM * len(rest) // 64) * 64
        place = _level_places(rest, len(sizes), bits)
        alone = np.bincount(place, minlength=bits) == 1
        sizes.append(bits)
        words.append(_bit_words(alone))
        rest = rest[~alone[place]]
    return sizes, np.concatenate(words)


def ranks(words: np.ndarray) -> np.ndarray:
    """Set bits before each word."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(words))])[:-1].astype("<u8")


def numbers(keys: np.ndarray, sizes: list[int], words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The number of each key; of keys that are not stored, that of some other key or -1."""
    out = np.full(len(keys), -1, np.int64)
    open_, first = np.arange(len(keys)), 0
    for level, bits in enumerate(sizes):
        place = _level_places(keys[open_], level, bits) + first
        word, bit = words[place >> 6], (place & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) == 1
        lower = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        out[open_[hit]] = before[place[hit] >> 6].astype(np.int64) + np.bitwise_count(lower)
        open_, first = open_[~hit], first + bits
    return out


def _record_type() -> np.dtype:
    return np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("records", "<u8")])


def packed_part(keys: np.ndarray, fingerprints: np.ndarray, shard: np.ndarray, first: np.ndarray, records: np.ndarray) -> bytes:
    """The bytes of an index part."""
    sizes, words = build(keys)
    before = ranks(words)
    entries = np.empty(len(keys), _record_type())
    at = numbers(keys, sizes, words, before)
    for name, values in zip(entries.dtype.names, (fingerprints, shard, first, records)):
        entries[name][at] = values
    header = np.array([FORMAT, len(keys), len(sizes), *sizes], "<u8")
    return b"".join(x.tobytes() for x in (header, words, before, entries))


def found_in_part(raw: bytes, keys: np.ndarray, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are stored, and their entries."""
    n, levels = (int(x) for x in np.frombuffer(raw, "<u8", 2, 8))
    sizes = [int(x) for x in np.frombuffer(raw, "<u8", levels, 24)]
    at, n_words = 24 + 8 * levels, sum(sizes) // 64
    words, before = np.frombuffer(raw, "<u8", n_words, at), np.frombuffer(raw, "<u8", n_words, at + 8 * n_words)
    entries = np.frombuffer(raw, _record_type(), n, at + 16 * n_words)
    number = numbers(keys, sizes, words, before)
    ok = number >= 0
    ok[ok] = entries["fingerprint"][number[ok]] == fingerprints[ok]
    return ok, entries[number[ok]]


# Writing


def _hashes(key: Column) -> list[Column]:
    """Two hashes of a key of any plain type."""
    return [F.xxhash64(F.lit(k), key.isNull(), key.cast("string")).alias(f"h{k}") for k in (1, 2)]


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``h1``, ``h2``, ``text``) dealt out by ranges of the key and sorted within them."""
    docs = storage.stable(docs)
    place = docs.metadataColumn("_metadata")
    texts = F.col(f"`{text}`").cast("string")
    own = F.col(f"`{key}`")
    read = docs.select(own.alias("key"), *_hashes(own), F.xxhash64(F.coalesce(texts, F.lit(""))).alias("by_text"),
                       F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("place"), texts.alias("text"))
    order = [F.col("key").asc_nulls_first(), *map(F.col, ("by_text", "file", "place"))]
    return read.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "h1", "h2", "text")


def write_shards(ordered: DataFrame, folder: str, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Writes one shard a task; a row per record: the key's hashes, shard, its file, the record's number in it, and its ids."""
    def run(batches):
        task = TaskContext.get().partitionId()
        name = f"shard-{task:06d}-{uuid.uuid4().hex}.ids"
        special, out, counts = tokenizer_files.specials(tokenizer), None, [np.zeros(1, np.int64)]
        done = 0
        for batch in batches:
            for t in arrays.texts(batch.column(2), ENCODE_BYTES):
                if out is None:
                    system, path = _open(folder)
                    out = system.open_output_stream(f"{path}/{name}")
                ids, n = _encoded(t, special, tokenizer, end_id)
                out.write(ids.astype(f"<u{width}").tobytes())
                counts.append(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.rows), batch.column(1).slice(t.first, t.rows), pa.array(np.full(t.rows, task)),
                     pa.DictionaryArray.from_arrays(pa.array(np.zeros(t.rows, np.int32)), [name]).cast(pa.string()),
                     pa.array(done + np.arange(t.rows)), pa.array(n)], names=["h1", "h2", "shard", "file", "record", "n"])
                done += t.rows
        if out is not None:
            offsets = np.cumsum(np.concatenate(counts)).astype("<u8")
            out.write(offsets.tobytes())
            out.write(np.array([FORMAT, width, done, offsets[-1], NAME], "<u8").tobytes())
            out.close()

    return ordered.select("h1", "h2", "text").mapInArrow(run, "h1 long, h2 long, shard long, file string, record long, n long")


def _encoded(t: arrays.Texts, special: dict[bytes, int], tokenizer: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a slice, each text's closed by ``end_id``, and how many each text has."""
    p = pretokens.pieces(t, pretokens.BYTE_LEVEL, special)
    known = packing.vocabulary(tokenizer, MOST_PRETOKENS)
    entry = known.lookup(t, p)
    flat, starts, lengths = known.arrays()
    ids = flat[arrays.expand(starts[entry], lengths[entry])]
    counts = arrays.sums(lengths[entry], p.bounds)
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def write_index(records: DataFrame, folder: str, parts: int) -> DataFrame:
    """Writes the parts of the index: (``part``, ``file``, ``keys``)."""
    place = F.struct("shard", "record")
    keys = records.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count("*").alias("records"))
    keys = keys.select(F.pmod("h2", F.lit(parts)).alias("part"), "h1", "h2", "at.shard", F.col("at.record").alias("first"), "records")

    def one(table: pa.Table) -> pa.Table:
        part = table.column(0)[0].as_py()
        h1, h2, shard, first, n = (table.column(k).to_numpy() for k in range(1, 6))
        raw = packed_part(*_part_keys(h1, h2), shard, first, n)
        name = f"index-{part:06d}-{uuid.uuid4().hex}.mph"
        system, path = _open(folder)
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(raw)
        return pa.table({"part": [part], "file": [name], "keys": [table.num_rows]})

    return keys.groupBy("part").applyInArrow(one, "part long, file string, keys long")


def _part_keys(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key's 64 bits for the hash, and its fingerprint."""
    turned = arrays.mix(h2.view(np.uint64))
    return h1.view(np.uint64) ^ turned, (turned >> np.uint64(32)).astype(np.uint32)


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = packing.TOKENIZER,
          end_id: int = packing.END_ID) -> dict:
    """Writes shards, index and manifest to a new folder, and returns the manifest (a line a shard and a line an index part)."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    width = 2 if max(tokenizer_files.library(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    records = storage.written(write_shards(in_order(docs, key, text), folder, tokenizer, end_id, width), "records")
    shards = records.groupBy("shard", "file").agg(F.count("*").alias("records"), F.sum("n").alias("ids")).orderBy("shard").collect()
    parts = max(1, -(-sum(s["records"] for s in shards) // PART_KEYS))
    index = write_index(records, folder, parts).orderBy("part").collect()
    manifest = {"format": FORMAT, "tokenizer": tokenizer, "end_id": end_id, "bytes_an_id": width, "parts": parts,
                "shards": [s.asDict() for s in shards], "index": [x.asDict() for x in index]}
    with system.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


# Reading


def manifest_of(folder: str) -> dict:
    system, path = _open(folder)
    with system.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def locate(keys: DataFrame, folder: str, manifest: dict) -> DataFrame:
    """(``key``, ``shard``, ``first``, ``records``) for each distinct key of the first column that is stored, by shard.

    Shards are numbered by their place in the manifest.
    """
    own = F.col(f"`{keys.columns[0]}`")
    asked = keys.select(own.alias("key"), *_hashes(own), F.pmod(F.xxhash64(F.lit(2), own.isNull(), own.cast("string")), F.lit(manifest["parts"])).alias("part"))
    files = {x["part"]: x["file"] for x in manifest["index"]}
    numbers_of = {s["shard"]: k for k, s in enumerate(manifest["shards"])}
    base = np.cumsum([0, *[s["records"] for s in manifest["shards"]]])

    def one(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        none = np.zeros(0, np.int64)
        if part not in files:
            return pa.table([table.column("key").slice(0, 0), none, none, none], names=["key", "shard", "first", "records"])
        system, path = _open(folder)
        with system.open_input_stream(f"{path}/{files[part]}") as f:
            raw = f.read()
        ok, entries = found_in_part(raw, *_part_keys(table.column("h1").to_numpy(), table.column("h2").to_numpy()))
        shard = np.array([numbers_of[s] for s in entries["shard"].tolist()], np.int64)
        begin = base[shard] + entries["first"].astype(np.int64)
        end = begin + entries["records"].astype(np.int64)
        last = np.searchsorted(base, end - 1, "right") - 1
        row = np.repeat(np.arange(len(shard)), last - shard + 1)  # a key's records may go on in the next shards
        place = arrays.expand(shard, last - shard + 1)
        a, b = np.maximum(begin[row], base[place]), np.minimum(end[row], base[place + 1])
        key = table.column("key").filter(pa.array(ok)).take(pa.array(row))
        return pa.table([key, place, a - base[place], b - a], names=["key", "shard", "first", "records"])

    schema = asked.select("key").schema.add("shard", "long").add("first", "long").add("records", "long")
    return asked.distinct().groupBy("part").applyInArrow(one, schema)


class _Shard:
    """An open shard."""

    def __init__(self, folder: str, name: str, start: int):
        system, path = _open(folder)
        self.file, self.name, self.start = system.open_input_file(f"{path}/{name}"), name, start
        size = self.file.size()
        form, self.width, n, ids, mark = np.frombuffer(self.file.read_at(40, size - 40), "<u8").tolist()
        if form != FORMAT or mark != NAME:
            raise ValueError(f"{name} is not a shard of this format")
        self.offsets = np.frombuffer(self.file.read_at(8 * (n + 1), ids * self.width), "<u8").astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - begin) * self.width, begin * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _reads(record: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of records that are read at once: they follow one another and hold a bounded number of ids."""
    begin, end = offsets[record], offsets[record + 1]
    cuts = (begin[1:] != end[:-1]) | (begin[1:] // READ_IDS != begin[:-1] // READ_IDS)
    edges = [0, *(np.flatnonzero(cuts) + 1).tolist(), len(record)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def read(spark: SparkSession, folder: str, keys: DataFrame, ids: bool = True) -> DataFrame:
    """All records of the keys in the first column of ``keys``, read from the shards.

    ``start`` counts the ids of all records before, ``n_tokens`` the record's own ones, ``ids_crc32`` is the check sum of its
    ids as 32-bit numbers, and ``ids`` these numbers, if wanted.
    """
    manifest = manifest_of(folder)
    name = keys.columns[0]
    starts = np.cumsum([0, *[s["ids"] for s in manifest["shards"]]]).tolist()
    files = [s["file"] for s in manifest["shards"]]
    places = locate(keys, folder, manifest).repartitionByRange("shard", "first").sortWithinPartitions("shard", "first")

    def run(batches):
        shard, now = None, -1
        for batch in batches:
            number, first, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if number[low] != now:
                    now = int(number[low])
                    shard = _Shard(folder, files[now], starts[now])
                key = np.repeat(np.arange(low, high), n[low:high])
                record = arrays.expand(first[low:high], n[low:high])
                for a, b in _reads(record, shard.offsets):
                    yield out(batch.column(0).take(pa.array(key[a:b])), shard, shard.offsets[record[a]:record[b - 1] + 2])

    def out(key, shard, offsets):
        raw = shard.ids(int(offsets[0]), int(offsets[-1])).tobytes()
        stops = 4 * (offsets - offsets[0])
        view, cuts = memoryview(raw), stops.tolist()
        sums = [zlib.crc32(view[a:b]) for a, b in zip(cuts, cuts[1:])]
        columns = [key, pa.array(shard.start + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())]
        if ids:
            columns.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(raw)]).cast(pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = keys.select(F.col(f"`{name}`").alias("key")).schema.add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    if ids:
        schema = schema.add("ids", "binary")
    return places.select("key", "shard", "first", "records").mapInArrow(run, schema).withColumnRenamed("key", name)


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = packing.TOKENIZER) -> DataFrame:
    """Writes all rows to a new folder of the shared one, and reads them back by their keys."""
    spark = docs.sparkSession
    folder = f"{storage.shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, folder, key, text, tokenizer)
    return read(spark, folder, docs.select(F.col(f"`{key}`")), ids=False)
