"""Repeated passages by seed and extend.

A window is ``window`` consecutive words of one text; a word goes if a window that covers it starts anywhere else too. Seeds
are winnowed anchors: in each window the run of ``gram`` words with the smallest hash (the first of equals), so equal
windows have equal seeds at equal places. Neighbouring windows mostly share their seed; such a run of windows is one row
(seed, and a fingerprint of all its words, which is the seed extended both ways as far as it stays the smallest).

1. Seeds that occur once are dropped. What is left is written to shared storage.
2. Runs with equal seeds and equal extensions are one class. In a class of two or more, all windows are repeats.
3. Where a seed has several classes, one member of each is extended window by window; windows found in several of them are
   repeats. So no pairs of texts are formed, however many share a passage.
4. Overlapping windows of a text are merged into maximal repeats, and their words go.

Seeds carry 64 bits and extensions 64 further, windows 128. Defined cases: a null or empty text has no words and stays as it
is (null becomes empty). Repeated rows are texts of their own, so all their windows repeat. Null keys are kept. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saccadia.llm import arrays, storage

WINDOW = 50
GRAM = 8
#: Bytes of text that a task works on at once: a machine's tasks share its memory with Spark's sorts.
SLICE_BYTES = 1 << 18


def numbered(docs: DataFrame, text: str = "text", carry: list[str] = []) -> DataFrame:  # noqa: B006
    """A number for each row of a table read from storage, the same in every read, its text, and other columns as ``carry``."""
    carried = F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")])
    return storage.numbered(docs, F.col(f"`{text}`").cast("string").alias("text"), carried.alias("carry"))


def _word_hashes(t: arrays.Texts):
    w = arrays.words(t)
    return w, *(arrays.span_hashes(t.data, w.starts, w.ends, k) for k in (0, 1))


def _seed_runs(t: arrays.Texts, window: int, gram: int):
    """Runs of windows that share their seed: row, first window, number of windows, seed, extension."""
    w, h, second = _word_hashes(t)
    at = np.flatnonzero(arrays.gram_starts(w.bounds, window))
    if not len(at):
        return None
    g = arrays.gram_hashes(h, gram)
    span = window - gram + 1
    views = sliding_window_view(g, span)
    seed = np.concatenate([part + views[part].argmin(axis=1) for part in np.array_split(at, max(1, len(at) // 50_000))])
    row = w.row_of()
    new = np.ones(len(at), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    low, place = at[first], seed[first]
    extension = arrays.run_hashes(second, low, low + count - 1 + window)
    extension = arrays.mix(extension ^ arrays.mix((place - low).astype(np.uint64) + np.uint64(1)))
    return row[low], low - w.bounds[row[low]], count, g[place], extension


def seed_runs(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for t in arrays.texts(batch.column(1), SLICE_BYTES):
                found = _seed_runs(t, window, gram)
                if found:
                    row, low, count, seed, extension = found
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[t.first + row]), pa.array(low.astype(np.int32)), pa.array(count.astype(np.int32)),
                         pa.array(arrays.signed(seed)), pa.array(arrays.signed(extension))], names=["row", "low", "windows", "seed", "extension"])

    return rows.select("row", "text").mapInArrow(run, "row long, low int, windows int, seed long, extension long")


def _lists(column: pa.Array, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds and fields of a column of lists of structs; a null list is an empty one."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    at = arrays.expand(offsets[:-1], lengths)
    return np.concatenate([[0], np.cumsum(lengths)]), [column.values.field(k).to_numpy()[at].astype(np.int64) for k in range(fields)]


def single_windows(chosen: DataFrame, window: int) -> DataFrame:
    """Fingerprints of all windows of the given runs of each text: columns row, text, runs (lists of low, windows), carry.

    Texts without runs come too, as this join then has the same exchange of texts as the last one.
    """
    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            ids = batch.column(0).to_numpy()
            bounds, (low, count) = _lists(batch.column(2), 2)
            for t in arrays.texts(batch.column(1), SLICE_BYTES):
                w, h, second = _word_hashes(t)
                mine = slice(bounds[t.first], bounds[t.first + t.rows])
                r = np.repeat(np.arange(t.rows), np.diff(bounds[t.first:t.first + t.rows + 1]))
                where = arrays.expand(low[mine] + w.bounds[r], count[mine])
                r = np.repeat(r, count[mine])
                a, b = (arrays.run_hashes(x, where, where + window) for x in (h, second))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[t.first + r]), pa.array((where - w.bounds[r]).astype(np.int32)), pa.array(arrays.signed(a)),
                     pa.array(arrays.signed(b))], names=["row", "low", "a", "b"])

    return chosen.mapInArrow(run, "row long, low int, a long, b long")


def repeats(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Repeated windows as (``row``, ``low``, ``windows``): runs of windows of ``numbered`` rows that start elsewhere too."""
    if gram >= window:
        raise ValueError("the seed must be shorter than the window")
    runs = seed_runs(rows, window, gram)
    several = runs.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed")
    runs = storage.written(runs.join(several, "seed"), "seeds")
    storage.let_go(rows.sparkSession)
    classes = runs.groupBy("seed", "extension").agg(F.count("*").alias("members"), F.min("row").alias("first"))
    spread = classes.groupBy("seed").agg(F.count("*").alias("classes"))
    known = runs.join(classes, ["seed", "extension"]).join(spread, "seed")
    open_ = known.filter((F.col("classes") > 1) & (F.col("row") == F.col("first")))
    lists = open_.groupBy("row").agg(F.collect_list(F.struct("low", "windows")).alias("runs"))
    singles = single_windows(rows.join(lists, "row", "left").select("row", "text", "runs", "carry"), window)
    twice = singles.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    found = singles.join(twice, ["a", "b"]).select("row", "low", F.lit(1).alias("windows"))
    return known.filter("members > 1").select("row", "low", "windows").union(found)


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, carry: list[str] | None = None) -> DataFrame:
    """``n_words``, ``n_removed``, ``spans`` (maximal repeats, in words), ``kept_text`` and the struct ``carry``.

    ``carry`` has the named columns of ``docs``, else all but the text. A text that loses nothing is kept as it is;
    elsewhere the white space before a removed run of words stays. Both joins with the texts share one exchange.
    """
    docs = storage.stable(docs)
    rows = numbered(docs, text, [c for c in docs.columns if c != text] if carry is None else carry)
    lists = repeats(rows, window, gram).groupBy("row").agg(F.collect_list(F.struct("low", "windows")).alias("runs"))
    joined = rows.join(lists, "row", "left").select("row", "text", "runs", "carry")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(t: arrays.Texts, r: int, w: arrays.Words, low, count):
        raw = t.text(r)
        n = int(w.bounds[r + 1] - w.bounds[r])
        if not len(low):
            return n, 0, [], raw
        gone = arrays.covered(n, low, low + count - 1 + window)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        starts = w.starts[w.bounds[r]:w.bounds[r + 1]] - t.bounds[r]
        kept, place = [], 0
        for a, b in spans:
            kept.append(raw[place:starts[a]])
            place = int(starts[b]) if b < n else len(raw)
        return n, int(gone.sum()), spans, b"".join([*kept, raw[place:]])

    def run(batches):
        for batch in batches:
            bounds, (low, count) = _lists(batch.column(2), 2)
            for t in arrays.texts(batch.column(1), SLICE_BYTES):
                w = arrays.words(t)
                cuts = [slice(bounds[t.first + r], bounds[t.first + r + 1]) for r in range(t.rows)]
                out = [one(t, r, w, low[c], count[c]) for r, c in enumerate(cuts)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(3).slice(t.first, t.rows), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in x[2]] for x in out], span_type),
                    pa.array([arrays.python_text(x[3]) for x in out], pa.string())], names=["carry", "n_words", "n_removed", "spans", "kept_text"])

    rest = StructType.fromDDL("n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")
    return joined.mapInArrow(run, StructType([rows.schema["carry"], *rest.fields]))


def digests(results: DataFrame) -> DataFrame:
    """Results with the SHA-256 of the kept words, one blank between two, in place of the kept text.

    Spark's own functions: a second step in Python would take a second process for each task beside Spark's sorts.
    """
    words = F.trim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "))
    return results.select("carry.*", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


def clean_documents(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages taken out of the text: the same rows and columns."""
    cleaned = remove_repeats(docs, text, window, gram)
    return cleaned.select(*[(F.col("kept_text") if c == text else F.col("carry").getField(c)).alias(c) for c in docs.columns])
