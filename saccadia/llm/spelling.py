"""Spelling variants: words that differ by one letter put in, left out or replaced, by permuterm rotations.

A word is closed by a mark and turned round at every place. A rotation ends with the letter that an edit would change, so
what stands before it (the rest of the word, from behind the edit round to before it) is the same for all words that
differ from one another there: replacements share a rotation without its last letter, and a word that lacks the letter has
just that as a whole rotation. Rotations are dealt out and sorted by this prefix; one scan over each range of equal prefixes
finds the neighbours. A range holds at most one word for every letter of the alphabet and one that lacks it, as prefix and
letter make the word, so no range is large, however frequent its words. A scan passes on counts and the best neighbour of
each word, not pairs. A letter that repeats the one before it counts as inserted only at the first of them, so that two words meet once.

Defined cases: a null or empty text has no words. Repeated rows count again. A null key is written as nothing in front of
the colon when hashes are taken. Other columns are not read. An empty table, or one without words often enough, gives no rows.
Ties of frequency go to the smaller word by code points.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.llm import arrays, pretokens, storage

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many has a letter taken out (by a hash of key and run).
MISSPELT = 199
#: Ends a word; smaller than all letters.
MARK = "\x01"
#: Distinct words that a task holds before it passes on their counts.
HELD = 400_000
#: Runs up to this many bytes are hashed side by side.
SHORT = 48

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _crc_table() -> np.ndarray:
    """The 256 remainders of CRC-32 (polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def runs(t: arrays.Texts) -> arrays.Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF; in UTF-8 the latter are the byte C3 and one more."""
    lead = t.data == 0xC3
    letter = _LETTER[t.data] | lead
    letter[1:] |= lead[:-1]
    marked = np.where(letter, np.uint8(97), np.uint8(32))
    return arrays.words(arrays.Texts(t.first, marked, t.bounds))


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, carried on from ``seeds``, the CRC-32 of what stands before it."""
    lengths = ends - starts
    state = seeds.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    state, at = state[order], starts[order]
    for k in range(int(min(SHORT, sizes[0])) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))  # spans longer than k bytes
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    for j in range(int(np.searchsorted(-sizes, -SHORT, "left"))):
        rest = data[at[j] + SHORT:at[j] + sizes[j]].tobytes()
        state[j] = zlib.crc32(rest, int(state[j]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty(len(lengths), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _counted(t: arrays.Texts, keys: list, misspelt: int) -> tuple[list[str], np.ndarray]:
    """The distinct words of a slice, some of them with a letter less, and how often each stands there."""
    low = arrays.Texts(t.first, arrays.LOWER[t.data], t.bounds)
    w = runs(low)
    h = arrays.span_hashes(low.data, w.starts, w.ends)
    seeds = np.array([zlib.crc32(b"%s:" % ("" if k is None else str(k)).encode()) for k in keys], np.uint32)
    hit = np.zeros(len(h), bool)
    if misspelt:
        hit = crcs(low.data, w.starts, w.ends, seeds[w.row_of()]) % np.uint32(misspelt) == 0
    kept = np.flatnonzero(~hit)
    _, first, n = np.unique(h[kept], return_index=True, return_counts=True)
    words = pretokens.span_values(low.data, w.starts[kept][first], w.ends[kept][first], pa.string())
    rows, changed = w.row_of()[hit].tolist(), pretokens.span_values(low.data, w.starts[hit], w.ends[hit], pa.string())
    for row, word in zip(rows, changed):
        place = zlib.crc32(word.encode(), int(seeds[row])) % len(word)
        words.append(word[:place] + word[place + 1:])
    return words, np.concatenate([n, np.ones(len(changed), np.int64)])


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", misspelt: int = MISSPELT, letters: int = MIN_LETTERS,
                least: int = MIN_COUNT) -> DataFrame:
    """(``word``, ``n``) for words of at least ``letters`` code points and ``least`` occurrences; ``misspelt`` 0 leaves all as they are."""
    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for t in arrays.texts(batch.column(1)):
                words, n = _counted(t, keys[t.first:t.first + t.rows], misspelt)
                for word, count in zip(words, n.tolist()):
                    if len(word) >= letters:
                        held[word] = held.get(word, 0) + count
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                    held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    read = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    return read.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(``prefix``, ``edited``, ``once``, ``n``): every rotation whole, without edited letter, and without its last letter.

    ``once`` is whether this letter counts as inserted here.
    """
    marked = F.concat("word", F.lit(MARK))
    letter = lambda i: F.substring("word", i, F.lit(1))
    turned = lambda i: F.substring(marked, i + 1, F.length("word") + 1 - i)
    whole = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.struct(
        F.concat(turned(i), F.substring("word", F.lit(1), i)).alias("prefix"), F.lit("").alias("edited"), F.lit(True).alias("once")))
    without = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(
        F.concat(turned(i), F.substring("word", F.lit(1), i - 1)).alias("prefix"), letter(i).alias("edited"),
        ((i == 1) | (letter(i) != letter(i - 1))).alias("once")))
    return words.select("n", F.explode(F.concat(whole, without)).alias("r")).select("r.*", "n")


def _scan(batches):
    """What each word meets in its range: how many neighbours, and the best of them. Ranges follow one another, sorted by prefix.

    The word that lacks the letter stands first in its range. Rows of the last range of a batch wait for the next batch.
    """
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        prefix = table.column(0).to_pylist()
        end = len(prefix)
        while end and prefix[end - 1] == prefix[-1]:
            end -= 1
        waiting = table.slice(end)
        if end:
            yield from _ranges(prefix[:end], table.slice(0, end))
    if waiting is not None and waiting.num_rows:
        yield from _ranges(waiting.column(0).to_pylist(), waiting)


def _ranges(prefix, table):
    edited, once, n = (table.column(k).to_pylist() for k in (1, 2, 3))
    out: list[tuple[str, int, int, str]] = []
    start, rows = 0, len(prefix)
    while start < rows:
        end = start + 1
        while end < rows and prefix[end] == prefix[start]:
            end += 1
        if end - start > 1:
            behind, before = prefix[start].split(MARK)
            members = [(-n[k], before + edited[k] + behind, once[k]) for k in range(start, end)]
            lacking = members.pop(0) if edited[start] == "" else None
            best = sorted(members)[:2]
            for member in members:
                first = best[0] if member is not best[0] else (best[1] if len(best) > 1 else None)
                near = len(members) - 1
                if lacking and member[2]:
                    near += 1
                    first = min(first, lacking) if first else lacking
                if near:
                    out.append((member[1], near, -first[0], first[1]))
            if lacking and (longer := [x for x in members if x[2]]):
                first = min(longer)
                out.append((lacking[1], len(longer), -first[0], first[1]))
        start = end
    columns = list(zip(*out)) or [(), (), (), ()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "near", "best_n", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """(``word``, ``n_near``, ``best``, ``best_n``) for words that have a neighbour: their number, and the most frequent one."""
    dealt = rotations(words).repartition("prefix").sortWithinPartitions("prefix", "edited")
    met = dealt.mapInArrow(_scan, "word string, near long, best_n long, best string")
    better: Column = F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))
    found = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(better).alias("b"))
    return found.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(``word``, ``root``) from (``word``, ``form``): the last word on the way from form to form.

    A form is at least ``ratio`` (2 or more) times as frequent as its word, so a way has at most log(``most``) steps. Each round doubles
    the steps taken; words that have arrived take no part in it.
    """
    now = forms.select("word", F.col("form").alias("root"))
    reach = 1
    while ratio ** reach <= most:
        now = storage.written(now, "roots")
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        reach *= 2
    return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", misspelt: int = MISSPELT, letters: int = MIN_LETTERS,
             least: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word: ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    ``form`` is the most frequent neighbour, if it is at least ``ratio`` times as frequent as the word.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else ways from form to form need not end")
    words = storage.written(word_counts(docs, key, text, misspelt, letters, least), "words")
    near = neighbours(words)
    named = F.col("best_n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", F.when(named, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(named, F.col("best_n")).alias("form_n"))
    told = storage.written(told, "variants")
    most = told.agg(F.max("n")).first()[0] or 0
    way = roots(told.filter("form IS NOT NULL"), most, ratio)
    return told.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def groups(found: DataFrame) -> DataFrame:
    """(``root``, ``words``, ``n``): how many variants each root has, and how often they occur together."""
    return found.groupBy("root").agg(F.count("*").alias("words"), F.sum("n").alias("n"))


def most_frequent(found: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` variants of each root that occur most often, most frequent first; ties go to the smaller word."""
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n"), "word"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)
