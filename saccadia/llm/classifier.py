"""A quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

A text becomes a sparse vector of 2**18 places: its words, pairs of words, the shapes of its words (capitals, marks at the
ends, length) and pairs of these, and three-word runs that it has had before. Each kind's counts are divided by the number
of words. The model is fitted on at most ``most_rows`` labelled texts, chosen by a hash of their key, streamed ``passes`` times
through one task, whose memory is the model's; every text is then scored in parallel as a sparse dot product.

Defined cases: a null or empty text has the constant term alone, and is scored like any other. A key with several labels
takes the lowest, and one with several texts is learnt from with each, within the bound; repeated rows are learnt from once. Rows
with a null key or label are not learnt from; a null key counts as held out. Repeated rows are scored each. Other columns are not read. With no labelled row every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.llm import arrays

PLACES = 1 << 18
#: The most labelled texts that the model is fitted on.
MOST_ROWS = 12_000
PASSES = 4
ALPHA, BETA, L1, L2 = 0.2, 1.0, 1e-4, 1e-4
SCALE = 20.0


def _shapes(t: arrays.Texts, w: arrays.Words) -> np.ndarray:
    """A small number for each word: how it is written."""
    upper = (t.data >= 65) & (t.data <= 90) | ((t.data == 0xC3))
    lower = (t.data >= 97) & (t.data <= 122) | (t.data >= 0x80)
    many = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[w.ends] - c[w.starts]
    size = w.ends - w.starts
    letters = np.minimum(many(upper), 2) + 3 * (many(lower) > 0)
    last, first = t.data[w.ends - 1].astype(np.int64), t.data[w.starts].astype(np.int64)
    plain = lambda b: (b >= 0x80) | ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
    last = np.where(plain(last), 0, last)
    first = np.where(plain(first), 0, first)
    return ((letters * 128 + last) * 128 + first) * 8 + np.minimum(size // 4, 7)


def features(t: arrays.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, bounds): row r has the entries from ``bounds[r]`` to ``bounds[r + 1]``, each place once."""
    w = arrays.words(t)
    n = len(w.starts)
    row = w.row_of()
    lowered = arrays.Texts(0, arrays.LOWER[t.data], t.bounds)
    h = arrays.span_hashes(lowered.data, w.starts, w.ends)
    shape = arrays.mix(_shapes(t, w).astype(np.uint64) + np.uint64(77)) if n else h
    parts = []
    for salt, base, k in ((1, h, 1), (2, h, 2), (3, shape, 1), (4, shape, 2)):
        at = np.flatnonzero(arrays.gram_starts(w.bounds, k))
        if len(at):
            parts.append((row[at], arrays.mix(arrays.gram_hashes(base, k)[at] + np.uint64(salt))))
    at = np.flatnonzero(arrays.gram_starts(w.bounds, 3))
    if len(at):
        g = arrays.gram_hashes(h, 3)[at]
        again = arrays.repeats(row[at], g, g)[0]
        parts.append((row[at][again], np.full(int(again.sum()), arrays.mix(np.array([5], np.uint64))[0])))
    rows = np.concatenate([np.arange(t.rows), *[p[0] for p in parts]])
    places = np.concatenate([np.zeros(t.rows, np.int64), *[1 + (p[1] % np.uint64(PLACES - 1)).astype(np.int64) for p in parts]])
    key, count = np.unique(rows * PLACES + places, return_counts=True)
    place, rows = key % PLACES, key // PLACES
    size = np.maximum(np.diff(w.bounds), 1)[rows]
    value = np.where(place == 0, 1.0, SCALE * count / size)
    return place.astype("<i4"), value.astype("<f4"), np.searchsorted(rows, np.arange(t.rows + 1))


class Ftrl:
    """Follow-the-regularised-leader with a learning rate for each place."""

    def __init__(self):
        self.z, self.n = np.zeros(PLACES), np.zeros(PLACES)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (logistic(np.array(w @ x)) - label) * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - s * w
        self.n[at] += g * g


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def held_out(key: str = "doc_id"):
    """Whether a row is never learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS,
        passes: int = PASSES) -> np.ndarray:
    """The weights. At most ``most_rows`` keys, then texts, are chosen by narrow rows, which are sent to all machines."""
    chosen = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
    chosen = chosen.filter(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out("key"))
    chosen = chosen.groupBy("key").agg(F.min("label").alias("label"), F.xxhash64("key").alias("order"))
    chosen = chosen.orderBy("order", "key").limit(most_rows)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit(1), "text"))
    # a key may be on any number of rows: the bound is put on the texts too, before one is turned into a vector
    picked = texts.join(F.broadcast(chosen), "key").groupBy("key", "a", "b").agg(F.min("label").alias("label"), F.min("order").alias("order"))
    picked = picked.orderBy("order", "key", "a", "b").limit(most_rows)
    rows = texts.join(F.broadcast(picked), ["key", "a", "b"]).dropDuplicates(["key", "a", "b"])

    def vectors(batches):
        for batch in batches:
            for t in arrays.texts(batch.column(0)):
                places, values, bounds = features(t)
                cuts = list(zip(bounds.tolist(), bounds[1:].tolist()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([places[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([values[a:b].tobytes() for a, b in cuts], pa.binary()),
                    batch.column(1).slice(t.first, t.rows), batch.column(2).slice(t.first, t.rows)], names=["places", "values", "label", "order"])

    sparse = rows.select("text", "label", "order").mapInArrow(vectors, "places binary, values binary, label int, order long")
    # at most passes * most_rows rows
    stream = sparse.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes)))).repartition(1)
    stream = stream.sortWithinPartitions("pass", "order", "places").select("places", "values", "label")

    def learn(batches):
        model = Ftrl()
        for batch in batches:
            for a, v, y in zip(*[c.to_pylist() for c in batch.columns]):
                model.update(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4").astype(float), y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["weights"])

    found = stream.mapInArrow(learn, "weights binary").collect()  # one row of a fixed size
    return np.frombuffer(found[0]["weights"], "<f4") if found else np.zeros(PLACES, "<f4")


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every text. The weights are a megabyte, whatever the input."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for t in arrays.texts(batch.column(1)):
                places, values, bounds = features(t)
                products = np.concatenate([[0.0], np.cumsum(model.value[places].astype(float) * values)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.rows), pa.array(logistic(products[bounds[1:]] - products[bounds[:-1]]))], names=["key", "score"])

    picked = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    out = picked.mapInArrow(run, picked.select("key").schema.add("score", "double"))
    return out.select(F.col("key").alias(key), held_out("key").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
