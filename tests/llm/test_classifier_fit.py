"""The fitted weights against a plain loop of follow-the-regularised-leader updates, and the bound on what is learnt from."""

import math
import zlib

import numpy as np
import pyarrow as pa

from saccadia.llm import arrays, classifier

DOCS = "doc_id long, text string"
LABELS = "doc_id long, quality int"


def _plain(samples, passes):
    """Weights by place of a loop over (places, values, label), one coordinate after another."""
    z, n = {}, {}

    def weight(p):
        if abs(z.get(p, 0.0)) <= classifier.L1:
            return 0.0
        return -(z[p] - math.copysign(classifier.L1, z[p])) / ((classifier.BETA + math.sqrt(n[p])) / classifier.ALPHA + classifier.L2)

    for _ in range(passes):
        for places, values, label in samples:
            w = [weight(p) for p in places]
            error = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, values)))) - label
            for p, x, old in zip(places, values, w):
                g = error * x
                step = (math.sqrt(n.get(p, 0.0) + g * g) - math.sqrt(n.get(p, 0.0))) / classifier.ALPHA
                z[p] = z.get(p, 0.0) + g - step * old
                n[p] = n.get(p, 0.0) + g * g
    return {p: weight(p) for p in z}


def test_weights_are_those_of_a_plain_loop(spark):
    good, bad = "The lake is calm, and birds sing there.", "BUY now!!! buy BUY cheap $$$ click"
    texts = {k: f"{good if k % 3 else bad} {k} {'x' * (k % 5)}" for k in range(60)}
    docs = spark.createDataFrame([*texts.items(), (4, texts[4])], DOCS)  # a repeated row counts once
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in texts], LABELS)
    got = classifier.fit(docs, labels, passes=2)
    order = {r.doc_id: r.o for r in labels.selectExpr("doc_id", "xxhash64(doc_id) AS o").collect()}
    samples = []
    for k in sorted((k for k in texts if zlib.crc32(str(k).encode()) % 5), key=order.get):
        t = next(iter(arrays.texts(pa.array([texts[k]]))))
        places, values, _ = classifier.features(t)
        samples.append((places.tolist(), values.tolist(), int(k % 3 > 0)))
    want = np.zeros(classifier.PLACES)
    for p, w in _plain(samples, 2).items():
        want[p] = w
    assert np.abs(want).max() > 0.01
    np.testing.assert_allclose(got, want, atol=1e-5)


def test_a_key_on_many_rows_stays_within_the_bound(spark, monkeypatch):
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5)
    docs = spark.range(3001).selectExpr(f"{key}L AS doc_id", "concat('word ', id) AS text")
    labels = spark.createDataFrame([(key, 1)], LABELS)
    few = classifier.fit(docs, labels, most_rows=10)
    all_ = classifier.fit(docs, labels, most_rows=5000)
    # a word of its own a text: of 10 texts at most 10 words and pairs are learnt from
    assert 0 < np.count_nonzero(few) < 40 < 3000 < np.count_nonzero(all_)


def test_no_labels_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], DOCS)
    none = classifier.fit(docs, spark.createDataFrame([], LABELS))
    assert not none.any()
    assert {r.score for r in classifier.score(docs, none).collect()} == {0.5}
    some = classifier.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], LABELS))
    scores = {r.doc_id: r.score for r in classifier.score(docs, some).collect()}
    assert scores[1] == scores[2]
