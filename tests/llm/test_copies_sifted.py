"""Exact copies are one set: texts that resemble no other text leave the Jaccard join also if each has copies."""

import random

from saccadia.llm import jaccard, storage


def _stored(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    return storage.written(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "docs")


def _text(seed, words=120):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(words))


def test_copies_share_nothing_with_each_other(spark):
    docs = _stored(spark, [_text(k) for k in range(40)] * 3)
    rows = jaccard.numbered(docs)
    found = storage.written(jaccard.points(rows, 5), "points")
    assert jaccard.sift(found, rows, 5, 80).count() == 0
    assert {r["lone"] for r in jaccard.lone_grams(rows, 5, 1.0).collect()} == {116}


def test_near_copies_stay_among_copies(spark):
    one = _text(1)
    near = one + " tail"
    docs = _stored(spark, [*[_text(k) for k in range(1, 21)] * 3, near, near, "", None])
    rows = jaccard.numbered(docs)
    found = storage.written(jaccard.points(rows, 5), "points")
    left = jaccard.sift(found, rows, 5, 80).collect()
    assert sorted(r["size"] for r in left) == [116, 117]
    kept = [r["text"] for r in jaccard.keep_one(docs).collect()]  # most go: those that stay are sent
    assert len(kept) == 22 and {None, ""} < set(kept) and len({one, near} & set(kept)) == 1
    few = _stored(spark, [_text(k) for k in range(5)] + [_text(0)])
    assert sorted(r["text"] for r in jaccard.keep_one(few).collect()) == sorted(_text(k) for k in range(5))
