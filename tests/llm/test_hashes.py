"""Hashes of strings made to collide in sums of powers, and entries whose first hash collides."""

import numpy as np
import pyarrow as pa
import pytest

from saccadia.llm import arrays, pretokens


def alternating(n):
    """Two strings of n letters, each the other with a and b exchanged: bits of places added up, odd or even."""
    first = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return first, first.translate(str.maketrans("ab", "ba"))


def slice_of(texts):
    return next(arrays.texts(pa.array(texts), 1 << 30))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_and_grams_differ(n):
    t = slice_of(list(alternating(n)))
    for h in arrays.span_hash_pairs(t.data, t.bounds[:-1], t.bounds[1:]):
        assert h[0] != h[1]
    x, y = (np.array([ord(c) for c in s], np.uint64) for s in alternating(n))
    assert arrays.gram_hashes(x, n)[0] != arrays.gram_hashes(y, n)[0]


def test_hashes_depend_on_the_span_alone():
    t = slice_of(["ab cab ab", "", "abab"])
    w = arrays.words(t)
    a, b = arrays.span_hash_pairs(t.data, w.starts, w.ends)
    assert a[0] == a[2] and b[0] == b[2] and len({*a.tolist()}) == 3
    assert np.array_equal(a, arrays.span_hashes(t.data, w.starts, w.ends, 0)) and np.array_equal(b, arrays.span_hashes(t.data, w.starts, w.ends, 1))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 35])
def test_grams_are_equal_where_their_values_are(k):
    rng = np.random.default_rng(k)
    h = np.tile(rng.integers(0, 1 << 60, 40).astype(np.uint64), 3)
    g = arrays.gram_hashes(h, k)
    assert len(g) == len(h) - k + 1 and np.array_equal(g[:40], g[40:80]) and len(set(g[:40].tolist())) == 40
    assert len(arrays.gram_hashes(h[:2], 3)) == 0


def test_entries_are_told_apart_when_the_first_hash_collides(monkeypatch):
    pairs = arrays.span_hash_pairs
    monkeypatch.setattr(arrays, "span_hash_pairs", lambda *x: (pairs(*x)[0] % np.uint64(3), pairs(*x)[1]))
    known = pretokens.Vocabulary(lambda found: [list(x.encode()) for x in found])
    for texts in (["one two three four", "five one"], ["six two one seven", "eight"]):
        t = slice_of(texts)
        p = pretokens.pieces(t, pretokens.WORD_LEVEL, {})
        entry = known.lookup(t, p)
        flat, starts, lengths = known.arrays()
        found = [bytes(flat[starts[e]:starts[e] + lengths[e]].tolist()).decode() for e in entry.tolist()]
        assert found == " ".join(texts).split()


def test_runs_of_any_length():
    rng = np.random.default_rng(1)
    h = np.tile(rng.integers(0, 1 << 60, 50).astype(np.uint64), 6)
    starts = rng.integers(0, 50, 300)
    ends = starts + rng.integers(1, 150, 300)
    a, b = arrays.run_hashes(h, starts, ends), arrays.run_hashes(h, starts + 50, ends + 50)
    assert np.array_equal(a, b) and len(set(a.tolist())) == len(set(zip(starts.tolist(), ends.tolist())))
    x, y = (np.array([ord(c) for c in s], np.uint64) for s in alternating(2048))
    assert arrays.run_hashes(x, np.array([0]), np.array([2048])) != arrays.run_hashes(y, np.array([0]), np.array([2048]))


@pytest.mark.parametrize("percent", [20, 30, 50, 80])
def test_linkable_sizes_share_a_region(percent):
    """Sets that could link by their sizes meet in some ring, also when these are many rings apart."""
    from saccadia.llm import jaccard

    full = [np.arange(n, dtype=np.uint64) + np.uint64(1) for n in range(1, 61)]
    rows, regions = jaccard._regions(np.repeat(np.arange(60), np.arange(1, 61)), np.concatenate(full), np.arange(1, 61), percent)
    of = [set(regions[rows == r].tolist()) for r in range(60)]
    assert all(of[a - 1] & of[b - 1] for b in range(1, 61) for a in range(1, b + 1) if 100 * a >= percent * b)


def test_release_keeps_what_is_still_read(spark):
    from saccadia.llm import storage

    first, second, kept = storage.written(spark.range(5), "first"), storage.written(spark.range(7), "second"), storage.written(spark.range(3), "kept", keep=True)
    storage.release(spark, second.filter("id > 1"))
    assert second.count() == 7 and kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        first.count()
