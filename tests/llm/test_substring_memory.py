"""What a machine holds at once while repeated passages are taken out."""

import hashlib

import numpy as np
import pyarrow as pa

from saccadia.llm import arrays, substrings

TEXTS = ["", " \n ", "one", " one\ttwo \r\n three\x0b\x0cfour ", "no\xa0break\x1cé　中 \U0001f600", "a  b", None]


def test_one_python_step_after_the_last_join(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    kept = substrings.remove_repeats(docs, window=35, carry=["doc_id"])
    found = substrings.digests(kept)
    steps = [x._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for x in (kept, found)]
    assert steps[0] == steps[1]
    want = {k: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for k, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["kept_sha256"] for r in found.collect()} == want
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_lists_are_read_without_python_objects():
    kind = pa.list_(pa.struct([("low", pa.int32()), ("windows", pa.int32())]))
    rows = [[{"low": 1, "windows": 2}], None, [], [{"low": 3, "windows": 4}, {"low": 5, "windows": 6}], None]
    whole = pa.array(rows, kind)
    # a null list may have members of its own, which don't count
    hidden = pa.ListArray.from_arrays(pa.array([0, 1, 2, 2, 4, 4], pa.int32()), pa.array([x for r in ([1, 2], [8, 9], [3, 4], [5, 6]) for x in [dict(zip(("low", "windows"), r))]], kind.value_type),
                                      mask=pa.array([False, True, False, False, True]))

    class Watched:
        def __init__(self, column):
            self.column = column

        def __getattr__(self, name):
            assert name != "to_pylist"
            return getattr(self.column, name)

    for column in (whole, hidden):
        bounds, (low, count) = substrings._lists(Watched(column), 2)
        assert bounds.tolist() == [0, 1, 1, 1, 3, 3] and low.tolist() == [1, 3, 5] and count.tolist() == [2, 4, 6]
        bounds, (low, _) = substrings._lists(Watched(column.slice(1, 3)), 2)
        assert bounds.tolist() == [0, 0, 0, 2] and low.tolist() == [3, 5]


def test_small_slices(monkeypatch):
    rng, sizes, texts = np.random.default_rng(5), [], arrays.texts
    column = pa.array([" ".join(map(str, rng.integers(0, 50, 2000))) for _ in range(300)])
    monkeypatch.setattr(arrays, "texts", lambda c, most=arrays.SLICE_BYTES: (sizes.append(most), texts(c, most))[1])

    class Rows:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            self.found = list(run([pa.RecordBatch.from_arrays([pa.array(np.arange(300)), column], names=["row", "text"])]))
            return self

    substrings.seed_runs(Rows(), 35, 8)
    assert sizes and max(sizes) <= 1 << 18
