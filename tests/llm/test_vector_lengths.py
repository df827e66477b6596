"""Neighbours where a few vectors are very much longer than the others."""

import numpy as np
import pytest

from saccadia.llm import graph_index


@pytest.mark.parametrize("factors", [(1e3, 1e6), (1e12, 1e20), (1e-30, 1e160, 1e300)])
def test_recall_beside_long_vectors(factors, spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    for k, f in enumerate(factors):
        v[3 + 40 * k] *= f  # these are no queries
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    k = 10
    found = {}
    for r in graph_index.nearest(spark.read.parquet(str(tmp_path / "v")), every=20, k=k).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    queries = range(0, 1500, 20)
    assert set(found) == set(queries)
    hits = 0
    for q in queries:
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:k].tolist()) & set(found[q]))
        assert all(np.isclose(s, v[i] @ v[q]) for i, s in found[q].items())
    assert hits / (k * len(queries)) > 0.95


def test_products_beyond_doubles_are_infinite(spark):
    rows = [(0, [1e200, -1e200]), (1, [1e200, 1e199]), (2, [-1e200, 1e200]), (3, [1.0, 0.0])]
    found = {r.vec_id: r.score for r in graph_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 3).collect()}
    assert found == {1: np.inf, 3: 1e200, 2: -np.inf}
