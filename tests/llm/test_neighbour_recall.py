"""Recall of the registered path against brute force on vectors of several kinds."""

import numpy as np
import pytest

from saccadia.llm import graph_index


def _kinds():
    rng = np.random.default_rng(5)
    normal = rng.normal(size=(4000, 64))
    unit = normal / np.linalg.norm(normal, axis=1)[:, None]
    wide = rng.normal(size=(4000, 256))
    families = rng.normal(size=(40, 64))[rng.integers(0, 40, 4000)] + 0.3 * normal
    return {
        "normal": normal, "uneven": unit * rng.uniform(0.2, 3, size=(4000, 1)), "log_normal": unit * rng.lognormal(size=(4000, 1)),
        "wide": wide / np.linalg.norm(wide, axis=1)[:, None], "families": families / np.linalg.norm(families, axis=1)[:, None],
    }


@pytest.mark.parametrize("kind", ["normal", "uneven", "log_normal", "wide", "families"])
def test_recall_by_the_default_path(kind, spark, tmp_path):
    v = _kinds()[kind]
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    found = {}
    for r in graph_index.nearest(spark.read.parquet(str(tmp_path / "v"))).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    queries = range(0, len(v), 20)
    assert set(found) == set(queries)
    hits = 0
    for q in queries:
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(found[q]))
    assert hits / (20 * len(queries)) >= 0.95


def test_every_point_is_reached():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(700, 8)), 50 + 0.01 * rng.normal(size=(300, 8)), 1e3 * rng.normal(size=(40, 8))]).astype(np.float32)
    graph, start = graph_index.build(x, degree=8)
    assert graph_index._reached(graph, start).all()


def test_blocks_pass_copies_of_a_shard(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(600, 12))
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, graph_index.nearest(table, every=2, k=5).collect()))
    monkeypatch.setattr(graph_index, "QUERY_BLOCK", 16)
    monkeypatch.setattr(graph_index, "LANE", 3)
    assert sorted(map(tuple, graph_index.nearest(table, every=2, k=5).collect())) == whole
