"""Rounds over few edges are few and short, whatever the shuffle setting."""

import random

import numpy as np
import pytest

from saccadia.llm import components, storage


def test_rounds_have_tasks_by_their_edges(spark, monkeypatch):
    """A long chain: before, each round wrote as many files as there are shuffle partitions, and there were more rounds."""
    files, written = [], storage.written

    def counted(df, name, *more, **named):
        out = written(df, name, *more, **named)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(storage, "written", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        order = random.Random(1).sample(range(900), 900)
        found = components.components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.node for r in found} == set(range(900)) and {r.component for r in found} == {0}
    assert max(files[1:]) <= spark.sparkContext.defaultParallelism + 1


@pytest.mark.parametrize("held", [4, 1 << 20])
def test_a_task_contracts_what_it_holds(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD", held)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label


def test_stars():
    a, b = np.array([5, 3, 9, 7, 7]), np.array([4, 5, 3, 8, 7])
    assert sorted(components._stars(a, b).tolist()) == [[4, 3], [5, 3], [8, 7], [9, 3]]
