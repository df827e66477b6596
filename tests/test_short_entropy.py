"""Recordings of few samples are counted whole, many at once, and equal to those counted by cells."""

import numpy as np
from pyspark.sql import functions as F

from saccadia.operators import entropy


def test_short_recordings_equal_the_formula_and_the_cells(spark, make_samples):
    random = np.random.default_rng(5)
    df, series = None, {}
    for k, n in enumerate((11, 12, 13, 40, 41, 300)):
        values = np.round(random.normal(0, 3, n), 1) if k % 2 else np.repeat(2.5, n)
        series[f"r{k}"] = values
        rows = [{"timestamp_ms": float(i), "x": float(v), "y": None if i % 3 else 1.0 * i, "pupil": None} for i, v in enumerate(values)]
        one = make_samples(rows, f"r{k}")
        df = one if df is None else df.union(one)
    df = df.withColumn("sample_index", F.col("sample_seq").cast("long")).repartition(5).localCheckpoint()
    found = entropy.entropies(df, ("x", "y", "pupil"))
    short = {(r[0], r[1]): r[2] for r in found.collect()}
    assert set(k for k, s in short if s == "x") == {f"r{k}" for k in range(1, 6)}
    assert not [k for k in short if k[1] == "pupil"]
    for name, values in series.items():
        if len(values) >= entropy.MIN_POINTS:
            assert abs(short[name, "x"] - entropy.approximate_entropy(values)) < 1e-9
    spark.conf.set(entropy.SHORT_CONF, "30")
    try:
        cells = {(r[0], r[1]): r[2] for r in entropy.entropies(df, ("x", "y", "pupil")).collect()}
    finally:
        spark.conf.unset(entropy.SHORT_CONF)
    assert set(cells) == set(short)
    assert all(abs(cells[k] - short[k]) < 1e-9 for k in short)


def test_many_short_series_are_one_call(monkeypatch):
    """Before, each series was a call of its own: 0.7 million for the buffers of 9,000 recordings."""
    lengths = np.array([12, 14, 14, 15, 60] * 200)
    values = np.random.default_rng(1).normal(size=lengths.sum())
    calls = []
    real = np.count_nonzero
    monkeypatch.setattr(np, "count_nonzero", lambda *a, **k: calls.append(1) or real(*a, **k))
    found = entropy.whole_entropies(values, lengths, np.repeat(0.2, len(lengths)), 2)
    assert len(calls) < 20
    assert np.isfinite(found).all()
