"""Validation by summed statistics against models fitted anew without each row."""

import numpy as np
import pytest

from saccadia.operators import leave_one_out as loo

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    """Three classes of unequal size, one with a single row, a constant feature, nulls and large offsets."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(90):
        y = ["x", "y", "z"][k % 3] if k else "alone"
        shift = {"x": 0.0, "y": 1.0, "z": 2.5, "alone": 9.0}[y]
        rows.append((f"r{k}", y if k % 17 else None, float(rng.normal(shift, 1)), float(rng.normal(1e4 - shift, 2)), 3.0, None if k % 7 == 0 else float(rng.normal(0, 1))))
    return rows, spark.createDataFrame(rows, "recording_id string, y string, a double, b double, c double, d double")


def matrix(rows):
    return np.array([[0.0 if v is None else v for v in r[2:]] for r in rows]), np.array(["null" if r[1] is None else r[1] for r in rows])


def test_naive_bayes(table):
    rows, df = table
    x, y = matrix(rows)
    found = {(r.recording_id, r.n_features): (r.y_true, r.y_pred) for r in loo.naive_bayes(df, "y", NAMES).collect()}
    assert len(found) == len(rows) * len(NAMES)
    for i, r in enumerate(rows):
        others = np.arange(len(rows)) != i
        for k in range(1, len(NAMES) + 1):
            best = None
            for label in sorted(set(y)):
                mine = others & (y == label)
                if not mine.any():
                    continue
                mean, var = x[mine, :k].mean(axis=0), x[mine, :k].var(axis=0) + loo.LEAST_VARIANCE
                score = np.log(mine.sum()) + (-0.5 * np.log(var) - (x[i, :k] - mean) ** 2 / (2 * var)).sum()
                if best is None or score > best[0]:
                    best = (score, label)
            assert found[r[0], k] == (y[i], best[1])


def test_least_squares(table):
    rows, df = table
    x, y = matrix(rows)
    labels = sorted(set(y))
    spread = x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(spread == 0, 1, spread)])
    one = (y[:, None] == np.array(labels)).astype(float)
    found = {(r.recording_id, r.n_features): r.y_pred for r in loo.least_squares(df, "y", NAMES).collect()}
    for i, r in enumerate(rows):
        others = np.arange(len(rows)) != i
        for k in range(1, len(NAMES) + 1):
            d = z[others, :k + 1]
            weights = np.linalg.solve(d.T @ d + np.diag([0.0, *[loo.RIDGE * len(rows)] * k]), d.T @ one[others])
            fit = z[i, :k + 1] @ weights
            top = np.sort(fit)[-2:]
            if top[1] - top[0] > 1e-9:
                assert found[r[0], k] == labels[int(fit.argmax())]


def test_scores_and_ablation(table):
    rows, df = table
    by_size = {r.n_features: r for r in loo.scores(loo.naive_bayes(df, "y", NAMES)).collect()}
    assert sorted(by_size) == [1, 2, 3, 4]
    whole = {r.model: r for r in loo.validate(df, "y", NAMES).collect()}
    assert set(whole) == {"naive_bayes", "least_squares"}
    assert abs(whole["naive_bayes"].accuracy - by_size[4].accuracy) < 1e-12 and abs(whole["naive_bayes"].f1_macro - by_size[4].f1_macro) < 1e-12
    table_ = loo.ablation(df, "y", NAMES).collect()
    best = max(r.accuracy for r in table_)
    assert [r.n_features for r in table_ if r.sufficient] == [min(r.n_features for r in table_ if r.accuracy >= 0.95 * best)]


def test_too_many_classes(spark):
    df = spark.range(1200).selectExpr("cast(id as string) recording_id", "cast(id as string) y", "1.0D a")
    with pytest.raises(ValueError, match="classes"):
        loo.naive_bayes(df, "y", ["a"])
