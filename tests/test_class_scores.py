"""Scores of each class beside a prediction."""

import pytest

from saccadia.operators import modeling


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(60).selectExpr(
        "concat('r', id) AS recording_id", "CAST(id % 3 * 10 + id / 100 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b",
        "concat('k', id % 3) AS kind", "CAST(id AS DOUBLE) AS amount",
    )


def test_a_row_for_each_class(table):
    fitted = modeling.train_model(table, "kind", model_name="logistic_regression", feature_columns=["a", "b"])
    rows = modeling.class_scores(fitted, table.drop("kind")).collect()
    by_row = {}
    for r in rows:
        by_row.setdefault(r.recording_id, {})[r["class"]] = (r.score, r.prediction)
    assert len(by_row) == 60 and all(set(x) == set(fitted.labels) for x in by_row.values())
    for name, scores in by_row.items():
        assert sum(s for s, _ in scores.values()) == pytest.approx(1)
        best = max(scores, key=lambda c: scores[c][0])
        assert {p for _, p in scores.values()} == {best} == {f"k{int(name[1:]) % 3}"}


def test_models_without_class_scores(table):
    number = modeling.train_model(table, "amount", "regression", "svm", feature_columns=["a", "b"])
    with pytest.raises(ValueError, match="only a classification"):
        modeling.class_scores(number, table)
    vectors = modeling.train_model(table, "kind", model_name="svm", feature_columns=["a", "b"])
    with pytest.raises(ValueError, match="no probabilities"):
        modeling.class_scores(vectors, table)


def test_no_rows(table):
    fitted = modeling.train_model(table, "kind", model_name="logistic_regression", feature_columns=["a", "b"])
    assert modeling.class_scores(fitted, table.limit(0)).count() == 0
