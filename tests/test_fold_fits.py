"""Folds are stored once, and their fits have few tasks."""

from pyspark.sql import functions as F

from saccadia.operators import modeling as ml


def test_folds_are_stored_and_fitted_in_few_tasks(spark, monkeypatch):
    seen = []

    class Watched(ml.Pipeline):
        def fit(self, train):
            plan = train._jdf.queryExecution().optimizedPlan().toString()
            seen.append((train.rdd.getNumPartitions(), "Join" in plan))
            return super().fit(train)

    monkeypatch.setattr(ml, "Pipeline", Watched)
    rows = [(str(k), "ab"[k % 2], float(k % 2), float(k), None) for k in range(80)]
    df = spark.createDataFrame(rows, "recording_id string, c string, x double, y double, z double").repartition(8)
    found = ml.cross_predictions(df, "c", ["x", "y", "z"], "logistic_regression", 3)
    assert seen == [(1, False)] * 3
    assert found.count() == 80 and found.filter("y_true <> y_pred").count() == 0
    sizes = sorted(r["n"] for r in found.groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert sizes == [26, 27, 27]
