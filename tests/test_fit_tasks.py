"""Rows of a fit lie in few tasks, whatever the shuffle setting."""

from saccadia.operators import modeling as ml


def test_few_rows_one_task(spark, monkeypatch):
    seen = []

    class Watched:
        def __init__(self, pipeline):
            self.pipeline = pipeline

        def fit(self, train):
            seen.append(train.rdd.getNumPartitions())
            return self.pipeline.fit(train)

    plain = ml._pipeline
    monkeypatch.setattr(ml, "_pipeline", lambda *a: Watched(plain(*a)))
    df = spark.createDataFrame([(str(k), "abc"[k % 3], float(k % 3), float(k)) for k in range(60)], "recording_id string, c string, x double, y double")
    found = ml.train_model(df.repartition(8), "c", model_name="gradient_boosting", maxIter=1)
    assert seen == [1] and found.metrics.first()["accuracy"] == 1.0
    assert ml.build_model("classification", "gradient_boosting", classes=3).getParallelism() == 3
