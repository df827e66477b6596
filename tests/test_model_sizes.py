"""The registered model queries fit with the operators' own sizes."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from saccadia.plans import queries_models as qm


def test_classifiers_and_regressors_are_whole(spark, monkeypatch):
    data = spark.createDataFrame([("r", "a", 1.0, 2.0, 3)], "recording_id string, condition string, path_length double, x double, fixation_count int")
    calls = []

    def fit(df, target, task="classification", model_name="random_forest", feature_columns=None, **options):
        calls.append((target, model_name, feature_columns, options))
        return SimpleNamespace(metrics=spark.range(1).select(*[F.lit(1.0).alias(c) for c in ("accuracy", "f1_macro", "mae", "rmse", "r2")]))

    monkeypatch.setattr(qm, "dataset", lambda spark, sf: data)
    monkeypatch.setattr(qm.ml, "train_model", fit)
    assert qm.l2(spark, "").count() == 4 and qm.l3(spark, "").count() == 3
    assert all(options == {} for *_, options in calls)
    assert all(set(names) == {"x", "fixation_count"} for target, _, names, _ in calls if target == "path_length")
