"""Queries on models and their evaluation."""

from pyspark.sql import functions as F

from saccadia.functions.ordered import lay_out
from saccadia.operators import features as ft
from saccadia.operators import leave_one_out as loo
from saccadia.operators import modeling as ml
from saccadia.plans import sql
from saccadia.plans.catalog import query
from saccadia.plans.gaze_view import heart_rate, recordings
from saccadia.plans.queries_features import HEART, HEART_FEATURES, HEART_NUM, R
from saccadia.plans.queries_insight import FEATURES, features
from saccadia.sources.readers import materialize

CLASSIFIERS = ["random_forest", "gradient_boosting", "svm", "logistic_regression"]


def dataset(spark, sf):
    """Feature table with classes (trial, condition), written once as model fits read it repeatedly."""
    found = features(spark, sf).join(recordings(spark, sf).select(R, "condition", "trial"), R)
    return materialize(found, "features")


METRICS = "accuracy f1_macro roc_auc confusion_matrix_trace"


@query("L1_train_model", "model", METRICS, "")
def l1(spark, sf):
    fitted = ml.train_model(dataset(spark, sf), "trial", feature_columns=None)
    return fitted.metrics.withColumn("model", F.lit(fitted.model_name))


@query("L2_classifiers", "model", "accuracy f1_macro", "")
def l2(spark, sf):
    """Three classes with each kind of classifier."""
    data, out = dataset(spark, sf), None
    for name in CLASSIFIERS:
        one = ml.train_model(data, "condition", model_name=name).metrics.withColumn("model", F.lit(name)).select("model", "accuracy", "f1_macro")
        out = one if out is None else out.union(one)
    return out


@query("L3_regressors", "model", "mae rmse r2", "")
def l3(spark, sf):
    data, out = dataset(spark, sf), None
    names = ml.numeric_features(data, ["path_length"])
    for name in ["random_forest", "gradient_boosting", "svm"]:
        one = ml.train_model(data, "path_length", "regression", name, feature_columns=names).metrics.withColumn("model", F.lit(name))
        out = one if out is None else out.union(one)
    return out


PREDICTED = """
pr AS (SELECT d.doc_id, CAST(quality AS VARCHAR) AS y_true, CASE WHEN n_chars > 800 THEN '1' ELSE '0' END AS y_pred, CAST(n_chars AS DOUBLE) AS score_1
  FROM labels JOIN documents d USING (doc_id)),
cc AS (SELECT c.label, count(*) FILTER (y_true = c.label AND y_pred = c.label) AS tp, count(*) FILTER (y_true = c.label) AS n_true,
    count(*) FILTER (y_pred = c.label) AS n_pred FROM pr, (VALUES ('0'), ('1')) c(label) GROUP BY 1),
rk AS (SELECT y_true, rank() OVER (ORDER BY score_1) + (count(*) OVER (PARTITION BY score_1) - 1) / 2.0 AS r FROM pr),
mt AS (SELECT (SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM pr) AS accuracy, (SELECT avg(2 * tp / (n_true + n_pred)) FROM cc) AS f1_macro,
    (SELECT (sum(r) FILTER (y_true = '1') - count(*) FILTER (y_true = '1') * (count(*) FILTER (y_true = '1') + 1) / 2.0)
      / (count(*) FILTER (y_true = '1') * count(*) FILTER (y_true = '0')) FROM rk) AS roc_auc, (SELECT sum(tp) FROM cc) AS confusion_matrix_trace)"""


def rule_predictions(spark, sf):
    """Document quality predicted from length, as a classifier whose output SQL can repeat."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("quality").cast("string").alias("y_true"), F.when(F.col("n_chars") > 800, "1").otherwise("0").alias("y_pred"),
        F.col("n_chars").cast("double").alias("score_1"),
    )


@query("L4_classification_metrics", "", METRICS, "", [PREDICTED], "mt")
def l4(spark, sf):
    return ml.classification_metrics(rule_predictions(spark, sf))


@query("L5_regression_metrics", "", "mae rmse r2", "", [],
       """(SELECT avg(abs(t - p)) AS mae, sqrt(avg(pow(t - p, 2))) AS rmse, 1 - sum(pow(t - p, 2)) / (var_pop(t) * count(*)) AS r2
  FROM (SELECT l_extendedprice / 1000 AS t, l_quantity * 1.5 + 3 AS p FROM lineitem))""")
def l5(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    return ml.regression_metrics(items.select((F.col("l_extendedprice") / 1000).alias("y_true"), (F.col("l_quantity") * 1.5 + 3).alias("y_pred")))


@query("L6_predict", R + " prediction", "", "")
def l6(spark, sf):
    data = dataset(spark, sf)
    return ml.predict(ml.train_model(data, "trial"), data)


@query("L7_permutation_importance", "feature", "importance_mean importance_std", "")
def l7(spark, sf):
    data = dataset(spark, sf)
    return ml.permutation_importance(ml.train_model(data, "trial", feature_columns=ml.numeric_features(data)), data)


@query("L8_holdout_predictions", R + " y_true y_pred", "score_0 score_1", "")
def l8(spark, sf):
    return ml.train_model(dataset(spark, sf), "trial").holdout


ORDER_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority constant nothing".split()


@query("L9_candidate_targets", "column_name", "", "", ["oc AS (SELECT *, 3 AS constant, CAST(NULL AS INTEGER) AS nothing FROM orders)"],
       "(" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS d FROM oc" for c in ORDER_COLUMNS) + ") WHERE d >= 2")
def l9(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return ml.candidate_targets(orders.withColumns({"constant": F.lit(3), "nothing": F.lit(None).cast("int")}))


TASK_COLUMNS = ["o_orderstatus", "o_totalprice", "o_custkey", "o_orderkey"]


def _task_arm(c):
    return f"""SELECT '{c}' AS column_name, CASE WHEN count(TRY_CAST({c} AS DOUBLE)) = count({c}) AND count(DISTINCT TRY_CAST({c} AS DOUBLE)) / greatest(count({c}), 1) > 0.3
  AND count(DISTINCT TRY_CAST({c} AS DOUBLE)) > 10 THEN 'regression' ELSE 'classification' END AS task FROM orders"""


@query("L10_infer_task", "column_name task", "", "", [], "(" + " UNION ALL ".join(_task_arm(c) for c in TASK_COLUMNS) + ")")
def l10(spark, sf):
    orders, out = spark.read.parquet(f"{sf}/orders.parquet"), None
    for c in TASK_COLUMNS:
        one = ml.infer_task(orders, c).select(F.lit(c).alias("column_name"), "task")
        out = one if out is None else out.union(one)
    return out


SCORE = "greatest(least(8.0 * pupil_baseline + fixation_duration_mean / 80.0 + 5.0 * blink_rate_hz, 100.0), 0.0)"


@query("L11_load_level", R + " level", "score", "", [*FEATURES, f"ll AS (SELECT recording_id, {SCORE} AS score, CASE WHEN {SCORE} < 30 THEN 'low' WHEN {SCORE} < 60 THEN 'medium' ELSE 'high' END AS level FROM ff)"], "ll")
def l11(spark, sf):
    score = ml.load_score(F.col("pupil_baseline"), F.col("fixation_duration_mean"), F.col("blink_rate_hz"))
    return features(spark, sf).select(R, score.alias("score"), ml.load_level(score).alias("level"))


@query("L12_run_experiment", "feature", "importance_mean", "")
def l12(spark, sf):
    return ml.run_experiment(dataset(spark, sf), "trial")[1]


LOO_NAMES = ("duration_ms sample_count valid_ratio path_length velocity_mean velocity_peak fixation_count fixation_duration_mean fixation_duration_total "
             "fixation_density saccade_count saccade_amplitude_mean saccade_peak_velocity_mean saccade_latency_mean blink_count blink_rate_hz "
             "blink_duration_mean pupil_baseline pupil_change_rate").split()
# a row's class by the counts, means and squares of all other rows, for every number of features
LEFT_OUT = [*FEATURES, sql.RECORDINGS, "lx AS (" + " UNION ALL ".join(
    f"SELECT recording_id, trial AS y, {k} AS k, coalesce(CAST({c} AS DOUBLE), 0) AS x FROM ff JOIN rec USING (recording_id)" for k, c in enumerate(LOO_NAMES, 1)) + ")", """
lc AS (SELECT k, avg(x) AS centre FROM lx GROUP BY 1),
lv AS (SELECT recording_id, y, k, x - centre AS x FROM lx JOIN lc USING (k)),
ls AS (SELECT y AS c, k, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS squares FROM lv GROUP BY 1, 2),
lm AS (SELECT lv.*, c, squares, n - CASE WHEN y = c THEN 1 ELSE 0 END AS m, mean,
    CASE WHEN y = c THEN (mean * n - x) / greatest(n - 1, 1) ELSE mean END AS mean_left FROM lv JOIN ls USING (k)),
lf AS (SELECT *, greatest((squares - CASE WHEN y = c THEN (x - mean) * (x - mean_left) ELSE 0 END) / greatest(m, 1), 0) + 1e-9 AS v FROM lm WHERE m > 0),
lg_ AS (SELECT recording_id, y, c, k, ln(m) + sum(-0.5 * ln(v) - (x - mean_left) * (x - mean_left) / (2 * v)) OVER (PARTITION BY recording_id, c ORDER BY k) AS score FROM lf),
lp AS (SELECT recording_id, k AS n_features, y AS y_true, c AS y_pred FROM lg_ QUALIFY row_number() OVER (PARTITION BY recording_id, k ORDER BY score DESC, c) = 1),
la AS (SELECT n_features, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM lp GROUP BY 1)"""]


@query("L13_cross_validate", "model is_best", "accuracy f1_macro", "")
def l13(spark, sf):
    """Every row left out once where summed statistics allow it; trees and iterated models by three folds; all features."""
    data = dataset(spark, sf)
    models = {"random_forest": {}, "svm": {}, "logistic_regression": {}}
    fitted = ml.cross_validate(data, "trial", LOO_NAMES, models, folds=3).drop("is_best")
    return ml.marked_best(fitted.unionByName(loo.validate(data, "trial", LOO_NAMES)))


@query("L13_leave_one_out", R + " y_true y_pred", "", "n_features", LEFT_OUT, "lp")
def l13_rows(spark, sf):
    """The class of every recording by a naive Bayes model of all others, for every number of features."""
    return loo.naive_bayes(dataset(spark, sf), "trial", LOO_NAMES)


@query("L14_confusion_matrix", "y_true y_pred", "", "n", [PREDICTED], "(SELECT y_true, y_pred, count(*) AS n FROM pr GROUP BY ALL)")
def l14(spark, sf):
    return ml.confusion_matrix(rule_predictions(spark, sf))


@query("L14_class_report", "label", "precision recall f1", "support", [PREDICTED],
       "(SELECT label, coalesce(tp / nullif(n_pred, 0), 0) AS precision, coalesce(tp / nullif(n_true, 0), 0) AS recall, 2 * tp / (n_true + n_pred) AS f1, n_true AS support FROM cc)")
def l14_report(spark, sf):
    return ml.class_report(rule_predictions(spark, sf))


@query("L15_misclassified", "y_true y_pred", "", "doc_id", [PREDICTED], "pr WHERE y_true <> y_pred")
def l15(spark, sf):
    return ml.misclassified(rule_predictions(spark, sf))


@query("L16_feature_ablation", "sufficient", "accuracy", "n_features", LEFT_OUT,
       """(SELECT *, n_features = min(n_features) FILTER (accuracy >= 0.95 * best) OVER () AS sufficient
  FROM (SELECT *, max(accuracy) OVER () AS best FROM la))""")
def l16(spark, sf):
    """Every number of features, each recording left out once, from one set of sums."""
    return loo.ablation(dataset(spark, sf), "trial", LOO_NAMES)


@query("L17_pca", "reaches_90", "explained_ratio cumulative_ratio", "component")
def l17(spark, sf):
    data = dataset(spark, sf)
    return ml.pca(data, ml.numeric_features(ml.drop_constant_features(data, ml.numeric_features(data))))[0]


@query("L17_pca_loadings", "feature", "loading", "component rank")
def l17_loadings(spark, sf):
    """The 15 largest loadings of the first two components."""
    data = dataset(spark, sf)
    return ml.pca(data, ml.numeric_features(ml.drop_constant_features(data, ml.numeric_features(data))))[1]


@query("L18_drop_constant_features", R, "valid_ratio path_length", "", [sql.GAZE, sql.VELOCITY],
       "(SELECT recording_id, avg(CAST(valid AS DOUBLE)) AS valid_ratio, sum(step_px) AS path_length FROM v GROUP BY 1)")
def l18(spark, sf):
    from saccadia.plans.gaze_view import samples

    data = ft.base_features(samples(spark, sf)).withColumn("flat", F.lit(1.5))
    kept = ml.drop_constant_features(data, ["valid_ratio", "path_length", "flat"])
    assert "flat" not in kept.columns
    return kept


@query("L19_dedupe_keys", "event_type", "value", "user_id event_id", [],
       "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1)")
def l19(spark, sf):
    return ml.dedupe(spark.read.parquet(f"{sf}/events.parquet"), ["user_id", "event_type"], ["ts", "event_id"])


@query("M6_modality_comparison", "modality", "accuracy f1_macro accuracy_delta f1_macro_delta", "feature_count")
def m6(spark, sf):
    """Gaze features alone and together with heart-rate features, and what the latter add."""
    data = dataset(spark, sf)
    gaze = ml.numeric_features(data)
    both = materialize(data.join(ft.heart_rate_features(lay_out(heart_rate(spark, sf))), R, "left"), "gaze_and_heart")
    return ml.compare_modalities({"gaze_only": (data, gaze), "gaze_plus_heart_rate": (both, ml.numeric_features(both))}, "trial")


@query("M6_modality_leave_one_out", "modality", "accuracy accuracy_delta", "", [*LEFT_OUT[:-2], HEART, HEART_FEATURES, "lx AS (" + " UNION ALL ".join(
    [f"SELECT recording_id, trial AS y, {k} AS k, coalesce(CAST({c} AS DOUBLE), 0) AS x FROM ff JOIN rec USING (recording_id) LEFT JOIN hf USING (recording_id)"
     for k, c in enumerate([*LOO_NAMES, *HEART_NUM.split()], 1)]) + ")", LEFT_OUT[-1]], f"""(SELECT 'gaze_only' AS modality, accuracy, 0.0 AS accuracy_delta FROM la WHERE n_features = {len(LOO_NAMES)}
  UNION ALL SELECT 'gaze_plus_heart_rate', accuracy, accuracy - (SELECT accuracy FROM la WHERE n_features = {len(LOO_NAMES)}) FROM la
  WHERE n_features = {len(LOO_NAMES) + len(HEART_NUM.split())})""")
def m6_left_out(spark, sf):
    """The same with every recording left out once: gaze features are a prefix of all features."""
    both = dataset(spark, sf).join(ft.heart_rate_features(lay_out(heart_rate(spark, sf))), R, "left")
    found = loo.scores(loo.naive_bayes(materialize(both, "gaze_and_heart"), "trial", [*LOO_NAMES, *HEART_NUM.split()]))
    gaze, whole = len(LOO_NAMES), len(LOO_NAMES) + len(HEART_NUM.split())
    named = found.filter(F.col("n_features").isin(gaze, whole)).withColumn("modality", F.when(F.col("n_features") == gaze, "gaze_only").otherwise("gaze_plus_heart_rate"))
    base = F.max(F.when(F.col("n_features") == gaze, F.col("accuracy")))
    one = named.agg(base.alias("_base")).withColumn("_k", F.lit(1))
    return named.withColumn("_k", F.lit(1)).join(one, "_k").withColumn("accuracy_delta", F.col("accuracy") - F.col("_base"))
