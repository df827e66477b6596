"""Models on the feature table: training, scoring, explanation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saccadia.functions.ranks import value_counts
from saccadia.functions.storage import materialize

# Columns of a feature table that are never features.
METADATA_COLUMNS = {
    "recording_id", "session_id", "subject_id", "condition", "trial", "intent_label", "source", "file_path",
    "cognitive_load_level", "cognitive_load_score",
}

#: The class of rows whose target is null.
NO_CLASS = "null"

_models: dict[tuple[str, str], Callable] = {}


def register_model(name: str, task: str, factory: Callable) -> None:
    """Add an estimator: ``factory(seed, **options)`` with columns ``features`` and ``label``."""
    _models[(task.lower(), name.lower())] = factory


#: Rows of a task while a model is fitted: each of some hundred rounds starts all tasks anew.
ROWS_PER_TASK = 20_000


def _multiclass(classifier, classes: int):
    """One model a class, fitted at the same time: the rounds of each are short jobs that follow one another."""
    return OneVsRest(classifier=classifier, parallelism=min(classes, 8))


def build_model(task: str, name: str, seed: int = 42, classes: int = 2, **options):
    """Estimator by task and name.

    Kernel machines have no distributed form here: ``svm`` is a linear one, and its
    regression a linear regression. Boosting and ``svm`` are binary, so more classes go one
    against the rest.
    """
    key = (task.lower(), name.lower())
    if key in _models:
        return _models[key](seed=seed, **options)
    if key == ("classification", "random_forest"):
        return RandomForestClassifier(seed=seed, **{"numTrees": 200, **options})
    if key == ("classification", "logistic_regression"):
        return LogisticRegression(**{"maxIter": 2000, "regParam": 1e-3, **options})
    if key == ("classification", "gradient_boosting"):
        one = GBTClassifier(seed=seed, **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, **options})
        return one if classes <= 2 else _multiclass(one, classes)
    if key == ("classification", "svm"):
        one = LinearSVC(**{"maxIter": 100, **options})
        return one if classes <= 2 else _multiclass(one, classes)
    if key == ("regression", "random_forest"):
        return RandomForestRegressor(seed=seed, **{"numTrees": 200, **options})
    if key == ("regression", "gradient_boosting"):
        return GBTRegressor(seed=seed, **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, **options})
    if key == ("regression", "svm"):
        return LinearRegression(**options)
    raise ValueError(f"unknown model {name} for task {task}")


@dataclass
class Fitted:
    """A fitted pipeline with its holdout predictions and metrics (one row each)."""

    model: PipelineModel
    task: str
    model_name: str
    target: str
    feature_names: list[str]
    labels: list[str]
    holdout: DataFrame
    metrics: DataFrame


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    skip = METADATA_COLUMNS | set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def hash_order(df: DataFrame, ids: Sequence[str], seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_place`` (0-based) and ``_of``: a row's place in a random but repeatable order per group."""
    hashed = df.withColumn("_h", F.xxhash64(*ids, F.lit(seed)))
    places = value_counts(hashed, list(by), "_h").select(*by, "_h", F.col("below").alias("_place"), F.col("total").alias("_of"))
    return hashed.join(places, [*by, "_h"]).drop("_h")


def stratified_split(df: DataFrame, label: str | None, ids: Sequence[str], test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``is_test``: the given share of every class, picked by hash order; one row of each class is never a test row."""
    by = [label] if label else []
    placed = hash_order(df, ids, seed, by)
    return placed.withColumn("is_test", F.col("_place") < F.least(F.ceil(F.col("_of") * F.lit(test_size) - 1e-9), F.col("_of") - 1)).drop("_place", "_of")


def _indexer(labels: list[str]) -> StringIndexerModel:
    """Numbers all classes the same way, whichever of them a share of the rows holds."""
    return StringIndexerModel.from_labels(labels, inputCol="_target", outputCol="label", handleInvalid="error")


def _pipeline(task: str, model_name: str, names: list[str], seed: int, labels: list[str], options: dict) -> Pipeline:
    stages = [_indexer(labels)] if task == "classification" else []
    stages.append(VectorAssembler(inputCols=names, outputCol="features"))
    stages.append(build_model(task, model_name, seed, len(labels), **options))
    return Pipeline(stages=stages)


def prepare(df: DataFrame, target: str | None, names: Sequence[str], task: str) -> DataFrame:
    """Nulls in features become 0; the target becomes text (classes, null being one) or a number."""
    out = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in names})
    if target is None or target not in df.columns:
        return out
    if task == "classification":
        return out.withColumn("_target", F.coalesce(F.col(target).cast("string"), F.lit(NO_CLASS)))
    return out.withColumn("label", F.coalesce(F.col(target).try_cast("double") if dict(df.dtypes)[target] == "string" else F.col(target).cast("double"), F.lit(0.0)))


def train_model(
    df: DataFrame,
    target: str,
    task: str = "classification",
    model_name: str = "random_forest",
    test_size: float = 0.25,
    seed: int = 42,
    feature_columns: Sequence[str] | None = None,
    ids: Sequence[str] = ("recording_id",),
    **options,
) -> Fitted:
    """Fit on a stratified share of the rows and score the rest."""
    if target not in df.columns:
        raise KeyError(f"target column not found: {target}")
    wanted = feature_columns or [c for c in df.columns if c != target]
    names = [c for c in wanted if isinstance(df.schema[c].dataType, T.NumericType)]
    ready = prepare(df, target, names, task)
    split = materialize(stratified_split(ready, "_target" if task == "classification" else None, ids, test_size, seed), "split")
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    train = train.coalesce(-(-split.count() // ROWS_PER_TASK) or 1)
    labels = class_labels(ready) if task == "classification" else []
    if task == "classification" and len(labels) < 2:
        raise ValueError("the target has a single class")
    model = _pipeline(task, model_name, names, seed, labels, options).fit(train)
    holdout = holdout_predictions(model, test, task, labels, ids)
    metrics = classification_metrics(holdout) if task == "classification" else regression_metrics(holdout)
    return Fitted(model, task, model_name, target, names, labels, holdout, metrics)


def class_labels(ready: DataFrame) -> list[str]:
    """All classes; a model holds one score for each, so they fit on the driver wherever a model does."""
    return sorted(r[0] for r in ready.select("_target").distinct().collect())


def _label_of(index: Column, labels: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in labels])[index.cast("int")]


def holdout_predictions(model: PipelineModel, test: DataFrame, task: str, labels: list[str], ids: Sequence[str]) -> DataFrame:
    """``y_true``, ``y_pred`` with class scores, or the residual for a regression."""
    scored = model.transform(test)
    if task != "classification":
        return scored.select(*ids, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"), (F.col("label") - F.col("prediction")).alias("residual"))
    columns = [*ids, F.col("_target").alias("y_true"), _label_of(F.col("prediction"), labels).alias("y_pred")]
    source = next((c for c in ("probability", "rawPrediction") if c in scored.columns), None)
    if source:
        scores = vector_to_array(source)
        columns += [F.get(scores, k).alias(f"score_{k}") for k in range(len(labels))]
    return scored.select(columns)


def class_counts(predictions: DataFrame) -> DataFrame:
    """Per class: true positives, rows of the class, rows predicted as it."""
    pairs = predictions.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("c"))
    ends = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("c").alias("n_true"), F.lit(0).cast("long").alias("n_pred")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("n_true"), F.col("c").alias("n_pred")),
    )
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("c")).otherwise(0)
    return pairs.select(F.inline(ends), hit.alias("_hit")).groupBy("label").agg(
        (F.sum("_hit") / 2).cast("long").alias("tp"), F.sum("n_true").alias("n_true"), F.sum("n_pred").alias("n_pred")
    )


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class."""

    def share(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    tp, n, m = F.col("tp"), F.col("n_true"), F.col("n_pred")
    return class_counts(predictions).select(
        "label", share(tp, m).alias("precision"), share(tp, n).alias("recall"), share(2 * tp, n + m).alias("f1"), n.alias("support"), "tp"
    )


def roc_auc(predictions: DataFrame, positive: str, score: str = "score_1") -> DataFrame:
    """Exact area under the ROC curve from average ranks; one row."""
    counts = value_counts(predictions, [], score, {"_pos": F.count_if(F.col("y_true") == positive)})
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    p, q = F.sum("_pos"), F.sum(F.col("n") - F.col("_pos"))
    return counts.agg(((F.sum(rank * F.col("_pos")) - p * (p + 1) / 2.0) / F.nullif(p * q, F.lit(0))).alias("roc_auc"))


def classification_metrics(predictions: DataFrame, score: str = "score_1", positive: str | None = None) -> DataFrame:
    """Accuracy, macro F1, ROC AUC (two true classes with scores), trace of the confusion matrix."""
    report = class_report(predictions)
    n = F.sum("support")
    one = report.agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        F.sum("tp").cast("double").alias("confusion_matrix_trace"),
    )
    if score not in predictions.columns:
        return one.withColumn("roc_auc", F.lit(None).cast("double"))
    seen = sorted(r[0] for r in predictions.select("y_true").filter("y_true IS NOT NULL").distinct().limit(3).collect())
    if len(seen) != 2:
        return one.withColumn("roc_auc", F.lit(None).cast("double"))
    # of two classes the later one is the positive
    area = roc_auc(predictions, positive or seen[1], score)
    return one.withColumn("_k", F.lit(1)).join(area.withColumn("_k", F.lit(1)), "_k").drop("_k")


def regression_metrics(predictions: DataFrame) -> DataFrame:
    e = F.col("y_true") - F.col("y_pred")
    n = F.count(F.lit(1))
    sse, sst = F.sum(e * e), F.var_pop("y_true") * n
    return predictions.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(sse / n).alias("rmse"), (1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"))


def predict(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Rows with their ``prediction``: the class label, or the number."""
    ready = prepare(df, None, fitted.feature_names, fitted.task)
    if fitted.task == "classification":
        # the fitted pipeline indexes a target; scoring has none
        stages = [s for s in fitted.model.stages if not hasattr(s, "labelsArray")]
        scored = PipelineModel(stages).transform(ready)
        return scored.withColumn("prediction", _label_of(F.col("prediction"), fitted.labels))
    return fitted.model.transform(ready)


def class_scores(fitted: Fitted, df: DataFrame) -> DataFrame:
    """One row per row of ``df`` and class: its ``class`` and ``score``, beside the ``prediction``; for models with probabilities."""
    if fitted.task != "classification":
        raise ValueError("only a classification has scores of classes")
    scored = predict(fitted, df)
    if "probability" not in scored.columns:
        raise ValueError(f"{fitted.model_name} gives no probabilities")
    kept = [c for c in scored.columns if c in {*df.columns, "prediction"}]
    classes = F.array(*[F.lit(c) for c in fitted.labels])
    return scored.select(*kept, F.posexplode(vector_to_array("probability")).alias("_nth", "score")).select(
        *kept, F.get(classes, F.col("_nth")).alias("class"), "score"
    )


def permutation_importance(fitted: Fitted, df: DataFrame, n_repeats: int = 10, seed: int = 42, ids: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Mean and SD of the score lost when one feature is shuffled, largest first.

    Per repeat every row gets a partner from a random permutation (two hash orders joined
    by place). A row is then scored once per feature with the partner's value in it.
    """
    names = fitted.feature_names
    ready = prepare(df, fitted.target, names, fitted.task)
    truth = F.col("_target") if fitted.task == "classification" else F.col("label")
    rows = ready.select(*ids, truth.cast("string").alias("_truth"), F.array(*names).alias("_x"))
    repeats = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(n_repeats))))
    left = hash_order(repeats, [*ids, "repeat"], seed, ["repeat"]).drop("_of")
    right = hash_order(repeats.select(*ids, "repeat", F.col("_x").alias("_other")), [*ids, "repeat"], seed + 1, ["repeat"]).select(
        "repeat", "_place", "_other"
    )
    paired = left.join(right, ["repeat", "_place"])
    index = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1)))
    swapped = paired.withColumn("_j", index).withColumn(
        "_x", F.transform("_x", lambda v, i: F.when(i == F.col("_j"), F.get("_other", F.col("_j"))).otherwise(v))
    )
    base = _score(fitted, rows, []).first()["score"]
    lost = F.lit(base) - F.col("score")
    found = _score(fitted, swapped, ["_j", "repeat"]).groupBy("_j").agg(
        F.avg(lost).alias("importance_mean"), F.stddev_pop(lost).alias("importance_std")
    )
    return found.select(F.array(*[F.lit(n) for n in names])[F.col("_j")].alias("feature"), "importance_mean", "importance_std").orderBy(
        F.desc("importance_mean"), "feature"
    )


def _score(fitted: Fitted, rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy or R² of the model on vectors ``_x``, per group."""
    scored = fitted.model.stages[-1].transform(rows.withColumn("features", array_to_vector("_x")))
    if fitted.task == "classification":
        right = _label_of(F.col("prediction"), fitted.labels) == F.col("_truth")
        return scored.groupBy(*by).agg(F.avg(right.cast("double")).alias("score"))
    y = F.col("_truth").cast("double")
    e = y - F.col("prediction")
    return scored.groupBy(*by).agg((1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("score"))


def candidate_targets(df: DataFrame) -> DataFrame:
    """Columns with two distinct values or more: their smallest and largest differ."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.min(c) < F.max(c)).alias("varies")) for c in df.columns])
    return df.agg(rows.alias("_r")).select(F.inline("_r")).filter("varies").select("column_name")


def infer_task(df: DataFrame, column: str) -> DataFrame:
    """``regression`` for numeric columns with many distinct values, else ``classification``; one row."""
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    number = F.col("v").try_cast("double")
    numbers = values.groupBy(number.alias("x")).agg(F.sum("c").alias("c"), F.count_if(number.isNull()).alias("bad"))
    d, n = F.count("x"), F.coalesce(F.sum("c"), F.lit(0))
    many = (F.sum("bad") == 0) & (d / F.greatest(n, F.lit(1)) > 0.3) & (d > 10)
    return numbers.agg(F.when(many, "regression").otherwise("classification").alias("task"))


def load_score(pupil: Column, fixation_ms: Column, blink_hz: Column) -> Column:
    """Cognitive load score, 0 to 100."""
    return F.greatest(F.least(8.0 * pupil + fixation_ms / 80.0 + 5.0 * blink_hz, F.lit(100.0)), F.lit(0.0))


def load_level(score: Column) -> Column:
    return F.when(score < 30, "low").when(score < 60, "medium").otherwise("high")


def run_experiment(df: DataFrame, target: str, task: str = "classification", model_name: str = "random_forest", seed: int = 42, n_repeats: int = 10,
                   ids: Sequence[str] = ("recording_id",), **options) -> tuple[Fitted, DataFrame]:
    """Train on every feature column and explain by permutation."""
    fitted = train_model(df, target, task, model_name, seed=seed, feature_columns=numeric_features(df, [target]), ids=ids, **options)
    return fitted, permutation_importance(fitted, df, n_repeats, seed, ids)


def cross_predictions(df: DataFrame, target: str, names: Sequence[str], model_name: str, folds: int, seed: int = 42,
                      ids: Sequence[str] = ("recording_id",), standardize: bool = True, **options) -> DataFrame:
    """Out-of-fold predictions; as many folds as rows leaves one out.

    Folds are stored, as each fit reads them several times, and a fit has a task for ``ROWS_PER_TASK`` rows.
    """
    ready = prepare(df, target, names, "classification")
    placed = hash_order(ready.select(*dict.fromkeys([*ids, "_target", *names])), ids, seed)
    placed = materialize(placed.withColumn("fold", F.col("_place") % folds).drop("_place", "_of"), "folds")
    labels = class_labels(placed)
    tasks = -(-placed.count() // ROWS_PER_TASK) or 1
    parts = []
    for k in range(folds):
        stages = [
            _indexer(labels),
            VectorAssembler(inputCols=list(names), outputCol="raw" if standardize else "features"),
        ]
        if standardize:
            stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
        stages.append(build_model("classification", model_name, seed, len(labels), **options))
        model = Pipeline(stages=stages).fit(placed.filter(F.col("fold") != k).coalesce(tasks))
        scored = model.transform(placed.filter(F.col("fold") == k))
        parts.append(scored.select(*ids, "fold", F.col("_target").alias("y_true"), _label_of(F.col("prediction"), labels).alias("y_pred")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_validate(df: DataFrame, target: str, names: Sequence[str], models: dict[str, dict], folds: int, seed: int = 42,
                   ids: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Accuracy and macro F1 per model, the best by F1 marked."""
    rows = None
    for name, options in models.items():
        one = classification_metrics(cross_predictions(df, target, names, name, folds, seed, ids, **options))
        one = one.select(F.lit(name).alias("model"), "accuracy", "f1_macro")
        rows = one if rows is None else rows.unionByName(one)
    return marked_best(rows)


def marked_best(rows: DataFrame) -> DataFrame:
    """One row per model; those with the best macro F1 are marked."""
    best = F.max("f1_macro").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("is_best", F.col("f1_macro") == best)


def compare_modalities(tables: dict[str, tuple[DataFrame, Sequence[str]]], target: str, **options) -> DataFrame:
    """A model for each named (table, features), its metrics, and their difference from the first one's."""
    out = None
    for place, (name, (df, names)) in enumerate(tables.items()):
        metrics = train_model(df, target, feature_columns=names, **options).metrics
        one = metrics.select(F.lit(place).alias("_place"), F.lit(name).alias("modality"), "accuracy", "f1_macro", F.lit(len(names)).alias("feature_count"))
        out = one if out is None else out.unionByName(one)
    whole = Window.partitionBy(F.lit(1))  # one row per modality
    first = lambda c: F.min_by(c, "_place").over(whole)
    return out.withColumns({f"{c}_delta": F.col(c) - first(c) for c in ("accuracy", "f1_macro")}).drop("_place")


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def misclassified(predictions: DataFrame) -> DataFrame:
    return predictions.filter(~F.col("y_true").eqNullSafe(F.col("y_pred")))


def feature_ablation(df: DataFrame, target: str, ordered: Sequence[str], sizes: Sequence[int], model_name: str, folds: int, seed: int = 42,
                     ids: Sequence[str] = ("recording_id",), **options) -> DataFrame:
    """Cross-validated accuracy with the first k features; the smallest k within 95 % of the best is marked."""
    rows = None
    for k in sorted({s for s in sizes if s <= len(ordered)}):
        one = classification_metrics(cross_predictions(df, target, list(ordered[:k]), model_name, folds, seed, ids, **options))
        one = one.select(F.lit(k).alias("n_features"), "accuracy")
        rows = one if rows is None else rows.unionByName(one)
    whole = Window.partitionBy(F.lit(1))
    enough = F.col("accuracy") >= 0.95 * F.max("accuracy").over(whole)
    marked = rows.withColumn("_enough", enough)
    first = F.min(F.when(F.col("_enough"), F.col("n_features"))).over(whole)
    return marked.withColumn("sufficient", F.col("n_features") == first).drop("_enough")


def pca(df: DataFrame, names: Sequence[str], components: int = 10, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """Explained variance per component, and the largest loadings of the first two."""
    k = min(components, len(names))
    ready = prepare(df, None, names, "")
    stages = [
        VectorAssembler(inputCols=list(names), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        PCA(k=k, inputCol="scaled", outputCol="components"),
    ]
    model = Pipeline(stages=stages).fit(ready).stages[-1]
    # the fitted arrays are features x components, whatever the number of rows
    shares = [float(v) for v in model.explainedVariance.toArray()]
    total, rows = 0.0, []
    for at, share in enumerate(shares, 1):
        before, total = total, total + share
        rows.append((at, share, total, before < 0.9 <= total))
    spark = df.sparkSession
    explained = spark.createDataFrame(rows, "component int, explained_ratio double, cumulative_ratio double, reaches_90 boolean")
    matrix = model.pc.toArray()
    loadings = [(c + 1, names[j], float(matrix[j][c])) for c in range(min(2, k)) for j in range(len(names))]
    table = spark.createDataFrame(loadings, "component int, feature string, loading double")
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature"))
    return explained, table.withColumn("rank", rank).filter(F.col("rank") <= top)


def drop_constant_features(df: DataFrame, names: Sequence[str], least: float = 1e-8) -> DataFrame:
    """Without the columns whose standard deviation is at most ``least``."""
    spread = df.agg(*[F.stddev_samp(c).alias(c) for c in names]).first()
    flat = [c for c in names if spread[c] is None or spread[c] <= least]
    return df.drop(*flat)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by ``order``, of each key. An aggregate, so a frequent key is reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*")
