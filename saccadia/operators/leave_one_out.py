"""Leave-one-out validation without refitting: a row is taken out of summed statistics.

For a Gaussian naive Bayes model these are each class's counts, means and squares; taking a row out changes those of its own
class. For a linear model (least squares on class indicators, with a small ridge) they are one matrix of sums of products; a
row's prediction without it follows from its prediction with it and its leverage. Both read the rows twice, whatever their
number, and give the predictions for every prefix of a list of features at once, as the statistics of fewer features are a
part of those of all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saccadia.operators.modeling import NO_CLASS, classification_metrics

#: Added to every variance, and to the diagonal of the products of standardised features (times the number of rows).
LEAST_VARIANCE, RIDGE = 1e-9, 1e-6
MOST_CLASSES = 1000


def _rows(df: DataFrame, target: str, names: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(ids, ``y_true``, ``x``): features as an array; null and non-finite ones are 0."""
    def clean(c):
        v = F.col(c).cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)

    return df.select(*ids, F.coalesce(F.col(target).cast("string"), F.lit(NO_CLASS)).alias("y_true"), F.array(*[clean(c) for c in names]).alias("x"))


def _classes(rows: DataFrame) -> list[str]:
    found = sorted(r[0] for r in rows.select("y_true").distinct().limit(MOST_CLASSES + 1).collect())
    if len(found) > MOST_CLASSES:
        raise ValueError(f"the target has more than {MOST_CLASSES} classes")
    return found


def _sums(rows: DataFrame, size: int, part) -> np.ndarray:
    """The sum over all rows of ``part(y, x)``, an array of ``size`` numbers for each Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(*_arrays(batch, 0))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    each = rows.select("y_true", "x").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("k", "v"))
    out = np.zeros(size)
    for r in each.groupBy("k").agg(F.sum("v").alias("v")).collect():  # as many numbers as there are statistics
        out[r["k"]] = r["v"]
    return out


def _arrays(batch: pa.RecordBatch, first: int) -> tuple[list[str], np.ndarray]:
    lists = batch.column(first + 1)
    return batch.column(first).to_pylist(), lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _predicted(rows: DataFrame, ids: Sequence[str], labels: list[str], predict) -> DataFrame:
    """(ids, ``n_features``, ``y_true``, ``y_pred``) from ``predict(class numbers, x)``: a class number for each row and prefix."""
    number = {v: k for k, v in enumerate(labels)}
    names = np.array(labels, object)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x = _arrays(batch, len(ids))
            found = predict(np.array([number[v] for v in y]), x)
            n, prefixes = found.shape
            at = pa.array(np.repeat(np.arange(n), prefixes))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(at) for k in range(len(ids) + 1)], pa.array(np.tile(np.arange(1, prefixes + 1), n)),
                 pa.array(names[found.ravel()].tolist(), pa.string())], names=[*ids, "y_true", "n_features", "y_pred"])

    schema = rows.select(*ids, "y_true").schema.add("n_features", "long").add("y_pred", "string")
    return rows.select(*ids, "y_true", "x").mapInArrow(run, schema)


def naive_bayes(df: DataFrame, target: str, names: Sequence[str], ids: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Each row's class by a Gaussian naive Bayes model of all other rows, for every prefix of ``names``.

    Ties go to the class that sorts first; a class without other rows is not predicted.
    """
    rows = _rows(df, target, names, ids)
    labels, f = _classes(rows), len(names)
    number = {v: k for k, v in enumerate(labels)}
    c = len(labels)

    def moments(centre):
        def part(y, x):
            out, at = np.zeros((c, 1 + 2 * f)), np.array([number[v] for v in y])
            moved = x - centre
            np.add.at(out, at, np.column_stack([np.ones(len(x)), moved, moved * moved]))
            return out.ravel()

        return _sums(rows, c * (1 + 2 * f), part).reshape(c, 1 + 2 * f)

    # squares are summed about the mean of all rows: sums of raw squares would lose small variances
    first = moments(np.zeros(f))
    centre = first[:, 1:f + 1].sum(axis=0) / max(first[:, 0].sum(), 1)
    found = moments(centre)
    n, mean = found[:, 0], found[:, 1:f + 1] / found[:, :1]
    squares = found[:, f + 1:] - mean * mean * found[:, :1]

    def predict(y, x):
        x = x - centre
        own = np.arange(c)[None, :] == y[:, None]
        left = np.where(own, n - 1, n).astype(float)
        rest = np.maximum(left, 1)[:, :, None]
        mean_left = np.where(own[:, :, None], (mean * n[:, None] - x[:, None, :]) / rest, mean)
        squares_left = np.where(own[:, :, None], squares - (x[:, None, :] - mean) * (x[:, None, :] - mean_left), squares)
        variance = np.maximum(squares_left / rest, 0) + LEAST_VARIANCE
        fit = -0.5 * np.log(variance) - (x[:, None, :] - mean_left) ** 2 / (2 * variance)
        with np.errstate(divide="ignore"):
            score = np.log(left)[:, :, None] + np.cumsum(fit, axis=2)
        return score.argmax(axis=1)

    return _predicted(rows, ids, labels, predict)


def least_squares(df: DataFrame, target: str, names: Sequence[str], ids: Sequence[str] = ("recording_id",), ridge: float = RIDGE) -> DataFrame:
    """Each row's class by a linear model of all other rows, for every prefix of ``names``.

    Features are standardised over all rows first. The largest of the fitted class indicators wins, the first of equal ones.
    """
    rows = _rows(df, target, names, ids)
    labels, f = _classes(rows), len(names)
    number = {v: k for k, v in enumerate(labels)}
    c, width = len(labels), len(names) + 1
    first = _sums(rows, 1 + f, lambda y, x: np.concatenate([[len(x)], x.sum(axis=0)]))
    count = max(first[0], 1)
    centre = first[1:] / count
    spread = np.sqrt(_sums(rows, f, lambda y, x: ((x - centre) ** 2).sum(axis=0)) / count)
    spread[spread == 0] = 1.0

    def design(x):
        return np.column_stack([np.ones(len(x)), (x - centre) / spread])

    def products(y, x):
        d, one = design(x), np.zeros((len(x), c))
        one[np.arange(len(x)), [number[v] for v in y]] = 1.0
        return np.concatenate([(d.T @ d).ravel(), (d.T @ one).ravel()])

    found = _sums(rows, width * width + width * c, products)
    xx, xy = found[:width * width].reshape(width, width), found[width * width:].reshape(width, c)
    penalty = np.diag([0.0, *[ridge * count] * f])
    inverses = [np.linalg.inv((xx + penalty)[:k, :k]) for k in range(2, width + 1)]

    def predict(y, x):
        d, one = design(x), np.arange(c)[None, :] == y[:, None]
        out = np.empty((len(x), f), np.int64)
        for k, inverse in enumerate(inverses):
            part = d[:, :k + 2]
            leverage = np.einsum("ij,jk,ik->i", part, inverse, part)[:, None]
            with_row = part @ (inverse @ xy[:k + 2])
            out[:, k] = ((with_row - leverage * one) / np.maximum(1 - leverage, 1e-12)).argmax(axis=1)
        return out

    return _predicted(rows, ids, labels, predict)


#: Models validated by summed statistics.
MODELS = {"naive_bayes": naive_bayes, "least_squares": least_squares}


def scores(predictions: DataFrame) -> DataFrame:
    """(``n_features``, ``accuracy``, ``f1_macro``) of predictions for all prefixes; the classes are the true and the predicted ones."""
    ends = F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
                   F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    per_class = predictions.select("n_features", hit.alias("hit"), F.inline(ends)).groupBy("n_features", "label").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum(F.col("hit") * F.col("t")).alias("tp"))
    f1 = 2 * F.col("tp") / (F.col("t") + F.col("p"))
    return per_class.groupBy("n_features").agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("f1_macro"))


def validate(df: DataFrame, target: str, names: Sequence[str], models: Sequence[str] = tuple(MODELS), ids: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Accuracy and macro F1 of each model with all features, every row left out once."""
    out = None
    for name in models:
        whole = MODELS[name](df, target, names, ids).filter(F.col("n_features") == len(names))
        one = classification_metrics(whole.drop("n_features")).select(F.lit(name).alias("model"), "accuracy", "f1_macro")
        out = one if out is None else out.unionByName(one)
    return out


def ablation(df: DataFrame, target: str, ordered: Sequence[str], model: str = "naive_bayes", ids: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Accuracy with the first k features for every k; the smallest k within 95 % of the best is marked ``sufficient``."""
    found = scores(MODELS[model](df, target, ordered, ids)).select("n_features", "accuracy")
    whole = Window.partitionBy(F.lit(1))  # one row for each number of features
    enough = F.when(F.col("accuracy") >= 0.95 * F.max("accuracy").over(whole), F.col("n_features"))
    first = F.min("_enough").over(whole)
    return found.withColumn("_enough", enough).withColumn("sufficient", F.col("n_features") == first).drop("_enough")
