"""Joining gaze with other signals on time, and fusing features and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.functions.ordered import fill, join_small, lay_out
from saccadia.operators.signal import fill_gaps_both_ways
from saccadia.schema import BLOCK, INDEX, KEY

TIME = "timestamp_ms"
ORDER = [KEY, "sample_seq", TIME]


def prefixed(df: DataFrame, name: str) -> DataFrame:
    """Every column but the key, the order and the time gets the modality's name in front."""
    return df.select(*[F.col(c).alias(c if c in ORDER else f"{name}_{c}") for c in df.columns if c not in (INDEX, BLOCK)])


def asof_nearest(left: DataFrame, right: DataFrame, tolerance_ms: float = 50.0) -> DataFrame:
    """Each left row with the nearest right row of its recording, if within the tolerance.

    Both sides are put on one time line; the last right row before and the first one after
    each left row are carried to it. Of two equally near rows the earlier wins. The key
    is (recording, time, sequence); right columns must not repeat left names.
    """
    values = [c for c in right.columns if c not in ORDER]
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    # at one time right rows come first, so a left row sees them as "before or at"
    line = lay_out(both.withColumn("_seq", F.col("sample_seq")).withColumn("sample_seq", F.struct("_side", "_seq")))
    hit = F.when(F.col("_side") == 0, F.struct(F.col(TIME).alias("t"), *values))
    line = fill(line, {"_before": hit})
    # the first of several right rows at one later time, hence the nearest in index order
    line = fill(line, {"_after": hit}, ahead=True)
    rows = line.filter("_side = 1")
    back, ahead = F.col(TIME) - F.col("_before.t"), F.col("_after.t") - F.col(TIME)
    near_back = F.when(back <= tolerance_ms, F.col("_before"))
    near_ahead = F.when(ahead <= tolerance_ms, F.col("_after"))
    near = F.when(near_back.isNull(), near_ahead).when(near_ahead.isNull() | (back <= ahead), near_back).otherwise(near_ahead)
    rows = rows.withColumn("_near", near).withColumn("sample_seq", F.col("_seq"))
    kept = [c for c in left.columns if c not in (INDEX, BLOCK)]
    return rows.select(*kept, *[F.col(f"_near.{c}").alias(c) for c in values])


def align(modalities: dict[str, DataFrame], reference: str | None = None, tolerance_ms: float = 50.0) -> DataFrame:
    """All modalities on the reference's time line (the first one by default)."""
    names = list(modalities)
    base = reference or names[0]
    if base not in modalities:
        raise KeyError(f"unknown reference modality: {base}")
    out = prefixed(modalities[base], base)
    for name in names:
        if name != base:
            out = asof_nearest(out, prefixed(modalities[name], name), tolerance_ms)
    return out


def early_fusion(modalities: dict[str, DataFrame], reference: str | None = None, tolerance_ms: float = 50.0) -> DataFrame:
    """The aligned table with every null filled from the nearest rows before, else after."""
    aligned = lay_out(align(modalities, reference, tolerance_ms))
    return fill_gaps_both_ways(aligned, [c for c in aligned.columns if c not in (*ORDER, INDEX, BLOCK)])


def feature_concat(features: dict[str, DataFrame]) -> DataFrame:
    """Per-modality feature rows side by side, names prefixed."""
    parts = [df.select(KEY, *[F.col(c).cast("double").alias(f"{n}_{c}") for c in df.columns if c != KEY]) for n, df in features.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, KEY, "full")
    return out


def late_fusion(predictions: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weighted mean probability per recording and class from ``(recording_id, modality, class, p)``.

    A modality without a weight counts 1.
    """
    df = predictions
    if weights is not None:
        df = join_small(df, weights, ["modality"])
        weight = F.coalesce("weight", F.lit(1.0))
    else:
        weight = F.lit(1.0)
    return df.groupBy(KEY, "class").agg((F.sum(weight * F.col("p")) / F.sum(weight)).alias("p"))
