"""Fixations, saccades and blinks as runs of equally labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.functions.labels import event_kind
from saccadia.functions.ordered import is_split, join_recording, ordinal, reblock, run_starts, with_recording_values
from saccadia.operators.signal import step_length, with_velocity
from saccadia.schema import BLOCK, INDEX, KEY

VELOCITY_THRESHOLD = 850.0
MIN_FIXATION_MS = 60.0
MIN_BLINK_MS = 75.0


def threshold_kind(threshold: float = VELOCITY_THRESHOLD) -> Column:
    """Blink for invalid samples, saccade at or above the velocity threshold, else fixation."""
    return (
        F.when(~F.col("valid"), F.lit("blink"))
        .when(F.col("velocity") >= threshold, F.lit("saccade"))
        .otherwise(F.lit("fixation"))
    )


def label_by_velocity(samples: DataFrame, threshold: float = VELOCITY_THRESHOLD) -> DataFrame:
    """Samples with ``velocity`` and the ``kind`` the velocity threshold gives them."""
    return with_velocity(samples).withColumn("kind", threshold_kind(threshold))


def label_samples(
    samples: DataFrame,
    source: str = "auto",
    threshold: float = VELOCITY_THRESHOLD,
    label_column: str | None = None,
    label_map: dict[str, str] | None = None,
) -> DataFrame:
    """Samples with ``velocity``, ``kind`` and ``from_labels``, chosen recording by recording.

    ``auto`` takes the original labels where the recording has any, else the velocity
    threshold; ``labels``/``original`` fails for recordings without labels.
    """
    df = with_velocity(samples)
    name = source.lower()
    if name not in ("auto", "labels", "original"):
        return df.withColumns({"kind": threshold_kind(threshold), "from_labels": F.lit(False)})
    labels = [label_column] if label_column else ["event_label", "label"]
    seen = {f"_any_{c}": F.max(event_kind(F.col(c), label_map).isNotNull()) for c in labels}
    df = with_recording_values(df, seen)
    kinds = [F.when(F.col(f"_any_{c}"), F.struct(event_kind(F.col(c), label_map).alias("kind"))) for c in labels]
    chosen = F.coalesce(*kinds)
    if name == "auto":
        fallback = F.struct(threshold_kind(threshold).alias("kind"))
    else:
        fallback = F.struct(F.raise_error(F.lit("recording has no event labels")).cast("string").alias("kind"))
    return (
        df.withColumn("kind", F.coalesce(chosen, fallback)["kind"])
        .withColumn("from_labels", chosen.isNotNull())
        .drop(*seen)
    )


def runs_to_events(
    labelled: DataFrame,
    min_fixation_ms: float = MIN_FIXATION_MS,
    min_blink_ms: float = MIN_BLINK_MS,
) -> DataFrame:
    """One row per run of equal ``kind``; short fixations and blinks are dropped.

    Recordings labelled from original labels keep their runs of any length.
    """
    runs = run_starts(labelled, "kind").filter(F.col("kind").isNotNull())
    first, last = F.col(INDEX), F.col(INDEX)
    filtered = ~F.col("from_labels") if "from_labels" in labelled.columns else F.lit(True)
    events = runs.groupBy(KEY, "run_start", "kind").agg(
        F.min("timestamp_ms").alias("start_time_ms"),
        F.max("timestamp_ms").alias("end_time_ms"),
        F.max(INDEX).alias("end_index"),
        F.max("velocity").alias("peak_velocity"),
        F.min_by(F.struct("x", "y", "event_label"), first).alias("_first"),
        F.max_by(F.struct("x", "y"), last).alias("_last"),
        F.avg("x").alias("_cx"),
        F.avg("y").alias("_cy"),
        F.max(filtered).alias("_filtered"),
    )
    seen = F.col("kind") != "blink"
    duration = F.col("end_time_ms") - F.col("start_time_ms")
    short = ((F.col("kind") == "fixation") & (duration < min_fixation_ms)) | (
        (F.col("kind") == "blink") & (duration < min_blink_ms)
    )
    moved = step_length(F.col("_last.x") - F.col("_first.x"), F.col("_last.y") - F.col("_first.y"))
    kept = events.filter(~(F.col("_filtered") & short)).select(
        KEY,
        "kind",
        "start_time_ms",
        "end_time_ms",
        duration.alias("duration_ms"),
        F.col("run_start").alias("start_index"),
        "end_index",
        F.when(seen, moved).otherwise(0.0).alias("amplitude"),
        "peak_velocity",
        F.when(seen, F.col("_cx")).alias("centroid_x"),
        F.when(seen, F.col("_cy")).alias("centroid_y"),
        F.col("_first.event_label").alias("source_label"),
    )
    if is_split(labelled):
        kept = reblock(kept.withColumn(BLOCK, F.lit(0)), "start_index")
    return ordinal(kept, "event_index", ["start_index"]).withColumn("event_index", F.col("event_index") - 1)


def detect_events(
    samples: DataFrame,
    source: str = "auto",
    threshold: float = VELOCITY_THRESHOLD,
    min_fixation_ms: float = MIN_FIXATION_MS,
    min_blink_ms: float = MIN_BLINK_MS,
    label_column: str | None = None,
    label_map: dict[str, str] | None = None,
) -> DataFrame:
    return runs_to_events(
        label_samples(samples, source, threshold, label_column, label_map), min_fixation_ms, min_blink_ms
    )


def events_from_labels(
    samples: DataFrame, label_column: str = "event_label", label_map=None, min_fixation_ms=0.0, min_blink_ms=0.0
) -> DataFrame:
    """Events from original labels; no duration filter unless asked for."""
    df = with_velocity(samples).withColumn("kind", event_kind(F.col(label_column), label_map))
    return runs_to_events(df, min_fixation_ms, min_blink_ms)


def event_table(events: DataFrame) -> DataFrame:
    return events.select(
        KEY, "kind", "start_time_ms", "end_time_ms", "duration_ms", "start_index", "end_index", "amplitude", "peak_velocity"
    )


DESIGN = ("session_id", "subject_id", "condition", "trial")


def fixation_table(events: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """Fixations with their place among all events and the recording's design columns."""
    block = [BLOCK] if is_split(events) else []
    fixations = events.filter("kind = 'fixation'").select(
        KEY, *block, "event_index", "start_time_ms", "end_time_ms", "duration_ms", "centroid_x", "centroid_y"
    )
    if recordings is None:
        return fixations
    return join_recording(fixations, recordings.select(KEY, *DESIGN))


def fixation_mask(
    labelled: DataFrame, min_fixation_ms: float = MIN_FIXATION_MS, name: str = "is_fixation"
) -> DataFrame:
    """Samples with a flag for lying in a fixation that is long enough."""
    from saccadia.functions.ordered import fill, shift

    runs = run_starts(labelled, "kind")
    edge = shift(runs, {"_next_run": F.col("run_start")}, ahead=True)
    ends = F.when(
        ~F.col("run_start").eqNullSafe(F.col("_next_run")), F.col("timestamp_ms")
    )
    begins = F.when(F.col("run_start") == F.col(INDEX), F.col("timestamp_ms"))
    edge = fill(edge, {"_begin": begins})
    edge = fill(edge, {"_end": ends}, ahead=True)
    long_enough = F.col("_end") - F.col("_begin") >= min_fixation_ms
    flag = F.coalesce((F.col("kind") == "fixation") & long_enough, F.lit(False))
    return edge.withColumn(name, flag).drop("run_start", "_next_run", "_begin", "_end")
