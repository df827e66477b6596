"""Pupil cleaning, baseline correction and workload features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.functions.ordered import fill, framed, is_split, join_recording, running_sum, settle, shift, trailing, with_recording_values
from saccadia.functions.ranks import recording_quantiles
from saccadia.operators.signal import interpolate_nulls
from saccadia.schema import INDEX, KEY


def in_blink_event(labelled: DataFrame, min_blink_ms: float) -> DataFrame:
    """Samples of a labelled table with ``in_blink`` for lying in a blink run that is long enough.

    Blink events are runs of samples, so the run's first and last time are filled in along
    the run; no join with the event table is needed.
    """
    df = shift(labelled, {"_before": F.col("kind")})
    df = shift(df, {"_after": F.col("kind")}, ahead=True)
    starts = (F.col(INDEX) == 0) | ~F.col("kind").eqNullSafe(F.col("_before"))
    df = fill(df, {"_begin": F.when(starts, F.col("timestamp_ms"))})
    df = fill(df, {"_end": F.when(~F.col("kind").eqNullSafe(F.col("_after")), F.col("timestamp_ms"))}, ahead=True)
    # the last row of a recording has no row after it: its run ends there
    end = F.coalesce(F.col("_end"), F.col("timestamp_ms"))
    blink = (F.col("kind") == "blink") & (end - F.col("_begin") >= min_blink_ms)
    return df.withColumn("in_blink", F.coalesce(blink, F.lit(False))).drop("_before", "_after", "_begin", "_end")


def clean_pupil(samples: DataFrame, smoothing_window: int = 5) -> DataFrame:
    """Add ``blink_mask`` and ``cleaned_pupil``.

    Masked are invalid samples, missing or non-positive pupils, and samples inside blink
    events where the input has ``in_blink``.
    """
    mask = ~F.col("valid") | F.col("pupil").isNull() | (F.col("pupil") <= 0)
    if "in_blink" in samples.columns:
        mask = mask | F.col("in_blink")
    df = samples.withColumn("blink_mask", F.coalesce(mask, F.lit(True)))
    df = interpolate_nulls(df, {"cleaned_pupil": F.when(~F.col("blink_mask"), F.col("pupil"))})
    df = df.withColumn("cleaned_pupil", F.coalesce("cleaned_pupil", F.lit(0.0)))
    if smoothing_window > 1:
        half = (smoothing_window // 2, (smoothing_window - 1) // 2)
        df = framed(df, {"_smooth": F.avg("cleaned_pupil")}, *half)
        df = df.withColumn("cleaned_pupil", F.col("_smooth")).drop("_smooth")
    return df


def pupil_baseline(cleaned: DataFrame, mode: str = "trial_start", window_ms: float = 500.0) -> DataFrame:
    """``baseline_value`` per recording, 0 where no pupil sample is usable.

    ``recording_median`` is the median of usable samples; any other mode the mean of those
    in the first ``window_ms``, or else of the first ten.
    """
    usable = F.when(~F.col("blink_mask"), F.col("cleaned_pupil"))
    df = cleaned.withColumn("_usable", usable)
    if mode == "recording_median":
        found = recording_quantiles(df, [KEY], {"baseline_value": ("_usable", 0.5)})
        return found.withColumn("baseline_value", F.coalesce("baseline_value", F.lit(0.0)))
    df = with_recording_values(df, {"_t0": F.min("timestamp_ms")})
    df = running_sum(df, {"_k": F.when(F.col("_usable").isNotNull(), 1).otherwise(0)})
    early = F.avg(F.when(F.col("timestamp_ms") <= F.col("_t0") + window_ms, F.col("_usable")))
    first = F.avg(F.when(F.col("_k") <= 10, F.col("_usable")))
    return df.groupBy(KEY).agg(F.coalesce(early, first, F.lit(0.0)).alias("baseline_value"))


def baseline_correct(
    cleaned: DataFrame, mode: str = "trial_start", window_ms: float = 500.0, zscore: bool = False
) -> DataFrame:
    """Add ``baseline_value`` and ``bc_pupil``; ``zscore`` scales it within the recording."""
    cleaned = settle(cleaned)
    df = join_recording(cleaned, pupil_baseline(cleaned, mode, window_ms))
    df = df.withColumn("bc_pupil", F.col("cleaned_pupil") - F.col("baseline_value"))
    if not zscore:
        return df
    df = with_recording_values(df, {"_mean": F.avg("bc_pupil"), "_sd": F.stddev_pop("bc_pupil")})
    scaled = (F.col("bc_pupil") - F.col("_mean")) / F.col("_sd")
    return df.withColumn("bc_pupil", F.when(F.col("_sd") > 1e-6, scaled).otherwise(F.col("bc_pupil"))).drop("_mean", "_sd")


def pupil_meta(corrected: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row per recording describing the cleaning."""
    masked = F.avg(F.col("blink_mask").cast("double"))
    meta = corrected.groupBy(KEY).agg(
        F.max(F.col("pupil").isNotNull()).alias("available"),
        masked.alias("blink_sample_ratio"),
        masked.alias("interpolation_ratio"),
        F.first("baseline_value").alias("baseline_value"),
    )
    if events is None:
        return meta.withColumn("blink_event_count", F.lit(0))
    blinks = events.groupBy(KEY).agg(F.count_if(F.col("kind") == "blink").alias("blink_event_count"))
    return meta.join(blinks, KEY, "left").fillna(0, ["blink_event_count"])


def with_frame_rows(df: DataFrame, window_ms: float, fallback_dt: float) -> DataFrame:
    """Add ``frame_rows``: how many samples a window of ``window_ms`` holds, 2 at least.

    ``_dt`` is the time since the sample before; its median sets the sampling step.
    """
    if is_split(df):
        df = settle(df)
        df = join_recording(df, recording_quantiles(df, [KEY], {"_median": ("_dt", 0.5)}))
    else:
        df = with_recording_values(df, {"_median": F.percentile("_dt", F.lit(0.5))})
    dt = F.greatest(F.coalesce("_median", F.lit(fallback_dt)), F.lit(1.0))
    return df.withColumn("frame_rows", F.greatest(F.bround(F.lit(window_ms) / dt), F.lit(2.0))).drop("_median")


def pupil_load_features(corrected: DataFrame, window_ms: float = 1000.0) -> DataFrame:
    """Ten workload features per recording from a baseline-corrected trace."""
    corrected = settle(corrected)
    df = shift(corrected, {"_t": F.col("timestamp_ms")}).withColumn("_dt", F.col("timestamp_ms") - F.col("_t"))
    df = with_frame_rows(df, window_ms, window_ms)
    df = trailing(df, {"_tonic": "avg(cleaned_pupil)", "_level": "avg(bc_pupil)"}, "frame_rows")
    df = df.withColumn("_phasic", F.greatest(F.col("bc_pupil") - F.col("_level"), F.lit(0.0)))
    df = with_recording_values(df, {"_top": F.max("bc_pupil"), "_t0": F.min("timestamp_ms")})
    df = df.withColumn("_peak", F.greatest("_top", F.lit(0.0)))
    onset = F.min(F.when((F.col("_peak") > 0) & (F.col("bc_pupil") >= 0.5 * F.col("_peak")), F.col("timestamp_ms")))
    masked = F.avg(F.col("blink_mask").cast("double"))
    q75 = [] if is_split(df) else [F.percentile("bc_pupil", F.lit(0.75)).alias("pupil_bc_q75")]
    found = df.groupBy(KEY).agg(
        *q75,
        F.avg("bc_pupil").alias("pupil_bc_mean"),
        F.stddev_pop("bc_pupil").alias("pupil_bc_std"),
        F.max("_peak").alias("pupil_bc_peak"),
        F.avg("_tonic").alias("pupil_tonic_level"),
        F.avg("_phasic").alias("pupil_phasic_mean"),
        F.max("_phasic").alias("pupil_phasic_peak"),
        F.coalesce(onset - F.min("_t0"), F.lit(0.0)).alias("pupil_dilation_latency_ms"),
        masked.alias("pupil_blink_ratio"),
        masked.alias("pupil_interpolation_ratio"),
    )
    if q75:
        return found
    return found.join(recording_quantiles(corrected, [KEY], {"pupil_bc_q75": ("bc_pupil", 0.75)}), KEY)


def pupil_trace(
    labelled: DataFrame,
    baseline_mode: str = "trial_start",
    baseline_window_ms: float = 500.0,
    zscore: bool = False,
    smoothing_window: int = 5,
    min_blink_ms: float = 75.0,
) -> DataFrame:
    """Blink mask, cleaned and baseline-corrected pupil of samples labelled with event kinds."""
    masked = in_blink_event(labelled, min_blink_ms)
    return baseline_correct(clean_pupil(masked, smoothing_window), baseline_mode, baseline_window_ms, zscore)
