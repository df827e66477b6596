"""Per-recording feature vectors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.functions.ordered import (
    is_split,
    ordinal,
    reblock,
    running_sum,
    settle,
    shift,
    trailing,
    with_recording_values,
)
from saccadia.functions.ranks import recording_quantiles
from saccadia.operators import events as ev
from saccadia.operators.entropy import entropies
from saccadia.operators.pupil import pupil_load_features, pupil_trace, with_frame_rows
from saccadia.operators.signal import with_velocity
from saccadia.schema import INDEX, KEY

SIGNALS = ("x", "y", "pupil")

_registered: dict[str, Column | tuple[Callable, str]] = {}


def register_feature(name: str, feature, schema: str | None = None) -> None:
    """Add a feature to every later ``extract_features``.

    ``feature`` is a Column aggregate over samples (it joins the other aggregates), or a
    function from a recording's pandas frame to ``{column: value}`` with ``schema`` naming
    its columns; such a function gets one whole recording, so keep it for short ones.
    """
    _registered[name] = feature if schema is None else (feature, schema)


def unregister_feature(name: str) -> None:
    _registered.pop(name, None)


def finite(c: Column) -> Column:
    """Null, NaN and infinite values become 0."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def base_aggregates() -> list[Column]:
    duration = F.max("timestamp_ms") - F.min("timestamp_ms")
    return [
        duration.alias("duration_ms"),
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.col("valid").cast("double")).alias("valid_ratio"),
        F.sum("step_px").alias("path_length"),
        F.avg("velocity").alias("velocity_mean"),
        F.max("velocity").alias("velocity_peak"),
    ]


def base_features(samples: DataFrame) -> DataFrame:
    """Duration, sample count, valid ratio, path length, mean and peak velocity."""
    df = samples if "velocity" in samples.columns else with_velocity(samples)
    return df.groupBy(KEY).agg(*base_aggregates())


def event_counts(events: DataFrame) -> DataFrame:
    """Counts, durations and amplitudes per kind, and the mean saccade latency.

    The latency pairs the i-th saccade with the i-th fixation, so events are first summed
    by their place within their kind, then over the recording.
    """
    df = events.filter("kind IN ('fixation', 'saccade', 'blink')")
    df = running_sum(
        df,
        {f"_{k}": F.when(F.col("kind") == k, 1).otherwise(0) for k in ("fixation", "saccade")},
        ["start_index"],
    )
    nth = F.when(F.col("kind") == "fixation", F.col("_fixation")).when(F.col("kind") == "saccade", F.col("_saccade")).otherwise(0)

    def of(kind, column):
        return F.when(F.col("kind") == kind, F.col(column))

    kinds = ("fixation", "saccade", "blink")
    by_place = df.groupBy(KEY, nth.alias("_nth")).agg(
        *[F.count_if(F.col("kind") == k).alias(f"_n_{k}") for k in kinds],
        *[F.sum(of(k, "duration_ms")).alias(f"_d_{k}") for k in kinds],
        F.sum(of("saccade", "amplitude")).alias("_amplitude"),
        F.sum(of("saccade", "peak_velocity")).alias("_peak"),
        (F.max(of("saccade", "start_time_ms")) - F.max(of("fixation", "end_time_ms"))).alias("_latency"),
    )

    def mean(total, kind):
        return F.sum(total) / F.nullif(F.sum(f"_n_{kind}"), F.lit(0))

    return by_place.groupBy(KEY).agg(
        *[F.sum(f"_n_{k}").alias(f"{k}_count") for k in kinds],
        mean("_d_fixation", "fixation").alias("fixation_duration_mean"),
        F.sum("_d_fixation").alias("fixation_duration_total"),
        mean("_amplitude", "saccade").alias("saccade_amplitude_mean"),
        mean("_peak", "saccade").alias("saccade_peak_velocity_mean"),
        F.avg("_latency").alias("saccade_latency_mean"),
        mean("_d_blink", "blink").alias("blink_duration_mean"),
    )


EVENT_COLUMNS = [
    "fixation_count", "fixation_duration_mean", "fixation_duration_total", "fixation_density",
    "saccade_count", "saccade_amplitude_mean", "saccade_peak_velocity_mean", "saccade_latency_mean",
    "blink_count", "blink_rate_hz", "blink_duration_mean",
]


def with_event_rates(df: DataFrame) -> DataFrame:
    """Add the densities, which need ``duration_ms``; recordings without events get zeros."""
    seconds = F.greatest(F.col("duration_ms") / 1000.0, F.lit(1e-6))
    filled = df.fillna(0, [c for c in EVENT_COLUMNS if c in df.columns])
    return filled.withColumns(
        {"fixation_density": F.col("fixation_count") / seconds, "blink_rate_hz": F.col("blink_count") / seconds}
    )


def event_features(samples: DataFrame, events: DataFrame) -> DataFrame:
    """Fixation, saccade and blink features for every recording, also those without events."""
    duration = samples.groupBy(KEY).agg((F.max("timestamp_ms") - F.min("timestamp_ms")).alias("duration_ms"))
    return with_event_rates(duration.join(event_counts(events), KEY, "left")).select(KEY, *EVENT_COLUMNS)


def corrected_skewness(c: Column) -> Column:
    n = F.count(c)
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def corrected_kurtosis(c: Column) -> Column:
    n = F.count(c)
    excess = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when((n >= 4) & (F.stddev_pop(c) > 0), excess)


QUARTILES = {f"{c}_{n}": (f"_valid_{c}", p) for c in SIGNALS for n, p in (("q25", 0.25), ("q75", 0.75))}


def with_valid_signals(samples: DataFrame) -> DataFrame:
    return samples.withColumns({f"_valid_{c}": F.when(F.col("valid"), F.col(c)) for c in SIGNALS})


def moment_aggregates(quartiles: bool) -> list[Column]:
    out = []
    for name in SIGNALS:
        c = F.col(f"_valid_{name}")
        out += [
            F.avg(c).alias(f"{name}_mean"),
            F.stddev_pop(c).alias(f"{name}_std"),
            F.min(c).alias(f"{name}_min"),
            F.max(c).alias(f"{name}_max"),
            finite(corrected_skewness(c)).alias(f"{name}_skew"),
            finite(corrected_kurtosis(c)).alias(f"{name}_kurtosis"),
        ]
    if quartiles:
        out += [F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in QUARTILES.items()]
    return out


def sample_aggregates(samples: DataFrame, aggregates: list[Column]) -> DataFrame:
    """``aggregates`` and the moments of valid samples, in one aggregation.

    Quartiles join it while recordings are of bounded length; in the block layout they
    are counted apart.
    """
    df = settle(with_valid_signals(samples))
    split = is_split(df)
    out = df.groupBy(KEY).agg(*aggregates, *moment_aggregates(quartiles=not split))
    return out.join(recording_quantiles(df, [KEY], QUARTILES), KEY, "left") if split else out


def moment_features(samples: DataFrame) -> DataFrame:
    """Mean, SD, extremes, quartiles, skewness and kurtosis of x, y and pupil over valid samples."""
    return sample_aggregates(samples, [])


def valid_sequence(samples: DataFrame) -> DataFrame:
    """Valid samples with their 0-based position among the valid ones as the index."""
    valid = ordinal(samples.filter("valid"), "_n").withColumn(INDEX, F.col("_n") - 1).drop("_n")
    return reblock(valid, INDEX)


def valid_frames(samples: DataFrame, window_ms: float) -> DataFrame:
    """Valid samples with step time, pupil rate, pupil rank and trailing means and SDs."""
    df = shift(valid_sequence(samples), {"_t": F.col("timestamp_ms"), "_p": F.col("pupil")})
    df = df.withColumn("_dt", F.col("timestamp_ms") - F.col("_t"))
    seconds = F.nullif("_dt", F.lit(0.0)) / 1000.0
    df = df.withColumn("_rate", F.abs(F.col("pupil") - F.col("_p")) / seconds)
    df = running_sum(df, {"_k": F.when(F.col("pupil").isNotNull(), 1).otherwise(0)})
    df = with_recording_values(df, {"_pupils": F.count("pupil")})
    df = with_frame_rows(df, window_ms, window_ms)
    frames = {}
    for c in SIGNALS:
        frames |= {f"_m_{c}": f"avg({c})", f"_s_{c}": f"stddev_samp({c})"}
    return trailing(df, frames, "frame_rows")


def rolling_aggregates() -> list[Column]:
    return [
        *[F.stddev_pop(f"_m_{c}").alias(f"{c}_rolling_mean_std") for c in SIGNALS],
        *[F.avg(F.coalesce(f"_s_{c}", F.lit(0.0))).alias(f"{c}_rolling_std_mean") for c in SIGNALS],
    ]


def pupil_aggregates() -> list[Column]:
    early = F.col("_k") <= F.greatest(F.floor(F.col("_pupils") * 0.1), F.lit(1))
    return [
        F.coalesce(F.avg(F.when(early, F.col("pupil"))), F.lit(0.0)).alias("pupil_baseline"),
        F.coalesce(F.avg("_rate"), F.lit(0.0)).alias("pupil_change_rate"),
    ]


def rolling_features(samples: DataFrame, window_ms: float = 500.0) -> DataFrame:
    """SD of trailing means and mean of trailing SDs, the frame sized by each recording's median step."""
    return valid_frames(samples, window_ms).groupBy(KEY).agg(*rolling_aggregates())


def pupil_features(samples: DataFrame) -> DataFrame:
    """Baseline (mean of the first tenth) and mean absolute rate of change over valid samples."""
    return valid_frames(samples, 500.0).groupBy(KEY).agg(*pupil_aggregates())


def entropy_features(samples: DataFrame, max_samples: int = 0, m: int = 2, r: float = 0.2) -> DataFrame:
    """Approximate entropy of x, y and pupil over valid samples, and how many samples it rests on.

    With ``max_samples``, recordings of more than that are thinned to so many evenly spaced samples first.
    """
    kept = valid_sequence(samples)
    if max_samples > 0:
        df = with_recording_values(kept, {"_n": F.count(F.lit(1))})
        step = F.col("_n") / float(max_samples)
        slot = F.ceil(F.col(INDEX) / step)
        picked = (F.floor(slot * step) == F.col(INDEX)) & (slot < max_samples - 1)
        kept = df.filter((F.col("_n") <= max_samples) | picked | (F.col(INDEX) == F.col("_n") - 1))
    kept = settle(kept)
    found = entropies(kept, SIGNALS, m, r).groupBy(KEY).agg(
        *[F.max(F.when(F.col("signal") == c, F.col("apen"))).alias(f"{c}_approx_entropy") for c in SIGNALS])
    total = kept.groupBy(KEY).agg(F.count(F.lit(1)).alias("entropy_samples"))
    return total.join(found, KEY, "left").fillna(0.0, [f"{c}_approx_entropy" for c in SIGNALS])


def extract_features(
    samples: DataFrame,
    labelled: DataFrame | None = None,
    window_ms: float = 500.0,
    include_complexity: bool = True,
    include_pupil_load: bool = False,
    names: list[str] | None = None,
    entropy_samples: int = 0,
    min_fixation_ms: float = ev.MIN_FIXATION_MS,
    min_blink_ms: float = ev.MIN_BLINK_MS,
) -> DataFrame:
    """One row per recording with every feature; null and non-finite values are 0.

    ``labelled`` are the samples with event kinds (by default ``label_samples(samples)``).
    ``names`` picks registered features (default: all).
    """
    if labelled is None:
        labelled = ev.label_samples(samples)
    labelled = settle(labelled)
    events = ev.runs_to_events(labelled, min_fixation_ms, min_blink_ms)
    picked = {n: _registered[n] for n in (_registered if names is None else names)}
    aggregates = [c.alias(n) for n, c in picked.items() if isinstance(c, Column)]
    parts = [
        event_counts(events),
        valid_frames(labelled, window_ms).groupBy(KEY).agg(*rolling_aggregates(), *pupil_aggregates()),
    ]
    if include_complexity:
        parts.append(entropy_features(labelled, entropy_samples).drop("entropy_samples"))
    if include_pupil_load:
        trace = pupil_trace(labelled, baseline_window_ms=window_ms, min_blink_ms=min_blink_ms)
        parts.append(pupil_load_features(trace, max(window_ms, 1000.0)))
    for feature in picked.values():
        if not isinstance(feature, Column):
            parts.append(_python_feature(samples, *feature))
    out = sample_aggregates(labelled, [*base_aggregates(), *aggregates])
    for part in parts:
        out = out.join(part, KEY, "left")
    out = with_event_rates(out)
    return out.select(KEY, *[finite(F.col(c)).alias(c) for c in out.columns if c != KEY])


def _python_feature(samples: DataFrame, fn, schema: str) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = fn(pdf.sort_values(INDEX).reset_index(drop=True))
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], **{k: [v] for k, v in values.items()}})

    return samples.groupBy(KEY).applyInPandas(one, f"{KEY} string, {schema}")


def feature_dataset(features: DataFrame, recordings: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Feature rows with the recording's design columns and, if given, targets by recording.

    A recording without a session id goes by its key.
    """
    df = features.join(recordings, KEY, "left")
    if targets is not None:
        df = df.join(targets, KEY, "left")
    if "session_id" not in df.columns:
        return df.withColumn("session_id", F.col(KEY))
    return df.withColumn("session_id", F.coalesce("session_id", KEY))


def heart_rate_features(signal: DataFrame) -> DataFrame:
    """Mean, SD, extremes and RMSSD of ``heart_rate_bpm`` per recording."""
    df = signal.filter(F.col("heart_rate_bpm").isNotNull())
    df = shift(df, {"_previous": F.col("heart_rate_bpm")})
    step = F.col("heart_rate_bpm") - F.col("_previous")
    return df.groupBy(KEY).agg(
        F.avg("heart_rate_bpm").alias("heart_rate_mean"),
        F.stddev_pop("heart_rate_bpm").alias("heart_rate_std"),
        F.min("heart_rate_bpm").alias("heart_rate_min"),
        F.max("heart_rate_bpm").alias("heart_rate_max"),
        F.coalesce(F.sqrt(F.avg(step * step)), F.lit(0.0)).alias("heart_rate_rmssd"),
    )


def unpivot(features: DataFrame, columns: list[str], ids=(KEY,)) -> DataFrame:
    """Long form: one row per recording and metric."""
    return features.unpivot(list(ids), columns, "metric", "value")


def top_features(features: DataFrame, k: int = 18) -> DataFrame:
    """The ``k`` largest feature values of each recording, ranked."""
    names = [c for c in features.columns if c != KEY]
    entry = F.array(*[F.struct((-F.col(c)).alias("neg"), F.lit(c).alias("metric")) for c in names])
    ranked = features.select(KEY, F.posexplode(F.slice(F.array_sort(entry), 1, k)).alias("_at", "_e"))
    return ranked.select(
        KEY, (F.col("_at") + 1).alias("rank"), F.col("_e.metric").alias("metric"), (-F.col("_e.neg")).alias("value")
    )


def quality_summary(samples: DataFrame, labelled: DataFrame, events: DataFrame) -> DataFrame:
    """Eight-number summary: raw samples' counts and validity, events per kind, peak velocity."""
    raw = samples.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("sample_count"),
        (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("duration_ms"),
        F.avg(F.col("valid").cast("double")).alias("valid_ratio"),
    )
    peak = labelled.groupBy(KEY).agg(F.max("velocity").alias("velocity_peak"))
    counts = events.groupBy(KEY).agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("fixation", "saccade", "blink")]
    )
    out = raw.join(peak, KEY).join(counts, KEY, "left").fillna(0)
    return out.withColumn("invalid_ratio", 1.0 - F.col("valid_ratio"))
