"""Cutting recordings into named segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.functions.ordered import fill, is_split, lay_out, ordinal
from saccadia.schema import BLOCK, INDEX, KEY

BIN_MS = 500.0


def bounds(samples: DataFrame) -> DataFrame:
    return samples.groupBy(KEY).agg(F.min("timestamp_ms").alias("_lo"), F.max("timestamp_ms").alias("_hi"))


def clamp(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """Segments cut to their recording; one that ends before it starts becomes its start."""
    start = F.greatest("start_ms", "_lo")
    return (
        segments.join(bounds(samples), KEY)
        .withColumn("start_ms", start)
        .withColumn("end_ms", F.greatest(F.least("end_ms", "_hi"), F.col("start_ms")))
        .drop("_lo", "_hi")
    )


def whole(samples: DataFrame) -> DataFrame:
    return bounds(samples).select(
        KEY, F.lit("whole_file").alias("segment_name"), F.col("_lo").alias("start_ms"), F.col("_hi").alias("end_ms")
    )


def time_ranges(samples: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    """``time_1``, ``time_2``, … for every recording."""
    rows = F.array(
        *[
            F.struct(F.lit(f"time_{k}").alias("segment_name"), F.lit(float(a)).alias("start_ms"), F.lit(float(b)).alias("end_ms"))
            for k, (a, b) in enumerate(ranges, 1)
        ]
    )
    found = bounds(samples).select(KEY, "_lo", "_hi", F.inline(rows))
    start = F.greatest("start_ms", "_lo")
    return found.select(
        KEY, "segment_name", start.alias("start_ms"), F.greatest(F.least("end_ms", "_hi"), start).alias("end_ms")
    )


def marker_rows(samples: DataFrame, column: str = "marker") -> DataFrame:
    return samples.filter(F.trim(F.col(column)) != "")


def marker_windows(
    samples: DataFrame, values: list[str] | None = None, pre_ms: float = 0.0, post_ms: float = 0.0, column: str = "marker"
) -> DataFrame:
    """A window around each marker, numbered among the markers chosen."""
    rows = marker_rows(samples, column)
    if values is not None:
        rows = rows.filter(F.col(column).isin([str(v) for v in values]))
    rows = ordinal(rows, "_k")
    segments = rows.select(
        KEY,
        F.concat_ws("_", F.lit("marker_window"), "_k", column).alias("segment_name"),
        (F.col("timestamp_ms") - pre_ms).alias("start_ms"),
        (F.col("timestamp_ms") + post_ms).alias("end_ms"),
        F.col(column).alias("marker_value"),
    )
    return clamp(segments, samples)


def between_markers(samples: DataFrame, start: str, end: str, column: str = "marker") -> DataFrame:
    """From each start marker to the first strictly later end marker; starts without one are skipped."""
    rows = marker_rows(samples, column)
    block = {BLOCK: F.min(BLOCK)} if is_split(samples) else {}
    times = rows.groupBy(KEY, "timestamp_ms").agg(
        F.max(F.when(F.col(column) == end, F.col("timestamp_ms"))).alias("_end"), *[c.alias(n) for n, c in block.items()]
    )
    times = fill(times, {"_next": F.col("_end")}, order=["timestamp_ms"], ahead=True, strict=True)
    starts = ordinal(rows.filter(F.col(column) == start), "_k")
    found = starts.drop(BLOCK).join(times.select(KEY, "timestamp_ms", "_next"), [KEY, "timestamp_ms"])
    segments = found.filter("_next IS NOT NULL").select(
        KEY,
        F.concat(F.lit("between_"), F.col("_k"), F.lit(f"_{start}_to_{end}")).alias("segment_name"),
        F.col("timestamp_ms").alias("start_ms"),
        F.col("_next").alias("end_ms"),
        F.lit(start).alias("start_marker"),
        F.lit(end).alias("end_marker"),
    )
    return clamp(segments, samples)


def in_intervals(samples: DataFrame, intervals: DataFrame, start: str, end: str, bin_ms: float = BIN_MS) -> DataFrame:
    """Samples inside closed intervals of their recording, once per interval.

    Both sides are cut into time bins and joined on (recording, bin), so that the work
    follows the samples found and a long recording is spread over its bins.
    """
    low, high = F.floor(F.col(start) / bin_ms), F.floor(F.col(end) / bin_ms)
    binned = intervals.withColumn("_bin", F.explode(F.sequence(low, high)))
    points = samples.withColumn("_bin", F.floor(F.col("timestamp_ms") / bin_ms))
    return (
        points.join(binned, [KEY, "_bin"])
        .filter((F.col("timestamp_ms") >= F.col(start)) & (F.col("timestamp_ms") <= F.col(end)))
        .drop("_bin")
    )


def segment_samples(samples: DataFrame, segments: DataFrame, bin_ms: float = BIN_MS) -> DataFrame:
    """Samples per segment, laid out anew: the recording key becomes ``recording#segment``."""
    picked = in_intervals(samples.drop(INDEX, BLOCK), segments, "start_ms", "end_ms", bin_ms)
    keyed = picked.withColumn("source_recording_id", F.col(KEY)).withColumn(
        KEY, F.concat_ws("#", "source_recording_id", "segment_name")
    )
    return lay_out(keyed)


def segment_features(samples: DataFrame, segments: DataFrame, missing_strategy="interpolate", **feature_options) -> DataFrame:
    """Preprocess, detect events and extract features segment by segment."""
    from saccadia.operators.events import label_samples
    from saccadia.operators.features import extract_features
    from saccadia.operators.signal import preprocess

    cut = segment_samples(samples, segments).drop(*[c for c in segments.columns if c != KEY], "source_recording_id")
    clean = preprocess(cut, missing_strategy=missing_strategy, normalize=False)
    features = extract_features(clean, label_samples(clean), **feature_options)
    named = segments.withColumn("source_recording_id", F.col(KEY)).withColumn(
        KEY, F.concat_ws("#", "source_recording_id", "segment_name")
    )
    return features.join(
        named.withColumnsRenamed({"start_ms": "segment_start_ms", "end_ms": "segment_end_ms"}), KEY
    )


def distinct_markers(samples: DataFrame, column: str = "marker") -> DataFrame:
    """Distinct trimmed markers of each recording in the order first seen."""
    found = marker_rows(samples, column).groupBy(KEY, F.trim(F.col(column)).alias("marker")).agg(
        F.min(F.struct("timestamp_ms", "sample_seq")).alias("_first")
    )
    return found.select(KEY, "marker", F.col("_first.timestamp_ms").alias("first_ms"), F.col("_first.sample_seq").alias("first_seq"))
