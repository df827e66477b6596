"""Comparing fixation detectors: ground truth, velocity thresholds, dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.functions.ordered import join_recording, partition_keys, run_starts, shift
from saccadia.operators.dispersion import dispersion_fixations  # noqa: F401
from saccadia.operators.events import threshold_kind
from saccadia.operators.segments import in_intervals
from saccadia.operators.signal import step_length
from saccadia.schema import BLOCK, INDEX, KEY


def ground_truth_labels(samples: DataFrame, name: str = "is_truth") -> DataFrame:
    """Flag samples whose label contains "fix"; per recording the first of event_label, label in use."""
    from saccadia.functions.ordered import with_recording_values

    df = with_recording_values(samples, {"_any": F.max(F.col("event_label").isNotNull())})
    label = F.when(F.col("_any"), F.col("event_label")).otherwise(F.col("label"))
    return df.withColumn(name, F.coalesce(F.lower(F.trim(label)).contains("fix"), F.lit(False))).drop("_any")


def flag_runs(samples: DataFrame, flag: str) -> DataFrame:
    """Fixations as runs of samples with a true flag, of any length."""
    runs = run_starts(samples, flag).filter(F.col(flag))
    found = runs.groupBy(KEY, F.col("run_start").alias("start_index")).agg(
        F.max(INDEX).alias("end_index"),
        F.min("timestamp_ms").alias("start_time_ms"),
        F.max("timestamp_ms").alias("end_time_ms"),
        F.min_by(F.struct("x", "y"), INDEX).alias("_a"),
        F.max_by(F.struct("x", "y"), INDEX).alias("_b"),
    )
    return found.select(
        KEY, "start_index", "end_index", "start_time_ms", "end_time_ms",
        (F.col("end_time_ms") - F.col("start_time_ms")).alias("duration_ms"),
        step_length(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")).alias("amplitude"),
    )


def intervals_to_events(samples: DataFrame, intervals: DataFrame) -> DataFrame:
    """Sample ranges and amplitude of external ``(recording_id, onset, offset)`` intervals.

    The range is from the first sample not before the onset to the last not after the
    offset; an interval between two samples gets the sample after its onset (at the
    recording's end, the last one).
    """
    keyed = intervals.select(KEY, "onset", "offset")
    inside = in_intervals(samples.drop(BLOCK), keyed, "onset", "offset")
    point = F.struct("timestamp_ms", "x", "y")
    found = inside.groupBy(KEY, "onset", "offset").agg(
        F.min(INDEX).alias("start_index"), F.max(INDEX).alias("end_index"),
        F.min_by(point, INDEX).alias("_a"), F.max_by(point, INDEX).alias("_b"),
    )
    empty = keyed.join(found.select(KEY, "onset", "offset"), [KEY, "onset", "offset"], "left_anti")
    found = found.unionByName(_next_samples(samples, empty))
    return found.select(
        KEY, "onset", "offset", "start_index", "end_index",
        F.col("_a.timestamp_ms").alias("start_time_ms"), F.col("_b.timestamp_ms").alias("end_time_ms"),
        step_length(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")).alias("amplitude"),
    )


def _next_samples(samples: DataFrame, intervals: DataFrame) -> DataFrame:
    """For intervals without samples: the first sample after the onset, else the last sample."""
    from saccadia.functions.ordered import fill, lay_out

    points = samples.select(KEY, "timestamp_ms", F.struct(F.lit(1), F.col("sample_seq")).alias("sample_seq"),
                            F.struct(F.col(INDEX).alias("i"), "timestamp_ms", "x", "y").alias("_hit"))
    marks = intervals.select(KEY, F.col("onset").alias("timestamp_ms"), F.struct(F.lit(0), F.lit(0).cast("long")).alias("sample_seq"),
                             "onset", "offset")
    line = lay_out(points.unionByName(marks, allowMissingColumns=True))
    line = fill(line, {"_after": F.col("_hit")}, ahead=True)
    line = fill(line, {"_before": F.col("_hit")})
    hit = F.coalesce("_after", "_before")
    point = F.struct(hit["timestamp_ms"].alias("timestamp_ms"), hit["x"].alias("x"), hit["y"].alias("y"))
    return line.filter("onset IS NOT NULL").select(
        KEY, "onset", "offset", hit["i"].alias("start_index"), hit["i"].alias("end_index"), point.alias("_a"), point.alias("_b")
    ).filter("start_index IS NOT NULL")


def method_summary(events_by_method: dict[str, DataFrame]) -> DataFrame:
    """Fixation count, mean and total duration, mean amplitude per method, over the cohort; zeros if none."""
    found = None
    for name, df in events_by_method.items():
        row = df.agg(
            F.count(F.lit(1)).alias("fixation_count"),
            *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(n) for n, c in {
                "fixation_duration_mean_ms": F.avg("duration_ms"),
                "fixation_duration_total_ms": F.sum("duration_ms"),
                "fixation_amplitude_mean": F.avg("amplitude"),
            }.items()],
        ).withColumn("method", F.lit(name))
        found = row if found is None else found.unionByName(row)
    return found


def sample_agreement(masks: DataFrame, pairs: list[tuple[str, str, str]], by: list[str] | None = None) -> DataFrame:
    """Overlap, precision, recall and F1 of boolean mask columns, one row per ``(name, a, b)`` pair."""
    sums = []
    for name, a, b in pairs:
        sums += [
            F.count_if(F.col(a) & F.col(b)).alias(f"{name}_tp"),
            F.count_if(~F.col(a) & F.col(b)).alias(f"{name}_fp"),
            F.count_if(F.col(a) & ~F.col(b)).alias(f"{name}_fn"),
        ]
    rows = F.array(*[
        F.struct(F.lit(n).alias("comparison"), *[F.col(f"{n}_{k}").cast("double").alias(k) for k in ("tp", "fp", "fn")])
        for n, _, _ in pairs
    ])
    df = masks.groupBy(*(by or [])).agg(*sums).select(*(by or []), F.inline(rows))

    def share(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.select(
        *(by or []),
        "comparison",
        F.round(share(tp, tp + fp + fn), 4).alias("sample_overlap_ratio"),
        F.round(share(tp, tp + fp), 4).alias("precision"),
        F.round(share(tp, tp + fn), 4).alias("recall"),
        F.round(share(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
    )


def best_method(agreement: DataFrame, summary: DataFrame, native_pair: str, dispersion_method: str, prefix: str = "truth_vs_") -> DataFrame:
    """The method nearest the ground truth, whether two velocity detectors agree, whether dispersion found nothing."""
    against = F.col("comparison").startswith(prefix)
    best = agreement.agg(
        F.max_by("comparison", F.when(against, F.struct("f1", (-F.col("pair_order")).alias("o")))).alias("_best"),
        F.max(F.when(against, F.col("f1"))).alias("best_f1"),
        F.max_by("sample_overlap_ratio", F.when(against, F.struct("f1", (-F.col("pair_order")).alias("o")))).alias("best_overlap"),
        F.max(F.when(F.col("comparison") == native_pair, F.col("sample_overlap_ratio"))).alias("native_overlap"),
    )
    empty = summary.agg(
        (F.max(F.when(F.col("method") == dispersion_method, F.col("fixation_count"))) == 0).alias("dispersion_empty")
    )
    # two one-row aggregates side by side
    one = best.withColumn("_k", F.lit(1)).join(empty.withColumn("_k", F.lit(1)), "_k")
    return one.select(
        F.replace("_best", F.lit(prefix), F.lit("")).alias("best_method"), "best_f1", "best_overlap",
        (F.col("native_overlap") >= 0.95).alias("native_agrees"), "dispersion_empty",
    )
