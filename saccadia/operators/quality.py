"""Data-quality grades, gaps, reports and cohort distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.ordered import run_starts
from saccadia.schema import INDEX, KEY

# Grade names from the lowest ratio that earns them, and the grade order.
GRADES = [(0.9, "优"), (0.75, "良"), (0.5, "可用")]
LOWEST_GRADE = "建议剔除"
UNKNOWN_GRADE = "未知"
GRADE_ORDER = ["优", "良", "可用", "建议剔除", "未知"]
GRADE_SCORES = {"建议剔除": 1.0, "可用": 2.0, "良": 3.0, "优": 4.0}
CARD_LABELS = ["追踪率", "采样率", "记录时长", "缺失段", "最大缺失段", "质量等级", "眨眼次数", "插值比例"]


def ratio_grade(ratio: Column) -> Column:
    grade = F.lit(LOWEST_GRADE)
    for least, name in reversed(GRADES):
        grade = F.when(ratio >= least, name).otherwise(grade)
    return grade


def quality_grade(samples: DataFrame) -> DataFrame:
    ratio = F.avg(F.col("valid").cast("double"))
    return samples.groupBy(KEY).agg(ratio.alias("tracking_ratio")).withColumn(
        "quality_grade", ratio_grade(F.coalesce("tracking_ratio", F.lit(0.0)))
    )


def missing_segments(samples: DataFrame) -> DataFrame:
    """Runs of invalid samples."""
    runs = run_starts(samples, "valid").filter(~F.col("valid"))
    return runs.groupBy(KEY, F.col("run_start").alias("start_index")).agg(
        F.max(INDEX).alias("end_index"),
        F.min("timestamp_ms").alias("start_time_ms"),
        F.max("timestamp_ms").alias("end_time_ms"),
        F.greatest(F.max("timestamp_ms") - F.min("timestamp_ms"), F.lit(0.0)).alias("duration_ms"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def assess_quality(
    samples: DataFrame,
    events: DataFrame | None = None,
    preprocessed: DataFrame | None = None,
    recordings: DataFrame | None = None,
) -> DataFrame:
    """One report row per recording.

    ``filled_ratio`` is the share of samples that interpolation can fill; ``interpolated_ratio``
    compares the validity flags before and after, which interpolation leaves alone.
    ``recordings`` may give ``sampling_rate_hz``, reported as the expected rate.
    """
    duration = (F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000.0
    total = F.count(F.lit(1))
    report = samples.groupBy(KEY).agg(
        F.avg(F.col("valid").cast("double")).alias("tracking_ratio"),
        total.alias("total_samples"),
        F.count_if("valid").alias("valid_samples"),
        duration.alias("recording_duration_s"),
        F.when((total >= 2) & (duration > 0), (total - 1) / F.nullif(duration, F.lit(0.0))).otherwise(0.0).alias("sampling_rate_actual"),
    )
    gaps = missing_segments(samples).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("missing_segments"), F.max("duration_ms").alias("max_gap_duration_ms")
    )
    report = report.join(gaps, KEY, "left")
    if events is not None:
        blinks = events.groupBy(KEY).agg(F.count_if(F.col("kind") == "blink").alias("blink_count"))
        report = report.join(blinks, KEY, "left")
    else:
        report = report.withColumn("blink_count", F.lit(0))
    if preprocessed is not None:
        after = preprocessed.groupBy(KEY).agg(F.avg(F.col("valid").cast("double")).alias("_after"))
        report = report.join(after, KEY, "left").withColumn(
            "interpolated_ratio", F.coalesce("_after", F.lit(0.0)) - F.col("tracking_ratio")
        ).drop("_after")
    else:
        report = report.withColumn("interpolated_ratio", F.lit(0.0))
    if recordings is not None and "sampling_rate_hz" in recordings.columns:
        rates = recordings.select(KEY, F.col("sampling_rate_hz").cast("double").alias("expected_sampling_rate_hz"))
        report = report.join(rates, KEY, "left")
    else:
        report = report.withColumn("expected_sampling_rate_hz", F.lit(None).cast("double"))
    return report.fillna(0, ["missing_segments", "max_gap_duration_ms", "blink_count"]).withColumns(
        {
            "quality_grade": ratio_grade(F.col("tracking_ratio")),
            "filled_ratio": F.when(F.col("valid_samples") > 0, 1.0 - F.col("tracking_ratio")).otherwise(0.0),
        }
    )


def fixed(c: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(c, digits) + F.lit(0.0))


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(fixed(c * 100.0, digits), F.lit("%"))


def quality_cards(report: DataFrame) -> DataFrame:
    """Eight cards per recording: label, formatted value, status."""

    def rising(c, good, warn):
        return F.when(c >= good, "good").when(c >= warn, "warn").otherwise("bad")

    def falling(c, good, warn):
        return F.when(c < good, "good").when(c <= warn, "warn").otherwise("bad")

    col = F.col
    expected = col("expected_sampling_rate_hz")
    off = F.abs(col("sampling_rate_actual") - expected) / F.nullif(expected, F.lit(0.0))
    gap = col("max_gap_duration_ms")
    cards = [
        (percent(col("tracking_ratio")), rising(col("tracking_ratio"), 0.90, 0.75)),
        (
            F.concat(fixed(col("sampling_rate_actual"), 1), F.lit(" Hz")),
            F.when(expected.isNull() | (expected <= 0), "good").otherwise(falling(off, 0.05, 0.10)),
        ),
        (F.concat(fixed(col("recording_duration_s"), 1), F.lit(" s")), rising(col("recording_duration_s"), 10.0, 5.0)),
        (
            F.concat(col("missing_segments").cast("string"), F.lit(" 段")),
            F.when(col("missing_segments") <= 2, "good").when(col("missing_segments") <= 5, "warn").otherwise("bad"),
        ),
        (
            F.when(gap >= 1000, F.concat(fixed(gap / 1000.0, 1), F.lit(" s"))).otherwise(F.concat(fixed(gap, 0), F.lit(" ms"))),
            falling(gap, 500.0, 2000.0),
        ),
        (
            col("quality_grade"),
            F.when(col("quality_grade").isin("优", "良"), "good").when(col("quality_grade") == "可用", "warn").otherwise("bad"),
        ),
        (F.concat(col("blink_count").cast("string"), F.lit(" 次")), F.lit("info")),
        (percent(col("interpolated_ratio")), falling(F.abs(col("interpolated_ratio")), 0.05, 0.15)),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(k + 1).alias("card_order"), F.lit(label).alias("card"), v.alias("value"), s.alias("status"))
            for k, (label, (v, s)) in enumerate(zip(CARD_LABELS, cards))
        ]
    )
    return report.select(KEY, F.inline(rows))


def gap_share(samples: DataFrame) -> DataFrame:
    """Each gap with its share of the recording's time, longest first (``gap_rank``)."""
    total = samples.groupBy(KEY).agg((F.max("timestamp_ms") - F.min("timestamp_ms")).alias("_total"))
    # gaps are far fewer than samples but still many in a long recording: rank by counting, not by a window
    from saccadia.functions.ranks import value_counts

    gaps = missing_segments(samples).join(total, KEY)
    gaps = gaps.withColumn(
        "percentage_of_total", F.when(F.col("_total") > 0, F.col("duration_ms") / F.nullif("_total", F.lit(0.0))).otherwise(0.0)
    ).drop("_total")
    ranked = value_counts(gaps.select(KEY, "duration_ms"), [KEY], "duration_ms").select(
        KEY, "duration_ms", (F.col("total") - F.col("below") - F.col("n") + 1).alias("gap_rank")
    )
    return gaps.join(ranked, [KEY, "duration_ms"])


def quality_distribution(batch: DataFrame) -> DataFrame:
    """Recordings per grade; grades without any are absent."""
    grade = F.coalesce("quality_grade", F.lit(UNKNOWN_GRADE))
    order = F.array_position(F.array(*[F.lit(g) for g in GRADE_ORDER]), F.col("quality_grade"))
    counts = batch.groupBy(grade.alias("quality_grade")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("grade_order", order).orderBy("grade_order")


def mean_grade(batch: DataFrame) -> DataFrame:
    """The grade nearest the mean grade score (ties to even); unknown where nothing is graded."""
    score = F.coalesce(*[F.when(F.col("quality_grade") == g, F.lit(s)) for g, s in GRADE_SCORES.items()])
    nearest = F.greatest(F.least(F.bround(F.avg(score)), F.lit(4.0)), F.lit(1.0))
    names = {s: g for g, s in GRADE_SCORES.items()}
    label = F.coalesce(*[F.when(F.col("_s") == s, F.lit(g)) for s, g in names.items()], F.lit(UNKNOWN_GRADE))
    found = batch.agg(nearest.alias("_s"), F.count(F.lit(1)).alias("_n"))
    return found.select(F.when(F.col("_n") == 0, "无").otherwise(label).alias("mean_grade"))
