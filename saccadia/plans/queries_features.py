"""Queries on pupil traces and feature vectors."""

from pyspark.sql import functions as F

from saccadia.functions.ordered import lay_out
from saccadia.operators import events as ev
from saccadia.operators import features as ft
from saccadia.operators import pupil as pu
from saccadia.operators import signal as sg
from saccadia.plans import sql
from saccadia.plans import sql_features as sf_
from saccadia.plans.catalog import query
from saccadia.plans.gaze_view import raw_samples, recordings, samples

R = "recording_id"


def labelled(spark, sf):
    return ev.label_samples(samples(spark, sf), "thresholds")


def threshold_events(spark, sf):
    return ev.runs_to_events(labelled(spark, sf))


LOAD = [sql.GAZE, sf_.pupil_load("pl", "g")]


@query("P9_pupil_clean", R + " blink_mask", "cleaned_pupil", "sample_index", LOAD, "(SELECT *, i AS sample_index FROM pl_s)")
def p9(spark, sf):
    return pu.clean_pupil(pu.in_blink_event(labelled(spark, sf), 75.0))


MEDIAN_BASELINE = """
bm AS (SELECT recording_id, coalesce(median(cleaned_pupil) FILTER (NOT blink_mask), 0) AS median_baseline FROM pl_s GROUP BY 1),
bb AS (SELECT * FROM pl_b JOIN bm USING (recording_id))"""


@query("P10_pupil_baseline", R, "baseline_value median_baseline", "", [*LOAD, MEDIAN_BASELINE], "bb")
def p10(spark, sf):
    cleaned = pu.clean_pupil(samples(spark, sf))
    median = pu.pupil_baseline(cleaned, "recording_median").withColumnRenamed("baseline_value", "median_baseline")
    return pu.pupil_baseline(cleaned).join(median, R)


ZSCORE = """
zs AS (SELECT *, i AS sample_index, CASE WHEN stddev_pop(bc_pupil) OVER u > 1e-6
    THEN (bc_pupil - avg(bc_pupil) OVER u) / stddev_pop(bc_pupil) OVER u ELSE bc_pupil END AS z
  FROM pl_t WINDOW u AS (PARTITION BY recording_id))"""


@query("P11_pupil_baseline_correct", R, "bc_pupil", "sample_index", [*LOAD, ZSCORE],
       "(SELECT recording_id, sample_index, z AS bc_pupil FROM zs)")
def p11(spark, sf):
    return pu.pupil_trace(labelled(spark, sf), zscore=True)


META = """
pm AS (SELECT recording_id, count(pupil) > 0 AS available, avg(CAST(blink_mask AS DOUBLE)) AS blink_sample_ratio,
    avg(CAST(blink_mask AS DOUBLE)) AS interpolation_ratio, any_value(baseline_value) AS baseline_value FROM pl_t GROUP BY 1),
bc AS (SELECT recording_id, count(*) FILTER (kind = 'blink') AS blink_event_count FROM ev GROUP BY 1),
pq AS (SELECT pm.*, coalesce(blink_event_count, 0) AS blink_event_count FROM pm LEFT JOIN bc USING (recording_id))"""


@query("P12_pupil_meta", R + " available", "blink_sample_ratio interpolation_ratio baseline_value", "blink_event_count",
       [*sql.BASE_EVENTS, sf_.pupil_load("pl", "g"), META], "pq")
def p12(spark, sf):
    labels = labelled(spark, sf)
    return pu.pupil_meta(pu.pupil_trace(labels), ev.runs_to_events(labels))


P14 = f"""
pf AS (SELECT recording_id, i AS sample_index,
    coalesce(last_value(x IGNORE NULLS) OVER b, first_value(x IGNORE NULLS) OVER a) AS x,
    coalesce(last_value(y IGNORE NULLS) OVER b, first_value(y IGNORE NULLS) OVER a) AS y,
    coalesce(last_value(pupil IGNORE NULLS) OVER b, first_value(pupil IGNORE NULLS) OVER a) AS pupil,
    coalesce(last_value(marker IGNORE NULLS) OVER b, first_value(marker IGNORE NULLS) OVER a) AS marker
  FROM g WINDOW b AS ({sql.ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS ({sql.ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("P14_early_fusion_fill", R + " marker", "x y pupil", "sample_index", [sql.GAZE, P14], "pf")
def p14(spark, sf):
    return sg.fill_gaps_both_ways(samples(spark, sf), ["x", "y", "pupil", "marker"])


@query("F1_base_features", R, sf_.BASE_NUM, "sample_count", [sql.GAZE, sql.VELOCITY, sf_.base("b", "v")], "b")
def f1(spark, sf):
    return ft.base_features(samples(spark, sf))


EVENT_FEATURES = [*sql.BASE_EVENTS, sf_.event_features("ef", "g", "ev")]


def event_features(spark, sf):
    labels = labelled(spark, sf)
    return ft.event_features(labels, ev.runs_to_events(labels))


query("F2_fixation_features", R, "fixation_duration_mean fixation_duration_total fixation_density", "fixation_count",
      EVENT_FEATURES, "ef")(event_features)
query("F3_saccade_features", R, "saccade_amplitude_mean saccade_peak_velocity_mean", "saccade_count", EVENT_FEATURES, "ef")(
    event_features)
query("F4_saccade_latency", R, "saccade_latency_mean", "", EVENT_FEATURES, "ef")(event_features)
query("F5_blink_features", R, "blink_rate_hz blink_duration_mean", "blink_count", EVENT_FEATURES, "ef")(event_features)


@query("F6_moments", R, sf_.MOMENT_NUM, "", [sql.GAZE, sf_.moments("m", "g")], "m")
def f6(spark, sf):
    return ft.moment_features(samples(spark, sf))


@query("F7_rolling_stats", R, sf_.ROLLING_NUM, "", [sql.GAZE, sf_.rolling("ro", "g")], "ro")
def f7(spark, sf):
    return ft.rolling_features(samples(spark, sf))


@query("F8_approx_entropy", R, sf_.ENTROPY_NUM, "", [sql.GAZE, sf_.entropy("en", "g")], "en")
def f8(spark, sf):
    return ft.entropy_features(samples(spark, sf))


@query("F9_pupil_features", R, sf_.PUPIL_NUM, "", [sql.GAZE, sf_.pupil("pu", "g")], "pu")
def f9(spark, sf):
    return ft.pupil_features(samples(spark, sf))


@query("F10_pupil_load", R, sf_.LOAD_NUM, "", LOAD, "pl")
def f10(spark, sf):
    return pu.pupil_load_features(pu.pupil_trace(labelled(spark, sf)))


@query("F11_extract_features", R, sf_.ALL_NUM, sf_.COUNTS,
       [*sql.BASE_EVENTS, *sf_.all_features("fa", "v", "ev")], "fa")
def f11(spark, sf):
    s = samples(spark, sf)
    return ft.extract_features(s, ev.label_samples(s, "thresholds"))


def pipeline_features(spark, sf, complexity=True):
    """Preprocess, detect events (labels where there are any), extract features."""
    clean = sg.preprocess(samples(spark, sf), normalize=False)
    return ft.extract_features(clean, ev.label_samples(clean), include_complexity=complexity)


PIPELINE = [*sql.PRE_EVENTS, *sf_.all_features("fp", "pv", "pe")]


@query("F12_build_feature_dataset", R + " session_id subject_id condition trial", sf_.ALL_NUM, sf_.COUNTS,
       [*PIPELINE, sql.RECORDINGS], "fp JOIN rec USING (recording_id)")
def f12(spark, sf):
    return ft.feature_dataset(pipeline_features(spark, sf), recordings(spark, sf))


def heart_rate(spark, sf):
    """A second signal from the view events: a rate around 70 bpm, 3.7 ms after the event."""
    from saccadia.plans.gaze_view import heart_rate as view

    return view(spark, sf)


HEART = """
hr AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, event_id AS sample_seq,
    (epoch_us(ts) - 1704067200000000) / 3.6e8 + 3.7 AS timestamp_ms, 60.0 + value / 9.7 AS heart_rate_bpm
  FROM events WHERE event_type = 'view')"""
HEART_FEATURES = """
hf AS (SELECT recording_id, avg(heart_rate_bpm) AS heart_rate_mean, stddev_pop(heart_rate_bpm) AS heart_rate_std,
    min(heart_rate_bpm) AS heart_rate_min, max(heart_rate_bpm) AS heart_rate_max, coalesce(sqrt(avg(d * d)), 0) AS heart_rate_rmssd
  FROM (SELECT *, heart_rate_bpm - lag(heart_rate_bpm) OVER (PARTITION BY recording_id ORDER BY timestamp_ms, sample_seq) AS d FROM hr)
  GROUP BY 1)"""
HEART_NUM = "heart_rate_mean heart_rate_std heart_rate_min heart_rate_max heart_rate_rmssd"


@query("F13_heart_rate_features", R, HEART_NUM, "", [HEART, HEART_FEATURES], "hf")
def f13(spark, sf):
    return ft.heart_rate_features(lay_out(heart_rate(spark, sf)))


def top_sql(src, columns):
    arms = " UNION ALL ".join(f"SELECT recording_id, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {src}" for c in columns)
    return f"""top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(value, 6) DESC, metric) AS rank
  FROM ({arms})) WHERE rank <= 18)"""


@query("F14_top_features", R + " metric", "value", "rank",
       [*PIPELINE, top_sql("fp", sf_.ALL_NUM.split() + sf_.COUNTS.split())], "top")
def f14(spark, sf):
    rounded = pipeline_features(spark, sf)
    rounded = rounded.select(R, *[F.round(c, 6).alias(c) for c in rounded.columns if c != R])
    return ft.top_features(rounded)


SUMMARY = """
qs AS (SELECT recording_id, count(*) AS sample_count, max(g.timestamp_ms) - min(g.timestamp_ms) AS duration_ms,
    avg(CAST(g.valid AS DOUBLE)) AS valid_ratio, 1.0 - avg(CAST(g.valid AS DOUBLE)) AS invalid_ratio FROM g GROUP BY 1),
qp AS (SELECT recording_id, max(velocity) AS velocity_peak FROM pv GROUP BY 1),
qe AS (SELECT recording_id, count(*) FILTER (kind = 'fixation') AS fixation_count, count(*) FILTER (kind = 'saccade') AS saccade_count,
    count(*) FILTER (kind = 'blink') AS blink_count FROM pe GROUP BY 1),
qa AS (SELECT qs.*, velocity_peak, coalesce(fixation_count, 0) AS fixation_count, coalesce(saccade_count, 0) AS saccade_count,
    coalesce(blink_count, 0) AS blink_count FROM qs JOIN qp USING (recording_id) LEFT JOIN qe USING (recording_id))"""


@query("F15_quality_summary", R, "duration_ms valid_ratio invalid_ratio velocity_peak", sf_.COUNTS, [*sql.PRE_EVENTS, SUMMARY], "qa")
def f15(spark, sf):
    raw = samples(spark, sf)
    labels = ev.label_samples(sg.preprocess(raw, normalize=False))
    return ft.quality_summary(raw, labels, ev.runs_to_events(labels))


@query("F16_register_feature", R, "x_range", "right_half", [sql.GAZE],
       "(SELECT recording_id, max(x) - min(x) AS x_range, count(*) FILTER (x > 100) AS right_half FROM g GROUP BY 1)")
def f16(spark, sf):
    """Two plug-in features: a column aggregate and a function of one recording's frame."""
    ft.register_feature("x_range", F.max("x") - F.min("x"))
    ft.register_feature("right_half", lambda pdf: {"right_half": float((pdf["x"] > 100).sum())}, "right_half double")
    try:
        return ft.extract_features(samples(spark, sf))
    finally:
        ft.unregister_feature("x_range")
        ft.unregister_feature("right_half")
