"""Queries on method comparison and multimodal joins."""

from pyspark.sql import functions as F

from saccadia.functions.ordered import lay_out
from saccadia.operators import events as ev
from saccadia.operators import features as ft
from saccadia.operators import methods as me
from saccadia.operators import multimodal as mm
from saccadia.operators import signal as sg
from saccadia.plans import sql
from saccadia.plans import sql_features as sf_
from saccadia.plans.catalog import query
from saccadia.plans.gaze_view import heart_rate, raw_samples, recordings, samples
from saccadia.plans.queries_features import HEART, HEART_FEATURES, HEART_NUM, R, labelled

TRUTH = [sql.GAZE, "tr AS (SELECT *, coalesce(lower(trim(event_label)) LIKE '%fix%', FALSE) AS truth FROM g)", sql.runs("tl", "tr", "truth"),
         """tv AS (SELECT recording_id, min(i) AS start_index, max(i) AS end_index, min(timestamp_ms) AS start_time_ms, max(timestamp_ms) AS end_time_ms,
    max(timestamp_ms) - min(timestamp_ms) AS duration_ms,
    sqrt(pow(arg_max(x, i) - arg_min(x, i), 2) + pow(arg_max(y, i) - arg_min(y, i), 2)) AS amplitude
  FROM tl WHERE truth GROUP BY recording_id, run)"""]


def truth(spark, sf):
    return me.flag_runs(me.ground_truth_labels(samples(spark, sf)), "is_truth")


query("N9_label_ground_truth", R, "start_time_ms end_time_ms duration_ms amplitude", "start_index end_index", TRUTH, "tv")(truth)


# the greedy scan as a recursion over samples: from each one the next start of a tight window, and the end it grows to
DISPERSION = ["RECURSIVE " + sql.GAZE, """
us AS (SELECT *, sum(CASE WHEN i - pi = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY i) AS island
  FROM (SELECT *, lag(i) OVER (PARTITION BY recording_id ORDER BY i) AS pi FROM g WHERE x IS NOT NULL AND y IS NOT NULL)),
sp AS (SELECT s.recording_id, s.island, s.i AS s, e.i AS e, e.timestamp_ms - s.timestamp_ms AS span,
    (max(e.x) OVER grown - min(e.x) OVER grown) + (max(e.y) OVER grown - min(e.y) OVER grown) AS spread
  FROM us s JOIN us e ON e.recording_id = s.recording_id AND e.island = s.island AND e.i >= s.i
  WINDOW grown AS (PARTITION BY s.recording_id, s.i ORDER BY e.i ROWS UNBOUNDED PRECEDING)),
st AS (SELECT recording_id, island, s, max(e) FILTER (spread <= 60) AS e FROM sp
  GROUP BY 1, 2, 3 HAVING min(spread) FILTER (span >= 100) <= 60),
nx AS (SELECT us.recording_id, us.island, us.i, min(st.s) AS s FROM us JOIN st ON st.recording_id = us.recording_id AND st.island = us.island AND st.s >= us.i
  GROUP BY 1, 2, 3),
ch AS (SELECT recording_id, island, min(s) AS s FROM st GROUP BY 1, 2
  UNION ALL SELECT nx.recording_id, nx.island, nx.s FROM ch JOIN st ON st.recording_id = ch.recording_id AND st.s = ch.s
    JOIN nx ON nx.recording_id = st.recording_id AND nx.island = st.island AND nx.i = st.e + 1),
di AS (SELECT ch.recording_id, a.i AS start_index, b.i AS end_index, a.timestamp_ms AS start_time_ms, b.timestamp_ms AS end_time_ms,
    b.timestamp_ms - a.timestamp_ms AS duration_ms, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS amplitude
  FROM ch JOIN st ON st.recording_id = ch.recording_id AND st.s = ch.s JOIN us a ON a.recording_id = ch.recording_id AND a.i = st.s
  JOIN us b ON b.recording_id = ch.recording_id AND b.i = st.e)"""]


@query("E10_idt_fixations", R, "start_time_ms end_time_ms duration_ms amplitude", "start_index end_index", DISPERSION, "di")
def e10(spark, sf):
    return me.dispersion_fixations(samples(spark, sf), 60.0, 100.0)


ALT = [sql.GAZE, sql.VELOCITY, sql.THRESHOLD_RUNS, sql.EVENTS, sql.runs("r5", "v", sql.kind_of(400.0)), sql.events("e5", "r5"),
       "av AS (SELECT recording_id, 'ivt_850' AS method, start_index, end_index, duration_ms FROM ev WHERE kind = 'fixation' UNION ALL "
       "SELECT recording_id, 'ivt_400', start_index, end_index, duration_ms FROM e5 WHERE kind = 'fixation')"]


@query("E11_ivt_alt_threshold", R + " method", "duration_ms", "start_index end_index", ALT, "av")
def e11(spark, sf):
    moving = sg.with_velocity(samples(spark, sf))
    parts = []
    for threshold in (850.0, 400.0):
        found = ev.runs_to_events(moving.withColumn("kind", ev.threshold_kind(threshold))).filter("kind = 'fixation'")
        parts.append(found.select(R, F.lit(f"ivt_{threshold:.0f}").alias("method"), "start_index", "end_index", "duration_ms"))
    return parts[0].union(parts[1])


INTERVALS = """
iv AS (SELECT DISTINCT CAST(o_custkey % (SELECT count(DISTINCT user_id) FROM events) AS VARCHAR) AS recording_id, CAST(o_orderkey % 7000 AS DOUBLE) + 0.5 AS onset,
    CAST(o_orderkey % 7000 AS DOUBLE) + 0.5 + o_custkey % 400 AS offset FROM orders),
gn AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM g),
pt AS (SELECT iv.recording_id, onset, "offset", count(*) FILTER (timestamp_ms < onset) AS a, count(*) FILTER (timestamp_ms <= "offset") - 1 AS b, any_value(n) AS n
  FROM iv JOIN gn USING (recording_id) GROUP BY 1, 2, 3),
px AS (SELECT *, greatest(0, least(a, n - 1)) AS start_index, greatest(greatest(0, least(a, n - 1)), least(b, n - 1)) AS end_index FROM pt),
ip AS (SELECT px.recording_id, onset, "offset" AS off_ms, start_index, end_index, s.timestamp_ms AS start_time_ms, e.timestamp_ms AS end_time_ms,
    sqrt(pow(e.x - s.x, 2) + pow(e.y - s.y, 2)) AS amplitude
  FROM px JOIN g s ON s.recording_id = px.recording_id AND s.i = start_index JOIN g e ON e.recording_id = px.recording_id AND e.i = end_index)"""


@query("E12_onset_offset_to_samples", R, "onset off_ms start_time_ms end_time_ms amplitude", "start_index end_index", [sql.GAZE, INTERVALS], "ip")
def e12(spark, sf):
    """Intervals from orders, placed into the recordings by customer."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    keys = recordings(spark, sf).count()
    onset = (F.col("o_orderkey") % 7000).cast("double") + 0.5
    intervals = orders.select(
        (F.col("o_custkey") % keys).cast("string").alias(R), onset.alias("onset"), (onset + F.col("o_custkey") % 400).alias("offset")
    ).distinct()
    return me.intervals_to_events(samples(spark, sf), intervals).withColumnRenamed("offset", "off_ms")


def method_events(spark, sf):
    s = samples(spark, sf)
    moving = sg.with_velocity(s)

    def ivt(threshold):
        return ev.runs_to_events(moving.withColumn("kind", ev.threshold_kind(threshold))).filter("kind = 'fixation'")

    return {
        "truth": me.flag_runs(me.ground_truth_labels(s), "is_truth"),
        "ivt_850": ivt(850.0),
        "ivt_400": ivt(400.0),
    }


def _summary_arm(method, src, where="TRUE"):
    return (f"SELECT '{method}' AS method, count(*) AS fixation_count, round(coalesce(avg(duration_ms), 0), 4) AS fixation_duration_mean_ms, "
            f"round(coalesce(sum(duration_ms), 0), 4) AS fixation_duration_total_ms, round(coalesce(avg(amplitude), 0), 4) AS fixation_amplitude_mean FROM {src} WHERE {where}")


SUMMARY = [*TRUTH, *ALT[1:-1], "su AS (" + " UNION ALL ".join([
    _summary_arm("truth", "tv"), _summary_arm("ivt_850", "ev", "kind = 'fixation'"), _summary_arm("ivt_400", "e5", "kind = 'fixation'")]) + ")"]


@query("E13_method_summary", "method", "fixation_duration_mean_ms fixation_duration_total_ms fixation_amplitude_mean", "fixation_count", SUMMARY, "su")
def e13(spark, sf):
    return me.method_summary(method_events(spark, sf))


PAIRS = [("truth_vs_ivt_850", "is_truth", "m850"), ("truth_vs_ivt_400", "is_truth", "m400"), ("ivt_850_vs_ivt_400", "m850", "m400")]


def masks(spark, sf):
    df = me.ground_truth_labels(samples(spark, sf))
    df = ev.fixation_mask(ev.label_by_velocity(df, 850.0), name="m850").drop("velocity", "step_px", "kind")
    return ev.fixation_mask(ev.label_by_velocity(df, 400.0), name="m400")


def agreement(spark, sf):
    return me.sample_agreement(masks(spark, sf), PAIRS)


def _mask(dst, src):
    return f"""{dst} AS (SELECT recording_id, i, kind = 'fixation' AND max(timestamp_ms) OVER (PARTITION BY recording_id, run)
  - min(timestamp_ms) OVER (PARTITION BY recording_id, run) >= 60 AS m FROM {src})"""


def _agree(k, name, a, b):
    return f"""SELECT '{name}' AS comparison, {k} AS pair_order, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 4) AS sample_overlap_ratio, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1
  FROM (SELECT count(*) FILTER ({a} AND {b}) AS tp, count(*) FILTER (NOT {a} AND {b}) AS fp, count(*) FILTER ({a} AND NOT {b}) AS fn FROM mk)"""


AGREEMENT = [*TRUTH[:2], sql.VELOCITY, sql.THRESHOLD_RUNS, sql.runs("r5", "v", sql.kind_of(400.0)), _mask("k8", "r"), _mask("k4", "r5"),
             "mk AS (SELECT tr.truth, k8.m AS m850, k4.m AS m400 FROM tr JOIN k8 USING (recording_id, i) JOIN k4 USING (recording_id, i))",
             "ag AS (" + " UNION ALL ".join(_agree(k, n, a.replace("is_", ""), b) for k, (n, a, b) in enumerate(PAIRS)) + ")"]

query("E14_sample_agreement", "comparison", "sample_overlap_ratio precision recall f1", "", AGREEMENT, "ag")(agreement)


@query("E15_best_method", "best_method native_agrees dispersion_empty", "best_f1 best_overlap", "", [*DISPERSION, *AGREEMENT[1:],
       """bm AS (SELECT replace(arg_max(comparison, (f1, -pair_order)) FILTER (comparison LIKE 'truth%'), 'truth_vs_', '') AS best_method,
  max(f1) FILTER (comparison LIKE 'truth%') AS best_f1, arg_max(sample_overlap_ratio, (f1, -pair_order)) FILTER (comparison LIKE 'truth%') AS best_overlap,
  max(sample_overlap_ratio) FILTER (comparison = 'ivt_850_vs_ivt_400') >= 0.95 AS native_agrees, (SELECT count(*) = 0 FROM di) AS dispersion_empty FROM ag)"""], "bm")
def e15(spark, sf):
    order = F.coalesce(*[F.when(F.col("comparison") == n, F.lit(k)) for k, (n, _, _) in enumerate(PAIRS)])
    found = {"idt": me.dispersion_fixations(samples(spark, sf), 60.0, 100.0)}
    return me.best_method(agreement(spark, sf).withColumn("pair_order", order), me.method_summary(found), "ivt_850_vs_ivt_400", "idt")


# multimodal -------------------------------------------------------------------------

@query("M1_prefix_modality", R, "timestamp_ms gaze_x gaze_y gaze_pupil", "", [sql.GAZE],
       "(SELECT recording_id, timestamp_ms, x AS gaze_x, y AS gaze_y, pupil AS gaze_pupil FROM g)")
def m1(spark, sf):
    return mm.prefixed(raw_samples(spark, sf), "gaze")


ASOF = """
bk AS (SELECT g.recording_id, g.sample_seq, g.timestamp_ms, g.x AS gaze_x, g.i, hr.timestamp_ms AS bt, hr.heart_rate_bpm AS bv
  FROM g ASOF LEFT JOIN hr ON g.recording_id = hr.recording_id AND g.timestamp_ms >= hr.timestamp_ms),
fw AS (SELECT g.recording_id, g.sample_seq, hr.timestamp_ms AS ft, hr.heart_rate_bpm AS fv
  FROM g ASOF LEFT JOIN hr ON g.recording_id = hr.recording_id AND g.timestamp_ms <= hr.timestamp_ms),
nr AS (SELECT bk.recording_id, bk.sample_seq, timestamp_ms, gaze_x, i,
    CASE WHEN timestamp_ms - bt <= 50 AND NOT coalesce(ft - timestamp_ms < timestamp_ms - bt, FALSE) THEN bv
      WHEN ft - timestamp_ms <= 50 THEN fv END AS hr_heart_rate_bpm
  FROM bk JOIN fw USING (recording_id, sample_seq))"""


def modalities(spark, sf):
    return {"gaze": raw_samples(spark, sf).select(R, "sample_seq", "timestamp_ms", "x"), "hr": heart_rate(spark, sf)}


@query("M2_asof_nearest", R, "timestamp_ms gaze_x hr_heart_rate_bpm", "sample_seq", [sql.GAZE, HEART, ASOF], "nr")
def m2(spark, sf):
    return mm.align(modalities(spark, sf))


FUSED = f"""
fu AS (SELECT recording_id, sample_seq, coalesce(last_value(gaze_x IGNORE NULLS) OVER b, first_value(gaze_x IGNORE NULLS) OVER a) AS gaze_x,
    coalesce(last_value(hr_heart_rate_bpm IGNORE NULLS) OVER b, first_value(hr_heart_rate_bpm IGNORE NULLS) OVER a) AS hr_heart_rate_bpm
  FROM nr WINDOW b AS ({sql.ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({sql.ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("M3_early_fusion", R, "gaze_x hr_heart_rate_bpm", "sample_seq", [sql.GAZE, HEART, ASOF, FUSED], "fu")
def m3(spark, sf):
    return mm.early_fusion(modalities(spark, sf))


CONCAT = """
fc AS (SELECT recording_id, duration_ms AS gaze_duration_ms, path_length AS gaze_path_length, heart_rate_mean AS hr_heart_rate_mean,
    heart_rate_rmssd AS hr_heart_rate_rmssd FROM b FULL JOIN hf USING (recording_id))"""


def gaze_and_heart(spark, sf):
    return mm.feature_concat({
        "gaze": ft.base_features(samples(spark, sf)),
        "hr": ft.heart_rate_features(lay_out(heart_rate(spark, sf))),
    })


query("M4_feature_concat", R, "gaze_duration_ms gaze_path_length hr_heart_rate_mean hr_heart_rate_rmssd", "",
      [sql.GAZE, sql.VELOCITY, sf_.base("b", "v"), HEART, HEART_FEATURES, CONCAT], "fc")(gaze_and_heart)


LATE = """
pr AS (SELECT CAST(user_id AS VARCHAR) AS recording_id, 'gaze' AS modality, event_type AS class, avg(value) / 499.0 AS p FROM events GROUP BY ALL
  UNION ALL SELECT CAST(user_id AS VARCHAR), 'hr', event_type, count(*) / 100.0 FROM events GROUP BY ALL),
lf AS (SELECT recording_id, class, sum(CASE modality WHEN 'gaze' THEN 2.0 ELSE 1.0 END * p) / sum(CASE modality WHEN 'gaze' THEN 2.0 ELSE 1.0 END) AS p FROM pr GROUP BY ALL)"""


@query("M5_late_fusion", R + " class", "p", "", [LATE], "lf")
def m5(spark, sf):
    """Two score sources per recording and class; the gaze one weighs double."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias(R), F.col("event_type").alias("class"), "value")
    by = events.groupBy(R, "class").agg((F.avg("value") / 499.0).alias("gaze"), (F.count(F.lit(1)) / 100.0).alias("hr"))
    long = by.unpivot([R, "class"], ["gaze", "hr"], "modality", "p")
    weights = spark.createDataFrame([("gaze", 2.0)], "modality string, weight double")
    return mm.late_fusion(long, weights)
