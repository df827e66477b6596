"""Queries on samples and events."""

from pyspark.sql import functions as F

from saccadia.operators import events as ev
from saccadia.operators import signal as sg
from saccadia.plans import sql
from saccadia.plans.catalog import query
from saccadia.plans.gaze_view import raw_samples, recordings, samples

SAMPLE = "recording_id"


@query("P1_interpolate_missing", SAMPLE + " valid", "x y pupil", "sample_index",
       [sql.GAZE, sql.interpolated_samples("gi")], "(SELECT *, i AS sample_index FROM gi)")
def p1(spark, sf):
    return sg.interpolate_missing(samples(spark, sf))


@query("P2_drop_invalid", SAMPLE, "timestamp_ms x y pupil", "sample_seq", [sql.GAZE], "g WHERE valid")
def p2(spark, sf):
    return sg.drop_invalid(raw_samples(spark, sf))


@query("P3_handle_missing", SAMPLE, "x y pupil", "sample_index",
       [sql.GAZE], "(SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY i) - 1 AS sample_index FROM g WHERE valid)")
def p3(spark, sf):
    return sg.handle_missing(samples(spark, sf), "clean")


@query("P4_smooth_moving_average", SAMPLE, "x y pupil", "sample_index",
       [sql.GAZE, sql.smoothed("s", "g")], "(SELECT *, i AS sample_index FROM s)")
def p4(spark, sf):
    return sg.smooth_moving_average(samples(spark, sf))


SAVGOL = """
sw AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM gi),
sf AS (SELECT recording_id, i, n, least(greatest(i - 2, 0), n - 5) AS ws FROM sw WHERE n >= 5),
sj AS (SELECT sf.recording_id, sf.i, sf.i - sf.ws - 2 AS p, w.i - sf.ws - 2 AS q, w.x, w.y, w.pupil
  FROM sf JOIN sw w ON w.recording_id = sf.recording_id AND w.i BETWEEN sf.ws AND sf.ws + 4),
sv AS (SELECT recording_id, i AS sample_index, CAST(NULL AS VARCHAR) AS error,
    sum(x * wt) AS x, sum(y * wt) AS y, sum(pupil * wt) AS pupil
  FROM (SELECT *, (17.0 - 5.0 * q * q) / 35.0 + p * q / 10.0 + (p * p) * (q * q - 2.0) / 14.0 AS wt FROM sj)
  GROUP BY recording_id, i
  UNION ALL SELECT recording_id, 0, 'recording is shorter than the smoothing window', NULL, NULL, NULL FROM sw WHERE n < 5 AND i = 0)"""


@query("P5_smooth_savitzky_golay", SAMPLE + " error", "x y pupil", "sample_index",
       [sql.GAZE, sql.interpolated_samples("gi"), SAVGOL], "sv")
def p5(spark, sf):
    """Recordings too short for the window leave a row that says so; the others are smoothed in the same plan."""
    return sg.smooth_savitzky_golay(sg.interpolate_missing(samples(spark, sf)))


def _norm_sql(src):
    def unit(c):
        return (f"({c} - min({c}) OVER u) / greatest(max({c}) OVER u - min({c}) OVER u, 1e-6) * 2.0 - 1.0 AS {c}_norm")
    return f"nm AS (SELECT *, i AS sample_index, {unit('x')}, {unit('y')} FROM {src} WINDOW u AS (PARTITION BY recording_id))"


@query("P6_normalize_coordinates", SAMPLE, "x_norm y_norm", "sample_index", [sql.GAZE, _norm_sql("g")], "nm")
def p6(spark, sf):
    return sg.normalize_coordinates(samples(spark, sf))


@query("P7_preprocess", SAMPLE + " valid", "x y pupil x_norm y_norm", "sample_index", [*sql.PRE, _norm_sql("p")], "nm")
def p7(spark, sf):
    return sg.preprocess(samples(spark, sf))


@query("P8_velocity", SAMPLE, "timestamp_ms velocity", "sample_index", [sql.GAZE, sql.VELOCITY],
       "(SELECT *, i AS sample_index FROM v)")
def p8(spark, sf):
    return sg.with_velocity(samples(spark, sf))


@query("P13_valid_samples", SAMPLE, "timestamp_ms x y", "sample_seq", [sql.GAZE], "g WHERE valid")
def p13(spark, sf):
    return raw_samples(spark, sf).filter("valid")


@query("E1_ivt_label", SAMPLE + " kind", "velocity", "sample_index", [sql.GAZE, sql.VELOCITY],
       f"(SELECT *, {sql.kind_of()} AS kind, i AS sample_index FROM v)")
def e1(spark, sf):
    return ev.label_by_velocity(samples(spark, sf))


EVENT_NUM = "start_time_ms end_time_ms duration_ms"
EVENT_CNT = "start_index end_index"


@query("E2_label_runs_to_events", SAMPLE + " kind", EVENT_NUM, EVENT_CNT, sql.BASE_EVENTS, "ev")
def e2(spark, sf):
    return ev.detect_events(samples(spark, sf), "thresholds")


@query("E3_event_attributes", SAMPLE + " kind source_label", "amplitude peak_velocity centroid_x centroid_y",
       "event_index start_index", sql.BASE_EVENTS, "ev")
def e3(spark, sf):
    return ev.detect_events(samples(spark, sf), "thresholds")


@query("E4_normalize_event_label", "event_label kind", "", "n", [sql.GAZE],
       f"(SELECT event_label, {sql.label_kind()} AS kind, count(*) AS n FROM g GROUP BY ALL)")
def e4(spark, sf):
    df = raw_samples(spark, sf).withColumn("kind", ev.event_kind(F.col("event_label")))
    return df.groupBy("event_label", "kind").agg(F.count(F.lit(1)).alias("n"))


LABEL_EVENTS = [sql.GAZE, sql.VELOCITY, sql.runs("lr", "v", sql.label_kind()), sql.events("le", "lr", "TRUE")]


@query("E5_events_from_labels", SAMPLE + " kind source_label", EVENT_NUM + " amplitude peak_velocity",
       EVENT_CNT + " event_index", LABEL_EVENTS, "le")
def e5(spark, sf):
    return ev.events_from_labels(samples(spark, sf))


AUTO_EVENTS = [
    sql.GAZE, sql.VELOCITY,
    "al AS (SELECT *, count(event_label) OVER (PARTITION BY recording_id) > 0 AS from_labels FROM v)",
    sql.runs("ar", "al", f"CASE WHEN from_labels THEN {sql.label_kind()} ELSE {sql.kind_of()} END"),
    sql.events("ae", "ar", "from_labels"),
]


@query("E6_detect_events", SAMPLE + " kind", EVENT_NUM + " amplitude peak_velocity", EVENT_CNT + " event_index",
       AUTO_EVENTS, "ae")
def e6(spark, sf):
    return ev.detect_events(samples(spark, sf))


@query("E7_event_table", SAMPLE + " kind", EVENT_NUM + " amplitude peak_velocity", EVENT_CNT, sql.BASE_EVENTS, "ev")
def e7(spark, sf):
    return ev.event_table(ev.detect_events(samples(spark, sf), "thresholds"))


@query("E8_fixation_table", SAMPLE + " session_id subject_id condition trial", EVENT_NUM + " centroid_x centroid_y",
       "event_index", [*sql.BASE_EVENTS, sql.RECORDINGS],
       "ev JOIN rec USING (recording_id) WHERE kind = 'fixation'")
def e8(spark, sf):
    return ev.fixation_table(ev.detect_events(samples(spark, sf), "thresholds"), recordings(spark, sf))


def mask_sql(dst, src):
    return f"""{dst} AS (SELECT *, i AS sample_index, kind = 'fixation' AND
  max(timestamp_ms) OVER (PARTITION BY recording_id, run) - min(timestamp_ms) OVER (PARTITION BY recording_id, run) >= 60 AS is_fixation
  FROM {src})"""


@query("E9_fixation_mask", SAMPLE + " is_fixation", "", "sample_index",
       [sql.GAZE, sql.VELOCITY, sql.THRESHOLD_RUNS, mask_sql("fm", "r")], "fm")
def e9(spark, sf):
    return ev.fixation_mask(ev.label_by_velocity(samples(spark, sf)))
