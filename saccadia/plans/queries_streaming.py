"""Queries on streams over the driver's tables: everything available is read once, in order of arrival."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from saccadia.operators import modeling as ml
from saccadia.plans import sql
from saccadia.plans import sql_features as sf_
from saccadia.plans.catalog import query
from saccadia.plans.gaze_view import gaze_columns, raw_samples, recordings
from saccadia.plans.queries_features import R
from saccadia.sources.readers import materialize, scratch_dir
from saccadia.streaming import stateful, windows


#: Files that make up one batch of arrivals.
FILES_PER_BATCH = 4


def stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return gaze_columns(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


@query("S1_sliding_window_predictor", R + " prediction class", "emit_ms duration_ms velocity_mean score", "sample_count")
def s1(spark, sf):
    """Buffers of 1.5 s every 250 ms, all features of each, and the score of each class by a model trained on whole recordings."""
    from saccadia.operators.events import label_samples
    from saccadia.operators.features import extract_features
    from saccadia.plans.gaze_view import samples

    whole = samples(spark, sf)
    features = extract_features(whole, label_samples(whole, "thresholds"))
    data = materialize(features.join(recordings(spark, sf).select(R, "trial"), R), "training")
    fitted = ml.train_model(data, "trial", model_name="logistic_regression")

    def score(batch):
        scored = ml.class_scores(fitted, stateful.buffer_features(batch))
        return scored.select(R, "emit_ms", "duration_ms", "sample_count", "velocity_mean", "prediction", "class", "score")

    return windows.run_to_table(stateful.sliding_buffers(windows.with_event_time(stream(spark, sf))), "predictor", transform=score)


# from each sample that could be emitted at, the next one 250 ms on; the chain of them from the first
BUFFERS = ["RECURSIVE " + sql.GAZE, """
lo AS (SELECT *, min(i) OVER (PARTITION BY recording_id ORDER BY timestamp_ms RANGE BETWEEN 1500 PRECEDING AND CURRENT ROW) AS oldest FROM g),
rdy AS (SELECT recording_id, timestamp_ms AS t, min(i) AS i FROM lo WHERE i - oldest >= 4 GROUP BY 1, 2),
nxt AS (SELECT recording_id, i, min(t) OVER later AS t2, min(i) OVER later AS i2 FROM rdy
  WINDOW later AS (PARTITION BY recording_id ORDER BY t RANGE BETWEEN 250 FOLLOWING AND UNBOUNDED FOLLOWING)),
em AS (SELECT recording_id, min(t) AS t, min(i) AS i FROM rdy GROUP BY 1
  UNION ALL SELECT nxt.recording_id, nxt.t2, nxt.i2 FROM em JOIN nxt ON nxt.recording_id = em.recording_id AND nxt.i = em.i WHERE nxt.i2 IS NOT NULL),
bg AS (SELECT em.recording_id || '|' || em.i AS recording_id, em.recording_id AS stream, em.t AS emit_ms, g.sample_seq, g.timestamp_ms, g.x, g.y, g.pupil,
    g.valid, CAST(NULL AS VARCHAR) AS event_label, g.i - lo.oldest AS i
  FROM em JOIN lo ON lo.recording_id = em.recording_id AND lo.i = em.i JOIN g ON g.recording_id = em.recording_id AND g.i BETWEEN lo.oldest AND lo.i)""",
           sql.velocity("bv", "bg"), sql.runs("br", "bv", sql.kind_of()), sql.events("be", "br"), *sf_.all_features("bf", "bv", "be"),
           "bo AS (SELECT e.stream AS recording_id, e.emit_ms, bf.* EXCLUDE (recording_id) FROM bf JOIN (SELECT DISTINCT recording_id, stream, emit_ms FROM bg) e "
           "ON e.recording_id = bf.recording_id)"]


@query("S1_buffer_features", R, "emit_ms " + sf_.ALL_NUM, sf_.COUNTS, BUFFERS, "bo")
def s1_features(spark, sf):
    """All features of every emitted buffer."""
    buffers = stateful.sliding_buffers(windows.with_event_time(stream(spark, sf)))
    return windows.run_to_table(buffers, "buffers", transform=stateful.buffer_features)


SLIDING = """
ww AS (SELECT g.*, floor(timestamp_ms * 1000) AS us, k FROM g, range(6) r(k)),
sl AS (SELECT recording_id, (floor(us / 250000) - k) * 250.0 AS window_start_ms, count(*) AS sample_count, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS valid_ratio,
    max(timestamp_ms) - min(timestamp_ms) AS duration_ms, avg(x) AS x_mean, stddev_pop(x) AS x_std, avg(pupil) AS pupil_mean FROM ww GROUP BY 1, 2)"""
SLIDING_NUM = "window_start_ms valid_ratio duration_ms x_mean x_std pupil_mean"


@query("S2_sliding_features", R, SLIDING_NUM, "sample_count", [sql.GAZE, SLIDING], "sl")
def s2(spark, sf):
    found = windows.sliding_features(windows.with_event_time(stream(spark, sf)))
    return windows.run_to_table(found, "sliding", "update", [R, "window_start_ms", "window_end_ms"])


QUALITY = """
qw AS (SELECT recording_id, floor(floor(timestamp_ms * 1000) / 1000000) * 1000.0 AS window_start_ms, count(*) AS sample_count,
    count(*) FILTER (NOT valid) AS lost_count, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS tracking_ratio FROM g GROUP BY 1, 2),
qv AS (SELECT *, CASE WHEN tracking_ratio >= 0.9 THEN '优' WHEN tracking_ratio >= 0.75 THEN '良' WHEN tracking_ratio >= 0.5 THEN '可用' ELSE '建议剔除' END AS grade,
    tracking_ratio < 0.75 AS alert FROM qw)"""


@query("S3_stream_quality", R + " grade alert", "window_start_ms tracking_ratio", "sample_count lost_count", [sql.GAZE, QUALITY], "qv")
def s3(spark, sf):
    found = windows.stream_quality(windows.with_event_time(stream(spark, sf)))
    return windows.run_to_table(found, "quality", "update", [R, "window_start_ms", "window_end_ms"])


@query("S4_stream_scoring", R, "window_start_ms prediction probability", "sample_count")
def s4(spark, sf):
    """Score streaming windows with a model fitted on the windows of the stored samples."""
    inputs = ["valid_ratio", "duration_ms", "x_mean", "pupil_mean"]
    batch = windows.sliding_features(windows.with_event_time(raw_samples(spark, sf))).join(recordings(spark, sf).select(R, "trial"), R)
    ready = batch.fillna(0.0, inputs).withColumn("label", (F.col("trial") == "t1").cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"),
                             LogisticRegression(regParam=0.01)]).fit(materialize(ready.select(*inputs, "label"), "windows"))
    live = windows.sliding_features(windows.with_event_time(stream(spark, sf))).fillna(0.0, inputs)
    scored = windows.stream_scoring(live, model).select(
        R, "window_start_ms", "sample_count", "prediction", F.get(vector_to_array("probability"), 1).alias("probability"))
    return windows.run_to_table(scored, "scored", "update", [R, "window_start_ms"])


ALL_RUNS = [*sql.BASE_EVENTS[:3],
            """ce AS (SELECT recording_id, kind, min(timestamp_ms) AS start_time_ms, max(timestamp_ms) AS end_time_ms, max(timestamp_ms) - min(timestamp_ms) AS duration_ms,
    count(*) AS sample_count, CASE WHEN kind = 'blink' THEN 0.0 ELSE sqrt(pow(arg_max(x, i) - arg_min(x, i), 2) + pow(arg_max(y, i) - arg_min(y, i), 2)) END AS amplitude,
    max(velocity) AS peak_velocity FROM r GROUP BY recording_id, run, kind)"""]


@query("S5_stream_ivt_events", R + " kind", "start_time_ms end_time_ms duration_ms amplitude peak_velocity", "sample_count", ALL_RUNS,
       "ce WHERE NOT ((kind = 'fixation' AND duration_ms < 60) OR (kind = 'blink' AND duration_ms < 75))")
def s5(spark, sf):
    """Events closed by a change of label, and the run still open where a recording ends by a timer: a beat without a recording
    arrives after the samples and moves the watermark past the end of all runs."""
    df = raw_samples(spark, sf)
    base = scratch_dir(spark, "samples")
    df.repartition(FILES_PER_BATCH).write.parquet(f"{base}/part=0")
    beat = df.agg((F.max("timestamp_ms") + 2 * stateful.END_MS + 60_000.0).alias("timestamp_ms"))
    for name in df.columns:
        if name != "timestamp_ms":
            beat = beat.withColumn(name, F.lit(None).cast(df.schema[name].dataType))
    # a batch is judged by the watermark of the one before, so the timers run in the second batch of beats
    beats = beat.select(df.columns).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(FILES_PER_BATCH)))).repartitionByRange(FILES_PER_BATCH, "_k").drop("_k")
    for k in (1, 2):
        beats.write.parquet(f"{base}/part={k}")
    arrivals = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{base}/part=*")
    return windows.run_to_table(stateful.stream_events(windows.with_event_time(arrivals)), "events")


LATE = """
lt AS (SELECT recording_id, floor(floor(timestamp_ms * 1000) / 1000000) * 1000.0 AS window_start_ms, count(*) AS sample_count
  FROM g WHERE NOT (timestamp_ms < 3000 AND sample_seq % 10 = 0) GROUP BY 1, 2)"""


@query("S6_late_data", R, "window_start_ms", "sample_count", [sql.GAZE, LATE], "lt")
def s6(spark, sf):
    """A tenth of the early rows arrives after the end of the recordings, beyond the watermark, and is dropped."""
    df = raw_samples(spark, sf)
    late = (F.col("timestamp_ms") < 3000) & (F.col("sample_seq") % 10 == 0)
    base = scratch_dir(spark, "arrivals")
    t = F.col("timestamp_ms")
    # rows are judged late by the watermark of the batch before, hence the batch in between
    for k, part in enumerate([~late & (t < 3000), ~late & (t >= 3000) & (t < 7000), ~late & (t >= 7000), late]):
        df.filter(part).repartition(FILES_PER_BATCH).write.mode("append").parquet(f"{base}/part={k}")
    arrivals = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{base}/part=*")
    found = windows.stream_quality(windows.with_event_time(arrivals, "2 seconds"))
    return windows.run_to_table(found, "late", "update", [R, "window_start_ms", "window_end_ms"])
