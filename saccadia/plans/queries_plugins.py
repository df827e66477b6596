"""Queries on the extension points: label maps, SQL functions, loaders and models of one's own."""

from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from saccadia.functions.geometry import register_sql_functions
from saccadia.operators import events as ev
from saccadia.operators import features as ft
from saccadia.operators import modeling as ml
from saccadia.plans import sql
from saccadia.plans.catalog import query
from saccadia.plans.gaze_view import raw_samples, samples
from saccadia.plans.queries_features import R, threshold_events
from saccadia.plans.queries_models import dataset
from saccadia.plans.queries_space import AREAS, ASSIGNED
from saccadia.sources import readers


@query("U1_register_feature", R, "y_range", "", [sql.GAZE], "(SELECT recording_id, max(y) - min(y) AS y_range FROM g GROUP BY 1)")
def u1(spark, sf):
    """A column aggregate joins the built-in features' aggregation."""
    ft.register_feature("y_range", F.max("y") - F.min("y"))
    try:
        return ft.extract_features(samples(spark, sf))
    finally:
        ft.unregister_feature("y_range")


@query("U2_register_loader", R + " valid", "timestamp_ms x y", "", [sql.GAZE], "g")
def u2(spark, sf):
    """A loader for JSON-lines files, used by its format name."""

    def load(session, paths, options):
        rows = session.read.schema("rec string, timestamp_ms double, x double, y double, pupil double, valid boolean").json(paths)
        return rows.withColumns({R: F.col("rec"), "sample_seq": readers.file_position()})

    readers.register_loader("jsonl", load)
    base = readers.scratch_dir(spark, "jsonl")
    raw_samples(spark, sf).select(F.col(R).alias("rec"), "timestamp_ms", "x", "y", "pupil", "valid").write.json(base)
    return readers.read_recordings(spark, [base], "jsonl")


@query("U3_register_model", "model", "accuracy", "")
def u3(spark, sf):
    """A model factory of one's own, trained by name."""
    ml.register_model("naive_bayes", "classification", lambda seed, **options: NaiveBayes(modelType="gaussian", **options))
    fitted = ml.train_model(dataset(spark, sf), "trial", model_name="naive_bayes", feature_columns=["fixation_count", "saccade_count", "path_length"])
    return fitted.metrics.withColumn("model", F.lit("naive_bayes"))


MAPPED = "CASE WHEN event_label = 'SP' THEN 'blink' ELSE " + sql.label_kind() + " END"


@query("U4_label_map", R + " kind", "start_time_ms end_time_ms", "start_index end_index",
       [sql.GAZE, sql.VELOCITY, sql.runs("ur", "v", MAPPED), sql.events("ue", "ur", "TRUE")], "ue")
def u4(spark, sf):
    """A label map of one's own reads smooth pursuit as blinks."""
    return ev.events_from_labels(samples(spark, sf), label_map={"SP": "blink"})


@query("U5_sql_functions", R + " kind", "centroid_x centroid_y", "event_index", ASSIGNED, "fx WHERE aoi_name = 'triangle'")
def u5(spark, sf):
    """Point-in-polygon and label mapping called from SQL text."""
    register_sql_functions(spark)
    threshold_events(spark, sf).createOrReplaceTempView("gaze_events")
    ring = ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in AREAS[1].region)
    return spark.sql(
        f"""
        SELECT recording_id, gaze_event_kind(kind) AS kind, centroid_x, centroid_y, event_index
        FROM gaze_events
        WHERE kind = 'fixation' AND point_in_polygon(centroid_x, centroid_y, array({ring}))
          AND NOT (centroid_x BETWEEN 0 AND 45 AND centroid_y BETWEEN 40 AND 100)
        """
    )
