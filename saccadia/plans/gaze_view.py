"""The driver's ``events`` table read as gaze recordings.

A user is a recording; 30 days of events are scaled to 7,200 ms; the value (taken off the
decimal grid, so that rounded means have no ties) and the ``k`` property are the gaze
position; ``error`` rows are lost samples. Every fourth recording has no event labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saccadia.functions.ordered import lay_out
from saccadia.schema import KEY

ORIGIN_US = 1704067200000000
US_PER_MS = 3.6e8


def gaze_columns(events: DataFrame) -> DataFrame:
    ok = F.col("event_type") != "error"
    kind = F.col("event_type")
    labels = {"click": "fix", "view": "Fixation", "purchase": "SACC", "signup": "SP", "error": "blink_start"}
    label = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in labels.items()])
    return events.select(
        F.col("user_id").cast("string").alias(KEY),
        F.col("event_id").alias("sample_seq"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN_US) / US_PER_MS).alias("timestamp_ms"),
        F.when(ok, F.col("value") / 0.97).alias("x"),
        F.when(ok, F.get_json_object("props", "$.k").cast("double")).alias("y"),
        F.when(ok, 2.0 + (F.col("event_id") % 37) / 19.0).alias("pupil"),
        ok.alias("valid"),
        F.when(kind == "purchase", "task_start").when(kind == "signup", "task_end").alias("marker"),
        F.when(F.col("user_id") % 4 != 0, label).alias("event_label"),
        F.lit(None).cast("string").alias("label"),
        F.concat(F.lit("t"), F.col("user_id") % 2).alias("trial"),
    )


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return gaze_columns(spark.read.parquet(f"{sf_dir}/events.parquet"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lay_out(raw_samples(spark, sf_dir))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return users.select(
        F.col("user_id").cast("string").alias(KEY),
        F.concat(F.lit("s"), F.col("user_id")).alias("session_id"),
        F.floor(F.col("user_id") / 3).cast("string").alias("subject_id"),
        F.concat(F.lit("c"), F.col("user_id") % 3).alias("condition"),
        F.concat(F.lit("t"), F.col("user_id") % 2).alias("trial"),
    )


def heart_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second signal: view events, 3.7 ms late, with a rate from the event value."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'view'")
    return events.select(
        F.col("user_id").cast("string").alias(KEY),
        F.col("event_id").alias("sample_seq"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN_US) / US_PER_MS + 3.7).alias("timestamp_ms"),
        (60.0 + F.col("value") / 9.7).alias("heart_rate_bpm"),
    )
