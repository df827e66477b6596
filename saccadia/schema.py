"""Canonical tables."""

from pyspark.sql import types as T

KEY = "recording_id"
INDEX = "sample_index"
BLOCK = "block"

SAMPLE_COLUMNS = ["timestamp_ms", "x", "y", "pupil", "valid", "marker", "event_label", "label", "trial"]

VERTICES = T.ArrayType(
    T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
)

SAMPLES = T.StructType(
    [
        T.StructField(KEY, T.StringType(), False),
        T.StructField("sample_seq", T.LongType(), False),
        T.StructField("timestamp_ms", T.DoubleType(), False),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("pupil", T.DoubleType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("marker", T.StringType()),
        T.StructField("event_label", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("trial", T.StringType()),
    ]
)

AOIS = T.StructType(
    [
        T.StructField("aoi_set", T.StringType()),
        T.StructField("aoi_order", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("region_type", T.StringType()),
        T.StructField("x_min", T.DoubleType()),
        T.StructField("y_min", T.DoubleType()),
        T.StructField("x_max", T.DoubleType()),
        T.StructField("y_max", T.DoubleType()),
        T.StructField("vertices", VERTICES),
    ]
)
