"""Queries on readers, normalisation and sinks.

File readers read files that Spark writes from the driver's tables first.
"""

from pyspark.sql import functions as F

from saccadia.plans import sql
from saccadia.plans.catalog import query
from saccadia.plans.gaze_view import raw_samples, recordings
from saccadia.schema import KEY
from saccadia.sources import normalize, readers, text_values

R = "recording_id"


def _name_from_path(df):
    """The recording key that the name of the file or its folder carries."""
    return df.withColumn(KEY, F.regexp_extract(KEY, r"rec=(\d+)", 1))


FILES = """
fl AS (SELECT g.*, CAST(recording_id AS BIGINT) % 2 = 0 AS even FROM g)"""


@query("N1_read_tabular", R + " valid marker", "timestamp_ms x y pupil", "", [sql.GAZE], "g")
def n1(spark, sf):
    """Half of the recordings as comma files, half as semicolon files with other column names."""
    df = raw_samples(spark, sf).drop("event_label", "label", "trial").withColumn("rec", F.col(R))
    base = readers.scratch_dir(spark, "tabular")
    one = df.filter(F.col("rec") % 2 == 0).select("rec", "timestamp_ms", "x", "y", "pupil", "valid", "marker")
    two = df.filter(F.col("rec") % 2 != 0).select(
        "rec", F.col("y").alias("gaze_y"), F.col("x").alias("gaze_x"), F.col("timestamp_ms").alias("time"),
        F.col("pupil").alias("pupil_size"), F.col("valid").cast("int").alias("is_valid"), F.col("marker").alias("trigger"),
    )
    readers.write_recordings(one, "rec", f"{base}/comma")
    readers.write_recordings(two, "rec", f"{base}/semicolon", ";")
    raw = readers.read_tabular(spark, [f"{base}/comma", f"{base}/semicolon"])
    return _name_from_path(normalize.validate_samples(raw))


@query("N2_normalize_columns", R, "timestamp_ms x y", "sample_seq", [sql.GAZE], "g")
def n2(spark, sf):
    odd = raw_samples(spark, sf).select(
        R, "sample_seq", F.col("timestamp_ms").alias("Time"), F.col("x").alias("Gaze_X"), F.col("y").alias("vertical"),
        F.lit(0).alias("unused"),
    )
    return normalize.normalize_columns(odd, {"y": "vertical", "pupil": "absent"})


@query("N3_synthesize_timestamps", R, "timestamp_ms", "sample_seq", [sql.GAZE],
       "(SELECT recording_id, sample_seq, (row_number() OVER (PARTITION BY recording_id ORDER BY sample_seq) - 1) * (1000.0 / 60.0) AS timestamp_ms FROM g)")
def n3(spark, sf):
    return normalize.synthesize_timestamps(raw_samples(spark, sf).select(R, "sample_seq", "x", "y"), 60.0)


CODES = ["'1'", "'0'", "' TRUE '", "'Yes'", "'nan'", "'valid'", "'no'", "NULL", "'2.5'", "'-0.0'", "''"]
CODE_SQL = "CASE sample_seq % 11 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(CODES)) + " END"


@query("N4_coerce_valid", "code flag", "", "n", [sql.GAZE],
       f"""(SELECT code, coalesce(CASE WHEN isnan(TRY_CAST(code AS DOUBLE)) THEN NULL ELSE TRY_CAST(code AS DOUBLE) <> 0 END,
  lower(trim(code)) IN ('true', 't', 'yes', 'y', 'valid'), FALSE) AS flag, count(*) AS n FROM (SELECT {CODE_SQL} AS code FROM g) GROUP BY ALL)""")
def n4(spark, sf):
    df = raw_samples(spark, sf).withColumn("code", F.expr(CODE_SQL))
    df = df.withColumn("flag", normalize.coerce_valid(F.col("code"), df.schema["code"].dataType))
    return df.groupBy("code", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("N5_validate_samples", R + " valid marker", "timestamp_ms x y pupil", "sample_seq", [sql.GAZE],
       "(SELECT * REPLACE (sample_seq % 11 <> 3 AND x IS NOT NULL AND y IS NOT NULL AND pupil IS NOT NULL AS valid) FROM g)")
def n5(spark, sf):
    df = raw_samples(spark, sf)
    texts = df.select(
        R, "sample_seq", F.col("timestamp_ms").cast("string").alias("timestamp_ms"),
        F.coalesce(F.col("x").cast("string"), F.lit("lost")).alias("x"), F.coalesce(F.col("y").cast("string"), F.lit("NaN")).alias("y"),
        "pupil", F.when(F.col("sample_seq") % 11 == 3, "0").otherwise("yes").alias("valid"), "marker",
    )
    return normalize.validate_samples(texts)


@query("N6_read_eyelink_asc", R, "timestamp_ms x y pupil", "", [sql.GAZE], "g WHERE valid")
def n6(spark, sf):
    """Recordings written as ASC text, with message and lost-sample lines in between."""
    df = raw_samples(spark, sf)
    line = F.when(F.col("valid"), F.concat_ws("  ", "timestamp_ms", "x", "y", "pupil", F.lit("..."))).otherwise(
        F.concat_ws(" ", "timestamp_ms", F.lit(". . 0.0 ..."))
    )
    lines = F.array(line, F.concat_ws(" ", F.lit("MSG"), "timestamp_ms", F.lit("SYNC")))
    base = readers.scratch_dir(spark, "asc")
    readers.writer_by(df.select(F.col(R).alias("rec"), F.explode(lines).alias("value")), "rec").text(base)
    return _name_from_path(readers.read_eyelink_asc(spark, [base]))


@query("N7_from_frame", R + " valid", "timestamp_ms x y", "sample_seq", [sql.GAZE], "g")
def n7(spark, sf):
    events = raw_samples(spark, sf).select(
        F.col(R).alias("session"), F.col("sample_seq").alias("row"), F.col("timestamp_ms").alias("t"),
        F.col("x").alias("screen_x"), F.col("y").alias("screen_y"), F.col("pupil").alias("diameter"), F.col("valid").alias("tracking_valid"),
    )
    return normalize.from_frame(events, recording="session", sequence="row")


@query("N8_flatten_pixel_samples", R + " marker trial", "timestamp_ms x y", "sample_seq", [sql.GAZE], "g")
def n8(spark, sf):
    """Pixel pairs as arrays for some rows' source and as structs for the others'."""
    df = raw_samples(spark, sf).withColumnsRenamed({"timestamp_ms": "time", "marker": "message", "trial": "name"})
    as_array = df.filter("sample_seq % 2 = 0").withColumn("pixel", F.array("x", "y")).drop("x", "y")
    as_struct = df.filter("sample_seq % 2 = 1").withColumn("pixel", F.struct(F.col("x").alias("pixel_x"), F.col("y").alias("pixel_y"))).drop("x", "y")
    keep = [R, "sample_seq", "timestamp_ms", "x", "y", "marker", "trial"]
    return normalize.flatten_pixel_samples(as_array).select(keep).union(normalize.flatten_pixel_samples(as_struct).select(keep))


@query("N10_scenario_aois", "scenario task_id name", "x_min y_min x_max y_max", "", [],
       """(SELECT r_name AS scenario, 'T' || (n_nationkey % 3) AS task_id, n_name AS name, n_nationkey * 10.0 AS x_min, 0.0 AS y_min,
  n_nationkey * 10.0 + 100 AS x_max, 50.0 AS y_max FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_nationkey % 3 = 2)""")
def n10(spark, sf):
    """Areas of a scenario's task, from a JSON dimension written from nation and region."""
    nation = spark.read.parquet(f"{sf}/nation.parquet").join(
        F.broadcast(spark.read.parquet(f"{sf}/region.parquet")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    base = readers.scratch_dir(spark, "scenarios")
    left = F.col("n_nationkey") * 10.0
    nation.select(
        F.col("r_name").alias("scenario"), F.concat(F.lit("T"), F.col("n_nationkey") % 3).alias("task_id"), F.col("n_name").alias("name"),
        left.alias("x_min"), F.lit(0.0).alias("y_min"), (left + 100).alias("x_max"), F.lit(50.0).alias("y_max"),
    ).write.json(base)
    schema = "scenario string, task_id string, name string, x_min double, y_min double, x_max double, y_max double"
    return readers.scenario_aois(spark.read.schema(schema).json(base), "ASIA", "T2")


CANVAS_SQL = """
ob AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 AS k, 'rect' AS type, 0.0 AS angle, l_quantity AS w, l_quantity / 2 AS h, 1.5 AS sc FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 2, CASE WHEN l_linenumber % 2 = 0 THEN 'rect' ELSE 'circle' END, l_tax * 100 - l_tax * 100, 40.0, 30.0, 1.0 FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 3, 'rect', l_discount, 20.0, 20.0, 1.0 FROM lineitem),
kp AS (SELECT *, w * sc AS sw, h * sc AS sh, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY k) - 1 AS aoi_order
  FROM ob WHERE type = 'rect' AND angle = 0 AND w * sc >= 8 AND h * sc >= 8),
cr AS (SELECT l_orderkey, l_linenumber, l_partkey, aoi_order, 'AOI ' || (aoi_order + 1) AS name, k * 10.0 * 2.5 AS x_min, 5.0 * 2 AS y_min,
    (k * 10.0 + sw) * 2.5 AS x_max, (5.0 + sh) * 2 AS y_max FROM kp)"""


@query("N11_canvas_rects_to_aois", "name", "x_min y_min x_max y_max", "l_orderkey l_linenumber l_partkey aoi_order", [CANVAS_SQL], "cr")
def n11(spark, sf):
    """A drawing with three objects for every line item."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")

    def item(kind, angle, w, h, scale, k):
        return F.struct(kind.alias("type"), angle.alias("angle"), w.alias("width"), h.alias("height"), F.lit(scale).alias("scaleX"),
                        F.lit(scale).alias("scaleY"), F.lit(k * 10.0).alias("left"), F.lit(5.0).alias("top"))

    rect, flat = F.lit("rect"), F.lit(0.0)
    objects = F.array(
        item(rect, flat, F.col("l_quantity"), F.col("l_quantity") / 2, 1.5, 1),
        item(F.when(F.col("l_linenumber") % 2 == 0, "rect").otherwise("circle"), flat, F.lit(40.0), F.lit(30.0), 1.0, 2),
        item(rect, F.col("l_discount"), F.lit(20.0), F.lit(20.0), 1.0, 3),
    )
    drawings = items.withColumn("drawing", F.to_json(F.struct(objects.alias("objects"))))
    return text_values.canvas_rectangles(drawings, "drawing", ["l_orderkey", "l_linenumber", "l_partkey"], (400, 300), (1000, 600))


@query("N12_parse_time_ranges", "", "start_ms end_ms", "o_orderkey range_order", [],
       """(SELECT o_orderkey, 1 AS range_order, 0.0 AS start_ms, 10.5 AS end_ms FROM orders UNION ALL
  SELECT o_orderkey, 2, o_custkey, o_custkey + 5 FROM orders UNION ALL SELECT o_orderkey, 3, -3.0, 4.0 FROM orders)""")
def n12(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    second = F.concat(
        F.col("o_custkey"), F.lit(" to "), F.col("o_custkey") + 5
    )
    text = F.concat(F.lit("0-10.5; "), second, F.lit(" ;\n -3 ~ 4"))
    return text_values.parse_time_ranges(orders.withColumn("ranges", text), "ranges", ["o_orderkey"])


@query("N14_write_tables", R, "timestamp_ms x", "sample_seq", [sql.GAZE], "g")
def n14(spark, sf):
    """Samples written as partitioned parquet and, for the lost ones, as JSON, then read back."""
    df = raw_samples(spark, sf).join(recordings(spark, sf).select(R, "condition"), R)
    base = readers.scratch_dir(spark, "tables")
    readers.write_table(df.filter("valid"), f"{base}/valid", "parquet", ["condition"])
    readers.write_table(df.filter("NOT valid"), f"{base}/lost", "json")
    columns = [R, "sample_seq", "timestamp_ms", "x"]
    lost = spark.read.schema("recording_id string, sample_seq long, timestamp_ms double, x double").json(f"{base}/lost")
    return spark.read.parquet(f"{base}/valid").select(columns).union(lost.select(columns))
