"""Queries on quality, segments, areas of interest and grids."""

from pyspark.sql import functions as F

from saccadia.operators import aoi, grid, quality, segments
from saccadia.operators import events as ev
from saccadia.operators import features as ft
from saccadia.operators import signal as sg
from saccadia.plans import sql
from saccadia.plans import sql_features as sf_
from saccadia.plans.catalog import query
from saccadia.plans.gaze_view import raw_samples, recordings, samples
from saccadia.plans.queries_features import PIPELINE, R, labelled, pipeline_features, threshold_events

GRADE = "CASE WHEN {r} >= 0.9 THEN '优' WHEN {r} >= 0.75 THEN '良' WHEN {r} >= 0.5 THEN '可用' ELSE '建议剔除' END"

Q1 = f"q1 AS (SELECT *, {GRADE.format(r='tracking_ratio')} AS quality_grade FROM (SELECT recording_id, avg(CAST(valid AS DOUBLE)) AS tracking_ratio FROM g GROUP BY 1))"


@query("Q1_quality_grade", R + " quality_grade", "tracking_ratio", "", [sql.GAZE, Q1], "q1")
def q1(spark, sf):
    return quality.quality_grade(raw_samples(spark, sf))


GAPS = [
    sql.GAZE,
    sql.runs("vr", "g", "valid"),
    """gaps AS (SELECT recording_id, min(i) AS start_index, max(i) AS end_index, min(timestamp_ms) AS start_time_ms,
    max(timestamp_ms) AS end_time_ms, max(timestamp_ms) - min(timestamp_ms) AS duration_ms, count(*) AS sample_count
  FROM vr WHERE NOT valid GROUP BY recording_id, run)""",
]


@query("Q2_missing_segments", R, "start_time_ms end_time_ms duration_ms", "start_index end_index sample_count", GAPS, "gaps")
def q2(spark, sf):
    return quality.missing_segments(samples(spark, sf))


REPORT = """
qr AS (SELECT recording_id, avg(CAST(valid AS DOUBLE)) AS tracking_ratio, count(*) AS total_samples, count(*) FILTER (valid) AS valid_samples,
    (max(timestamp_ms) - min(timestamp_ms)) / 1000.0 AS recording_duration_s,
    coalesce((count(*) - 1) / nullif((max(timestamp_ms) - min(timestamp_ms)) / 1000.0, 0.0), 0) AS sampling_rate_actual,
    10.0 AS expected_sampling_rate_hz, 0.0 AS interpolated_ratio,
    CASE WHEN count(*) FILTER (valid) > 0 THEN 1.0 - avg(CAST(valid AS DOUBLE)) ELSE 0.0 END AS filled_ratio FROM g GROUP BY 1),
qg AS (SELECT recording_id, count(*) AS missing_segments, max(duration_ms) AS max_gap_duration_ms FROM gaps GROUP BY 1),
qb AS (SELECT recording_id, count(*) FILTER (kind = 'blink') AS blink_count FROM ev GROUP BY 1),
report AS (SELECT qr.*, coalesce(missing_segments, 0) AS missing_segments, coalesce(max_gap_duration_ms, 0) AS max_gap_duration_ms,
    coalesce(blink_count, 0) AS blink_count, """ + GRADE.format(r="tracking_ratio") + """ AS quality_grade
  FROM qr LEFT JOIN qg USING (recording_id) LEFT JOIN qb USING (recording_id))"""
REPORT_CTES = [*GAPS, sql.VELOCITY, sql.THRESHOLD_RUNS, sql.EVENTS, REPORT]


def report(spark, sf):
    s = samples(spark, sf)
    rec = recordings(spark, sf).withColumn("sampling_rate_hz", F.lit(10.0))
    labels = ev.label_samples(s, "thresholds")
    return quality.assess_quality(s, ev.runs_to_events(labels), sg.interpolate_missing(s), rec)


query("Q3_assess_quality", R + " quality_grade",
      "tracking_ratio max_gap_duration_ms interpolated_ratio filled_ratio recording_duration_s sampling_rate_actual expected_sampling_rate_hz",
      "total_samples valid_samples missing_segments blink_count", REPORT_CTES, "report")(report)


def _card(order, label, value, status):
    return f"SELECT recording_id, {order} AS card_order, '{label}' AS card, {value} AS value, {status} AS status FROM report"


def _fixed(c, d):
    return f"printf('%.{d}f', round_even({c}, {d}) + 0.0)"


def _rising(c, good, warn):
    return f"CASE WHEN {c} >= {good} THEN 'good' WHEN {c} >= {warn} THEN 'warn' ELSE 'bad' END"


def _falling(c, good, warn):
    return f"CASE WHEN {c} < {good} THEN 'good' WHEN {c} <= {warn} THEN 'warn' ELSE 'bad' END"


CARDS = "cards AS (" + " UNION ALL ".join([
    _card(1, "追踪率", _fixed("tracking_ratio * 100.0", 1) + " || '%'", _rising("tracking_ratio", 0.9, 0.75)),
    _card(2, "采样率", _fixed("sampling_rate_actual", 1) + " || ' Hz'", _falling("abs(sampling_rate_actual - 10.0) / 10.0", 0.05, 0.1)),
    _card(3, "记录时长", _fixed("recording_duration_s", 1) + " || ' s'", _rising("recording_duration_s", 10, 5)),
    _card(4, "缺失段", "missing_segments || ' 段'", "CASE WHEN missing_segments <= 2 THEN 'good' WHEN missing_segments <= 5 THEN 'warn' ELSE 'bad' END"),
    _card(5, "最大缺失段", f"CASE WHEN max_gap_duration_ms >= 1000 THEN {_fixed('max_gap_duration_ms / 1000.0', 1)} || ' s' ELSE {_fixed('max_gap_duration_ms', 0)} || ' ms' END",
          _falling("max_gap_duration_ms", 500, 2000)),
    _card(6, "质量等级", "quality_grade", "CASE WHEN quality_grade IN ('优', '良') THEN 'good' WHEN quality_grade = '可用' THEN 'warn' ELSE 'bad' END"),
    _card(7, "眨眼次数", "blink_count || ' 次'", "'info'"),
    _card(8, "插值比例", _fixed("interpolated_ratio * 100.0", 1) + " || '%'", _falling("abs(interpolated_ratio)", 0.05, 0.15)),
]) + ")"


@query("Q4_quality_cards", R + " card value status", "", "card_order", [*REPORT_CTES, CARDS], "cards")
def q4(spark, sf):
    return quality.quality_cards(report(spark, sf))


SHARE = """
total AS (SELECT recording_id, max(timestamp_ms) - min(timestamp_ms) AS t FROM g GROUP BY 1),
share AS (SELECT gaps.*, coalesce(duration_ms / nullif(t, 0.0), 0) AS percentage_of_total,
    rank() OVER (PARTITION BY recording_id ORDER BY duration_ms DESC) AS gap_rank FROM gaps JOIN total USING (recording_id))"""


@query("Q5_gap_share", R, "start_time_ms end_time_ms duration_ms percentage_of_total", "gap_rank", [*GAPS, SHARE], "share")
def q5(spark, sf):
    return quality.gap_share(samples(spark, sf))


@query("Q6_quality_distribution", "quality_grade", "", "count", [sql.GAZE, Q1],
       "(SELECT quality_grade, count(*) AS count FROM q1 GROUP BY 1)")
def q6(spark, sf):
    return quality.quality_distribution(quality.quality_grade(raw_samples(spark, sf)))


@query("Q7_mean_grade", "mean_grade", "", "", [sql.GAZE, Q1],
       """(SELECT CASE CAST(round_even(avg(CASE quality_grade WHEN '建议剔除' THEN 1.0 WHEN '可用' THEN 2.0 WHEN '良' THEN 3.0 ELSE 4.0 END), 0) AS INTEGER)
  WHEN 1 THEN '建议剔除' WHEN 2 THEN '可用' WHEN 3 THEN '良' ELSE '优' END AS mean_grade FROM q1)""")
def q7(spark, sf):
    return quality.mean_grade(quality.quality_grade(raw_samples(spark, sf)))


# segments ---------------------------------------------------------------------------

BOUNDS = "bd AS (SELECT recording_id, min(timestamp_ms) AS lo, max(timestamp_ms) AS hi FROM g GROUP BY 1)"
RANGES = [(0.0, 800.0), (600.0, 2500.0), (6000.0, 9000.0), (-50.0, -10.0), (9000.0, 9500.0)]


@query("G1_segment_whole", R + " segment_name", "start_ms end_ms", "", [sql.GAZE, BOUNDS],
       "(SELECT recording_id, 'whole_file' AS segment_name, lo AS start_ms, hi AS end_ms FROM bd)")
def g1(spark, sf):
    return segments.whole(raw_samples(spark, sf))


def clamped(dst, src):
    return f"""{dst} AS (SELECT * EXCLUDE (a, b, lo, hi), greatest(a, lo) AS start_ms, greatest(least(b, hi), greatest(a, lo)) AS end_ms
  FROM {src} JOIN bd USING (recording_id))"""


def members(dst, src):
    return f"""{dst} AS (SELECT s.*, g.sample_seq, g.x FROM {src} s JOIN g ON g.recording_id = s.recording_id
  AND g.timestamp_ms >= s.start_ms AND g.timestamp_ms <= s.end_ms)"""


RANGE_ROWS = ", ".join(f"('time_{k}', {a}, {b})" for k, (a, b) in enumerate(RANGES, 1))
G2 = [sql.GAZE, BOUNDS, f"rr AS (SELECT recording_id, v.* FROM bd, (VALUES {RANGE_ROWS}) v(segment_name, a, b))", clamped("sg", "rr"), members("sm", "sg")]


@query("G2_segment_time_ranges", R + " segment_name", "start_ms end_ms x", "sample_seq", G2, "sm")
def g2(spark, sf):
    s = raw_samples(spark, sf)
    return segments.in_intervals(s, segments.time_ranges(s, RANGES), "start_ms", "end_ms")


G3 = [sql.GAZE, BOUNDS,
      """mk AS (SELECT recording_id, 'marker_window_' || row_number() OVER (PARTITION BY recording_id ORDER BY i) || '_' || marker AS segment_name,
  timestamp_ms - 100 AS a, timestamp_ms + 250 AS b, marker AS marker_value FROM g WHERE marker = 'task_start')""",
      clamped("sg", "mk"), members("sm", "sg")]


@query("G3_segment_marker_windows", R + " segment_name marker_value", "start_ms end_ms x", "sample_seq", G3, "sm")
def g3(spark, sf):
    s = samples(spark, sf)
    found = segments.marker_windows(s, ["task_start"], 100.0, 250.0)
    return segments.in_intervals(s, found, "start_ms", "end_ms")


G4 = [sql.GAZE, BOUNDS,
      """mk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY i) AS k FROM g WHERE marker = 'task_start'),
bt AS (SELECT mk.recording_id, 'between_' || k || '_task_start_to_task_end' AS segment_name, mk.timestamp_ms AS a, min(e.timestamp_ms) AS b
  FROM mk JOIN g e ON e.recording_id = mk.recording_id AND e.marker = 'task_end' AND e.timestamp_ms > mk.timestamp_ms GROUP BY ALL)""",
      clamped("sg", "bt"), members("sm", "sg")]


@query("G4_segment_between_markers", R + " segment_name", "start_ms end_ms x", "sample_seq", G4, "sm")
def g4(spark, sf):
    s = samples(spark, sf)
    found = segments.between_markers(s, "task_start", "task_end")
    return segments.in_intervals(s, found, "start_ms", "end_ms")


HALVES = [(0.0, 3600.0), (3600.0, 7200.0)]
HALF_ROWS = ", ".join(f"('time_{k}', {a}, {b})" for k, (a, b) in enumerate(HALVES, 1))


def _segment_pipeline():
    pre = [sql.GAZE.replace("\ng AS (SELECT", "\ng0 AS (SELECT"), "bd AS (SELECT recording_id, min(timestamp_ms) AS lo, max(timestamp_ms) AS hi FROM g0 GROUP BY 1)",
           f"rr AS (SELECT recording_id, v.* FROM bd, (VALUES {HALF_ROWS}) v(segment_name, a, b))", clamped("sg", "rr"),
           """g1 AS (SELECT g0.* EXCLUDE (recording_id, i), g0.recording_id || '#' || s.segment_name AS recording_id
  FROM sg s JOIN g0 ON g0.recording_id = s.recording_id AND g0.timestamp_ms >= s.start_ms AND g0.timestamp_ms <= s.end_ms)""",
           "g AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY timestamp_ms, sample_seq) - 1 AS i FROM g1)"]
    rest = [*sql.PRE_EVENTS[1:], *sf_.all_features("fp", "pv", "pe")]
    last = """seg AS (SELECT fp.*, sg.segment_name, sg.start_ms AS segment_start_ms, sg.end_ms AS segment_end_ms
  FROM fp JOIN sg ON fp.recording_id = sg.recording_id || '#' || sg.segment_name)"""
    return [*pre, *rest, last]


@query("G5_segment_features", R + " segment_name", sf_.ALL_NUM + " segment_start_ms segment_end_ms", sf_.COUNTS,
       _segment_pipeline(), "seg")
def g5(spark, sf):
    s = samples(spark, sf)
    return segments.segment_features(s, segments.time_ranges(s, HALVES))


@query("N13_distinct_markers", R + " marker", "first_ms", "marker_order", [sql.GAZE],
       """(SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY first_ms) AS marker_order FROM
  (SELECT recording_id, trim(marker) AS marker, min(timestamp_ms) AS first_ms FROM g WHERE trim(marker) <> '' GROUP BY 1, 2))""")
def n13(spark, sf):
    from pyspark.sql import Window

    found = segments.distinct_markers(raw_samples(spark, sf))
    # the distinct markers of a recording are few, whatever its length
    w = Window.partitionBy(R).orderBy("first_ms", "first_seq")
    return found.withColumn("marker_order", F.row_number().over(w))


# areas ------------------------------------------------------------------------------

AREAS = [
    aoi.rectangle("left", 45.0, 100.0, 0.0, 40.0),
    aoi.polygon("triangle", [(20.0, -1.0), (90.3, 10.0), (35.0, 70.2)]),
    aoi.rectangle("right", 40.0, 0.0, 500.0, 100.0),
    aoi.rectangle("nowhere", 900.0, 900.0, 990.0, 990.0),
]
NAMES = [a.name for a in AREAS]


def _ray(points, x, y):
    terms = []
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]]):
        terms.append(f"CASE WHEN (({ay} > {y}) <> ({by} > {y})) AND {x} < ({bx} - {ax}) * ({y} - {ay}) / nullif({by} - {ay}, 0.0) + {ax} THEN 1 ELSE 0 END")
    return f"(({' + '.join(terms)}) % 2 = 1)"


AREA_SQL = (
    "CASE WHEN centroid_x BETWEEN 0 AND 45 AND centroid_y BETWEEN 40 AND 100 THEN 'left' "
    f"WHEN {_ray(AREAS[1].region, 'centroid_x', 'centroid_y')} THEN 'triangle' "
    "WHEN centroid_x BETWEEN 40 AND 500 AND centroid_y BETWEEN 0 AND 100 THEN 'right' END"
)
ASSIGNED = [*sql.BASE_EVENTS, f"fx AS (SELECT *, {AREA_SQL} AS aoi_name FROM ev WHERE kind = 'fixation')"]


def assigned(spark, sf):
    return aoi.assign(ev.fixation_table(threshold_events(spark, sf)), AREAS)


@query("A1_define_aoi", R, "x_min y_min x_max y_max", "", [*sql.BASE_EVENTS,
       """co AS (SELECT recording_id, arg_min(centroid_x, event_index) AS x1, arg_min(centroid_y, event_index) AS y1,
  arg_max(centroid_x, event_index) AS x2, arg_max(centroid_y, event_index) AS y2 FROM ev WHERE kind = 'fixation' GROUP BY 1)"""],
       "(SELECT recording_id, least(x1, x2) AS x_min, least(y1, y2) AS y_min, greatest(x1, x2) AS x_max, greatest(y1, y2) AS y_max FROM co)")
def a1(spark, sf):
    """A rectangle per recording between its first and last fixation."""
    corners = ev.fixation_table(threshold_events(spark, sf)).groupBy(R).agg(
        F.min_by("centroid_x", "event_index").alias("x1"),
        F.min_by("centroid_y", "event_index").alias("y1"),
        F.max_by("centroid_x", "event_index").alias("x2"),
        F.max_by("centroid_y", "event_index").alias("y2"),
    )
    return aoi.define_rectangles(corners, "x1", "y1", "x2", "y2")


RECT_SQL = ("CASE WHEN centroid_x BETWEEN 0 AND 45 AND centroid_y BETWEEN 40 AND 100 THEN 'left' "
            "WHEN centroid_x BETWEEN 40 AND 500 AND centroid_y BETWEEN 0 AND 100 THEN 'right' END AS aoi_name")


@query("A2_assign_aoi_rect", R + " aoi_name", "centroid_x centroid_y", "event_index", sql.BASE_EVENTS,
       f"(SELECT *, {RECT_SQL} FROM ev WHERE kind = 'fixation')")
def a2(spark, sf):
    """Rectangles from a table of areas, each fixation naming its set."""
    table = aoi.area_table(spark, [a for a in AREAS if a.region_type == "rectangle"])
    fixations = ev.fixation_table(threshold_events(spark, sf)).withColumn("aoi_set", F.lit("default"))
    return aoi.assign_by_set(fixations, table)


def _areas_by_set(spark, sf):
    """Rectangles and triangles, one of each part, in two sets."""
    k = F.col("p_partkey")
    x, y, w, h = (k * 37) % 500 + 0.013, (k * 53) % 100 + 0.017, (k % 11 + 3).cast("double"), (k % 7 + 2).cast("double")
    rows = spark.read.parquet(f"{sf}/part.parquet").select(
        F.concat(F.lit("t"), k % 2).alias("aoi_set"), k.cast("int").alias("aoi_order"), F.concat(F.lit("a"), k).alias("name"),
        F.when(k % 3 == 0, "rectangle").otherwise("polygon").alias("region_type"),
        x.alias("x_min"), y.alias("y_min"), (x + w).alias("x_max"), (y + h).alias("y_max"))
    corner = lambda px, py: F.struct(F.col(px).alias("x"), F.col(py).alias("y"))
    return rows.withColumn("vertices", F.when(F.col("region_type") == "polygon", F.array(
        corner("x_min", "y_min"), corner("x_max", "y_min"), corner("x_min", "y_max"))))


AREA_SETS = [*sql.BASE_EVENTS, f"""
ar AS (SELECT 't' || (p_partkey % 2) AS aoi_set, p_partkey AS aoi_order, 'a' || p_partkey AS name, p_partkey % 3 = 0 AS box,
    (p_partkey * 37) % 500 + 0.013::DOUBLE AS x0, (p_partkey * 53) % 100 + 0.017::DOUBLE AS y0,
    (p_partkey * 37) % 500 + 0.013::DOUBLE + (p_partkey % 11 + 3)::DOUBLE AS x1, (p_partkey * 53) % 100 + 0.017::DOUBLE + (p_partkey % 7 + 2)::DOUBLE AS y1 FROM part),
fs AS (SELECT *, 't' || (CAST(recording_id AS BIGINT) % 2) AS aoi_set FROM ev WHERE kind = 'fixation'),
hs AS (SELECT recording_id, event_index, arg_min(name, aoi_order) AS aoi_name FROM fs JOIN ar USING (aoi_set)
  WHERE centroid_x BETWEEN x0 AND x1 AND centroid_y BETWEEN y0 AND y1
    AND (box OR {_ray((("x0", "y0"), ("x1", "y0"), ("x0", "y1")), "centroid_x", "centroid_y")}) GROUP BY 1, 2)"""]


@query("A2_assign_aoi_set", R + " aoi_set aoi_name", "centroid_x centroid_y", "event_index", AREA_SETS,
       "fs LEFT JOIN hs USING (recording_id, event_index)")
def a2_sets(spark, sf):
    """Polygons and rectangles in sets of any size, each fixation naming its set."""
    fixations = ev.fixation_table(threshold_events(spark, sf))
    named = fixations.withColumn("aoi_set", F.concat(F.lit("t"), F.col(R).cast("long") % 2))
    return aoi.assign_by_set(named, _areas_by_set(spark, sf))


@query("A3_assign_aoi_polygon", R + " aoi_name", "centroid_x centroid_y", "event_index", ASSIGNED, "fx")
def a3(spark, sf):
    return assigned(spark, sf)


VALUES = ", ".join(f"({k}, '{n}')" for k, n in enumerate(NAMES))
METRICS = f"""
du AS (SELECT recording_id, max(timestamp_ms) - min(timestamp_ms) AS total FROM g GROUP BY 1),
f0 AS (SELECT recording_id, min(start_time_ms) AS t0 FROM fx GROUP BY 1),
vi AS (SELECT *, aoi_name IS DISTINCT FROM lag(aoi_name) OVER (PARTITION BY recording_id ORDER BY event_index) AS enters FROM fx),
hi AS (SELECT recording_id, aoi_name, min(start_time_ms) AS hit, sum(duration_ms) AS dwell, count(*) AS n, count(*) FILTER (enters) AS visits
  FROM vi WHERE aoi_name IS NOT NULL GROUP BY 1, 2),
am AS (SELECT du.recording_id, v.aoi_name, v.aoi_order, hit - t0 AS ttff_ms, coalesce(dwell, 0) AS dwell_ms,
    coalesce(dwell, 0) / total AS dwell_prop, coalesce(n, 0) AS fixation_count, coalesce(visits, 0) AS visit_count,
    greatest(coalesce(visits, 0) - 1, 0) AS revisit_count, coalesce(dwell / n, 0) AS mean_fixation_duration
  FROM du CROSS JOIN (VALUES {VALUES}) v(aoi_order, aoi_name) LEFT JOIN f0 USING (recording_id) LEFT JOIN hi USING (recording_id, aoi_name))"""
METRIC_CTES = [*ASSIGNED, METRICS]


def metric_rows(spark, sf):
    durations = ft.base_features(samples(spark, sf)).select(R, "duration_ms")
    return aoi.metrics(assigned(spark, sf), NAMES, durations)


query("A4_aoi_metrics", R + " aoi_name", "ttff_ms dwell_ms dwell_prop mean_fixation_duration",
      "fixation_count visit_count revisit_count", METRIC_CTES, "am")(metric_rows)
query("A5_visit_count", R + " aoi_name", "", "visit_count revisit_count", METRIC_CTES, "am")(metric_rows)

TRANSITIONS = f"""
lk AS (SELECT *, lag(aoi_name) OVER (PARTITION BY recording_id ORDER BY event_index) AS source FROM fx WHERE aoi_name IS NOT NULL),
tc AS (SELECT recording_id, source, aoi_name AS target, count(*) AS c FROM lk WHERE source <> aoi_name GROUP BY 1, 2, 3),
tm AS (SELECT recording_id, s.aoi_name AS source, t.aoi_name AS target, coalesce(c, 0) AS transitions,
    coalesce(c / sum(c) OVER (PARTITION BY recording_id, s.aoi_name), 0) AS probability
  FROM (SELECT DISTINCT recording_id FROM g) r CROSS JOIN (VALUES {VALUES}) s(o, aoi_name) CROSS JOIN (VALUES {VALUES}) t(o, aoi_name)
  LEFT JOIN tc ON tc.recording_id = r.recording_id AND tc.source = s.aoi_name AND tc.target = t.aoi_name)"""


@query("A6_transition_matrix", R + " source target", "probability", "transitions", [*ASSIGNED, TRANSITIONS.replace("SELECT recording_id, s.aoi_name", "SELECT r.recording_id, s.aoi_name").replace("PARTITION BY recording_id, s.", "PARTITION BY r.recording_id, s.")], "tm")
def a6(spark, sf):
    return aoi.transition_matrix(assigned(spark, sf), NAMES, recordings(spark, sf))


WIDE_NUM = " ".join(f"{n}_{m}" for n in NAMES for m in ("ttff_ms", "dwell_ms", "dwell_prop"))
WIDE_CNT = " ".join(f"{n}_{m}" for n in NAMES for m in ("visit_count", "fixation_count"))
WIDE = "aw AS (SELECT recording_id, " + ", ".join(
    f"max({m}) FILTER (aoi_name = '{n}') AS {n}_{m}" for n in NAMES for m in aoi.METRIC_SUFFIXES) + " FROM am GROUP BY 1)"


@query("A7_batch_aoi_columns", R, WIDE_NUM, WIDE_CNT, [*METRIC_CTES, WIDE], "aw")
def a7(spark, sf):
    return aoi.wide_columns(metric_rows(spark, sf), NAMES)


@query("A8_aoi_columns_to_metrics", R + " aoi_name", "ttff_ms dwell_ms dwell_prop mean_fixation_duration",
       "fixation_count visit_count revisit_count", METRIC_CTES, "am")
def a8(spark, sf):
    return aoi.from_wide_columns(aoi.wide_columns(metric_rows(spark, sf), NAMES))


HIGHLIGHTS = """
hl AS (SELECT recording_id, arg_max(aoi_name, (dwell_ms, -aoi_order)) AS top_dwell, max(dwell_ms) AS top_dwell_ms,
    arg_min(aoi_name, (ttff_ms, aoi_order)) FILTER (ttff_ms IS NOT NULL) AS fastest, min(ttff_ms) AS fastest_ms,
    arg_max(aoi_name, (revisit_count, -aoi_order)) AS top_revisit, max(revisit_count) AS top_revisits,
    arg_max(aoi_name, (ttff_ms, -aoi_order)) FILTER (ttff_ms IS NOT NULL) AS slowest, max(ttff_ms) AS slowest_ms,
    coalesce(max(ttff_ms) > 1500, FALSE) AS slow_entry FROM am GROUP BY 1)"""


@query("A9_aoi_highlights", R + " top_dwell fastest top_revisit slowest slow_entry", "top_dwell_ms fastest_ms slowest_ms", "top_revisits",
       [*METRIC_CTES, HIGHLIGHTS], "hl")
def a9(spark, sf):
    return aoi.highlights(metric_rows(spark, sf))


# grids ------------------------------------------------------------------------------

HIST = """
ex AS (SELECT recording_id, min(x) AS x0, max(x) - min(x) AS xs, min(y) AS y0, max(y) - min(y) AS ys FROM g WHERE valid GROUP BY 1),
hb AS (SELECT g.recording_id, least(floor((x - x0) / xs * 40), 39) AS bin_x, least(floor((y - y0) / ys * 40), 39) AS bin_y
  FROM g JOIN ex USING (recording_id) WHERE valid),
hh AS (SELECT recording_id, bin_x, bin_y, count(*) AS n FROM hb GROUP BY 1, 2, 3)"""


@query("H1_gaze_hist2d", R, "", "bin_x bin_y n", [sql.GAZE, HIST], "hh")
def h1(spark, sf):
    return grid.gaze_histogram(samples(spark, sf))


BINS = 140
SEEDS = """
sd AS (SELECT recording_id, event_index, centroid_x AS x, centroid_y AS y,
    greatest(duration_ms, 40) / greatest(median(duration_ms) OVER (PARTITION BY recording_id), 40) AS weight
  FROM ev WHERE kind = 'fixation' AND centroid_x IS NOT NULL)"""


def fixations(spark, sf):
    return ev.fixation_table(threshold_events(spark, sf))


@query("H2_fixation_seeds", R, "x y weight", "event_index", [*sql.BASE_EVENTS, SEEDS], "sd")
def h2(spark, sf):
    return grid.fixation_seeds(fixations(spark, sf))


EXTENT = """
xt AS (SELECT recording_id, min(x) - greatest((max(x) - min(x)) * 0.18, 120.0) AS x0, max(x) + greatest((max(x) - min(x)) * 0.18, 120.0) AS x1,
    min(y) - greatest((max(y) - min(y)) * 0.2, 120.0) AS y0, max(y) + greatest((max(y) - min(y)) * 0.2, 120.0) AS y1
  FROM g WHERE valid GROUP BY 1)"""


def density_sql(dst, seeds, sigma=None):
    sx = sigma or "greatest((x1 - x0) * 0.032, 24.0)"
    sy = sigma or "greatest((y1 - y0) * 0.032, 24.0)"
    return f"""
{dst} AS (SELECT recording_id, gy, gx, sum(weight * exp(-(pow(x0 + gx * (x1 - x0) / {BINS - 1} - x, 2) / (2 * pow({sx}, 2))
    + pow(y0 + gy * (y1 - y0) / {BINS - 1} - y, 2) / (2 * pow({sy}, 2))))) AS s
  FROM {seeds} JOIN xt USING (recording_id), range({BINS}) a(gy), range({BINS}) b(gx) GROUP BY 1, 2, 3)"""


DENSITY = [*sql.BASE_EVENTS, SEEDS, EXTENT, density_sql("kd0", "sd"),
           "kd AS (SELECT recording_id, gy, gx, s / max(s) OVER (PARTITION BY recording_id) AS s FROM kd0)"]


def density(spark, sf, fixation_sigma=None):
    return grid.attention_density(fixations(spark, sf), samples(spark, sf), BINS, fixation_sigma)


@query("H3_attention_kde", R, "s", "gy gx", DENSITY, "kd")
def h3(spark, sf):
    return grid.to_cells(density(spark, sf))


def blur_sql(passes):
    ctes, src = [], "kd"
    for k in range(passes):
        for axis, other in (("gy", "gx"), ("gx", "gy")):
            dst = f"bl_{k}_{axis}"
            ctes.append(f"""{dst} AS (SELECT recording_id, gy, gx, (lag(s, 2, 0.0) OVER w + 4 * lag(s, 1, 0.0) OVER w + 6 * s
  + 4 * lead(s, 1, 0.0) OVER w + lead(s, 2, 0.0) OVER w) / 16 AS s FROM {src} WINDOW w AS (PARTITION BY recording_id, {other} ORDER BY {axis}))""")
            src = dst
    ctes.append(f"""cu AS (SELECT recording_id, gy, gx, CASE WHEN s < quantile_cont(s, 0.18) FILTER (s > 0) OVER (PARTITION BY recording_id) THEN 0.0 ELSE s END AS s FROM {src})""")
    return ctes


@query("H4_smooth_density", R, "s", "gy gx", [*DENSITY, *blur_sql(3)], "cu")
def h4(spark, sf):
    return grid.to_cells(grid.cut_low(grid.smooth_density(density(spark, sf), 3)))


SCANPATH = """
sp0 AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY event_index) AS "order" FROM ev WHERE kind = 'fixation'),
sp AS (SELECT recording_id, "order", centroid_x AS x, centroid_y AS y, duration_ms,
    18.0 + 24.0 * (greatest(duration_ms, 1.0) / max(greatest(duration_ms, 1.0)) OVER u) AS marker_size,
    coalesce((row_number() OVER w - 1) / nullif(count(*) OVER u - 1, 0), 0) AS progress
  FROM sp0 WHERE centroid_x IS NOT NULL WINDOW u AS (PARTITION BY recording_id), w AS (PARTITION BY recording_id ORDER BY event_index)),
sq AS (SELECT * EXCLUDE ("order"), "order" AS place FROM sp)"""


@query("H5_fixation_scanpath", R, "x y duration_ms marker_size progress", "place", [*sql.BASE_EVENTS, SCANPATH], "sq")
def h5(spark, sf):
    return grid.fixation_scanpath(fixations(spark, sf)).withColumnRenamed("order", "place")


SUMMARY = f"""
gs AS (SELECT recording_id, sum(s) AS total_mass, avg(s) AS mean_saliency, max(s) AS peak_saliency,
    arg_max(gy, (round(s, 9), -gy, -gx)) AS peak_y, arg_max(gx, (round(s, 9), -gy, -gx)) AS peak_x,
    sum(s * gx) / sum(s) AS attention_center_x, sum(s * gy) / sum(s) AS attention_center_y,
    avg(CASE WHEN s >= 0.75 THEN 1.0 ELSE 0.0 END) AS hotspot_ratio FROM kd GROUP BY 1),
ge AS (SELECT recording_id, -sum(s / total_mass * log2(s / total_mass + 1e-12)) / log2(count(*)) AS entropy
  FROM kd JOIN gs USING (recording_id) GROUP BY 1),
gz AS (SELECT gs.*, entropy FROM gs JOIN ge USING (recording_id))"""


@query("H6_grid_summary", R, "total_mass mean_saliency peak_saliency attention_center_x attention_center_y hotspot_ratio entropy", "peak_y peak_x",
       [*DENSITY, SUMMARY], "gz")
def h6(spark, sf):
    return grid.grid_summary(density(spark, sf))


NORMAL = """
rl AS (SELECT recording_id, quantile_cont(s, 0.02) AS lo, quantile_cont(s, 0.98) AS hi, max(s) AS peak FROM kd GROUP BY 1),
rn AS (SELECT recording_id, gy, gx, CASE WHEN hi <= lo + 1e-8 THEN s / peak ELSE (least(greatest(s, lo), hi) - lo) / (hi - lo) END AS s
  FROM kd JOIN rl USING (recording_id))"""


@query("H7_robust_normalize", R, "s", "gy gx", [*DENSITY, NORMAL], "rn")
def h7(spark, sf):
    return grid.to_cells(grid.robust_normalize(density(spark, sf)))


COMPARE = [
    "s1 AS (SELECT recording_id, x, y, 1.0 AS weight FROM sd)",
    density_sql("q0", "s1", 28.0),
    f"""ht AS (SELECT recording_id, greatest(least(round_even((y - y0) / (y1 - y0) * {BINS - 1}, 0), {BINS - 1}), 0) AS gy,
    greatest(least(round_even((x - x0) / (x1 - x0) * {BINS - 1}, 0), {BINS - 1}), 0) AS gx FROM sd JOIN xt USING (recording_id)),
mp AS (SELECT recording_id, avg(s) AS m, stddev_pop(s) AS d, sum(greatest(s, 1e-12)) AS mass FROM kd GROUP BY 1),
ns AS (SELECT recording_id, avg((s - m) / d) AS nss_mean, stddev_pop((s - m) / d) AS nss_std
  FROM ht JOIN kd USING (recording_id, gy, gx) JOIN mp USING (recording_id) GROUP BY 1),
qt AS (SELECT recording_id, sum(s) AS t FROM q0 GROUP BY 1),
pq AS (SELECT recording_id, greatest(kd.s, 1e-12) / mass AS p, q0.s / t AS q
  FROM kd JOIN q0 USING (recording_id, gy, gx) JOIN mp USING (recording_id) JOIN qt USING (recording_id)),
cm AS (SELECT recording_id, sum(least(p, q)) AS sim, sum(CASE WHEN q > 0 THEN q * ln(q / p) ELSE 0.0 END) AS kl_divergence FROM pq GROUP BY 1),
mf AS (SELECT * FROM ns JOIN cm USING (recording_id))""",
]


@query("H8_map_vs_fixations", R, "nss_mean nss_std sim kl_divergence", "", [*DENSITY, *COMPARE], "mf")
def h8(spark, sf):
    return grid.map_vs_fixations(density(spark, sf, fixation_sigma=28.0))
