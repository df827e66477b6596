"""Queries on batches, anomalies and report texts."""

from pyspark.sql import functions as F

from saccadia.functions import insight_texts as texts
from saccadia.operators import insight, stats
from saccadia.plans import sql
from saccadia.plans import sql_features as sf_
from saccadia.plans.catalog import query
from saccadia.plans.gaze_view import raw_samples, recordings
from saccadia.plans.queries_features import PIPELINE, R
from saccadia.plans.queries_space import AREAS, GRADE, NAMES, metric_rows
from saccadia.plans.queries_stats import METRICS, SUMMARY, TWO, summary
from saccadia.sources import readers

BATCH = f"""
br AS (SELECT recording_id, {', '.join(sf_.BASE_NUM.split() + sf_.EVENT_NUM.split() + sf_.COUNTS.split())},
    {GRADE.format(r='valid_ratio')} AS quality_grade, CAST(NULL AS VARCHAR) AS error FROM fp WHERE recording_id <> '3'
  UNION ALL SELECT '3', {', '.join('NULL' for _ in sf_.BASE_NUM.split() + sf_.EVENT_NUM.split() + sf_.COUNTS.split())}, NULL, 'sample without a valid timestamp'
  UNION ALL SELECT 'absent', {', '.join('NULL' for _ in sf_.BASE_NUM.split() + sf_.EVENT_NUM.split() + sf_.COUNTS.split())}, NULL, 'file not found')"""
BATCH_NUM = sf_.BASE_NUM + " " + sf_.EVENT_NUM


def batch(spark, sf):
    """Every recording as a file; one of them has a broken time, and one file does not exist."""
    df = raw_samples(spark, sf)
    broken = (F.col(R) == "3") & (F.col("sample_seq") % 7 == 0)
    out = df.select(
        F.col(R).alias("rec"), F.when(broken, "broken").otherwise(F.col("timestamp_ms").cast("string")).alias("timestamp_ms"),
        "x", "y", "pupil", "valid", "marker", "event_label", "trial",
    )
    base = readers.scratch_dir(spark, "batch")
    readers.write_recordings(out, "rec", base)
    found = insight.analyze_files(spark, [f"{base}/rec=absent/none.csv"], folders=[base], window_ms=500.0)
    name = F.regexp_extract(R, r"rec=(\w+)", 1)
    return found.withColumn("error", F.regexp_extract("error", r"^(file not found|[^:]+)", 1)).withColumn(R, name)


query("B1_batch_analyze", R + " quality_grade error", BATCH_NUM, sf_.COUNTS, [*PIPELINE, BATCH], "br")(batch)


@query("B2_successful_rows", R + " error", "valid_ratio", "", [sql.GAZE],
       "(SELECT recording_id, CAST(NULL AS VARCHAR) AS error, avg(CAST(valid AS DOUBLE)) AS valid_ratio FROM g GROUP BY 1 HAVING avg(CAST(valid AS DOUBLE)) >= 0.75)")
def b2(spark, sf):
    rows = raw_samples(spark, sf).groupBy(R).agg(F.avg(F.col("valid").cast("double")).alias("valid_ratio"))
    flagged = rows.withColumn("error", F.when(F.col("valid_ratio") < 0.75, "too many lost samples"))
    return insight.successful_rows(flagged)


FEATURES = [*sql.BASE_EVENTS, sf_.base("b", "v"), sf_.event_features("ef", "v", "ev"), sf_.pupil("pu", "v"),
            "ff AS (SELECT * FROM b JOIN ef USING (recording_id) LEFT JOIN pu USING (recording_id))"]


def features(spark, sf):
    from saccadia.operators import events as ev
    from saccadia.operators import features as ft
    from saccadia.plans.queries_features import labelled

    labels = labelled(spark, sf)
    base = ft.base_features(labels).join(ft.event_features(labels, ev.runs_to_events(labels)), R)
    return base.join(ft.pupil_features(labels), R, "left")


def _fixed(c, d):
    return f"printf('%.{d}f', round_even({c}, {d}) + 0.0)"


def _anomaly_arms():
    arms = []
    for k, (name, s) in enumerate(texts.THRESHOLDS.items()):
        cases = []
        for limit, direction, severity, op in (("critical_low", "low", "critical", "<"), ("low", "low", "warning", "<"),
                                               ("critical_high", "high", "critical", ">"), ("high", "high", "warning", ">")):
            if limit in s:
                cases.append((f"{name} {op} {s[limit]}", direction, severity))
        direction = " ".join(f"WHEN {c} THEN '{d}'" for c, d, _ in cases)
        severity = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
        arms.append(f"SELECT recording_id, {k} AS feature_order, '{name}' AS feature, CAST({name} AS DOUBLE) AS value, CASE {direction} END AS direction, "
                    f"CASE {severity} END AS severity, '{s['desc']}，实测 ' || {_fixed(name, 2)} || '{s['unit']}' AS threshold_ref FROM ff")
    return "an AS (SELECT * FROM (" + " UNION ALL ".join(arms) + ") WHERE direction IS NOT NULL)"


@query("B3_feature_anomalies", R + " feature direction severity threshold_ref", "value", "feature_order", [*FEATURES, _anomaly_arms()], "an")
def b3(spark, sf):
    return insight.feature_anomalies(features(spark, sf))


def _rule_case(which):
    arms = " ".join(f"WHEN feature = '{f}' AND direction = '{d}' THEN '{t[which]}'" for (f, d), t in texts.ANOMALY_RULES.items() if t[which])
    return f"CASE {arms} END"


HYPOTHESES = f"""
ar AS (SELECT *, {_rule_case(0)} AS hyp, {_rule_case(1)} AS rec FROM an),
ah AS (SELECT recording_id, CASE WHEN bool_or(severity = 'critical') THEN '存在严重异常指标' ELSE '存在轻度异常指标' END || '（' || string_agg(feature, '、' ORDER BY feature_order)
    || '）。' || coalesce(string_agg(hyp, '；' ORDER BY feature_order), '') || '。' AS hypothesis, coalesce(string_agg(rec, '|' ORDER BY feature_order), '') AS advice FROM ar GROUP BY 1),
hy AS (SELECT ff.recording_id, coalesce(hypothesis, '{texts.NO_ANOMALY}') AS hypothesis, coalesce(advice, '') AS advice FROM ff LEFT JOIN ah USING (recording_id))"""


@query("B4_anomaly_hypothesis", R + " hypothesis advice", "", "", [*FEATURES, _anomaly_arms(), HYPOTHESES], "hy")
def b4(spark, sf):
    return insight.anomaly_hypotheses(features(spark, sf)).withColumn("advice", F.concat_ws("|", "recommendations"))


def _interpret_arm(name, lang):
    t = texts
    spec = t.THRESHOLDS[name]
    low, high = (t.POOR_RATIO, t.GOOD_RATIO) if name == "valid_ratio" else (spec["low"], spec["high"])
    d, suffix = t.VALUE_FORMATS[name]
    scaled = f"{name} * 100.0" if suffix == "%" else name
    label, pieces = t.METRIC_LABELS[lang][name], ((" is ", ", which is ", ". ") if lang == "en" else ("为", "，", "。"))
    level = f"CASE WHEN {name} < {low} THEN 'low' WHEN {name} > {high} THEN 'high' ELSE 'normal' END"

    def words(table):
        return "CASE " + level + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE '' END"

    meaning = t.MEANINGS[lang].get(name)
    return (f"SELECT recording_id, '{name}' AS metric, {level} AS level, '{label}{pieces[0]}' || {_fixed(scaled, d)} || '{suffix}{pieces[1]}' || {words(t.LEVELS[lang])} "
            f"|| '{pieces[2]}' || {words(meaning) if meaning else chr(39) * 2} AS text FROM ff")


INTERPRETED = ["valid_ratio", "fixation_count", "fixation_duration_mean", "saccade_amplitude_mean", "blink_rate_hz"]


@query("B5_interpret_metric", R + " metric level text", "", "", [*FEATURES, "im AS (" + " UNION ALL ".join(
    _interpret_arm(n, lang) for n in INTERPRETED for lang in ("zh", "en")) + ")"], "im")
def b5(spark, sf):
    found = features(spark, sf)
    return insight.interpret_metrics(found, INTERPRETED, "zh").union(insight.interpret_metrics(found, INTERPRETED, "en"))


@query("B6_insight_sections", R + " section heading body", "", "section_order")
def b6(spark, sf):
    found = features(spark, sf)
    results = stats.compare_conditions(summary(spark, sf).filter(F.col("condition").isin(TWO)), METRICS, test="parametric", conditions=TWO)
    context = {"name": "settings", "product": "phone", "design_type": "within-subject"}
    return insight.insight_sections(found, context, results, metric_rows(spark, sf), explain_anomalies=True, lang="zh")


@query("B7_quality_note", R + " note", "", "", [*FEATURES,
       f"""nt AS (SELECT recording_id, '有效追踪率为' || {_fixed('valid_ratio * 100.0', 1)} || '%，质量等级为“' || {GRADE.format(r='valid_ratio')} || '”。' ||
  CASE WHEN valid_ratio < 0.5 THEN '{texts.QUALITY_TAILS['zh']['poor']}' WHEN valid_ratio >= 0.9 THEN '{texts.QUALITY_TAILS['zh']['good']}' ELSE '{texts.QUALITY_TAILS['zh']['usable']}' END AS note FROM ff)"""], "nt")
def b7(spark, sf):
    return features(spark, sf).select(R, insight.quality_note(F.col("valid_ratio")).alias("note"))
