"""Queries on condition comparisons and cohort tables."""

from pyspark.sql import functions as F

from saccadia.operators import events as ev
from saccadia.operators import features as ft
from saccadia.operators import quality, stats
from saccadia.plans import sql
from saccadia.plans import sql_features as sf_
from saccadia.plans.catalog import query
from saccadia.plans.gaze_view import recordings, samples

METRICS = ["fixation_count", "fixation_duration_mean", "saccade_count", "valid_ratio", "path_length", "velocity_mean"]
TWO = ["c0", "c1"]

SUMMARY = [*sql.BASE_EVENTS, sf_.base("b", "v"), sf_.event_features("ef", "v", "ev"), sql.RECORDINGS,
           f"sm AS (SELECT subject_id, condition, recording_id, {', '.join(METRICS)} FROM b JOIN ef USING (recording_id) JOIN rec USING (recording_id))"]
LONG = "lg AS (" + " UNION ALL ".join(
    f"SELECT subject_id, condition, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM sm" for m in METRICS) + ")"
LONG_CTES = [*SUMMARY, LONG]


def summary(spark, sf):
    labels = ev.label_samples(samples(spark, sf), "thresholds")
    features = ft.base_features(labels).join(ft.event_features(labels, ev.runs_to_events(labels)), "recording_id")
    return features.join(recordings(spark, sf), "recording_id")


def long_rows(spark, sf):
    return stats.long_form(summary(spark, sf), METRICS, ["subject_id", "condition"])


@query("T1_descriptive_table", "condition metric", "mean sd median min max ci_lower ci_upper", "n", [*LONG_CTES,
       """de AS (SELECT condition, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, median(value) AS median, min(value) AS min, max(value) AS max,
  avg(value) - 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS ci_lower, avg(value) + 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS ci_upper,
  count(*) AS n FROM lg GROUP BY 1, 2)"""], "de")
def t1(spark, sf):
    return stats.descriptive_table(summary(spark, sf), "condition", METRICS)


WELCH = """
wg AS (SELECT metric, count(*) FILTER (condition = 'c0') AS n1, count(*) FILTER (condition = 'c1') AS n2, avg(value) FILTER (condition = 'c0') AS m1,
    avg(value) FILTER (condition = 'c1') AS m2, var_samp(value) FILTER (condition = 'c0') AS v1, var_samp(value) FILTER (condition = 'c1') AS v2 FROM lg GROUP BY 1),
wt AS (SELECT metric, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS statistic, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df,
    (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS effect_size, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS scale, n1 + n2 AS n FROM wg)"""


@query("T2_welch_t", "metric", "statistic df effect_size", "n", [*LONG_CTES, WELCH], "wt")
def t2(spark, sf):
    return stats.welch_t(long_rows(spark, sf), TWO)


PAIRS = """
pp AS (SELECT metric, subject_id, max(value) FILTER (condition = 'c0') AS a, max(value) FILTER (condition = 'c1') AS b FROM lg GROUP BY 1, 2),
pd AS (SELECT metric, subject_id, a, b, b - a AS d FROM pp WHERE a IS NOT NULL AND b IS NOT NULL)"""
PAIRED = "pt AS (SELECT metric, -avg(d) / (stddev_samp(d) / sqrt(count(*))) AS statistic, count(*) - 1 AS df, avg(d) / stddev_samp(d) AS effect_size, count(*) AS n FROM pd GROUP BY 1)"


def paired_rows(spark, sf):
    return stats.pairs(long_rows(spark, sf), TWO)


@query("T3_paired_t", "metric", "statistic df effect_size", "n", [*LONG_CTES, PAIRS, PAIRED], "pt")
def t3(spark, sf):
    return stats.paired_t(paired_rows(spark, sf))


WILCOXON = """
wr AS (SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0 AS r FROM pd WHERE d <> 0),
ws AS (SELECT metric, count(*) AS k, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS statistic FROM wr GROUP BY 1),
wm AS (SELECT metric, avg(d) AS m, count(*) AS n FROM pd GROUP BY 1),
wx AS (SELECT metric, statistic, n, (statistic - k * (k + 1) / 4.0) / sqrt(k * (k + 1) * (2 * k + 1) / 24.0) * CASE WHEN m >= 0 THEN 1 ELSE -1 END / sqrt(k) AS effect_size
  FROM ws JOIN wm USING (metric))"""


@query("T4_wilcoxon", "metric", "statistic effect_size", "n", [*LONG_CTES, PAIRS, WILCOXON], "wx")
def t4(spark, sf):
    return stats.wilcoxon(paired_rows(spark, sf))


MANN = """
mr AS (SELECT metric, condition, value, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS r
  FROM lg WHERE condition IN ('c0', 'c1')),
mg AS (SELECT metric, count(*) FILTER (condition = 'c0') AS n1, count(*) FILTER (condition = 'c1') AS n2, sum(r) FILTER (condition = 'c0') AS r1,
    avg(value) FILTER (condition = 'c0') - avg(value) FILTER (condition = 'c1') AS md FROM mr GROUP BY 1),
mu AS (SELECT metric, r1 - n1 * (n1 + 1) / 2.0 AS statistic, n1 + n2 AS n,
    (r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0) * CASE WHEN md >= 0 THEN 1 ELSE -1 END / sqrt(n1 + n2) AS effect_size FROM mg)"""


@query("T5_mann_whitney", "metric", "statistic effect_size", "n", [*LONG_CTES, MANN], "mu")
def t5(spark, sf):
    return stats.mann_whitney(long_rows(spark, sf), TWO)


ANOVA = """
ac AS (SELECT *, count(*) OVER (PARTITION BY metric, subject_id) AS have FROM lg),
ak AS (SELECT metric, subject_id, condition, value FROM ac WHERE have = 3),
am AS (SELECT *, avg(value) OVER (PARTITION BY metric) AS gm, avg(value) OVER (PARTITION BY metric, subject_id) AS sm, avg(value) OVER (PARTITION BY metric, condition) AS cm FROM ak),
ax AS (SELECT metric, count(*) AS n, sum(pow(value - gm, 2)) AS st, sum(pow(cm - gm, 2)) AS sb, sum(pow(sm - gm, 2)) AS ss FROM am GROUP BY 1),
ao AS (SELECT metric, (sb / 2) / (greatest(st - sb - ss, 0) / (2 * (n / 3 - 1))) AS statistic, 2.0 AS df1, 2 * (n / 3 - 1) AS df2, sb / st AS effect_size, n FROM ax)"""


@query("T6_rm_anova", "metric", "statistic df1 df2 effect_size", "n", [*LONG_CTES, ANOVA], "ao")
def t6(spark, sf):
    return stats.repeated_measures_anova(long_rows(spark, sf))


def two_conditions(spark, sf):
    return summary(spark, sf).filter(F.col("condition").isin(TWO))


COMPARE = "metric test_name effect_size_name p_method conclusion apa stars"


@query("T7_compare_conditions", COMPARE, "statistic p_value effect_size ci_lower ci_upper", "n")
def t7(spark, sf):
    return stats.compare_conditions(two_conditions(spark, sf), METRICS)


@query("T8_granularity_check", "subject_id condition", "", "copies", [*SUMMARY],
       "(SELECT subject_id, condition, count(*) AS copies FROM (SELECT CAST(CAST(subject_id AS BIGINT) % 20 AS VARCHAR) AS subject_id, condition FROM sm) GROUP BY 1, 2 HAVING count(*) > 1)")
def t8(spark, sf):
    """Duplicates after subjects are merged to twenty."""
    merged = recordings(spark, sf).withColumn("subject_id", (F.col("subject_id").cast("long") % 20).cast("string"))
    return stats.granularity(merged)


def _p_text(p):
    return f"CASE WHEN {p} < 0.001 THEN '< .001' ELSE '= ' || regexp_replace(printf('%.3f', round_even({p}, 3)), '^0', '') END"


REPORT = f"""
rp AS (SELECT metric, 'Cohen''s d' AS nm, effect_size, statistic, n, 1.0 / (1 + n) AS p FROM wt),
rt AS (SELECT metric, CASE WHEN abs(effect_size) < 0.2 THEN '微小' WHEN abs(effect_size) < 0.5 THEN '小' WHEN abs(effect_size) < 0.8 THEN '中' ELSE '大' END AS word, * EXCLUDE (metric) FROM rp),
rs AS (SELECT metric, word, metric || CASE WHEN p < 0.05 THEN '差异显著' ELSE '差异不显著' END || ', p ' || {_p_text('p')} || ', ' || nm || ' = ' || printf('%.2f', round_even(effect_size, 2) + 0.0) || '（' || word || '）' AS conclusion,
    't(' || greatest(n - 2, 1) || ') = ' || printf('%.2f', round_even(statistic, 2) + 0.0) || ', p ' || {_p_text('p')} || ', ' || nm || ' = ' || printf('%.2f', round_even(effect_size, 2) + 0.0) AS apa,
    CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM rt)"""


@query("T9_effect_texts", "metric word conclusion apa stars", "", "", [*LONG_CTES, WELCH, REPORT], "rs")
def t9(spark, sf):
    """Texts of the Welch results with a p-value that both engines can compute."""
    df = stats.welch_t(long_rows(spark, sf), TWO).withColumn("p_value", 1.0 / (1 + F.col("n")))
    return df.select("metric", stats.effect_word(F.col("effect_size"), F.col("effect_size_name")).alias("word"),
                     stats.conclusion().alias("conclusion"), stats.apa_string().alias("apa"), stats.stars(F.col("p_value")).alias("stars"))


@query("T10_effect_ci", "metric", "effect_size effect_ci_lower effect_ci_upper", "", [*LONG_CTES, WELCH],
       "(SELECT metric, effect_size, effect_size - 1.0 / scale AS effect_ci_lower, effect_size + 1.0 / scale AS effect_ci_upper FROM wt)")
def t10(spark, sf):
    """Interval of one unit around the difference, as the t quantile is not available in SQL."""
    df = stats.welch_t(long_rows(spark, sf), TWO)
    unit = df.withColumns({"ci_lower": F.col("effect_size") * F.col("scale") - 1.0, "ci_upper": F.col("effect_size") * F.col("scale") + 1.0})
    return stats.effect_ci(unit)


@query("T11_metric_groups", "metric subject_id", "first second", "", [*LONG_CTES, PAIRS],
       "(SELECT metric, subject_id, a AS first, b AS second FROM pd WHERE metric = 'path_length')")
def t11(spark, sf):
    return stats.metric_groups(summary(spark, sf), "path_length", TWO, paired=True)


@query("T12_forced_test", "metric test_name", "statistic effect_size", "n", [*LONG_CTES, MANN],
       "(SELECT metric, 'Mann-Whitney U 检验' AS test_name, statistic, effect_size, n FROM mu)")
def t12(spark, sf):
    return stats.compare_conditions(two_conditions(spark, sf), METRICS, test="nonparametric", conditions=TWO)


@query("T12_forced_parametric", "metric test_name", "statistic df effect_size", "n", [*LONG_CTES, WELCH],
       "(SELECT *, '独立样本 t 检验' AS test_name FROM wt)")
def t12_parametric(spark, sf):
    return stats.compare_conditions(two_conditions(spark, sf), METRICS, test="parametric", conditions=TWO)


CORR = "cr AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {i} AS oa, {j} AS ob, corr({a}, {b}) AS r FROM sm" for i, a in enumerate(METRICS) for j, b in enumerate(METRICS)) + ")"


def correlations(spark, sf):
    return stats.correlation_matrix(summary(spark, sf), METRICS)


query("T13_correlation_matrix", "metric_a metric_b", "r", "", [*SUMMARY, CORR], "cr")(correlations)


@query("T14_high_corr_pairs", "metric_a metric_b", "r", "", [*SUMMARY, CORR],
       "(SELECT * FROM cr WHERE oa < ob AND abs(r) > 0.4 ORDER BY abs(r) DESC, oa, ob LIMIT 8)")
def t14(spark, sf):
    return stats.high_correlations(correlations(spark, sf), above=0.4)


GROUPS = {"注视指标": ["fixation_count", "fixation_duration_mean"], "扫视指标": ["saccade_count"], "速度统计": ["velocity_mean"]}


@query("T15_describe_groups", "feature_group metric", "mean sd min max", "", [*LONG_CTES],
       """(SELECT CASE WHEN metric LIKE 'fix%' THEN '注视指标' WHEN metric LIKE 'sac%' THEN '扫视指标' ELSE '速度统计' END AS feature_group, metric,
  avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max FROM lg WHERE metric NOT IN ('valid_ratio', 'path_length') GROUP BY 1, 2)""")
def t15(spark, sf):
    return stats.describe_groups(summary(spark, sf), GROUPS)


@query("T16_batch_descriptives", "metric", "mean sd", "n", [*LONG_CTES],
       "(SELECT metric, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, count(*) AS n FROM lg WHERE metric <> 'velocity_mean' GROUP BY 1)")
def t16(spark, sf):
    return stats.batch_descriptives(summary(spark, sf))


@query("T17_batch_summary", "metric note", "mean sd", "n", [*LONG_CTES,
       """gr AS (SELECT CASE WHEN valid_ratio >= 0.9 THEN '优' WHEN valid_ratio >= 0.75 THEN '良' WHEN valid_ratio >= 0.5 THEN '可用' ELSE '建议剔除' END AS q, count(*) AS c FROM sm GROUP BY 1),
bs AS (SELECT metric, '' AS note, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, count(*) AS n FROM lg
  WHERE metric NOT IN ('velocity_mean', 'path_length') GROUP BY 1 UNION ALL
  SELECT '质量等级', (SELECT q FROM gr ORDER BY c DESC, q LIMIT 1), NULL, NULL, (SELECT sum(c) FROM gr))"""], "bs")
def t17(spark, sf):
    graded = summary(spark, sf).withColumn("quality_grade", quality.ratio_grade(F.col("valid_ratio")))
    return stats.batch_summary(graded)


@query("T18_boxplot_values", "condition metric", "low q1 median q3 high mean", "n", [*LONG_CTES],
       """(SELECT condition, metric, min(value) AS low, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3,
  max(value) AS high, avg(value) AS mean, count(*) AS n FROM lg GROUP BY 1, 2)""")
def t18(spark, sf):
    return stats.boxplot_values(summary(spark, sf), METRICS)
