"""Condition comparisons and descriptive tables over subject × condition summaries.

All metrics are tested in one plan in long form (metric, subject, condition, value).
Conditions are ordered by value; of two conditions the smaller is the first group.
Ranks and medians come from counted values, so a condition may have any number of subjects.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions import distributions as dist
from saccadia.functions.ordered import join_small
from saccadia.functions.ranks import average_rank, quantiles, value_counts
from saccadia.functions.storage import materialize
from saccadia.operators.quality import fixed

# Test names, effect words, conclusion words.
WELCH, PAIRED, WILCOXON, MANN_WHITNEY, RM_ANOVA = (
    "独立样本 t 检验", "配对样本 t 检验", "Wilcoxon 符号秩检验", "Mann-Whitney U 检验", "重复测量方差分析",
)
COHEN, RANK_R, ETA = "Cohen's d", "r", "eta_sq"
EFFECT_WORDS = ["微小", "小", "中", "大"]
EFFECT_LIMITS = {COHEN: [0.2, 0.5, 0.8], RANK_R: [0.1, 0.3, 0.5], ETA: [0.01, 0.06, 0.14]}
SIGNIFICANT, NOT_SIGNIFICANT = "差异显著", "差异不显著"

EXACT_PAIRS = 50
EXACT_GROUP = 8
# Royston's polynomials for the Shapiro-Wilk test (AS R94).
SW_C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_C3 = [0.544, -0.39978, 0.025054, -6.714e-4]
SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_C6 = [-0.4803, -0.082676, 0.0030302]
SW_G = [-2.273, 0.459]


def ratio(a: Column, b: Column) -> Column:
    """a/b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def long_form(summary: DataFrame, metrics: list[str], ids: list[str]) -> DataFrame:
    """(ids, metric, value) with finite values only; unreadable texts are left out."""
    types = dict(summary.dtypes)
    known = [m for m in metrics if m in types]
    typed = summary.select(
        *ids, *[(F.col(m).try_cast("double") if types[m] == "string" else F.col(m).cast("double")).alias(m) for m in known]
    )
    rows = typed.unpivot(ids, known, "metric", "value")
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def check_granularity(summary: DataFrame, subject: str = "subject_id", condition: str = "condition") -> DataFrame:
    """The summary itself; fails when a subject has two rows in one condition."""
    pairs = summary.groupBy(subject, condition).agg(F.count(F.lit(1)).alias("_copies"))
    ok = F.when(F.col("_copies") > 1, F.raise_error(F.lit("input must have one row per subject and condition")).cast("long")).otherwise(
        F.col("_copies")
    )
    checked = pairs.withColumn("_copies", ok)
    return summary.join(checked, [subject, condition]).filter("_copies = 1").drop("_copies")


def granularity(summary: DataFrame, subject: str = "subject_id", condition: str = "condition") -> DataFrame:
    """Subject-condition pairs that occur more than once."""
    return summary.groupBy(subject, condition).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def conditions_of(summary: DataFrame, condition: str = "condition", expected: int = 2) -> list:
    """The distinct conditions, sorted; fails if there are not ``expected`` of them."""
    rows = summary.select(condition).filter(F.col(condition).isNotNull()).distinct().limit(expected + 1).collect()
    if len(rows) != expected:
        raise ValueError(f"exactly {expected} conditions are needed; use the repeated-measures test for more")
    return sorted(r[0] for r in rows)


def descriptive_table(summary: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    rows = long_form(summary, metrics, [group])
    n = F.count("value")
    simple = rows.groupBy(group, "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        n.alias("n"),
    )
    margin = 1.96 * F.col("sd") / F.sqrt("n")
    return simple.join(quantiles(rows, [group, "metric"], "value", {"median": 0.5}), [group, "metric"]).withColumns(
        {"ci_lower": F.col("mean") - margin, "ci_upper": F.col("mean") + margin}
    )


def _groups(rows: DataFrame, condition: str, pair: list) -> dict[str, Column]:
    first, second = (F.when(F.col(condition) == c, F.col("value")) for c in pair)
    return {"1": first, "2": second}


def welch_t(rows: DataFrame, pair: list, condition: str = "condition") -> DataFrame:
    g = _groups(rows, condition, pair)
    df = rows.groupBy("metric").agg(
        *[agg(g[k]).alias(f"{n}{k}") for k in "12" for n, agg in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    ).filter("n1 >= 2 AND n2 >= 2")
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    diff, se = F.col("m1") - F.col("m2"), F.sqrt(e1 + e2)
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    freedom = ratio((e1 + e2) * (e1 + e2), e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    df = df.select(
        "metric",
        F.lit(WELCH).alias("test_name"),
        ratio(diff, se).alias("statistic"),
        freedom.alias("df"),
        F.coalesce(ratio(diff, pooled), F.lit(0.0)).alias("effect_size"),
        F.lit(COHEN).alias("effect_size_name"),
        diff.alias("mean_diff"),
        se.alias("_se"),
        (F.col("n1") + F.col("n2")).alias("n"),
        pooled.alias("scale"),
    )
    return _finish_t(df)


def _finish_t(df: DataFrame) -> DataFrame:
    margin = dist.t_quantile_975("df") * F.col("_se")
    return df.withColumns(
        {
            "p_value": dist.t_p_value("statistic", "df"),
            "ci_lower": F.col("mean_diff") - margin,
            "ci_upper": F.col("mean_diff") + margin,
            "p_method": F.lit("t"),
        }
    ).drop("_se", "mean_diff")


def pairs(rows: DataFrame, pair: list, subject: str = "subject_id", condition: str = "condition") -> DataFrame:
    """(metric, subject, first, second) for subjects with both conditions."""
    g = _groups(rows, condition, pair)
    both = rows.groupBy("metric", subject).agg(F.max(g["1"]).alias("first"), F.max(g["2"]).alias("second"))
    return both.filter("first IS NOT NULL AND second IS NOT NULL")


def paired_t(paired: DataFrame) -> DataFrame:
    """``d`` is second − first; the t statistic is of first − second, so their signs differ."""
    d = F.col("second") - F.col("first")
    df = paired.groupBy("metric").agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).filter("n >= 2")
    se = F.col("s") / F.sqrt("n")
    df = df.select(
        "metric",
        F.lit(PAIRED).alias("test_name"),
        ratio(-F.col("m"), se).alias("statistic"),
        (F.col("n") - 1).cast("double").alias("df"),
        F.coalesce(ratio(F.col("m"), F.col("s")), F.lit(0.0)).alias("effect_size"),
        F.lit(COHEN).alias("effect_size_name"),
        F.col("m").alias("mean_diff"),
        se.alias("_se"),
        "n",
        F.col("s").alias("scale"),
    )
    return _finish_t(df)


def _rank_columns(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.withColumns({"df": none, "effect_size_name": F.lit(RANK_R), "ci_lower": none, "ci_upper": none, "scale": none})


def wilcoxon(paired: DataFrame) -> DataFrame:
    """Signed-rank test, zeros dropped. p is exact up to 50 pairs without ties or zeros, else normal."""
    d = F.col("second") - F.col("first")
    diffs = paired.withColumn("_d", d)
    whole = diffs.groupBy("metric").agg(
        F.count("_d").alias("n"), F.avg("_d").alias("_mean"), F.count_if(F.col("_d") == 0).alias("_zeros")
    ).filter("n >= 2")
    ranks = value_counts(
        diffs.filter("_d <> 0").withColumn("_size", F.abs("_d")), ["metric"], "_size", {"_up": F.count_if(F.col("_d") > 0)}
    )
    sums = ranks.groupBy("metric").agg(
        F.sum(average_rank() * F.col("_up")).alias("_plus"),
        F.sum(average_rank() * (F.col("n") - F.col("_up"))).alias("_minus"),
        F.sum("n").alias("_k"),
        F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("_ties"),
    )
    df = whole.join(sums, "metric", "left").fillna(0, ["_plus", "_minus", "_k", "_ties"])
    k = F.col("_k").cast("double")
    w = F.least("_plus", "_minus")
    expected, spread = k * (k + 1) / 4.0, F.sqrt(k * (k + 1) * (2 * k + 1) / 24.0)
    sign = F.when(F.col("_mean") >= 0, 1.0).otherwise(-1.0)
    tied = F.sqrt(k * (k + 1) * (2 * k + 1) / 24.0 - F.col("_ties") / 48.0)
    exact = (k <= EXACT_PAIRS) & (F.col("_ties") == 0) & (F.col("_zeros") == 0)
    df = df.withColumns(
        {
            "statistic": w,
            "effect_size": F.coalesce(ratio((w - expected) * sign, spread) / F.sqrt(F.nullif(k, F.lit(0.0))), F.lit(0.0)),
            "p_method": F.when(exact, "exact").otherwise("normal"),
            "_z": F.abs(ratio(w - expected, tied)),
            "_nx": F.when(exact, k),
        }
    )
    p = F.coalesce(dist.signed_rank_exact_p("statistic", "_nx"), F.least(2.0 * dist.normal_upper("_z"), F.lit(1.0)))
    df = _rank_columns(df.withColumns({"p_value": p, "test_name": F.lit(WILCOXON)}))
    return df.drop("_mean", "_zeros", "_plus", "_minus", "_k", "_ties", "_z", "_nx")


def mann_whitney(rows: DataFrame, pair: list, condition: str = "condition") -> DataFrame:
    """U of the first group. p is exact if a group has at most 8 values and none are tied, else normal
    with tie and continuity correction."""
    chosen = rows.filter(F.col(condition).isin(pair))
    g = _groups(rows, condition, pair)
    means = chosen.groupBy("metric").agg(
        F.count(g["1"]).alias("n1"), F.count(g["2"]).alias("n2"), F.avg(g["1"]).alias("_m1"), F.avg(g["2"]).alias("_m2")
    ).filter("n1 >= 2 AND n2 >= 2")
    ranks = value_counts(chosen, ["metric"], "value", {"_one": F.count_if(F.col(condition) == pair[0])})
    sums = ranks.groupBy("metric").agg(
        F.sum(average_rank() * F.col("_one")).alias("_r1"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("_ties")
    )
    df = means.join(sums, "metric")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2.0
    middle, spread = n1 * n2 / 2.0, F.sqrt(n1 * n2 * (n + 1) / 12.0)
    sign = F.when(F.col("_m1") >= F.col("_m2"), 1.0).otherwise(-1.0)
    tied = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    exact = (F.least(n1, n2) <= EXACT_GROUP) & (F.col("_ties") == 0)
    df = df.withColumns(
        {
            "statistic": u,
            "effect_size": F.coalesce(ratio((u - middle) * sign, spread) / F.sqrt(n), F.lit(0.0)),
            "n": F.col("n1") + F.col("n2"),
            "p_method": F.when(exact, "exact").otherwise("normal"),
            "_z": ratio(F.greatest(u, n1 * n2 - u) - middle - 0.5, tied),
            "_x1": F.when(exact, n1),
        }
    )
    p = F.coalesce(
        dist.rank_sum_exact_p("statistic", "_x1", "n2"), F.least(2.0 * dist.normal_upper("_z"), F.lit(1.0)), F.lit(1.0)
    )
    df = _rank_columns(df.withColumns({"p_value": p, "test_name": F.lit(MANN_WHITNEY)}))
    return df.drop("n1", "n2", "_m1", "_m2", "_r1", "_ties", "_z", "_x1")


def repeated_measures_anova(rows: DataFrame, subject: str = "subject_id", condition: str = "condition") -> DataFrame:
    """One-way repeated measures per metric over subjects seen in every condition."""
    check = check_granularity_long(rows, subject, condition)
    wanted = check.groupBy("metric").agg(F.count_distinct(condition).alias("_c"))
    seen = check.groupBy("metric", subject).agg(F.count("value").alias("_have"))
    complete = seen.join(wanted, "metric").filter("_have = _c").select("metric", subject, "_c")
    kept = check.join(complete, ["metric", subject])
    n_all = F.count("value")
    # squares are summed over residuals: by subtraction, rounding would decide whether F is infinite
    effects = kept.join(kept.groupBy("metric", condition).agg(F.avg("value").alias("_mc")), ["metric", condition])
    effects = effects.join(kept.groupBy("metric", subject).agg(F.avg("value").alias("_ms")), ["metric", subject])
    effects = effects.join(kept.groupBy("metric").agg(F.avg("value").alias("_mg")), "metric")
    residual = F.col("value") - F.col("_mc") - F.col("_ms") + F.col("_mg")
    total = effects.groupBy("metric").agg(
        n_all.alias("_n"), (F.var_pop("value") * n_all).alias("ss_total"), F.max("_c").alias("_c"), F.sum(residual * residual).alias("_error")
    )
    by_condition = kept.groupBy("metric", condition).agg(F.avg("value").alias("_m")).groupBy("metric").agg(F.var_pop("_m").alias("_vc"))
    df = total.join(by_condition, "metric")
    c, s = F.col("_c"), F.col("_n") / F.col("_c")
    between = F.col("_vc") * F.col("_n")
    # what is left of residuals by rounding is none
    error = F.when(F.col("_error") > 1e-20 * F.col("ss_total"), F.col("_error")).otherwise(0.0)
    d1, d2 = (c - 1).cast("double"), (c - 1) * (s - 1)
    f = F.when(error / F.nullif(d2, F.lit(0.0)) > 0, (between / d1) / (error / d2)).otherwise(float("inf"))
    df = df.filter((s >= 2) & (c >= 3)).select(
        "metric",
        F.lit(RM_ANOVA).alias("test_name"),
        f.alias("statistic"),
        d1.alias("df1"),
        d2.alias("df2"),
        F.coalesce(ratio(between, F.col("ss_total")), F.lit(0.0)).alias("effect_size"),
        F.lit(ETA).alias("effect_size_name"),
        F.col("_n").alias("n"),
    )
    return df.withColumn("p_value", dist.f_p_value("statistic", "df1", "df2"))


def check_granularity_long(rows: DataFrame, subject: str, condition: str) -> DataFrame:
    once = rows.groupBy("metric", subject, condition).agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("_copies"))
    fail = F.raise_error(F.lit("input must have one row per subject and condition")).cast("double")
    return once.withColumn("value", F.when(F.col("_copies") > 1, fail).otherwise(F.col("value"))).drop("_copies")


def shapiro_wilk(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """W and p per group, from the ranks of the group's values; W is 1 for constant groups.

    The weights of the order statistics follow from rank and group size alone, so the
    statistic is two sums, whatever the size of the group.
    """
    ranked = value_counts(rows, by, value).withColumn("_i", F.explode(F.sequence(F.col("below") + 1, F.col("below") + F.col("n"))))
    n = F.col("total").cast("double")

    def score(i):
        return dist.normal_quantile((i - 0.375) / (n + 0.25))

    scored = ranked.withColumn("_m", score(F.col("_i")))
    sums = scored.groupBy(*by).agg(F.sum(F.col("_m") * F.col("_m")).alias("_s2"))
    whole = rows.groupBy(*by).agg(
        F.count(value).alias("total"), F.avg(value).alias("_mean"), (F.var_pop(value) * F.count(value)).alias("_ss")
    )
    last, second, rsn = score(n), score(n - 1), 1.0 / F.sqrt(n)
    size = F.sqrt("_s2")
    a1 = F.when(n == 3, math.sqrt(0.5)).otherwise(dist.polynomial(SW_C1, rsn) + last / size)
    a2 = dist.polynomial(SW_C2, rsn) + second / size
    groups = whole.join(sums, by).withColumns({"_a1": a1, "_a2": a2})
    top2 = F.col("_s2") - 2 * last * last
    small = F.sqrt(top2 / (1 - 2 * F.col("_a1") * F.col("_a1")))
    large = F.sqrt((top2 - 2 * second * second) / (1 - 2 * F.col("_a1") * F.col("_a1") - 2 * F.col("_a2") * F.col("_a2")))
    groups = groups.withColumn("_scale", F.when(n > 5, large).otherwise(small)).filter("total >= 3")
    rows2 = join_small(scored.select(*by, value, "_i", "_m"), groups, by, "inner")
    i, total = F.col("_i"), F.col("total")
    edge = F.least(i, total - i + 1)
    weight = F.when(edge == 1, F.signum("_m") * F.col("_a1")).when((edge == 2) & (total > 5), F.signum("_m") * F.col("_a2")).otherwise(
        F.when(total == 3, 0.0).otherwise(F.col("_m") / F.col("_scale"))
    )
    fit = rows2.groupBy(*by).agg(F.sum(weight * (F.col(value) - F.col("_mean"))).alias("_fit"), F.max("_ss").alias("_ss"), F.max("total").alias("n"))
    w = F.least(F.coalesce(ratio(F.col("_fit") * F.col("_fit"), F.col("_ss")), F.lit(1.0)), F.lit(1.0))
    found = fit.select(*by, w.alias("w"), F.col("n").cast("double").alias("n"))
    n, y = F.col("n"), F.ln(1 - F.col("w"))
    gamma = dist.polynomial(SW_G, n)
    z_small = (-F.ln(gamma - y) - dist.polynomial(SW_C3, n)) / F.exp(dist.polynomial(SW_C4, n))
    z_large = (y - dist.polynomial(SW_C5, F.ln(n))) / F.exp(dist.polynomial(SW_C6, F.ln(n)))
    found = found.withColumn("_z", F.when(n <= 11, z_small).otherwise(z_large))
    p3 = F.greatest(6.0 / math.pi * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))), F.lit(0.0))
    p = (
        F.when(F.col("w") >= 1, 1.0)
        .when(n == 3, p3)
        .when((n <= 11) & (y >= gamma), 0.0)
        .otherwise(dist.normal_upper("_z"))
    )
    return found.withColumn("p", p).drop("_z")


def is_normal(rows: DataFrame, by: list[str]) -> DataFrame:
    """Whether each group may pass as normal: 3 values or more, not constant, Shapiro p above .05."""
    spread = rows.groupBy(*by).agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi")
    )
    constant = F.col("_hi") - F.col("_lo") <= 1e-8 + 1e-5 * F.abs("_lo")
    tested = shapiro_wilk(rows, by)
    return spread.join(tested, by, "left").select(
        *by, F.coalesce((F.col("p") > 0.05) & ~constant, F.lit(False)).alias("normal"), F.col("w").alias("shapiro_w"), F.col("p").alias("shapiro_p")
    )


RESULT = ["metric", "test_name", "statistic", "df", "p_value", "p_method", "effect_size", "effect_size_name", "ci_lower", "ci_upper", "n", "scale"]


def compare_conditions(
    summary: DataFrame,
    metrics: list[str],
    paired: bool = False,
    subject: str = "subject_id",
    condition: str = "condition",
    conditions: list | None = None,
    test: str = "auto",
) -> DataFrame:
    """One test per metric between two conditions.

    ``test`` is ``auto`` (parametric where both groups pass as normal), ``parametric`` or
    ``nonparametric``.
    """
    pair = sorted(conditions) if conditions else conditions_of(summary, condition)
    chosen = summary.filter(F.col(condition).isin(pair))
    rows = check_granularity_long(long_form(chosen, metrics, [subject, condition]), subject, condition)
    # one row per subject, condition and metric; read by every test and both normality checks
    rows = materialize(rows, "comparison")
    if paired:
        both = pairs(rows, pair, subject, condition)
        tested = both.select("metric", F.lit(pair[0]).alias(condition), F.col("first").alias("value")).union(
            both.select("metric", F.lit(pair[1]).alias(condition), F.col("second").alias("value"))
        )
        parametric, ranked = paired_t(both), wilcoxon(both)
    else:
        tested, parametric, ranked = rows, welch_t(rows, pair, condition), mann_whitney(rows, pair, condition)
    if test == "parametric":
        out = parametric.select(RESULT)
    elif test == "nonparametric":
        out = ranked.select(RESULT)
    else:
        normal = is_normal(tested, ["metric", condition]).groupBy("metric").agg(F.min("normal").alias("_normal"))
        both_tests = parametric.select(RESULT).withColumn("_parametric", F.lit(True)).unionByName(
            ranked.select(RESULT).withColumn("_parametric", F.lit(False))
        )
        out = both_tests.join(normal, "metric").filter(F.col("_parametric") == F.col("_normal")).drop("_parametric", "_normal")
    return out.withColumns({"conclusion": conclusion(), "apa": apa_string(), "stars": stars(F.col("p_value"))})


def effect_word(size: Column, name: Column) -> Column:
    """Fixed word for the magnitude of an effect."""
    size = F.abs(size)

    def word(limits):
        out = F.lit(EFFECT_WORDS[3])
        for limit, w in reversed(list(zip(limits, EFFECT_WORDS))):
            out = F.when(size < limit, w).otherwise(out)
        return out

    return F.when(name == COHEN, word(EFFECT_LIMITS[COHEN])).when(name == RANK_R, word(EFFECT_LIMITS[RANK_R])).otherwise(
        word(EFFECT_LIMITS[ETA])
    )


def p_text(p: Column) -> Column:
    """``< .001`` or ``= .012``."""
    return F.when(p < 0.001, "< .001").otherwise(F.concat(F.lit("= "), F.regexp_replace(fixed(p, 3), "^0", "")))


def _effect_name(name: Column) -> Column:
    return F.when(name == ETA, "η²").otherwise(name)


def conclusion() -> Column:
    p, size, name = F.col("p_value"), F.col("effect_size"), F.col("effect_size_name")
    return F.concat(
        "metric", F.when(p < 0.05, SIGNIFICANT).otherwise(NOT_SIGNIFICANT), F.lit(", p "), p_text(p), F.lit(", "), _effect_name(name),
        F.lit(" = "), fixed(size, 2), F.lit("（"), effect_word(size, name), F.lit("）"),
    )


def apa_string() -> Column:
    test, n = F.col("test_name"), F.col("n").cast("long")
    freedom = F.greatest(n - F.when(test == PAIRED, 1).otherwise(2), F.lit(1))
    label = (
        F.when(test.isin(WELCH, PAIRED), F.concat(F.lit("t("), freedom.cast("string"), F.lit(")")))
        .when(test == RM_ANOVA, "F")
        .when(test == MANN_WHITNEY, "U")
        .otherwise("W")
    )
    return F.concat(
        label, F.lit(" = "), fixed(F.col("statistic"), 2), F.lit(", p "), p_text(F.col("p_value")), F.lit(", "),
        _effect_name(F.col("effect_size_name")), F.lit(" = "), fixed(F.col("effect_size"), 2),
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def effect_ci(results: DataFrame) -> DataFrame:
    """Confidence interval of the effect: the difference's interval over its scale."""
    flat = F.coalesce(F.col("scale"), F.lit(0.0)) == 0
    none = F.lit(None).cast("double")
    known = F.col("ci_lower").isNotNull() & F.col("ci_upper").isNotNull()

    def scaled(c):
        return F.when(~known, none).when(flat, F.col("effect_size")).otherwise(ratio(F.col(c), F.col("scale")))

    return results.select("metric", "effect_size", scaled("ci_lower").alias("effect_ci_lower"), scaled("ci_upper").alias("effect_ci_upper"))


def metric_groups(summary: DataFrame, metric: str, pair: list, paired: bool, subject: str = "subject_id", condition: str = "condition") -> DataFrame:
    """Values of one metric in two conditions: side by side by subject, or one row each."""
    rows = long_form(summary.filter(F.col(condition).isin(pair)), [metric], [subject, condition])
    if paired:
        return pairs(rows, pair, subject, condition)
    return rows.select("metric", condition, subject, "value")


def correlation_matrix(features: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every pair of columns, as rows; the matrix is columns × columns whatever the data."""
    vectors = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(features)
    matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
    rows = [(a, b, i, j, float(matrix[i][j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return features.sparkSession.createDataFrame(rows, "metric_a string, metric_b string, order_a int, order_b int, r double")


def high_correlations(matrix: DataFrame, above: float = 0.85, top: int = 8) -> DataFrame:
    upper = matrix.filter((F.col("order_a") < F.col("order_b")) & (F.abs("r") > above) & ~F.isnan("r"))
    return upper.orderBy(F.abs("r").desc(), "order_a", "order_b").limit(top).select("metric_a", "metric_b", "r")


def describe_groups(features: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Mean, SD, extremes of each feature, with its group's name."""
    rows = long_form(features, [c for cols in groups.values() for c in cols], [])
    name = F.coalesce(*[F.when(F.col("metric").isin(cols), F.lit(g)) for g, cols in groups.items()])
    return rows.groupBy(name.alias("feature_group"), "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")
    )


# The metrics of the batch tables.
KEY_METRICS = ["fixation_count", "fixation_duration_mean", "saccade_count", "valid_ratio", "path_length"]
SUMMARY_METRICS = ["fixation_count", "fixation_duration_mean", "saccade_count", "valid_ratio"]
GRADE_METRIC = "质量等级"


def batch_descriptives(batch: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Mean, SD (0 for one value) and n per metric, rounded to 4 places."""
    rows = long_form(batch, metrics or KEY_METRICS, [])
    return rows.groupBy("metric").agg(
        F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("sd"),
        F.count("value").alias("n"),
    )


def batch_summary(batch: DataFrame) -> DataFrame:
    """Four metrics and the commonest quality grade (ties: the smallest)."""
    numbers = batch_descriptives(batch, SUMMARY_METRICS).withColumn("note", F.lit(""))
    grades = batch.filter("quality_grade IS NOT NULL").groupBy("quality_grade").agg(F.count(F.lit(1)).alias("c"))
    commonest = grades.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.max("c").alias("_top"),
        F.collect_list(F.struct("c", "quality_grade")).alias("_all"),
    )
    best = F.array_min(F.transform(F.filter("_all", lambda e: e["c"] == F.col("_top")), lambda e: e["quality_grade"]))
    none = F.lit(None).cast("double")
    row = commonest.select(
        F.lit(GRADE_METRIC).alias("metric"), none.alias("mean"), none.alias("sd"), "n", F.coalesce(best, F.lit("未知")).alias("note")
    )
    return numbers.unionByName(row)


def boxplot_values(summary: DataFrame, metrics: list[str], condition: str = "condition") -> DataFrame:
    """Five-number summary and mean per condition and metric."""
    rows = long_form(summary, metrics, [condition])
    five = quantiles(rows, [condition, "metric"], "value", {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})
    return five.join(rows.groupBy(condition, "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n")), [condition, "metric"])
