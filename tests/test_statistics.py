"""Tests of hypotheses against published or enumerable values."""

import statistics

import pytest
from pyspark.sql import functions as F

from saccadia.functions import distributions as dist
from saccadia.operators import stats


def long(spark, groups):
    rows = [("m", f"s{i}", c, float(v)) for c, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "metric string, subject_id string, condition string, value double")


def test_normal_quantile(spark):
    df = spark.range(1, 2000).select((F.col("id") / 2000.0).alias("p"))
    normal = statistics.NormalDist()
    for r in df.select("p", dist.normal_quantile(F.col("p")).alias("z")).collect():
        assert abs(r["z"] - normal.inv_cdf(r["p"])) < 1e-12


def test_critical_values():
    assert abs(dist.t_critical(10) - 2.228139) < 1e-6
    assert abs(dist.f_upper(4.102821, 2, 10) - 0.05) < 1e-6


@pytest.mark.parametrize("split", [False, True])
def test_shapiro_wilk(spark, request, split):
    if split:
        request.getfixturevalue("small_blocks")
    x = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]
    row = stats.shapiro_wilk(long(spark, {"a": x}), ["metric"]).first()
    assert abs(row["w"] - 0.900473) < 1e-5 and abs(row["p"] - 0.042090) < 1e-5


def test_rank_tests_exact(spark):
    high, low = [10, 11, 10.5, 12, 11.5, 10.8], [1, 2, 1.5, 2.2, 1.2, 1.8]
    rows = long(spark, {"a": high, "b": low})
    u = stats.mann_whitney(rows, ["a", "b"]).first()
    assert u["statistic"] == 36.0 and u["p_method"] == "exact" and abs(u["p_value"] - 2 / 924) < 1e-12
    t = stats.welch_t(rows, ["a", "b"]).first()
    assert t["p_value"] < 0.05 and t["effect_size"] > 0.5
    before, after = [1, 2, 3, 4, 5, 6, 7, 8], [2.1, 3.2, 4.3, 5.4, 6.5, 7.6, 8.7, 9.8]
    w = stats.wilcoxon(stats.pairs(long(spark, {"a": before, "b": after}), ["a", "b"])).first()
    assert w["statistic"] == 0.0 and abs(w["p_value"] - 2 / 256) < 1e-12 and w["n"] == 8


def test_equal_groups(spark):
    t = stats.welch_t(long(spark, {"a": [1, 2, 3, 4, 5], "b": [5, 4, 3, 2, 1]}), ["a", "b"]).first()
    assert t["p_value"] > 0.05 and t["effect_size"] == 0.0


def test_repeated_measures(spark):
    base = [1.0, 2.1, 2.9, 4.2, 5.1, 5.8, 7.2, 8.1]
    wobble = [0.1, -0.2, 0.05, 0.15, -0.1, 0.2, -0.05, -0.15]
    groups = {c: [b + off + w * k for b, w in zip(base, wobble)] for k, (c, off) in enumerate([("a", 0.0), ("b", 1.4), ("c", 2.6)])}
    row = stats.repeated_measures_anova(long(spark, groups)).first()
    assert row["statistic"] > 1 and row["p_value"] < 0.05 and row["effect_size"] > 0.1


def test_granularity(spark):
    df = spark.createDataFrame([("S01", "a", 1.0), ("S01", "a", 2.0), ("S02", "b", 1.0)], "subject_id string, condition string, m double")
    with pytest.raises(Exception, match="one row per subject and condition"):
        stats.compare_conditions(df, ["m"], test="parametric", conditions=["a", "b"]).collect()
