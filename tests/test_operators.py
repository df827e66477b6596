"""Small recordings with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccadia.functions.ordered import lay_out
from saccadia.operators import aoi, dispersion, entropy, events, features, methods, multimodal, pupil, quality, segments, signal
from saccadia.sources import normalize, readers, text_values


def rows_of(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def sample_rows(t, x, y, **more):
    return [{"timestamp_ms": float(a), "x": b, "y": c, **{k: v[i] for k, v in more.items()}} for i, (a, b, c) in enumerate(zip(t, x, y))]


def test_drop_invalid(make_samples):
    df = make_samples(sample_rows([0, 10, 20, 30], [100.0, None, 120.0, 130.0], [200.0, None, 220.0, 230.0], valid=[True, False, True, True]))
    assert signal.drop_invalid(df).count() == 3


def test_interpolation_keeps_flags(make_samples):
    df = lay_out(make_samples(sample_rows([0, 8.3, 16.6, 24.9], [100.0, None, 120.0, 130.0], [1.0, None, 3.0, 4.0],
                                          pupil=[3.1, None, 3.2, 3.3], valid=[True, False, True, True])))
    row = rows_of(signal.interpolate_missing(df), "sample_index")[1]
    assert row["x"] == 110.0 and row["y"] == 2.0 and abs(row["pupil"] - 3.15) < 1e-12 and row["valid"] is False


def test_normalised_range(make_samples):
    df = lay_out(make_samples(sample_rows([0, 1, 2], [0.0, 50.0, 100.0], [0.0, 25.0, 50.0])))
    got = rows_of(signal.normalize_coordinates(df), "sample_index")
    assert [r["x_norm"] for r in got] == [-1.0, 0.0, 1.0] and [r["y_norm"] for r in got] == [-1.0, 0.0, 1.0]


@pytest.mark.parametrize("split", [False, True])
def test_labelled_events(make_samples, request, split):
    if split:
        request.getfixturevalue("small_blocks")
    labels = ["fixation", "fixation", "fixation", "saccade", "saccade", "blink"]
    df = lay_out(make_samples(sample_rows(range(0, 60, 10), [1.0] * 6, [1.0] * 6, event_label=labels, valid=[True] * 5 + [False])))
    got = rows_of(events.detect_events(df), "start_index")
    assert [r["kind"] for r in got] == ["fixation", "saccade", "blink"]
    assert [r["event_index"] for r in got] == [0, 1, 2]


def test_labels_are_required_when_asked_for(make_samples):
    df = lay_out(make_samples(sample_rows([0, 10], [1.0, 1.0], [1.0, 1.0])))
    with pytest.raises(Exception, match="no event labels"):
        events.detect_events(df, source="labels").collect()


def test_column_aliases(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["time", "gaze_x", "gaze_y", "pupil_size"])
    assert normalize.normalize_columns(df).columns == ["timestamp_ms", "x", "y", "pupil"]


def test_inferred_and_mixed_valid(spark):
    inferred = spark.createDataFrame([("r", 0, 0.0, 1.0, 1.0, 3.1), ("r", 1, 1.0, 1.0, 1.0, None), ("r", 2, 2.0, 1.0, 1.0, 3.3)],
                                     "recording_id string, sample_seq int, timestamp_ms double, x double, y double, pupil double")
    assert [r["valid"] for r in rows_of(normalize.validate_samples(inferred), "sample_seq")] == [True, False, True]
    mixed = spark.createDataFrame([("r", 0, 0.0, 1.0, 1.0, "1"), ("r", 1, 1.0, None, None, "1"), ("r", 2, 2.0, 1.0, 1.0, "0")],
                                  "recording_id string, sample_seq int, timestamp_ms double, x double, y double, valid string")
    assert [r["valid"] for r in rows_of(normalize.validate_samples(mixed), "sample_seq")] == [True, False, False]


def test_asc_lines(spark):
    lines = ["0 100 200 3.1", "8.3 110 210 3.2", "MSG 9 TRIAL", "12 . . 0.0", "16.6 120 220"]
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)], "recording_id string, sample_seq int, value string")
    got = rows_of(readers.parse_asc_lines(df), "sample_seq")
    assert [(r["timestamp_ms"], r["x"], r["pupil"]) for r in got] == [(0.0, 100.0, 3.1), (8.3, 110.0, 3.2), (16.6, 120.0, None)]


@pytest.mark.parametrize("split", [False, True])
def test_gaps(make_samples, request, split):
    if split:
        request.getfixturevalue("small_blocks")
    flags = [True, False, False, True, False, False, False, True]
    df = lay_out(make_samples(sample_rows(range(0, 80, 10), [1.0] * 8, [1.0] * 8, valid=flags)))
    got = rows_of(quality.missing_segments(df), "start_index")
    assert [(r["start_index"], r["end_index"], r["duration_ms"], r["sample_count"]) for r in got] == [(1, 2, 10.0, 2), (4, 6, 20.0, 3)]
    report = rows_of(quality.assess_quality(df), "recording_id")[0]
    assert report["max_gap_duration_ms"] == 20.0 and report["missing_segments"] == 2


def test_sampling_rate(make_samples):
    df = lay_out(make_samples(sample_rows(np.linspace(0, 1000, 100), [1.0] * 100, [1.0] * 100)))
    assert abs(rows_of(quality.assess_quality(df), "recording_id")[0]["sampling_rate_actual"] - 99.0) < 1e-9


def test_grades(spark):
    df = spark.createDataFrame([(0.9,), (0.75,), (0.5,), (0.25,)], "r double")
    got = [r["g"] for r in df.select("r", quality.ratio_grade(F.col("r")).alias("g")).orderBy(F.desc("r")).collect()]
    assert got == ["优", "良", "可用", "建议剔除"]


def fixations(spark, rows):
    return spark.createDataFrame([("r1", k, *r) for k, r in enumerate(rows)],
                                 "recording_id string, event_index int, start_time_ms double, duration_ms double, centroid_x double, centroid_y double")


def test_areas(spark):
    areas = [aoi.rectangle("A", 0, 0, 100, 100), aoi.rectangle("B", 200, 0, 300, 100)]
    df = fixations(spark, [(0.0, 1.0, 50.0, 50.0), (1.0, 1.0, 250.0, 50.0), (2.0, 1.0, 420.0, 420.0)])
    assert [r["aoi_name"] for r in rows_of(aoi.assign(df, areas), "event_index")] == ["A", "B", None]
    triangle = aoi.polygon("T", [(0, 0), (120, 0), (0, 120)])
    points = fixations(spark, [(0.0, 1.0, 10.0, 10.0), (1.0, 1.0, 80.0, 80.0)])
    by_case = [r["aoi_name"] for r in rows_of(aoi.assign(points, [triangle]), "event_index")]
    table = aoi.area_table(spark, [triangle])
    by_set = [r["aoi_name"] for r in rows_of(aoi.assign_by_set(points.withColumn("aoi_set", F.lit("default")), table), "event_index")]
    assert by_case == by_set == ["T", None]
    with pytest.raises(ValueError):
        aoi.polygon("flat", [(0, 0), (1, 1)])


def test_area_metrics_and_visits(spark):
    df = fixations(spark, [(100.0, 50.0, 1.0, 1.0), (200.0, 100.0, 1.0, 1.0), (350.0, 50.0, 1.0, 1.0)])
    named = df.withColumn("aoi_name", F.when(F.col("event_index") > 0, "A"))
    total = spark.createDataFrame([("r1", 500.0)], "recording_id string, duration_ms double")
    a, b = rows_of(aoi.metrics(named, ["A", "B"], total), "aoi_order")
    assert (a["ttff_ms"], a["dwell_ms"], a["dwell_prop"], a["fixation_count"], a["mean_fixation_duration"]) == (100.0, 150.0, 0.3, 2, 75.0)
    assert b["ttff_ms"] is None and b["fixation_count"] == 0
    visits = df.withColumn("aoi_name", F.when(F.col("event_index") == 1, "B").otherwise("A"))
    a, b = rows_of(aoi.metrics(visits, ["A", "B"], total), "aoi_order")
    assert (a["visit_count"], a["revisit_count"], b["visit_count"], b["revisit_count"]) == (2, 1, 1, 0)


def test_transitions(spark):
    names = ["A", "B", "A", "C"]
    df = fixations(spark, [(float(k), 1.0, 0.0, 0.0) for k in range(4)])
    seq = F.array(*[F.lit(n) for n in names])
    rec = spark.createDataFrame([("r1",)], "recording_id string")
    got = rows_of(aoi.transition_matrix(df.withColumn("aoi_name", seq[F.col("event_index")]), ["A", "B", "C"], rec), "source", "target")
    sums = {s: sum(r["probability"] for r in got if r["source"] == s) for s in "ABC"}
    assert sums == {"A": 1.0, "B": 1.0, "C": 0.0} and all(r["probability"] == 0 for r in got if r["source"] == r["target"])


def test_pupil_mask(make_samples):
    pupils = [3.0, 3.1, 0.0, 0.0, 3.6, 3.7]
    df = lay_out(make_samples(sample_rows(range(0, 600, 100), [1.0] * 6, [1.0] * 6, pupil=pupils, valid=[True, True, True, False, True, True])))
    got = rows_of(pupil.clean_pupil(df), "sample_index")
    assert [r["blink_mask"] for r in got] == [False, False, True, True, False, False]
    assert all(r["cleaned_pupil"] is not None for r in got)


def test_pupil_missing_gives_zeros(make_samples):
    df = lay_out(make_samples(sample_rows(range(0, 200, 10), [1.0] * 20, [1.0] * 20)))
    got = rows_of(features.extract_features(df, include_pupil_load=True, include_complexity=False), "recording_id")[0]
    assert all(v == 0.0 for k, v in got.items() if k.startswith("pupil_") and k not in ("pupil_blink_ratio", "pupil_interpolation_ratio"))


@pytest.mark.parametrize("split", [False, True])
def test_entropy_thins_long_recordings(make_samples, spark, request, split):
    if split:
        spark.conf.set("spark.saccadia.rowsPerBlock", "700")
    wave = np.sin(np.linspace(0, 40 * np.pi, 5000))
    df = lay_out(make_samples(sample_rows(range(5000), [float(v) for v in wave], [0.0] * 5000, pupil=[1.0] * 5000)))
    got = rows_of(features.entropy_features(df, 2000), "recording_id")[0]["x_approx_entropy"]
    spark.conf.unset("spark.saccadia.rowsPerBlock")
    at = np.floor(np.arange(2000) * 2.5).astype(int)
    at[-1] = 4999
    assert abs(got - entropy.approximate_entropy(wave[at])) < 1e-12


@pytest.mark.parametrize("rows_per_block,points,most", [(100_000, 16_000, 60_000), (700, 300, 60_000), (100_000, 300, 150), (700, 50, 100)])
def test_entropy_of_every_sample(make_samples, spark, rows_per_block, points, most):
    """Whole series against the plain formula: one cell or many, cells in pieces, both layouts, plateaus, nulls, short series."""
    settings = {"spark.saccadia.rowsPerBlock": rows_per_block, entropy.CELL_POINTS_CONF: points, entropy.MOST_POINTS_CONF: most}
    for name, value in settings.items():
        spark.conf.set(name, str(value))
    rng = np.random.default_rng(8)
    n = 5000
    x = np.sin(np.linspace(0, 40 * np.pi, n)) + rng.normal(0, 0.05, n)
    y = np.repeat(rng.integers(0, 5, n // 10), 10).astype(float)
    pupil = [None if k % 7 == 0 else float(v) for k, v in enumerate(rng.normal(0, 1, n))]
    rows = sample_rows(range(n), x.tolist(), y.tolist(), pupil=pupil, valid=[k % 11 != 3 for k in range(n)])
    few = sample_rows(range(13), [5.0] * 13, [float(k) for k in range(13)], pupil=[1.0] * 11 + [None] * 2)
    df = lay_out(make_samples(rows).union(make_samples(few, "r2")).union(make_samples(few[:5], "r3")))
    got = rows_of(features.entropy_features(df), "recording_id")
    for name in settings:
        spark.conf.unset(name)
    kept = [r for r in rows if r["valid"]]
    for g, own in zip(got, (kept, few, few[:5])):
        assert g["entropy_samples"] == len(own)
        for c in ("x", "y", "pupil"):
            values = np.array([r[c] for r in own if r[c] is not None])
            expected = entropy.approximate_entropy(values) if len(values) >= 12 else 0.0
            assert abs(g[f"{c}_approx_entropy"] - expected) < 1e-9, (g["recording_id"], c)


@pytest.mark.parametrize("m", [1, 2, 3])
def test_neighbours_by_small_integers(m):
    rng = np.random.default_rng(m)
    near = np.round(rng.normal(0, 1, (700, m + 1)), 1)
    near[::9, m] = np.nan
    asking = np.concatenate([near[:200], rng.normal(0, 2, (50, m + 1))])
    few, more = entropy.count_near(asking, near, 0.3)
    met = np.abs(asking[:, None, :] - near[None, :, :]) <= 0.3
    assert np.array_equal(few, met[:, :, :m].all(axis=2).sum(axis=1)) and np.array_equal(more, met.all(axis=2).sum(axis=1))


def greedy_dispersion(t, x, y, limit, least):
    """Quadratic check of the dispersion method."""
    found, i, n = [], 0, len(t)
    while i < n:
        j = i
        while j < n and t[j] - t[i] < least:
            j += 1
        if j == n:
            break

        def spread(a, b):
            return max(x[a : b + 1]) - min(x[a : b + 1]) + max(y[a : b + 1]) - min(y[a : b + 1])

        if spread(i, j) > limit:
            i += 1
            continue
        while j + 1 < n and spread(i, j + 1) <= limit:
            j += 1
        found.append((i, j))
        i = j + 1
    return found


@pytest.mark.parametrize("split", [False, True])
def test_dispersion_against_brute_force(make_samples, spark, split):
    spark.conf.set("spark.saccadia.rowsPerBlock", "40" if split else "100000")
    rng = np.random.default_rng(3)
    n = 400
    t = np.cumsum(rng.integers(5, 25, n)).astype(float)
    x = np.cumsum(rng.normal(0, 9, n)) + np.repeat(rng.normal(0, 200, 20), 20)
    y = np.cumsum(rng.normal(0, 9, n))
    df = lay_out(make_samples(sample_rows(t, [float(v) for v in x], [float(v) for v in y])))
    got = [(r["start_index"], r["end_index"]) for r in rows_of(methods.dispersion_fixations(df, 80.0, 60.0), "start_index")]
    spark.conf.unset("spark.saccadia.rowsPerBlock")
    expected = greedy_dispersion(t, x, y, 80.0, 60.0)
    assert got == expected and len(got) > 5


def test_segments(make_samples):
    marks = [None, "go", None, "stop", "go", None]
    df = lay_out(make_samples(sample_rows(range(0, 60, 10), [1.0] * 6, [1.0] * 6, marker=marks)))
    found = rows_of(segments.between_markers(df, "go", "stop"), "start_ms")
    assert [(r["segment_name"], r["start_ms"], r["end_ms"]) for r in found] == [("between_1_go_to_stop", 10.0, 30.0)]
    windows = rows_of(segments.marker_windows(df, ["go"], 10.0, 30.0), "start_ms")
    assert [(r["start_ms"], r["end_ms"]) for r in windows] == [(0.0, 40.0), (30.0, 50.0)]
    before = rows_of(segments.time_ranges(df, [(-20.0, -10.0)]), "start_ms")[0]
    assert (before["start_ms"], before["end_ms"]) == (0.0, 0.0)


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([("r", 0, 100.0), ("r", 1, 300.0)], "recording_id string, sample_seq long, timestamp_ms double")
    right = spark.createDataFrame([("r", 0, 90.0, 1.0), ("r", 1, 110.0, 2.0), ("r", 2, 351.0, 3.0)],
                                  "recording_id string, sample_seq long, timestamp_ms double, v double")
    assert [r["v"] for r in rows_of(multimodal.asof_nearest(left, right, 50.0), "sample_seq")] == [1.0, None]


def test_late_fusion_means(spark):
    df = spark.createDataFrame([("r", "a", "x", 0.2), ("r", "a", "y", 0.8), ("r", "b", "x", 0.4), ("r", "b", "y", 0.6)],
                               "recording_id string, modality string, class string, p double")
    assert [round(r["p"], 9) for r in rows_of(multimodal.late_fusion(df), "class")] == [0.3, 0.7]


def test_bad_inputs_fail(spark):
    df = spark.createDataFrame([("20-10",)], "ranges string")
    with pytest.raises(Exception, match="ends before it starts"):
        text_values.parse_time_ranges(df, "ranges", []).collect()
    aois = spark.createDataFrame([("s", "T1", "a")], "scenario string, task_id string, name string")
    with pytest.raises(Exception, match="unknown task"):
        readers.scenario_aois(aois, "s", "T9").collect()


@pytest.mark.parametrize("size", [1, 2, 7, 30, 1000])
def test_dispersion_blocks_against_plain_windows(size):
    """Blocks of any size chained give the fixations of one greedy scan: gaps, still gaze over many blocks, jumps, drifts, equal times."""
    rng = np.random.default_rng(size)
    for k in range(60):
        n = int(rng.integers(1, 90))
        step = [(1, 30), (0, 3), (5, 6)][k % 3]
        t = np.cumsum(rng.integers(*step, n)).astype(float)
        x = np.cumsum(rng.normal(0, [0.0, 6.0, 30.0][k % 3], n)) + (rng.random(n) < 0.04) * 300
        y = np.round(np.cumsum(rng.normal(0, 4, n)))
        breaks = rng.random(n) < (0.05 if k % 2 else 0.0)
        breaks[0] = True
        limit, least = float(rng.choice([20, 60, 200])), float(rng.choice([0.5, 20, 90]))
        state, found = None, []
        for a in range(0, n, size):
            part = slice(a, a + size)
            block = dispersion.Analysis(np.arange(n)[part], t[part], x[part], y[part], breaks[part], limit, least)
            crossing, entry, state = dispersion.step(block.summary(), state, limit, least)
            found += crossing + (list(block.fixations(entry)) if entry is not None else [])
        if state.first:
            found.append((state.first, state.last))
        expected = []
        edges = [*np.flatnonzero(breaks).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            expected += [(a + i, a + j) for i, j in greedy_dispersion(t[a:b], x[a:b], y[a:b], limit, least)]
        assert sorted((a[0], b[0]) for a, b in found) == expected
        assert all(r == (r[0], t[r[0]], x[r[0]], y[r[0]]) for pair in found for r in pair)



def test_ranks_of_hashes_and_of_far_values_in_many_cells(spark, small_blocks):
    from saccadia.functions.ranks import value_counts

    values = [-(2**63), 2**63 - 1, 0, 5, 5, 7, -3, *range(1000, 1040), 10**15]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    found = {r["v"]: (r["n"], r["below"], r["total"]) for r in value_counts(df, [], "v").collect()}
    assert found == {v: (values.count(v), sum(x < v for x in values), len(values)) for v in values}


def test_long_recording_at_one_time(spark, make_samples, small_blocks):
    from saccadia.functions.ordered import lay_out

    laid = lay_out(make_samples([{"timestamp_ms": 5.0, "x": 1.0, "y": 1.0} for _ in range(23)]))
    assert sorted(r["sample_index"] for r in laid.collect()) == list(range(23))


def test_a_class_with_one_row_keeps_names_right(spark):
    from saccadia.operators import modeling

    rows = [(str(k), "lo" if k % 2 else "hi", float(k % 2)) for k in range(40)] + [("x", "a_rare", 0.5), ("n", None, 3.0)]
    data = spark.createDataFrame(rows, "recording_id string, target string, f double")
    fitted = modeling.train_model(data, "target", feature_columns=["f"], numTrees=5)
    assert fitted.labels == ["a_rare", "hi", "lo", "null"]
    assert all(r["y_true"] == r["y_pred"] for r in fitted.holdout.collect())
    binary = data.filter("target IN ('lo', 'hi')")
    for name in ("svm", "logistic_regression"):
        fitted = modeling.train_model(binary, "target", model_name=name, feature_columns=["f"])
        assert fitted.metrics.first()["accuracy"] == 1.0
