"""Areas found by cells, smoothing with error rows, lazy ranks, and the last runs of a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccadia.functions.ordered import lay_out
from saccadia.functions.ranks import quantiles, value_counts
from saccadia.operators import aoi, signal
from saccadia.schema import AOIS


def jobs_of(spark, build):
    """How many jobs run while a plan is built."""
    spark.sparkContext.setJobGroup("building", "building")
    df = build()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return df, len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))


def contains(area, x, y):
    kind, x0, y0, x1, y1, ring = area
    if not (x0 <= x <= x1 and y0 <= y <= y1):
        return False
    if kind == "rectangle":
        return True
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


@pytest.mark.parametrize("count,spread", [(1, 1.0), (40, 1.0), (400, 3.0), (3000, 0.2)])
def test_areas_by_cells_against_a_scan(spark, count, spread):
    """The first area in order, over sets with rectangles, concave polygons, very unequal sizes, and points nowhere."""
    rng = np.random.default_rng(count)
    areas = {}
    for s in ("a", "b"):
        listed = []
        for k in range(count):
            x, y = rng.uniform(0, 1000, 2)
            size = float(np.exp(rng.normal(1.5, spread)))
            if k % 3 == 0:
                w, h = rng.uniform(0, size, 2)
                listed.append(("rectangle", x, y, x + w, y + h, None))
            else:
                turns = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(3, 9))))
                ring = [(float(x + size * r * np.cos(a)), float(y + size * r * np.sin(a))) for a, r in zip(turns, rng.uniform(0.2, 1, len(turns)))]
                xs, ys = zip(*ring)
                listed.append(("polygon", min(xs), min(ys), max(xs), max(ys), ring))
        areas[s] = listed
    rows = [(s, k, f"{s}{k}", a[0], *[float(v) for v in a[1:5]], a[5]) for s, listed in areas.items() for k, a in enumerate(listed)]
    points = [("c" if k % 50 == 0 else "ab"[k % 2], k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-20, 1020, (1500, 2)))]
    points += [("a", 2000, None, 5.0), (None, 2001, 5.0, 5.0), points[1], points[1]]
    df = spark.createDataFrame(points, "aoi_set string, id long, centroid_x double, centroid_y double")
    found = sorted((r.id, r.aoi_name or "") for r in aoi.assign_by_set(df, spark.createDataFrame(rows, AOIS)).collect())

    def first(s, x, y):
        if x is None or s not in areas:
            return ""
        return next((f"{s}{k}" for k, a in enumerate(areas[s]) if contains(a, x, y)), "")

    assert found == sorted((k, first(s, x, y)) for s, k, x, y in points)
    listed = aoi.index_areas(spark.createDataFrame(rows, AOIS)).count()
    assert listed <= 30 * 2 * count


@pytest.mark.parametrize("rows_per_block", [100_000, 4])
@pytest.mark.parametrize("window,polyorder", [(5, 2), (7, 3), (4, 1)])
def test_smoothing_leaves_an_error_row(make_samples, spark, rows_per_block, window, polyorder):
    spark.conf.set("spark.saccadia.rowsPerBlock", str(rows_per_block))
    rng = np.random.default_rng(window)
    sizes = {"long": 23, "whole": window + 1 - window % 2, "short": 3, "one": 1}
    parts = [make_samples([{"timestamp_ms": float(k), "x": float(v), "y": float(-v), "pupil": None if k == 9 else 1.0} for k, v in enumerate(rng.normal(0, 1, n))], name)
             for name, n in sizes.items()]
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    laid = lay_out(df)
    before = {(r.recording_id, r.sample_index): r for r in laid.collect()}
    out = {(r.recording_id, r.sample_index): r for r in signal.smooth_savitzky_golay(laid, window, polyorder).collect()}
    spark.conf.unset("spark.saccadia.rowsPerBlock")
    width = max(window, polyorder + 2)
    width += 1 - width % 2
    for name, n in sizes.items():
        if n < width:
            assert [k for k in out if k[0] == name] == [(name, 0)]
            r = out[name, 0]
            assert r.error == signal.TOO_SHORT and r.x is None and r.y is None and r.pupil is None
            continue
        x = np.array([before[name, k].x for k in range(n)])
        for k in range(n):
            start = min(max(k - width // 2, 0), n - width)
            fit = np.polyfit(np.arange(width), x[start:start + width], polyorder)
            r = out[name, k]
            assert r.error is None and abs(r.x - np.polyval(fit, k - start)) < 1e-9 and abs(r.x + r.y) < 1e-9
            if n > 9:  # a window with a missing value has no fit
                assert (r.pupil is None) == (start <= 9 < start + width)


def test_ranks_are_one_lazy_plan(spark):
    rng = np.random.default_rng(6)
    rows = [("g", float(v)) for v in np.round(rng.normal(0, 1, 4000), 2)] + [("h", float(v)) for v in rng.exponential(1, 900)] + [("k", 1.0), ("k", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    counted, jobs = jobs_of(spark, lambda: value_counts(df, ["g"], "v", {"_high": F.count_if(F.col("v") > 0)}))
    assert jobs == 0
    found = {(r.g, r.v): (r.n, r.below, r.total, r._high) for r in counted.collect()}
    values = {g: np.sort([v for h, v in rows if h == g and v is not None]) for g in "ghk"}
    expected = {(g, v): (int((x == v).sum()), int((x < v).sum()), len(x), int((x == v).sum()) * (v > 0)) for g, x in values.items() for v in x.tolist()}
    assert found == expected
    quartiles, jobs = jobs_of(spark, lambda: quantiles(df, ["g"], "v", {"q": 0.25, "m": 0.5}))
    assert jobs == 0
    for r in quartiles.collect():
        assert abs(r.q - np.quantile(values[r.g], 0.25)) < 1e-12 and abs(r.m - np.median(values[r.g])) < 1e-12


def test_ranks_read_their_rows_once(spark, tmp_path):
    spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") * 0.37 % 11).alias("v")).write.parquet(str(tmp_path / "rows"))
    counted = value_counts(spark.read.parquet(str(tmp_path / "rows")), ["g"], "v", {"_high": F.count_if(F.col("v") > 5)})
    execution = counted._jdf.queryExecution()
    execution.executedPlan().execute().count()
    plan = execution.executedPlan().toString()
    final = plan[plan.index("Final Plan"):plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
