"""Density maps: nothing but seeds is exchanged, and both layouts give the same cells."""

import numpy as np
import pytest

from saccadia.operators import grid
from saccadia.plans import queries_space as qs

SF = "/root/testdata/sf0.001"


def _above_maps(df):
    """Steps above the one that makes maps which carry or sort rows."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    above = plan[:plan.rfind("MapInArrow")].splitlines()
    return [line for line in above if any(step in line for step in ("Exchange", "Aggregate", "Window", "Join", "Sort"))]


@pytest.mark.parametrize("name", ["H3_attention_kde", "H4_smooth_density", "H6_grid_summary", "H7_robust_normalize", "H8_map_vs_fixations"])
def test_no_cell_is_exchanged(spark, name):
    """Above the step that makes maps nothing carries or sorts cells."""
    from saccadia.plans.catalog import QUERIES

    assert _above_maps(QUERIES[name](spark, SF)) == []


def _cells(df):
    return {(r[0], r["gy"], r["gx"]): r["s"] for r in df.collect()}


def test_layouts_give_equal_maps(spark, request):
    whole = _cells(qs.h4(spark, SF)), {r[0]: r for r in qs.h8(spark, SF).collect()}
    request.getfixturevalue("small_blocks")
    parts = _cells(qs.h4(spark, SF)), {r[0]: r for r in qs.h8(spark, SF).collect()}
    assert whole[0].keys() == parts[0].keys() and whole[1].keys() == parts[1].keys()
    assert all(abs(v - parts[0][k]) < 1e-9 for k, v in whole[0].items())
    assert all(np.allclose(r[1:], parts[1][k][1:]) for k, r in whole[1].items())


def test_maps_from_elsewhere(spark):
    """Cells packed again and compared with fixations give what maps with layers give."""
    with_layers = {r[0]: r for r in qs.h8(spark, SF).collect()}
    packed = grid.to_maps(grid.to_cells(qs.density(spark, SF)))
    found = grid.map_vs_fixations(packed, qs.fixations(spark, SF), grid.padded_extent(qs.samples(spark, SF)), qs.BINS).collect()
    assert len(found) == len(with_layers)
    assert all(np.allclose(r[1:], with_layers[r[0]][1:]) for r in found)


def test_flat_and_empty_maps(spark):
    rows = [("a", 3, [0.0] * 6), ("b", 3, [2.0] * 6)]
    maps = spark.createDataFrame(rows, "recording_id string, width int, cells array<double>")
    flat = {r[0]: list(r["cells"]) for r in grid.robust_normalize(maps).collect()}
    assert flat == {"a": [0.0] * 6, "b": [1.0] * 6}
    found = {r[0]: r for r in grid.grid_summary(maps).collect()}
    assert (found["a"]["attention_center_x"], found["a"]["attention_center_y"], found["a"]["entropy"]) == (1.5, 1.0, 0.0)
    assert (found["b"]["attention_center_x"], found["b"]["attention_center_y"]) == (1.0, 0.5)
    assert found["b"]["hotspot_ratio"] == 1.0 and abs(found["b"]["entropy"] - 1) < 1e-9


@pytest.mark.parametrize("name", ["H3_attention_kde", "H4_smooth_density", "H6_grid_summary", "H7_robust_normalize", "H8_map_vs_fixations"])
def test_maps_are_made_and_changed_in_one_pass(spark, name):
    """Each pass of its own would hold batches of whole maps in Spark and in two Python processes."""
    from saccadia.plans.catalog import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1
