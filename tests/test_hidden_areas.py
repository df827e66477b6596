"""Areas that others hide are not listed, so a cell keeps few areas however many there are."""

import numpy as np
from pyspark.sql import functions as F

from saccadia.operators import aoi


def test_hidden_areas_are_left_out(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(1500):
        x, y = int(rng.integers(0, 4)) * 6.25, int(rng.integers(0, 3)) * 7.5  # few corners, so that cells lie across edges
        w, h = float(rng.integers(3, 14)), float(rng.integers(2, 9))
        polygon = k % 3 > 0
        vertices = [(x, y), (x + w, y), (x, y + h)] if polygon else None
        rows.append(("s", k // 2, f"a{k}", "polygon" if polygon else "rectangle", x, y, x + w, y + h, vertices))
    aois = spark.createDataFrame(rows, "aoi_set string, aoi_order int, name string, region_type string, x_min double, y_min double, "
                                 "x_max double, y_max double, vertices array<struct<x:double,y:double>>")
    listed = aoi.index_areas(aois)
    assert listed.groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] < 150
    points = [(k, "s" if k % 20 else "none", float(rng.choice([rng.uniform(-1, 34), 6.25, 12.5, 9.25])), float(rng.choice([rng.uniform(-1, 25), 7.5, 15.0])))
              for k in range(400)]
    points.append(points[0])
    fixations = spark.createDataFrame(points, "k int, aoi_set string, centroid_x double, centroid_y double")

    def first(s, px, py):
        for _, _, name, kind, x0, y0, x1, y1, _ in sorted(rows, key=lambda r: (r[1], r[2])):
            if s == "s" and x0 <= px <= x1 and y0 <= py <= y1:
                if kind == "rectangle" or ((y0 > py) != (y1 > py) and px < (x1 - x0) * (py - y1) / (y0 - y1) + x0) != ((y1 > py) != (y0 > py) and px < x0):
                    return name
        return None

    found = sorted((r["k"], r["aoi_name"]) for r in aoi.assign_by_set(fixations, aois).collect())
    assert [k for k, _ in found] == sorted(p[0] for p in points)
    want = {p[0]: first(*p[1:]) for p in points}
    assert [(k, n) for k, n in found if n != want[k]] == []


def test_cells_go_on_in_the_next_batch():
    import pyarrow as pa

    def batch(cells, boxes, whole):
        x = np.array(boxes, float)
        return pa.RecordBatch.from_arrays(
            [pa.array(["s"] * len(cells)), pa.array(cells), pa.array([0] * len(cells)), *[pa.array(x[:, k]) for k in range(4)], pa.array(whole)],
            names=["aoi_set", "_cx", "_cy", "_x0", "_y0", "_x1", "_y1", "_whole"])

    out = list(aoi._seen_areas([batch([1, 2], [[0, 0, 9, 9], [0, 0, 5, 5]], [True, True]),
                                batch([2, 2, 2, 3], [[1, 1, 5, 5], [1, 1, 6, 5], [2, 1, 6, 5], [1, 1, 2, 2]], [True, False, True, True])]))
    assert [b.column("_x0").to_pylist() for b in out] == [[0, 0], [1, 2, 1]]
