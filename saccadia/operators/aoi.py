"""Areas of interest: assignment, metrics, transitions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saccadia.functions.geometry import in_polygon, in_rectangle
from saccadia.functions.ordered import join_recording, partition_keys, shift
from saccadia.schema import AOIS, KEY

METRIC_SUFFIXES = ["ttff_ms", "dwell_ms", "dwell_prop", "visit_count", "fixation_count"]


@dataclass(frozen=True)
class Area:
    """A named region: ``(x_min, y_min, x_max, y_max)`` or a sequence of vertices."""

    name: str
    region: tuple
    region_type: str = "rectangle"


def rectangle(name: str, x1: float, y1: float, x2: float, y2: float) -> Area:
    return Area(name, (min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)))


def polygon(name: str, vertices: Sequence[tuple[float, float]]) -> Area:
    if len(vertices) < 3:
        raise ValueError("a polygon needs at least 3 vertices")
    return Area(name, tuple((float(x), float(y)) for x, y in vertices), "polygon")


def area_table(spark: SparkSession, areas: Sequence[Area], aoi_set: str = "default") -> DataFrame:
    """Areas as rows, in matching order."""
    rows = []
    for k, a in enumerate(areas):
        if a.region_type == "polygon":
            xs, ys = zip(*a.region)
            rows.append((aoi_set, k, a.name, "polygon", min(xs), min(ys), max(xs), max(ys), [(x, y) for x, y in a.region]))
        else:
            rows.append((aoi_set, k, a.name, "rectangle", *(float(v) for v in a.region), None))
    return spark.createDataFrame(rows, AOIS)


def define_rectangles(df: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """Rectangle rows from two opposite corners in any order."""
    return df.withColumns(
        {
            "x_min": F.least(x1, x2),
            "y_min": F.least(y1, y2),
            "x_max": F.greatest(x1, x2),
            "y_max": F.greatest(y1, y2),
        }
    )


def area_name(x: Column, y: Column, areas: Sequence[Area]) -> Column:
    """Name of the first area, in list order, that contains the point."""
    found = []
    for a in areas:
        if a.region_type == "polygon":
            ring = F.array(*[F.struct(F.lit(px).alias("x"), F.lit(py).alias("y")) for px, py in a.region])
            xs, ys = zip(*a.region)
            inside = in_rectangle(x, y, *[F.lit(float(v)) for v in (min(xs), min(ys), max(xs), max(ys))]) & in_polygon(x, y, ring)
        else:
            inside = in_rectangle(x, y, *[F.lit(float(v)) for v in a.region])
        found.append(F.when(inside, F.lit(a.name)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def assign(fixations: DataFrame, areas: Sequence[Area]) -> DataFrame:
    """Add ``aoi_name`` for a handful of areas given in the program: a CASE chain, no join."""
    return fixations.withColumn("aoi_name", area_name(F.col("centroid_x"), F.col("centroid_y"), areas))


def _grids(aois: DataFrame) -> DataFrame:
    """(set, ``_gx``, ``_gy``, ``_w``, ``_h``): the corner and cell size of each set's grid.

    A cell is half the root mean square of the areas' widths and heights, so that the areas of a set, however unequal, touch
    no more than about nine cells each on average (the sum of their products is at most that of their squares).
    """
    wide = lambda low, high: F.greatest(F.sqrt(F.avg(F.pow(F.col(high) - F.col(low), 2))) / 2, F.lit(1e-9))
    return aois.groupBy("aoi_set").agg(
        F.min("x_min").alias("_gx"), F.min("y_min").alias("_gy"), wide("x_min", "x_max").alias("_w"), wide("y_min", "y_max").alias("_h"))


def _at(value: Column, corner: str, size: str) -> Column:
    return F.floor((value - F.col(corner)) / F.col(size))


#: Areas of a cell that are compared at once, and earlier ones that each is held against at most.
SEEN_AT_ONCE, SEEN_MOST = 256, 2048
#: Fewer areas of a cell than this stay as they are.
SEEN_FEW = 8


def _unseen(boxes: np.ndarray, fronts: np.ndarray) -> np.ndarray:
    """For each box (x0, y0, x1, y1) and each of those in front whether the latter holds all of it."""
    return (fronts[None, :, :2] <= boxes[:, None, :2]).all(axis=2) & (fronts[None, :, 2:] >= boxes[:, None, 2:]).all(axis=2)


def _seen(boxes: np.ndarray, whole: np.ndarray, fronts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a cell's areas, in their order, are not wholly behind an earlier one, and the boxes in front of the next ones."""
    seen = np.ones(len(boxes), bool)
    for k in range(0, len(boxes), SEEN_AT_ONCE):
        part, full = boxes[k:k + SEEN_AT_ONCE], whole[k:k + SEEN_AT_ONCE]
        open_ = np.flatnonzero(~_unseen(part, fronts).any(axis=1))
        behind = (_unseen(part[open_], part[open_]) & full[open_][None, :] & np.tri(len(open_), k=-1, dtype=bool)).any(axis=1)
        left = open_[~behind]
        seen[k:k + SEEN_AT_ONCE] = False
        seen[k + left] = True
        fronts = np.concatenate([fronts, part[left[full[left]]]])[:SEEN_MOST]
    return seen, fronts


def _seen_areas(batches):
    """Rows sorted by cell and order without areas that are in their cell wholly behind an earlier one, so never the first.

    Areas that overlap much hide each other, so a cell keeps few however many there are. Only boxes in front are held.
    """
    none = np.zeros((0, 4))
    now, fronts = None, none
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("aoi_set").to_pylist()
        cx, cy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cx", "_cy"))
        boxes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x0", "_y0", "_x1", "_y1")], axis=1).astype(float)
        whole = batch.column("_whole").to_numpy(zero_copy_only=False).astype(bool)
        other_set = np.array([a != b for a, b in zip(names, names[1:])], bool)
        edges = [0, *(np.flatnonzero(other_set | (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])) + 1).tolist(), batch.num_rows]
        keep = np.ones(batch.num_rows, bool)
        for a, b in zip(edges, edges[1:]):
            cell = names[a], cx[a], cy[a]
            if cell != now:
                now, fronts = cell, none
            if b - a >= SEEN_FEW or len(fronts) or b == batch.num_rows:
                keep[a:b], fronts = _seen(boxes[a:b], whole[a:b], fronts)
        yield batch.filter(pa.array(keep))


def index_areas(aois: DataFrame) -> DataFrame:
    """One row for each area and grid cell that it may touch; a cell that a polygon's edges pass by outside of is left out.

    ``covers`` says that the cell lies wholly inside, so its points need no further test. Areas that earlier ones hide in a
    cell are left out there.
    """
    # a small file is read by one task, and each area becomes several rows that are compared with its edges
    tasks = int(aois.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = aois.join(_grids(aois), "aoi_set").repartition(tasks, "aoi_set", "aoi_order", "name")
    span = lambda low, high, corner, size: F.explode(F.sequence(_at(F.col(low), corner, size), _at(F.col(high), corner, size)))
    df = df.withColumn("_cx", span("x_min", "x_max", "_gx", "_w")).withColumn("_cy", span("y_min", "y_max", "_gy", "_h"))
    x0, y0 = F.col("_gx") + F.col("_cx") * F.col("_w"), F.col("_gy") + F.col("_cy") * F.col("_h")
    # a little more than the cell, as points are dealt to cells with rounding
    px, py = F.col("_w") * 1e-6, F.col("_h") * 1e-6
    x0, x1, y0, y1 = x0 - px, x0 + F.col("_w") + px, y0 - py, y0 + F.col("_h") + py
    inner = (x0 >= F.col("x_min")) & (x1 <= F.col("x_max")) & (y0 >= F.col("y_min")) & (y1 <= F.col("y_max"))
    following = F.concat(F.slice("vertices", 2, F.size("vertices") - 1), F.slice("vertices", 1, 1))

    def near(a, b):
        """Whether an edge's box meets the cell: more cells than the edge itself touches, never fewer."""
        return ((F.least(a["x"], b["x"]) <= x1) & (F.greatest(a["x"], b["x"]) >= x0)
                & (F.least(a["y"], b["y"]) <= y1) & (F.greatest(a["y"], b["y"]) >= y0))

    edge = F.aggregate(F.zip_with("vertices", following, near), F.lit(False), lambda s, v: s | v)
    middle = in_polygon((x0 + x1) / 2, (y0 + y1) / 2, F.col("vertices"))
    is_polygon = F.col("region_type") == "polygon"
    touched = F.when(is_polygon, edge | middle).otherwise(F.lit(True))
    covers = F.when(is_polygon, ~edge & middle & inner).otherwise(inner)
    df = df.withColumn("covers", covers).filter(touched)
    # what a covering area holds of a cell is all of it; else a point of the area lies in its box and in the cell
    corner = lambda area, cell, more: F.when(F.col("covers"), cell).otherwise(more(area, cell))
    df = df.withColumns({
        "_x0": corner(F.col("x_min"), x0, F.greatest), "_y0": corner(F.col("y_min"), y0, F.greatest),
        "_x1": corner(F.col("x_max"), x1, F.least), "_y1": corner(F.col("y_max"), y1, F.least),
        "_whole": F.col("covers") | (F.col("region_type") == "rectangle")})
    cell, order = ["aoi_set", "_cx", "_cy"], ["aoi_set", "_cx", "_cy", "aoi_order", "name"]
    # first in each task, so that few rows are exchanged
    df = df.sortWithinPartitions(*order).mapInArrow(_seen_areas, df.schema)
    df = df.repartition(*cell).sortWithinPartitions(*order).mapInArrow(_seen_areas, df.schema)
    return df.select("aoi_set", "_cx", "_cy", "aoi_order", "name", "region_type", "x_min", "y_min", "x_max", "y_max", "covers",
                     F.when(~F.col("covers"), F.col("vertices")).alias("vertices"))


def assign_by_set(fixations: DataFrame, aois: DataFrame) -> DataFrame:
    """Add ``aoi_name`` where each fixation names its ``aoi_set``: the first area in order that contains it.

    Areas are listed under the cells of a grid over their set, and a fixation meets only those listed under its own cell, so
    a set may have any number of rectangles and polygons. Cells of the same set are joined apart.
    """
    df = fixations.withColumn("_id", F.struct(*[F.col(c) for c in fixations.columns]))
    point = df.join(_grids(aois), "aoi_set", "left")
    x, y = F.col("centroid_x"), F.col("centroid_y")
    point = point.select("aoi_set", "_id", F.col("centroid_x").alias("_px"), F.col("centroid_y").alias("_py"),
                         _at(x, "_gx", "_w").alias("_cx"), _at(y, "_gy", "_h").alias("_cy"))
    x, y = F.col("_px"), F.col("_py")
    inside = in_rectangle(x, y, *[F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")]) & (
        (F.col("region_type") == "rectangle") | in_polygon(x, y, F.col("vertices")))
    met = point.join(index_areas(aois), ["aoi_set", "_cx", "_cy"])
    first = met.filter(F.col("covers") | inside).groupBy("_id").agg(F.min(F.struct("aoi_order", "name")).alias("_first"))
    named = first.select("_id", F.col("_first.name").alias("aoi_name"))
    return df.join(named, "_id", "left").select(*fixations.columns, "aoi_name")


def with_visits(assigned: DataFrame) -> DataFrame:
    """Flag the fixations that enter their area (the fixation before lies elsewhere)."""
    df = shift(assigned, {"_previous": F.col("aoi_name")}, order=["event_index"])
    enters = F.col("aoi_name").isNotNull() & ~F.col("aoi_name").eqNullSafe(F.col("_previous"))
    return df.withColumn("enters", enters).drop("_previous")


def names_table(recordings: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every recording with every area name."""
    rows = F.array(*[F.struct(F.lit(k).alias("aoi_order"), F.lit(n).alias("aoi_name")) for k, n in enumerate(names)])
    return recordings.select(KEY, F.inline(rows))


def metrics(assigned: DataFrame, names: Sequence[str], durations: DataFrame) -> DataFrame:
    """One row per recording and area, also for areas never looked at.

    ``durations`` has ``duration_ms`` per recording; every recording in it gets its rows.
    """
    first = assigned.groupBy(KEY).agg(F.min("start_time_ms").alias("_first"))
    hits = (
        with_visits(assigned)
        .filter("aoi_name IS NOT NULL")
        .groupBy(KEY, "aoi_name")
        .agg(
            F.min("start_time_ms").alias("_hit"),
            F.sum("duration_ms").alias("dwell_ms"),
            F.count(F.lit(1)).alias("fixation_count"),
            F.count_if("enters").alias("visit_count"),
        )
    )
    total = durations.select(KEY, F.greatest("duration_ms", F.lit(0.0)).alias("_total"))
    grid = names_table(total, names)
    df = grid.join(total, KEY).join(first, KEY, "left").join(hits, [KEY, "aoi_name"], "left")
    df = df.fillna(0, ["dwell_ms", "fixation_count", "visit_count"])
    return df.select(
        KEY,
        "aoi_order",
        "aoi_name",
        (F.col("_hit") - F.col("_first")).alias("ttff_ms"),
        "dwell_ms",
        F.coalesce(F.col("dwell_ms") / F.nullif("_total", F.lit(0.0)), F.lit(0.0)).alias("dwell_prop"),
        "fixation_count",
        "visit_count",
        F.greatest(F.col("visit_count") - 1, F.lit(0)).alias("revisit_count"),
        F.coalesce(F.col("dwell_ms") / F.nullif("fixation_count", F.lit(0)), F.lit(0.0)).alias("mean_fixation_duration"),
    )


def transition_matrix(assigned: DataFrame, names: Sequence[str], recordings: DataFrame) -> DataFrame:
    """Row-normalised transitions between areas, as (source, target) rows incl. zeros.

    Unassigned fixations are left out first; each fixation whose area differs from the
    one before is one transition.
    """
    looked = assigned.filter("aoi_name IS NOT NULL")
    df = shift(looked, {"source": F.col("aoi_name")}, order=["event_index"])
    wanted = list(names)
    counts = (
        df.filter(F.col("source").isin(wanted) & F.col("aoi_name").isin(wanted) & (F.col("source") != F.col("aoi_name")))
        .groupBy(KEY, "source", F.col("aoi_name").alias("target"))
        .agg(F.count(F.lit(1)).alias("transitions"))
    )
    rows = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a in wanted for b in wanted])
    grid = recordings.select(KEY, F.inline(rows)).join(counts, [KEY, "source", "target"], "left")
    from pyspark.sql import Window

    total = F.sum("transitions").over(Window.partitionBy(KEY, "source"))
    return grid.withColumn(
        "probability", F.coalesce(F.col("transitions") / F.nullif(total, F.lit(0)), F.lit(0.0))
    ).withColumn("transitions", F.coalesce("transitions", F.lit(0)))


def wide_columns(metric_rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``{aoi}_{metric}`` columns, one row per recording."""
    picked = [F.max(m).alias(m) for m in METRIC_SUFFIXES]
    return metric_rows.groupBy(KEY).pivot("aoi_name", list(names)).agg(*picked)


def from_wide_columns(wide: DataFrame) -> DataFrame:
    """Metric rows from ``{aoi}_{metric}`` columns; nulls count as absent, areas without any value are left out."""
    # a longer suffix must not be read as a shorter one, so each column matches once
    areas: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        for suffix in METRIC_SUFFIXES:
            if c.endswith("_" + suffix):
                areas.setdefault(c[: -len(suffix) - 1], {})[suffix] = c
                break
    missing = F.lit(None).cast("double")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("aoi_name"),
                *[(F.col(f"`{cols[s]}`").cast("double") if s in cols else missing).alias(s) for s in METRIC_SUFFIXES],
            )
            for name, cols in areas.items()
        ]
    )
    df = wide.select(KEY, F.inline(rows)).filter(F.coalesce(*METRIC_SUFFIXES).isNotNull())
    visits, hits = F.bround(F.coalesce("visit_count", F.lit(0.0))), F.bround(F.coalesce("fixation_count", F.lit(0.0)))
    dwell = F.coalesce("dwell_ms", F.lit(0.0))
    return df.select(
        KEY,
        "aoi_name",
        "ttff_ms",
        dwell.alias("dwell_ms"),
        F.coalesce("dwell_prop", F.lit(0.0)).alias("dwell_prop"),
        hits.cast("long").alias("fixation_count"),
        visits.cast("long").alias("visit_count"),
        F.greatest(visits - 1, F.lit(0.0)).cast("long").alias("revisit_count"),
        F.coalesce(dwell / F.nullif(hits, F.lit(0.0)), F.lit(0.0)).alias("mean_fixation_duration"),
    )


SLOW_ENTRY_MS = 1500.0


def highlights(metric_rows: DataFrame) -> DataFrame:
    """Per recording: most dwelt, first seen, most revisited and last seen area (ties: list order)."""
    earlier = -F.col("aoi_order")
    seen = F.col("ttff_ms").isNotNull()
    found = metric_rows.groupBy(KEY).agg(
        F.max_by(F.struct("aoi_name", "dwell_ms", "dwell_prop"), F.struct("dwell_ms", earlier)).alias("_d"),
        F.min_by(F.struct("aoi_name", "ttff_ms"), F.when(seen, F.struct("ttff_ms", "aoi_order"))).alias("_f"),
        F.max_by(F.struct("aoi_name", "revisit_count"), F.struct("revisit_count", earlier)).alias("_r"),
        F.max_by(F.struct("aoi_name", "ttff_ms"), F.when(seen, F.struct("ttff_ms", earlier))).alias("_s"),
    )
    return found.select(
        KEY,
        F.col("_d.aoi_name").alias("top_dwell"),
        F.col("_d.dwell_ms").alias("top_dwell_ms"),
        F.col("_d.dwell_prop").alias("top_dwell_prop"),
        F.col("_f.aoi_name").alias("fastest"),
        F.col("_f.ttff_ms").alias("fastest_ms"),
        F.col("_r.aoi_name").alias("top_revisit"),
        F.col("_r.revisit_count").alias("top_revisits"),
        F.col("_s.aoi_name").alias("slowest"),
        F.col("_s.ttff_ms").alias("slowest_ms"),
        (F.coalesce(F.col("_s.ttff_ms"), F.lit(0.0)) > SLOW_ENTRY_MS).alias("slow_entry"),
    )
