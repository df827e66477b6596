"""Density maps and other gridded views of gaze."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.functions.ordered import is_split, join_recording, ordinal, settle, with_recording_values
from saccadia.functions.ranks import recording_quantiles
from saccadia.schema import BLOCK, KEY

#: Maps of one Arrow batch on its way out of a task.
MAPS_PER_BATCH = 64


def gaze_histogram(samples: DataFrame, bins: int = 40) -> DataFrame:
    """Counts of valid samples in equal bins over the recording's own extent; empty cells are absent."""
    valid = samples.filter(F.col("valid") & F.col("x").isNotNull() & F.col("y").isNotNull())
    df = with_recording_values(valid, {f"_{k}_{c}": getattr(F, k)(c) for k in ("min", "max") for c in "xy"})

    def bin_of(c):
        span = F.col(f"_max_{c}") - F.col(f"_min_{c}")
        place = F.floor((F.col(c) - F.col(f"_min_{c}")) / F.nullif(span, F.lit(0.0)) * bins)
        return F.least(F.coalesce(place, F.lit(bins // 2)), F.lit(bins - 1)).cast("long")

    return df.groupBy(KEY, bin_of("x").alias("bin_x"), bin_of("y").alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def placed_fixations(fixations: DataFrame) -> DataFrame:
    return fixations.filter(F.col("centroid_x").isNotNull() & F.col("centroid_y").isNotNull())


def fixation_seeds(fixations: DataFrame) -> DataFrame:
    """Fixation centres weighted by duration relative to the recording's median (40 ms at least)."""
    placed = settle(placed_fixations(fixations))
    medians = recording_quantiles(placed, [KEY], {"_median": ("duration_ms", 0.5)})
    df = join_recording(placed, medians)
    weight = F.greatest("duration_ms", F.lit(40.0)) / F.greatest("_median", F.lit(40.0))
    return df.select(KEY, "event_index", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), weight.alias("weight"), *([BLOCK] if is_split(df) else []))


def padded_extent(samples: DataFrame) -> DataFrame:
    """Plot range per recording: the extent of valid samples plus a margin."""
    valid = samples.filter("valid")
    found = valid.groupBy(KEY).agg(*[getattr(F, k)(c).alias(f"_{k}_{c}") for k in ("min", "max") for c in "xy"])
    pads = {c: F.greatest((F.col(f"_max_{c}") - F.col(f"_min_{c}")) * share, F.lit(120.0)) for c, share in (("x", 0.18), ("y", 0.20))}
    return found.select(
        KEY,
        *[(F.col(f"_min_{c}") - pads[c]).alias(f"{c}0") for c in "xy"],
        *[(F.col(f"_max_{c}") + pads[c]).alias(f"{c}1") for c in "xy"],
    )


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    for k in range(len(column)):
        yield column[k].values.to_numpy(zero_copy_only=False)


def _packed(keys: list, layers: dict[str, list[np.ndarray]], width: int, name: str = KEY) -> pa.RecordBatch:
    """Maps as rows: ``width`` and, per layer, the cells of a map one row of it after the other."""
    columns = {name: pa.array(keys, pa.string()), "width": pa.array([width] * len(keys), pa.int32())}
    for layer, maps in layers.items():
        stops = np.cumsum([0, *(m.size for m in maps)])
        columns[layer] = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate([m.ravel() for m in maps])))
    return pa.RecordBatch.from_pydict(columns)


def _summed(parts: Iterator[tuple[str, dict[str, np.ndarray]]], width: int) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each map, which follow one another; one map is held, and those of a batch on their way out."""
    keys, done, current, sums = [], {}, None, None
    for key, found in parts:
        if sums is not None and key == current:
            sums = {n: sums[n] + found[n] for n in sums}
            continue
        if sums is not None:
            keys.append(current)
            for n, m in sums.items():
                done.setdefault(n, []).append(m)
            if len(keys) == MAPS_PER_BATCH:
                yield _packed(keys, done, width)
                keys, done = [], {}
        current, sums = key, found
    if sums is not None:
        for n, m in sums.items():
            done.setdefault(n, []).append(m)
        yield _packed([*keys, current], done, width)


def _together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a map in one task, one after the other.

    Tasks are as many as the setting says, also over few bytes, as each small row becomes thousands of cells: the hash is an
    exchange of its own, which Spark neither merges with one by the keys nor makes smaller.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys)).sortWithinPartitions(*keys)


def _mapped(parts: list[tuple[DataFrame, Callable]], schema) -> DataFrame:
    """Maps made of each source by its function, one below the other, with a note of how, for ``_then``."""
    frames = [source.mapInArrow(run, schema) for source, run in parts]
    out = functools.reduce(DataFrame.union, frames)
    out._made_by = parts
    return out


def _then(maps: DataFrame, step: Callable, schema) -> DataFrame:
    """``step`` after what made the maps, in the same pass if that was one of these operators.

    A map is some 150 KB: between passes of their own, batches of tens of MB would be held by Spark and by two Python processes
    at each step and core. In one pass only seeds go in, and a task holds some ``MAPS_PER_BATCH`` maps at each step.
    """
    def after(run):
        return lambda batches: step(run(batches))

    made_by = vars(maps).get("_made_by")
    return _mapped([(source, after(run)) for source, run in made_by] if made_by else [(maps, step)], schema)


def kernel_density(seeds: DataFrame, extent: DataFrame, bins: int = 140, sigma: float | None = None, fixation_sigma: float | None = None) -> DataFrame:
    """Gaussian sum of weighted seeds on a ``bins`` × ``bins`` grid of every recording with seeds, one row a map.

    Seeds, not cells, are exchanged: those of a recording stream through one task that adds
    them to its map (one matrix product per recording and batch). In the block layout each
    block of a long recording gives a partial map, and these are added up after an exchange.
    ``cells`` holds the map; with ``fixation_sigma`` there are also ``fixation_cells``, the density of seeds of equal
    weight, and ``hits``, the number of seeds nearest to each cell, for ``map_vs_fixations``.
    """
    def gauss(part, w, sx, sy, xs, ys):
        kx = np.exp(-((xs[None, :] - part["x"].to_numpy()[:, None]) ** 2) / (2 * sx * sx))
        ky = np.exp(-((ys[None, :] - part["y"].to_numpy()[:, None]) ** 2) / (2 * sy * sy))
        return (ky * w[:, None]).T @ kx

    def hits(part, x0, x1, y0, y1):
        gx, gy = ((part[c].to_numpy() - a) / (b - a) * (bins - 1) for c, a, b in (("x", x0, x1), ("y", y0, y1)))
        known = ~(np.isnan(gx) | np.isnan(gy))
        found = np.zeros((bins, bins))
        np.add.at(found, tuple(np.clip(np.rint(g[known]), 0, bins - 1).astype(np.int64) for g in (gy, gx)), 1.0)
        return found

    def parts_of(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for key, part in frame.groupby(KEY, sort=False):
                x0, x1, y0, y1 = part[["x0", "x1", "y0", "y1"]].iloc[0]
                xs, ys = np.linspace(x0, x1, bins), np.linspace(y0, y1, bins)
                sx = sigma or max(max(x1 - x0, 1.0) * 0.032, 24.0)
                sy = sigma or max(max(y1 - y0, 1.0) * 0.032, 24.0)
                maps = {"cells": gauss(part, part["weight"].to_numpy(), sx, sy, xs, ys)}
                if fixation_sigma:
                    maps["fixation_cells"] = gauss(part, np.ones(len(part)), fixation_sigma, fixation_sigma, xs, ys)
                    maps["hits"] = hits(part, x0, x1, y0, y1)
                yield key, maps

    layers = ["cells", *(["fixation_cells", "hits"] if fixation_sigma else [])]
    schema = f"{KEY} string, width int, " + ", ".join(f"{n} array<double>" for n in layers)

    def maps_from(df, *keys):
        found = _together(df.select(KEY, *keys, "x", "y", "weight", "x0", "x1", "y0", "y1"), KEY, *keys)
        return found, lambda batches: _summed(parts_of(batches), bins)

    if not is_split(seeds):
        return _mapped([maps_from(join_recording(seeds, extent))], schema)
    seeds = settle(seeds)
    blocks = seeds.groupBy(KEY).agg(F.count_distinct(BLOCK).alias("_blocks"))
    placed = settle(join_recording(seeds, blocks.join(extent, KEY, "left")))
    partial = _together(_mapped([maps_from(placed.filter("_blocks > 1"), BLOCK)], schema), KEY)

    def add_up(batches):
        read = ((batch.column(0)[k].as_py(), dict(zip(layers, maps))) for batch in batches
                for k, maps in enumerate(zip(*[_rows(batch.column(n)) for n in layers])))
        return _summed(read, bins)

    return _mapped([maps_from(placed.filter("_blocks = 1")), (partial, add_up)], schema)


def to_cells(maps: DataFrame, image: str = KEY) -> DataFrame:
    """One row per cell of each map: ``(image, gy, gx, s)``."""
    cells = maps.select(image, "width", F.posexplode("cells").alias("_at", "s"))
    return cells.select(image, F.expr("CAST(_at DIV width AS int)").alias("gy"), (F.col("_at") % F.col("width")).alias("gx"), "s")


def to_maps(grid: DataFrame, image: str = KEY) -> DataFrame:
    """Full grids of cells ``(image, gy, gx, s)`` as one row a map, the form the functions below take."""
    cells = F.array_sort(F.collect_list(F.struct("gy", "gx", "s")))
    return grid.groupBy(image).agg((F.max("gx") + 1).cast("int").alias("width"), cells.alias("_c")).select(image, "width", F.col("_c.s").alias("cells"))


def _each_map(maps: DataFrame, change) -> DataFrame:
    """Maps with ``change`` applied to the cells, a matrix; a map is small whatever it was made from."""
    at = maps.columns.index("cells")

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, MAPS_PER_BATCH):
                part = batch.slice(first, MAPS_PER_BATCH)
                widths = part.column("width").to_pylist()
                done = [change(m.reshape(-1, w)).ravel() for m, w in zip(_rows(part.column("cells")), widths)]
                stops = np.cumsum([0, *(m.size for m in done)])
                cells = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(done)))
                yield part.set_column(at, "cells", cells)

    return _then(maps, run, maps.schema)


def percentile_of(values: np.ndarray, p: float) -> float:
    """Linearly interpolated percentile of sorted values, as Spark's ``percentile`` computes it."""
    place = (values.size - 1) * p
    low, high = int(np.floor(place)), int(np.ceil(place))
    if low == high or values[low] == values[high]:
        return values[low]
    return (high - place) * values[low] + (place - low) * values[high]


def attention_density(fixations: DataFrame, samples: DataFrame, bins: int = 140, fixation_sigma: float | None = None) -> DataFrame:
    """Attention map per recording, its peak scaled to 1; see ``kernel_density`` for ``fixation_sigma``."""
    def scaled(s):
        peak = s.max()
        return s / peak if peak else np.zeros_like(s)

    return _each_map(kernel_density(fixation_seeds(fixations), padded_extent(samples), bins, fixation_sigma=fixation_sigma), scaled)


def smooth_density(maps: DataFrame, passes: int = 3) -> DataFrame:
    """Binomial blur (1 4 6 4 1)/16 along y, then x, per pass; outside the grid counts as 0."""
    weights = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)

    def along_y(s):
        wide = np.pad(s, ((2, 2), (0, 0)))
        return sum(k * wide[at:at + len(s)] for at, k in enumerate(weights))

    def blur(s):
        for _ in range(passes):
            s = along_y(along_y(s).T).T
        return s

    return _each_map(maps, blur)


def cut_low(maps: DataFrame, percentile: float = 0.18) -> DataFrame:
    """Cells below the given percentile of the map's positive cells become 0."""
    def cut(s):
        positive = np.sort(s[~(s <= 0)])
        return np.where(s < percentile_of(positive, percentile), 0.0, s) if positive.size else s

    return _each_map(maps, cut)


def fixation_scanpath(fixations: DataFrame) -> DataFrame:
    """Fixations in order with a duration-scaled marker size and progress from 0 to 1."""
    df = ordinal(fixations, "order", ["event_index"])
    df = ordinal(placed_fixations(df), "_k", ["event_index"])
    df = with_recording_values(df, {"_n": F.count(F.lit(1)), "_longest": F.max(F.greatest("duration_ms", F.lit(1.0)))})
    return df.select(
        KEY,
        "order",
        F.col("centroid_x").alias("x"),
        F.col("centroid_y").alias("y"),
        "duration_ms",
        (18.0 + 24.0 * (F.greatest("duration_ms", F.lit(1.0)) / F.col("_longest"))).alias("marker_size"),
        F.coalesce((F.col("_k") - 1) / F.nullif(F.col("_n") - 1, F.lit(0)), F.lit(0.0)).alias("progress"),
    )


def _per_map(maps: DataFrame, image: str, columns: list[str], schema: dict[str, str], measure) -> DataFrame:
    """One row per map: the values that ``measure`` finds in the named layers, or none where it gives None."""
    def run(batches):
        for batch in batches:
            batch = batch.select([image, "width", *columns])
            keys, found = [], []
            for k, layers in enumerate(zip(batch.column("width").to_pylist(), *[_rows(batch.column(c)) for c in columns])):
                values = measure(*[m.reshape(-1, layers[0]) for m in layers[1:]])
                if values is not None:
                    keys.append(k)
                    found.append(values)
            rows = {n: pa.array([v[n] for v in found], {"double": pa.float64(), "long": pa.int64()}[kind]) for n, kind in schema.items()}
            yield pa.RecordBatch.from_pydict({image: batch.column(image).take(pa.array(keys, pa.int64())), **rows})

    out = maps.select(image).schema
    for n, kind in schema.items():
        out = out.add(n, kind)
    return _then(maps if "_made_by" in vars(maps) else maps.select(image, "width", *columns), run, out)


SUMMARY = {"total_mass": "double", "mean_saliency": "double", "peak_saliency": "double", "peak_y": "long", "peak_x": "long",
           "attention_center_x": "double", "attention_center_y": "double", "hotspot_ratio": "double", "entropy": "double"}


def grid_summary(maps: DataFrame, image: str = KEY) -> DataFrame:
    """Peak, mean, centre of mass, hotspot share and normalised entropy of each map."""
    def measure(s):
        height, width = s.shape
        mass = s.sum()
        peak_y, peak_x = np.unravel_index(np.argmax(s), s.shape)
        heavy = not mass <= 1e-8
        entropy = 0.0
        if not mass <= 1e-12 and s.size > 1:
            p = s / mass
            entropy = -(p * np.log2(p + 1e-12)).sum() / np.log2(s.size)
        return {
            "total_mass": mass, "mean_saliency": mass / s.size, "peak_saliency": s.max(), "peak_y": int(peak_y), "peak_x": int(peak_x),
            "attention_center_x": (s.sum(axis=0) * np.arange(width)).sum() / mass if heavy else width / 2.0,
            "attention_center_y": (s.sum(axis=1) * np.arange(height)).sum() / mass if heavy else height / 2.0,
            "hotspot_ratio": 1.0 - (s < 0.75).mean(), "entropy": entropy,
        }

    return _per_map(maps, image, ["cells"], SUMMARY, measure)


def robust_normalize(maps: DataFrame) -> DataFrame:
    """Clip each map to its 2nd–98th percentile and scale to 0–1; a flat map is divided by its peak."""
    def scaled(s):
        s = np.where(np.isnan(s), 0.0, s)
        ordered = np.sort(s, axis=None)
        low, high, peak = percentile_of(ordered, 0.02), percentile_of(ordered, 0.98), ordered[-1]
        if high - low <= 1e-8:
            return s / peak if peak > 0 else np.zeros_like(s)
        return (np.clip(s, low, high) - low) / (high - low)

    return _each_map(maps, scaled)


def map_vs_fixations(maps: DataFrame, fixations: DataFrame | None = None, extent: DataFrame | None = None, bins: int = 140, sigma: float = 28.0) -> DataFrame:
    """NSS, similarity and KL divergence between a map and the density of fixations on the same grid.

    Maps with the layers ``fixation_cells`` and ``hits`` (``kernel_density`` with ``fixation_sigma``)
    are not exchanged. For maps from elsewhere both layers are made of ``fixations`` and joined.
    """
    if "hits" not in maps.columns:
        placed = placed_fixations(fixations)
        weighted = placed.select(KEY, *([BLOCK] if is_split(placed) else []), F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), F.lit(1.0).alias("weight"))
        maps = maps.join(kernel_density(weighted, extent, bins, sigma, sigma).drop("cells", "width"), KEY)

    def measure(s, density, hits):
        n = hits.sum()
        if not n:
            return None
        spread = s.std()
        z = (s - s.mean()) / spread if spread else None
        nss = None if z is None else (z * hits).sum() / n
        p = np.maximum(s, 1e-12)
        p = p / p.sum()
        q = density / density.sum()
        some = q > 0
        return {
            "nss_mean": nss,
            "nss_std": None if z is None else np.sqrt(max((z * z * hits).sum() / n - nss**2, 0.0)),
            "sim": np.minimum(p, q).sum(),
            "kl_divergence": (q[some] * np.log(q[some] / p[some])).sum(),
        }

    names = ["nss_mean", "nss_std", "sim", "kl_divergence"]
    return _per_map(maps, KEY, ["cells", "fixation_cells", "hits"], dict.fromkeys(names, "double"), measure)
