"""Approximate entropy over every sample, by counting neighbours in cells.

Runs of ``m`` and ``m + 1`` neighbouring values are points. A point's neighbours differ by the tolerance at most in each value,
so they lie in its own cell or next to it when points are dealt to cells at least a tolerance wide by their first values. The
cells of a series are as many as it has points for, the points next to a cell are copied into it, and a cell with too many points
is cut in pieces that meet each other one by one. Every piece is counted by itself, so none holds a series; neighbours in several
pieces are summed up by Spark. Recordings of few samples are counted whole instead, many of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.ordered import is_split, settle, shift, with_recording_values
from saccadia.schema import BLOCK, INDEX, KEY

MIN_POINTS = 12
#: Points of a series for each cell, and the most that meet in one piece (their places are 16-bit numbers).
CELL_POINTS_CONF, MOST_POINTS_CONF = "spark.saccadia.entropyPointsPerCell", "spark.saccadia.entropyMostPoints"
CELL_POINTS, MOST_POINTS = 16_000, 60_000
#: Points compared at once with all points of a piece.
STRIDE = 128
#: The most samples of a recording that is counted whole, as one row; and pairs compared at once.
SHORT_CONF, SHORT, PAIRS = "spark.saccadia.entropyShort", 512, 1 << 20

SERIES = [KEY, "signal"]
PIECE = [*SERIES, "_ca", "_cb", "_i", "_j"]


def approximate_entropy(values: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """The formula for one series in memory, in quadratic time: what the tests compare with."""
    tolerance = max(r * float(np.std(values)), 1e-6)

    def phi(order):
        windows = np.lib.stride_tricks.sliding_window_view(values, order)
        logs = np.empty(len(windows))
        for at in range(0, len(windows), 256):
            part = windows[at : at + 256]
            near = (np.abs(part[:, None, :] - windows[None, :, :]) <= tolerance).all(axis=2)
            logs[at : at + 256] = np.log(np.maximum(near.mean(axis=1), 1e-12))
        return logs.mean()

    return float(phi(m) - phi(m + 1)) if len(values) > m + 1 else 0.0


def _with_following(df: DataFrame, signals: tuple[str, ...], m: int) -> DataFrame:
    """(recording, signal, index, v0 ... vm, and the series' count, tolerance base, least value and span), nulls left out."""
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("v0")) for c in signals]))
    stats = {"_n": F.count("v0"), "_sd": F.stddev_pop("v0"), "_low": F.min("v0"), "_high": F.max("v0")}
    if not is_split(df):
        df = df.select(KEY, INDEX, value.alias("_v")).select(KEY, INDEX, "_v.*").filter("v0 IS NOT NULL")
        w, whole = Window.partitionBy(*SERIES).orderBy(INDEX), Window.partitionBy(*SERIES)
        return df.withColumns({f"v{k}": F.lead("v0", k).over(w) for k in range(1, m + 1)} | {n: c.over(whole) for n, c in stats.items()})
    # a series takes the place of a recording
    df = df.select(KEY, BLOCK, INDEX, value.alias("_v")).select(KEY, BLOCK, INDEX, "_v.*").filter("v0 IS NOT NULL")
    df = settle(df.withColumn(KEY, F.concat_ws(":", "signal", KEY)))
    for k in range(1, m + 1):
        df = shift(df, {f"v{k}": F.col(f"v{k - 1}")}, ahead=True)
    df = with_recording_values(df, stats)
    return df.withColumn(KEY, F.expr(f"substring({KEY}, length(signal) + 2)"))


def _points(df: DataFrame, m: int, r: float) -> DataFrame:
    """The points of series that are long enough, with tolerance and home cell (by their first two values)."""
    size = int(df.sparkSession.conf.get(CELL_POINTS_CONF, str(CELL_POINTS)))
    tolerance = F.greatest(r * F.col("_sd"), F.lit(1e-6))
    df = df.filter((F.col("_n") >= MIN_POINTS) & F.col(f"v{m - 1}").isNotNull()).withColumn("_tol", tolerance)
    most = F.floor((F.col("_high") - F.col("_low")) / F.col("_tol"))
    cells = F.greatest(F.least(F.ceil(F.sqrt(F.col("_n") / size)), most), F.lit(1))
    df = df.withColumn("_cells", cells.cast("int")).withColumn("_width", (F.col("_high") - F.col("_low")) / F.col("_cells"))
    return df.withColumns({"_ha": _cell(F.col("v0")), "_hb": _cell(F.col("v1" if m > 1 else "v0"))})


def _cell(value: Column) -> Column:
    place = F.floor((value - F.col("_low")) / F.nullif("_width", F.lit(0.0)))
    return F.coalesce(F.least(F.greatest(place, F.lit(0)), F.col("_cells") - 1), F.lit(0)).cast("int")


def _reach(value: Column) -> Column:
    """The cells that a value's neighbours may lie in; a little more, as cells are found with rounding."""
    far = F.col("_tol") * (1 + 1e-6) + F.abs(value) * 1e-12
    return F.explode(F.sequence(_cell(value - far), _cell(value + far)))


def _pieces(points: DataFrame, m: int) -> DataFrame:
    """Points in all pieces where they are counted (``_asks``) or are others' neighbours (``_near``)."""
    size = int(points.sparkSession.conf.get(MOST_POINTS_CONF, str(MOST_POINTS)))
    second = F.col("v1" if m > 1 else "v0")
    copies = points.withColumn("_ca", _reach(F.col("v0"))).withColumn("_cb", _reach(second))
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    # as many points as a cell can have at most: those of it and of the cells next to it
    counts = points.groupBy(*SERIES, F.col("_ha").alias("_ca"), F.col("_hb").alias("_cb")).agg(F.count("*").alias("_m"))
    counts = counts.withColumn("_da", around).withColumn("_db", around).groupBy(
        *SERIES, (F.col("_ca") + F.col("_da")).alias("_ca"), (F.col("_cb") + F.col("_db")).alias("_cb")).agg(F.sum("_m").alias("_m"))
    counts = counts.select(*SERIES, "_ca", "_cb", F.ceil(F.col("_m") / size).cast("int").alias("_parts"))
    df = copies.join(counts, [*SERIES, "_ca", "_cb"])
    own = (F.hash(F.lit(1), INDEX) % F.col("_parts") + F.col("_parts")) % F.col("_parts")
    every = F.sequence(F.lit(0), F.col("_parts") - 1)
    home = (F.col("_ca") == F.col("_ha")) & (F.col("_cb") == F.col("_hb"))
    pair = lambda i, j, asks, near: F.struct(i.alias("_i"), j.alias("_j"), asks.alias("_asks"), near.alias("_near"))
    near = F.transform(every, lambda i: pair(i, own, home & (i == own), F.lit(True)))
    asks = F.when(home, F.filter(F.transform(every, lambda j: pair(own, j, F.lit(True), F.lit(False))), lambda p: p["_j"] != own))
    spread = F.explode(F.concat(near, F.coalesce(asks, F.array().cast(_pair_type()))))
    values = [f"v{k}" for k in range(m + 1)]
    return df.select(*SERIES, "_ca", "_cb", "_parts", INDEX, "_tol", "_n", *values, spread.alias("_p")).select(
        *PIECE[:4], "_p.*", "_parts", INDEX, "_tol", "_n", *values)


def _pair_type() -> str:
    return "array<struct<_i: int, _j: int, _asks: boolean, _near: boolean>>"


def _bounds(values: np.ndarray, sorted_values: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Places ``low:high`` of the sorted values that differ from each value by the tolerance at most, as subtraction rounds."""
    n = len(sorted_values)
    low = np.searchsorted(sorted_values, values - tolerance, "left")
    high = np.searchsorted(sorted_values, values + tolerance, "right")
    for _ in range(n):
        moved = (low > 0) & (np.abs(values - sorted_values[np.maximum(low - 1, 0)]) <= tolerance)
        low = low - moved
        back = (low < high) & (np.abs(values - sorted_values[np.minimum(low, n - 1)]) > tolerance)
        low = low + back
        onward = (high < n) & (np.abs(values - sorted_values[np.minimum(high, n - 1)]) <= tolerance)
        high = high + onward
        less = (high > low) & (np.abs(values - sorted_values[np.maximum(high - 1, 0)]) > tolerance)
        high = high - less
        if not (moved | back | onward | less).any():
            break
    return low, high


def count_near(asking: np.ndarray, near: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point (a row of ``asking``) how many points of ``near`` differ by the tolerance at most in all values but the
    last one, and in all values. Points without a last value have it NaN and are near none in the second sense.

    Values become 16-bit places in their order, so that a comparison is one subtraction of small integers.
    """
    order = np.argsort(near[:, 0], kind="stable")
    near = near[order]
    queue = np.argsort(asking[:, 0], kind="stable")
    asks = asking[queue]
    places, low, wide = [], [], []
    for k in range(asking.shape[1]):
        by = np.argsort(near[:, k], kind="stable")
        place = np.empty(len(by), np.uint16)
        place[by] = np.arange(len(by))
        known = int(np.count_nonzero(~np.isnan(near[:, k])))  # NaN is last
        a, b = _bounds(asks[:, k], near[by[:known], k], tolerance) if known else (np.zeros(len(asks), np.int64),) * 2
        places.append(place)
        low.append(a.astype(np.uint16))
        wide.append(np.where(np.isnan(asks[:, k]), 0, b - a).astype(np.uint16))
    first, last = low[0].astype(np.int64), low[0].astype(np.int64) + wide[0]
    found = np.zeros((2, len(asks)), np.int64)
    for at in range(0, len(asks), STRIDE):
        part = slice(at, at + STRIDE)
        a, b = int(first[part].min()), int(last[part].max())
        if a >= b:
            continue
        met = np.ones((len(asks[part]), b - a), bool)
        for k, place in enumerate(places):
            if k == len(places) - 1:
                found[0, queue[part]] = _row_counts(met)
            met &= (place[a:b] - low[k][part, None]) < wide[k][part, None]
        found[1, queue[part]] = _row_counts(met)
    return found[0], found[1]


def _row_counts(met: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.packbits(met, axis=1)).sum(axis=1, dtype=np.int64)


def _count(m: int):
    """Pieces in a sorted stream: their sums of logarithms, or counts by point where a point has neighbours in several pieces."""
    def whole(table: pa.Table) -> pa.RecordBatch:
        first = lambda name: table.column(name)[0].as_py()
        flags = [table.column(name).to_numpy(zero_copy_only=False).astype(bool) for name in ("_asks", "_near")]
        points = np.column_stack([table.column(f"v{k}").cast(pa.float64()).fill_null(float("nan")).to_numpy() for k in range(m + 1)])
        few, more = count_near(points[flags[0]], points[flags[1]], first("_tol"))
        n, index = first("_n"), table.column(INDEX).to_numpy()[flags[0]]
        own = ~np.isnan(points[flags[0]][:, m])
        if first("_parts") > 1:
            rows = len(few)
            columns = [pa.array(index), pa.array(few), pa.array(np.where(own, more, 0)), pa.array(np.zeros(rows)), pa.array(np.zeros(rows))]
        else:
            logs = np.log(few / (n - m + 1)).sum(), np.log(more[own] / (n - m)).sum()
            rows = 1
            columns = [pa.array([None], pa.int64()), pa.array([0]), pa.array([0]), *[pa.array([float(x)]) for x in logs]]
        keys = [pa.array([first(c)] * rows, pa.string()) for c in SERIES]
        return pa.RecordBatch.from_arrays([*keys, pa.array([n] * rows, pa.int64()), *columns], names=[*SERIES, "n", "at", "few", "more", "log_few", "log_more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            edges = group_edges(table, PIECE)
            for a, b in zip(edges[:-2], edges[1:-1]):
                yield whole(table.slice(a, b - a))
            waiting = table.slice(edges[-2]) if len(edges) > 1 else None
        if waiting is not None:
            yield whole(waiting)

    return run


def group_edges(table: pa.Table, keys: list[str]) -> list[int]:
    """Where the groups of equal keys of a sorted table begin, and its length; nothing but 0 for an empty one."""
    if not table.num_rows:
        return [0]
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for name in keys:
        codes = table.column(name).combine_chunks()
        codes = (codes.dictionary_encode().indices if pa.types.is_string(codes.type) else codes).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return [*np.flatnonzero(change).tolist(), table.num_rows]


def _packed(df: DataFrame, signals: tuple[str, ...], most: int) -> DataFrame:
    """One row for up to ``most`` neighbouring samples of a recording, with their spread; a recording's only row holds all of it."""
    rows = F.collect_list(F.struct(INDEX, *[F.col(c).cast("double").alias(c) for c in signals])).alias("_rows")
    spread = [F.stddev_pop(c).alias(f"_sd_{c}") for c in signals]
    return df.groupBy(KEY, F.floor(F.col(INDEX) / most).alias("_nth")).agg(rows, *spread).drop("_nth")


def _short_and_long(df: DataFrame, signals: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Short recordings as one row each, and the samples of the others."""
    most = int(df.sparkSession.conf.get(SHORT_CONF, str(SHORT)))
    if is_split(df):
        marked = with_recording_values(df, {"_last": F.max(INDEX)})
        return _packed(marked.filter(F.col("_last") < most), signals, most), marked.filter(F.col("_last") >= most).drop("_last")
    # both sides read the packed rows of one exchange, so that what leads to the samples is done once
    counted = _packed(df, signals, most).repartition(KEY).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(KEY)))
    return counted.filter("_of = 1").drop("_of"), counted.filter("_of > 1").select(KEY, F.inline("_rows"))


def whole_entropies(values: np.ndarray, lengths: np.ndarray, tolerance: np.ndarray, m: int) -> np.ndarray:
    """Entropy of each of many short series, given one after the other; all pairs of points of a series are compared."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    found = np.empty(len(lengths))
    wide = -(-lengths // 8) * 8
    for size in np.unique(wide):
        alike = np.flatnonzero(wide == size)
        step = max(1, PAIRS // int(size * size))
        for at in range(0, len(alike), step):
            some = alike[at : at + step]
            n, place = lengths[some, None], np.arange(size)[None, :]
            table = np.where(place < n, values[np.minimum(starts[some, None] + place, len(values) - 1)], np.nan)
            close = np.abs(table[:, :, None] - table[:, None, :]) <= tolerance[some, None, None]
            met = close
            phi = []
            for order in range(1, m + 2):
                if order > 1:
                    met = met[:, :-1, :-1] & close[:, order - 1 :, order - 1 :]
                if order >= m:
                    points = n - order + 1
                    own = place[:, : met.shape[1]] < points
                    with np.errstate(divide="ignore"):
                        logs = np.log(np.where(own, np.count_nonzero(met, axis=2), points) / points)
                    phi.append(logs.sum(axis=1) / points[:, 0])
            with np.errstate(invalid="ignore"):
                found[some] = phi[0] - phi[1]
    return found


def _whole(signals: tuple[str, ...], m: int, r: float):
    """Entropies of recordings that are one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column(KEY), batch.column("_rows")
            samples = rows.flatten()
            row = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((samples.field(INDEX).to_numpy(zero_copy_only=False), row))
            row = row[order]
            for name in signals:
                field = samples.field(name)
                known = field.is_valid().to_numpy(zero_copy_only=False)[order]
                values, owner = field.to_numpy(zero_copy_only=False)[order][known], row[known]
                lengths = np.bincount(owner, minlength=len(rows))
                enough = lengths >= MIN_POINTS
                spread = batch.column(f"_sd_{name}").fill_null(0.0).to_numpy(zero_copy_only=False)
                found = whole_entropies(values[enough[owner]], lengths[enough], np.maximum(r * spread[enough], 1e-6), m)
                kept = keys.filter(pa.array(enough))
                yield pa.RecordBatch.from_arrays([kept, pa.array([name] * len(kept), pa.string()), pa.array(found, pa.float64())], names=[*SERIES, "apen"])

    return run


def entropies(df: DataFrame, signals: tuple[str, ...], m: int = 2, r: float = 0.2) -> DataFrame:
    """(recording, signal, ``apen``) for series of at least ``MIN_POINTS`` values; rows are in the order of the sample index."""
    short, long = _short_and_long(df, signals)
    whole = short.mapInArrow(_whole(signals, m, r), f"{KEY} string, signal string, apen double")
    return whole.union(_long_entropies(long, signals, m, r))


def _long_entropies(df: DataFrame, signals: tuple[str, ...], m: int, r: float) -> DataFrame:
    points = settle(_points(_with_following(df, signals, m), m, r))
    dealt = _pieces(points, m).repartition(*PIECE).sortWithinPartitions(*PIECE)
    schema = f"{KEY} string, signal string, n long, at long, few long, more long, log_few double, log_more double"
    found = dealt.mapInArrow(_count(m), schema)
    each = found.groupBy(*SERIES, "n", "at").agg(*[F.sum(c).alias(c) for c in ("few", "more", "log_few", "log_more")])
    few = F.when(F.col("at").isNull(), F.col("log_few")).otherwise(F.ln(F.col("few") / (F.col("n") - m + 1)))
    more = F.when(F.col("at").isNull(), F.col("log_more")).otherwise(F.coalesce(F.ln(F.col("more") / (F.col("n") - m)), F.lit(0.0)))
    n = F.first("n")
    return each.groupBy(*SERIES).agg((F.sum(few) / (n - m + 1) - F.sum(more) / (n - m)).alias("apen"))
