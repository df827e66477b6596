"""Ordered computation over recordings, safe for very long recordings.

Everything in a recording happens in time order, so the natural plan is a window
partitioned by recording. One recording may hold a third of all rows, and a window
partition cannot be split by AQE, so the layout step looks at the recording lengths:

* no recording longer than ``rows_per_block``: samples keep one partition key, the
  recording, and one exchange serves every window and aggregate after it;
* otherwise the samples get a ``block`` column (``sample_index div rows_per_block``) and every
  window is partitioned by ``(recording_id, block)``. What crosses a block edge is
  carried by one summary row per block, or by copies of the rows next to the edge.

The functions below look at the columns to see which layout they are given; their
results are the same in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.storage import materialize
from saccadia.schema import BLOCK, INDEX, KEY

ROWS_PER_BLOCK_CONF = "spark.saccadia.rowsPerBlock"
DEFAULT_ROWS_PER_BLOCK = 2_000_000
MAX_BROADCAST_ROWS = 200_000
MOST_CELLS = 256


def rows_per_block(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_BLOCK_CONF, str(DEFAULT_ROWS_PER_BLOCK)))


def partition_keys(df: DataFrame) -> list[str]:
    return [KEY, BLOCK] if BLOCK in df.columns else [KEY]


def is_split(df: DataFrame) -> bool:
    return BLOCK in df.columns


def settle(df: DataFrame) -> DataFrame:
    """In the block layout, write the rows out before they are read more than once.

    Carrying values across blocks joins a table with its own summary; without a cut a chain
    of such steps would double its plan at each one.
    """
    return materialize(df, "blocks") if is_split(df) else df


def _asc(order):
    return [F.col(c).asc() for c in order]


def _desc(order):
    return [F.col(c).desc() for c in order]


def join_small(df: DataFrame, small: DataFrame, on, how: str = "left", limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join with a table expected to be small.

    The table is read up to ``limit`` rows; within it the rows are broadcast, beyond it
    the join is left to Spark (shuffled, with AQE splitting skewed partitions).
    """
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        return df.join(small, on, how)
    local = df.sparkSession.createDataFrame(rows, small.schema)
    return df.join(F.broadcast(local), on, how)


def cut_points(value: str, cells: int):
    """Aggregate: values that cut a group's rows into about equal cells, however they are spread.

    At most ``MOST_CELLS``, as each row is compared with them; beyond that cells grow with the group.
    """
    cells = max(2, min(cells, MOST_CELLS))
    return F.percentile_approx(value, [k / cells for k in range(1, cells)])


def cell_of(value: Column, cuts: Column) -> Column:
    """The number of cut points below a value; equal values share a cell."""
    return F.when(cuts.isNull(), 0).otherwise(F.size(F.filter(cuts, lambda c: c < value))).cast("long")


def lay_out(samples: DataFrame) -> DataFrame:
    """Add the dense 0-based ``sample_index`` and, if some recording is long, ``block``."""
    size = rows_per_block(samples)
    long = (
        samples.groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > size)
    )
    longest = long.agg(F.max("_n")).first()[0]
    order = ["timestamp_ms", "sample_seq"]
    if longest is None:
        w = Window.partitionBy(KEY).orderBy(*order)
        return samples.withColumn(INDEX, (F.row_number().over(w) - 1).cast("long"))

    # cells of about equal counts: pauses and clock jumps do not crowd one of them
    cuts = samples.join(long, KEY, "left_semi").groupBy(KEY).agg(cut_points("timestamp_ms", -(-longest // size)).alias("_cuts"))
    celled = join_small(samples, cuts, KEY, limit=MAX_BROADCAST_ROWS // MOST_CELLS).withColumn("_cell", cell_of(F.col("timestamp_ms"), F.col("_cuts")))
    offsets = (
        celled.filter("_cuts IS NOT NULL")
        .groupBy(KEY, "_cell")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_before",
            F.sum("_rows").over(
                Window.partitionBy(KEY).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(KEY, "_cell", "_before")
    )
    w = Window.partitionBy(KEY, "_cell").orderBy(*order)
    indexed = (
        celled.withColumn("_local", F.row_number().over(w) - 1)
        .join(offsets, [KEY, "_cell"], "left")
        .withColumn(INDEX, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long"))
    )
    return (
        indexed.drop("_cuts", "_cell", "_local", "_before")
        .withColumn(BLOCK, F.floor(F.col(INDEX) / size))
    )


def reblock(df: DataFrame, index: str) -> DataFrame:
    """Cut blocks anew along a dense 0-based index (after a filter, or for events)."""
    if not is_split(df):
        return df
    return df.withColumn(BLOCK, F.floor(F.col(index) / rows_per_block(df)))


def _with_block_carry(df: DataFrame, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """Join per-block values, moved across the blocks of a recording, back to its rows."""
    df = settle(df)
    moved = (
        df.groupBy(KEY, BLOCK)
        .agg(*[c.alias(n) for n, c in summary.items()])
        .select(KEY, BLOCK, *[c.alias(n) for n, c in carry.items()])
    )
    return df.join(moved, [KEY, BLOCK], "left")


def shift(df: DataFrame, columns: dict[str, Column], order=(INDEX,), ahead: bool = False) -> DataFrame:
    """Values of the row before (or after) each row, as new columns; null at the ends."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    w = Window.partitionBy(*partition_keys(df)).orderBy(*_asc(order))
    move = F.lead if ahead else F.lag
    if not is_split(df):
        return df.withColumns({n: move(c).over(w) for n, c in columns.items()})
    position = F.struct(*[F.col(c) for c in order])
    edge = F.min_by(row, position) if ahead else F.max_by(row, position)
    blocks = Window.partitionBy(KEY).orderBy(BLOCK)
    out = _with_block_carry(df, {"_edge": edge}, {"_carry": move("_edge").over(blocks)})
    out = out.withColumn("_near", F.coalesce(move(row).over(w), F.col("_carry")))
    return out.withColumns({n: F.col(f"_near.{n}") for n in columns}).drop("_carry", "_near")


def fill(df: DataFrame, columns: dict[str, Column], order=(INDEX,), ahead: bool = False, strict: bool = False) -> DataFrame:
    """Nearest non-null value at or before (at or after) each row; ``strict`` leaves the row itself out.

    Looking ahead is written as looking back in descending order: a frame that ends at
    the partition's end would be recomputed for every row.
    """
    ordering = _desc(order) if ahead else _asc(order)
    end = -1 if strict else 0
    w = Window.partitionBy(*partition_keys(df)).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, end)
    near = {n: F.last(c, ignorenulls=True).over(w) for n, c in columns.items()}
    if not is_split(df):
        return df.withColumns(near)
    position = F.struct(*[F.col(c) for c in order])
    pick = F.min_by if ahead else F.max_by
    block_order = F.col(BLOCK).desc() if ahead else F.col(BLOCK).asc()
    blocks = Window.partitionBy(KEY).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    out = _with_block_carry(
        df,
        {f"_s_{n}": pick(c, F.when(c.isNotNull(), position)) for n, c in columns.items()},
        {f"_c_{n}": F.last(f"_s_{n}", ignorenulls=True).over(blocks) for n in columns},
    )
    out = out.withColumns({n: F.coalesce(c, F.col(f"_c_{n}")) for n, c in near.items()})
    return out.drop(*[f"_c_{n}" for n in columns])


def running_sum(df: DataFrame, columns: dict[str, Column], order=(INDEX,)) -> DataFrame:
    """Sum of an integer expression from the first row of the recording to this row."""
    w = Window.partitionBy(*partition_keys(df)).orderBy(*_asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    near = {n: F.sum(c).over(w) for n, c in columns.items()}
    if not is_split(df):
        return df.withColumns(near)
    blocks = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    out = _with_block_carry(
        df,
        {f"_s_{n}": F.sum(c) for n, c in columns.items()},
        {f"_c_{n}": F.coalesce(F.sum(f"_s_{n}").over(blocks), F.lit(0)) for n in columns},
    )
    out = out.withColumns({n: c + F.col(f"_c_{n}") for n, c in near.items()})
    return out.drop(*[f"_c_{n}" for n in columns])


def ordinal(df: DataFrame, name: str, order=(INDEX,)) -> DataFrame:
    """1-based position of each row in its recording."""
    return running_sum(df, {name: F.lit(1)}, order).withColumn(name, F.col(name).cast("long"))


def framed(df: DataFrame, columns: dict[str, Column], before: int, after: int, index: str = INDEX) -> DataFrame:
    """Aggregate over a frame of fixed width around each row.

    In the block layout the rows within the frame's reach of an edge are copied to
    the neighbouring block, and the copies are dropped after the window.
    """
    w = Window.partitionBy(*partition_keys(df)).orderBy(index).rowsBetween(-before, after)
    if not is_split(df):
        return df.withColumns({n: c.over(w) for n, c in columns.items()})
    return _drop_copies(_copy_to_blocks(df, F.lit(before), F.lit(after), index).withColumns(
        {n: c.over(w) for n, c in columns.items()}
    ))


def neighbouring(df: DataFrame, columns: list[str], reach: int, index: str = INDEX) -> DataFrame:
    """Values of the rows up to ``reach`` before and after each row, as columns ``_{column}_{offset}``; null beyond the ends."""
    split = is_split(df)
    if split:
        df = _copy_to_blocks(df, F.lit(reach), F.lit(reach), index)
    w = Window.partitionBy(*partition_keys(df)).orderBy(index)
    near = {f"_{c}_{o}": (F.lag(c, -o) if o < 0 else F.lead(c, o)).over(w) for c in columns for o in range(-reach, reach + 1) if o}
    out = df.withColumns(near | {f"_{c}_0": F.col(c) for c in columns})
    return _drop_copies(out) if split else out


def trailing(df: DataFrame, columns: dict[str, str], size: str, index: str = INDEX) -> DataFrame:
    """Aggregates over the last ``size`` rows, where ``size`` is a column (constant per recording).

    ``index / size`` grows by one every ``size`` rows, so a value range of just under
    one is exactly that many rows; ROWS frames only take literal widths.
    """
    split = is_split(df)
    if split:
        df = _copy_to_blocks(df, F.col(size) - 1, F.lit(0), index)
    keys = ", ".join(partition_keys(df))
    df = df.withColumn("_scaled", F.col(index).cast("double") / F.col(size))
    frame = (
        f"OVER (PARTITION BY {keys} ORDER BY _scaled "
        "RANGE BETWEEN 0.999999999D PRECEDING AND CURRENT ROW)"
    )
    out = df.withColumns({n: F.expr(f"{agg} {frame}") for n, agg in columns.items()}).drop("_scaled")
    return _drop_copies(out) if split else out


def _copy_to_blocks(df: DataFrame, before: Column, after: Column, index: str) -> DataFrame:
    size = rows_per_block(df)
    first = F.floor(F.greatest(F.col(index) - after, F.lit(0)) / size)
    last = F.floor((F.col(index) + before) / size)
    return df.withColumnRenamed(BLOCK, "_home").withColumn(BLOCK, F.explode(F.sequence(first, last)))


def _drop_copies(df: DataFrame) -> DataFrame:
    return df.filter(F.col(BLOCK) == F.col("_home")).drop("_home")


def run_starts(df: DataFrame, label: str, out: str = "run_start") -> DataFrame:
    """Index of the first row of the run of equal labels each row belongs to."""
    changed = shift(df, {"_previous": F.col(label)}).withColumn(
        "_boundary",
        F.when((F.col(INDEX) == 0) | ~F.col(label).eqNullSafe(F.col("_previous")), F.col(INDEX)),
    )
    return fill(changed, {out: F.col("_boundary")}).drop("_previous", "_boundary")


def join_recording(df: DataFrame, per_recording: DataFrame, how: str = "left") -> DataFrame:
    """Join one-row-per-recording values to rows of recordings.

    In the block layout the values go to the blocks first, so that the rows are joined
    on ``(recording_id, block)`` and a long recording stays spread out.
    """
    if not is_split(df):
        return df.join(per_recording, KEY, how)
    blocks = df.select(KEY, BLOCK).distinct().join(per_recording, KEY, how)
    return df.join(blocks, [KEY, BLOCK], how)


def with_recording_values(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Attach aggregates over the whole recording to each of its rows."""
    if not is_split(df):
        w = Window.partitionBy(KEY)
        return df.withColumns({n: c.over(w) for n, c in columns.items()})
    df = settle(df)
    return join_recording(df, df.groupBy(KEY).agg(*[c.alias(n) for n, c in columns.items()]))
