"""Exact ranks and quantiles of any number of values per group.

``percentile`` keeps a group's distinct values in one task. The functions here count equal values first, cut each group's
values into cells of about equal counts, these cells again, and add up the counts cell by cell, so a task holds a few
thousandths of a group. All of it is one lazy plan that reads its rows once: the counted values are one exchange, which every
later step reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saccadia.functions.ordered import is_split, settle

#: Cells of a group, and cells of a cell.
CELLS = 64


def _cut(counts: DataFrame, keys: list[str], value: str, cell: str) -> DataFrame:
    """``counts`` with the number of its cell in the group of ``keys``."""
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [k / CELLS for k in range(1, CELLS)], 1000).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return counts.join(cuts, keys).withColumn(cell, below).drop("_cuts")


def value_counts(df: DataFrame, by: list[str], value: str, extra: dict | None = None) -> DataFrame:
    """One row per group and distinct value: ``n`` equal values, ``below`` smaller ones, ``total``.

    ``extra`` adds further aggregates per value. Null values are left out.
    """
    if not by:
        return value_counts(df.withColumn("_all", F.lit(0)), ["_all"], value, extra).drop("_all")
    aggregates = [F.count(F.lit(1)).alias("n")] + [c.alias(k) for k, c in (extra or {}).items()]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggregates)
    # always true, but it reads all columns: steps that read the same columns share the exchange below them
    counts = counts.filter(F.greatest(F.lit(0), "n", *(extra or {})) > 0)
    celled = _cut(_cut(counts, by, value, "_cell"), [*by, "_cell"], value, "_part")
    per_cell = celled.groupBy(*by, "_cell", "_part").agg(F.sum("n").alias("_in_cell"))
    upto = Window.partitionBy(*by).orderBy("_cell", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select(
        *by,
        "_cell",
        "_part",
        F.coalesce(F.sum("_in_cell").over(upto), F.lit(0)).alias("_offset"),
        F.sum("_in_cell").over(Window.partitionBy(*by)).alias("total"),
    )
    inside = Window.partitionBy(*by, "_cell", "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        celled.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, [*by, "_cell", "_part"])
        .withColumn("below", F.col("_inside") + F.col("_offset"))
        .select(*by, value, "n", *(extra or {}), "below", "total")
    )


def average_rank():
    """Rank with ties sharing their mean rank, over the output of ``value_counts``."""
    return F.col("below") + (F.col("n") + 1) / 2.0


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group, one column per name."""
    picks = []
    for name, p in probabilities.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)

        def at(rank):
            return F.max(
                F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col(value))
            )

        picks += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"), F.max(place - low).alias(f"_f_{name}")]
    found = value_counts(df, by, value).groupBy(*by).agg(*picks)
    return found.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probabilities
        ],
    )


def recording_quantiles(df: DataFrame, by: list[str], columns: dict[str, tuple[str, float]]) -> DataFrame:
    """Quantiles per recording, ``{name: (column, probability)}``.

    Recordings of bounded length use the built-in aggregate; the block layout means
    some recording is long, and then the counting way is used for each column.
    """
    if not is_split(df):
        return df.groupBy(*by).agg(
            *[F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in columns.items()]
        )
    df = settle(df)
    out = df.select(*by).distinct()
    for column in dict.fromkeys(c for c, _ in columns.values()):
        wanted = {n: p for n, (c, p) in columns.items() if c == column}
        out = out.join(quantiles(df.select(*by, column), by, column, wanted), by, "left")
    return out
