"""Point-in-region tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def in_rectangle(x: Column, y: Column, x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """Closed rectangle."""
    return (x >= x_min) & (x <= x_max) & (y >= y_min) & (y <= y_max)


def in_polygon(x: Column, y: Column, vertices: Column) -> Column:
    """Even-odd rule over an array of ``{x, y}`` vertices; points exactly on an edge are undefined."""
    n = F.size(vertices)
    following = F.concat(F.slice(vertices, 2, F.greatest(n - 1, F.lit(0))), F.slice(vertices, 1, 1))

    def crosses(a, b):
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(spans & (x < at), F.lit(1)).otherwise(F.lit(0))

    hits = F.aggregate(F.zip_with(vertices, following, crosses), F.lit(0), lambda s, v: s + v)
    return hits % 2 == 1


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``point_in_polygon(x, y, vertices)`` and ``gaze_event_kind(label)`` callable from SQL.

    They are SQL functions, so Catalyst inlines their bodies into the calling query.
    """
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION point_in_polygon(
            px DOUBLE, py DOUBLE, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>)
        RETURNS BOOLEAN
        RETURN aggregate(
            zip_with(ring, concat(slice(ring, 2, size(ring) - 1), slice(ring, 1, 1)),
                (a, b) -> CASE WHEN ((a.y > py) != (b.y > py))
                    AND px < (b.x - a.x) * (py - a.y) / nullif(b.y - a.y, 0D) + a.x THEN 1 ELSE 0 END),
            0, (s, v) -> s + v) % 2 = 1
        """
    )
    from saccadia.functions.labels import EVENT_LABELS

    exact = " ".join(f"WHEN lower(trim(label)) = '{k}' THEN '{v}'" for k, v in EVENT_LABELS.items())
    inside = " ".join(f"WHEN contains(lower(label), '{k}') THEN '{v}'" for k, v in EVENT_LABELS.items())
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION gaze_event_kind(label STRING) RETURNS STRING
        RETURN CASE WHEN label IS NULL OR trim(label) = '' THEN NULL {exact} {inside} ELSE lower(trim(label)) END
        """
    )
