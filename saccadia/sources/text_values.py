"""Small text and JSON inputs that become rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The pattern of one time range.
TIME_RANGE = r"^\s*([+-]?\d+(?:\.\d+)?)\s*(?:-|~|to|:)\s*([+-]?\d+(?:\.\d+)?)\s*$"

CANVAS = (
    "objects ARRAY<STRUCT<type: STRING, angle: DOUBLE, width: DOUBLE, height: DOUBLE, "
    "scaleX: DOUBLE, scaleY: DOUBLE, left: DOUBLE, top: DOUBLE>>"
)
MIN_SIDE = 8.0


def parse_time_ranges(df: DataFrame, text: str, ids: list[str]) -> DataFrame:
    """One row per range of a text such as ``0-800; 1200 to 2000``; a bad range fails."""
    chunks = F.filter(F.transform(F.split(text, "[;\\n]+"), lambda c: F.trim(c)), lambda c: c != "")
    none = F.raise_error(F.lit("no time range given")).cast("array<string>")
    rows = df.select(*ids, F.posexplode(F.when(F.size(chunks) == 0, none).otherwise(chunks)).alias("_at", "_chunk"))
    start = F.regexp_extract("_chunk", TIME_RANGE, 1).try_cast("double")
    end = F.regexp_extract("_chunk", TIME_RANGE, 2).try_cast("double")
    bad = F.raise_error(F.concat(F.lit("not a time range: "), F.col("_chunk"))).cast("double")
    late = F.raise_error(F.concat(F.lit("time range ends before it starts: "), F.col("_chunk"))).cast("double")
    return rows.select(
        *ids,
        (F.col("_at") + 1).alias("range_order"),
        F.coalesce(start, bad).alias("start_ms"),
        F.when(end < start, late).otherwise(F.coalesce(end, bad)).alias("end_ms"),
    )


def canvas_rectangles(
    drawings: DataFrame, json: str, ids: list[str], canvas: tuple[int, int], screen: tuple[int, int]
) -> DataFrame:
    """Areas from canvas drawings: unrotated rectangles of 8 units or more, scaled to the screen.

    They are named ``AOI 1``, ``AOI 2``, … in drawing order among those kept.
    """
    sx, sy = screen[0] / max(canvas[0], 1), screen[1] / max(canvas[1], 1)
    parsed = F.from_json(json, CANVAS)["objects"]

    def number(o, name, default):
        return F.coalesce(o[name], F.lit(default))

    def size(o, side, scale):
        return number(o, side, 0.0) * number(o, scale, 1.0)

    def keep(o):
        return (
            (o["type"] == "rect")
            & (number(o, "angle", 0.0) == 0.0)
            & (size(o, "width", "scaleX") >= MIN_SIDE)
            & (size(o, "height", "scaleY") >= MIN_SIDE)
        )

    def corners(o):
        left, top = number(o, "left", 0.0), number(o, "top", 0.0)
        right, bottom = left + size(o, "width", "scaleX"), top + size(o, "height", "scaleY")
        return F.struct(
            F.least(left * sx, right * sx).alias("x_min"),
            F.least(top * sy, bottom * sy).alias("y_min"),
            F.greatest(left * sx, right * sx).alias("x_max"),
            F.greatest(top * sy, bottom * sy).alias("y_max"),
        )

    rows = drawings.select(*ids, F.posexplode(F.transform(F.filter(parsed, keep), corners)).alias("aoi_order", "_r"))
    return rows.select(
        *ids, "aoi_order", F.concat(F.lit("AOI "), F.col("aoi_order") + 1).alias("name"), F.lit("rectangle").alias("region_type"), "_r.*"
    )
