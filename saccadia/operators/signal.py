"""Cleaning, smoothing, scaling and velocity of gaze samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.functions.ordered import fill, framed, neighbouring, shift, with_recording_values
from saccadia.schema import INDEX

SIGNALS = ("x", "y", "pupil")


def interpolate_nulls(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Linear interpolation by row position; leading and trailing nulls take the nearest value."""
    masked = df.withColumns({f"_m_{n}": c for n, c in columns.items()})
    points = {n: F.when(F.col(f"_m_{n}").isNotNull(), F.struct(F.col(INDEX).alias("i"), F.col(f"_m_{n}").alias("v"))) for n in columns}
    both = fill(masked, {f"_p_{n}": c for n, c in points.items()})
    both = fill(both, {f"_n_{n}": c for n, c in points.items()}, ahead=True)

    def value(n):
        p, q = F.col(f"_p_{n}"), F.col(f"_n_{n}")
        between = p["v"] + (F.col(INDEX) - p["i"]) * (q["v"] - p["v"]) / F.nullif(q["i"] - p["i"], F.lit(0))
        return F.coalesce(F.col(f"_m_{n}"), between, p["v"], q["v"])

    out = both.withColumns({n: value(n) for n in columns})
    return out.drop(*[f"_{k}_{n}" for k in "mpn" for n in columns])


def interpolate_missing(samples: DataFrame, columns=SIGNALS) -> DataFrame:
    """Fill invalid or null signal values; the ``valid`` flags stay as they were."""
    return interpolate_nulls(samples, {c: F.when(F.col("valid"), F.col(c)) for c in columns})


def drop_invalid(samples: DataFrame) -> DataFrame:
    return samples.filter("valid")


def handle_missing(samples: DataFrame, strategy: str = "interpolate") -> DataFrame:
    """``interpolate``, ``drop``/``clean`` or ``keep``/``none``."""
    name = strategy.lower()
    if name == "interpolate":
        return interpolate_missing(samples)
    if name in ("drop", "clean"):
        from saccadia.functions.ordered import ordinal, reblock

        kept = ordinal(drop_invalid(samples), "_n").withColumn(INDEX, F.col("_n") - 1).drop("_n")
        return reblock(kept, INDEX)
    if name in ("keep", "none"):
        return samples
    raise ValueError(f"unknown missing-data strategy: {strategy}")


def smooth_moving_average(samples: DataFrame, window: int = 5, columns=SIGNALS) -> DataFrame:
    """Centred rolling mean that skips nulls and shortens at the ends."""
    means = framed(samples, {f"_s_{c}": F.avg(c) for c in columns}, window // 2, (window - 1) // 2)
    return means.withColumns({c: F.col(f"_s_{c}") for c in columns}).drop(*[f"_s_{c}" for c in columns])


def savgol_weights(width: int, polyorder: int) -> np.ndarray:
    """Row p: weights over a window of ``width`` values giving the fitted polynomial at position p."""
    positions = np.arange(width, dtype=float) - width // 2
    design = np.vander(positions, polyorder + 1, increasing=True)
    return design @ np.linalg.pinv(design)


#: What the error column says of a recording that is too short to be smoothed.
TOO_SHORT = "recording is shorter than the smoothing window"


def smooth_savitzky_golay(samples: DataFrame, window: int = 5, polyorder: int = 2, columns=SIGNALS) -> DataFrame:
    """Polynomial smoothing; rows near an end use the fit of the first or last full window.

    A window of the weights' width is a sum of neighbouring rows, one sum for each place in it. A recording shorter than the
    window has nothing to fit: one row is left of it, without signals, that says so in ``error``, null in all other rows.
    """
    width = max(window, polyorder + 2)
    width += 1 - width % 2
    weights = savgol_weights(width, polyorder)
    df = with_recording_values(samples, {"_rows": F.count(F.lit(1))})
    df = neighbouring(df, list(columns), width - 1)
    start = F.greatest(F.least(F.col(INDEX) - width // 2, F.col("_rows") - width), F.lit(0))
    place = F.col(INDEX) - start

    def smoothed(c):
        fits = F.lit(None).cast("double")
        for p in reversed(range(width)):
            terms = [float(weights[p, k]) * F.col(f"_{c}_{k - p}") for k in range(width)]
            total = terms[0]
            for t in terms[1:]:
                total = total + t
            fits = F.when(place == p, total).otherwise(fits)
        return F.when(F.col("_rows") >= width, fits)

    out = df.withColumns({c: smoothed(c) for c in columns})
    out = out.withColumn("error", F.when(F.col("_rows") < width, F.lit(TOO_SHORT)))
    near = [f"_{c}_{o}" for c in columns for o in range(1 - width, width)]
    return out.filter(F.col("error").isNull() | (F.col(INDEX) == 0)).drop("_rows", *near)


def smooth(samples: DataFrame, method: str = "moving_average", window: int = 5, polyorder: int = 2) -> DataFrame:
    if method == "moving_average":
        return smooth_moving_average(samples, window)
    if method == "savitzky_golay":
        return smooth_savitzky_golay(samples, window, polyorder)
    raise ValueError(f"unknown smoothing method: {method}")


def normalize_coordinates(samples: DataFrame, bounds=None, centered: bool = True) -> DataFrame:
    """Add ``x_norm``/``y_norm`` scaled by the recording's own or by fixed bounds."""
    if bounds is None:
        df = with_recording_values(
            samples, {f"_{k}_{c}": getattr(F, k)(c) for k in ("min", "max") for c in ("x", "y")}
        )
        limits = {c: (F.col(f"_min_{c}"), F.col(f"_max_{c}")) for c in ("x", "y")}
    else:
        df = samples
        x0, x1, y0, y1 = (F.lit(float(b)) for b in bounds)
        limits = {"x": (x0, x1), "y": (y0, y1)}
    scaled = {}
    for c, (low, high) in limits.items():
        unit = (F.col(c) - low) / F.greatest(high - low, F.lit(1e-6))
        scaled[f"{c}_norm"] = unit * 2.0 - 1.0 if centered else unit
    return df.withColumns(scaled).drop(*[f"_{k}_{c}" for k in ("min", "max") for c in ("x", "y")])


def preprocess(
    samples: DataFrame,
    missing_strategy: str = "interpolate",
    smooth_method: str = "moving_average",
    smooth_window: int = 5,
    normalize: bool = True,
) -> DataFrame:
    """Missing data, then smoothing, then optional scaling."""
    df = smooth(handle_missing(samples, missing_strategy), smooth_method, smooth_window)
    return normalize_coordinates(df) if normalize else df


def step_length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def with_velocity(samples: DataFrame) -> DataFrame:
    """Add ``velocity`` (px/s, 0 where undefined or invalid) and ``step_px`` (0 where undefined)."""
    df = shift(samples, {"_t": F.col("timestamp_ms"), "_x": F.col("x"), "_y": F.col("y")})
    length = step_length(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    seconds = F.nullif(F.col("timestamp_ms") - F.col("_t"), F.lit(0.0)) / 1000.0
    return df.withColumns(
        {
            "step_px": F.coalesce(length, F.lit(0.0)),
            "velocity": F.when(F.col("valid"), F.coalesce(length / seconds, F.lit(0.0))).otherwise(0.0),
        }
    ).drop("_t", "_x", "_y")


def fill_gaps_both_ways(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each null takes the last value before it, and at the start the first value after it."""
    both = fill(df, {f"_f_{c}": F.col(c) for c in columns})
    both = fill(both, {f"_b_{c}": F.col(c) for c in columns}, ahead=True)
    return both.withColumns({c: F.coalesce(f"_f_{c}", f"_b_{c}") for c in columns}).drop(
        *[f"_{k}_{c}" for k in "fb" for c in columns]
    )
