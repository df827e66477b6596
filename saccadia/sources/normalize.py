"""From raw columns to canonical, validated samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saccadia.functions.ordered import lay_out
from saccadia.schema import INDEX, BLOCK, KEY, SAMPLE_COLUMNS

# Accepted source names of each canonical column, in order of preference.
COLUMN_ALIASES = {
    "timestamp_ms": ["timestamp_ms", "timestamp", "time", "t", "sample_time"],
    "x": ["x", "gaze_x", "screen_x", "x_pos", "x_position"],
    "y": ["y", "gaze_y", "screen_y", "y_pos", "y_position"],
    "pupil": ["pupil", "pupil_size", "pupil_diameter", "diameter"],
    "valid": ["valid", "is_valid", "tracking_valid"],
    "marker": ["marker", "marker_name", "trigger", "message", "annotation", "stimulus_marker"],
    "event_label": ["event_label", "event_type", "eye_event", "gaze_event", "evt", "event"],
}
# Texts that mean a valid sample.
TRUE_TEXTS = ["true", "t", "yes", "y", "valid"]


def normalize_columns(df: DataFrame, column_map: dict[str, str] | None = None, keep: tuple[str, ...] = (KEY, "sample_seq")) -> DataFrame:
    """Rename source columns to the canonical ones and drop the rest.

    ``column_map`` (canonical → source) goes first; its missing sources are ignored. A
    projection only, so columns not needed are never read.
    """
    source = {c.lower(): c for c in reversed(df.columns)}
    chosen = {c: s for c, s in (column_map or {}).items() if s in df.columns}
    for canonical in SAMPLE_COLUMNS:
        if canonical in chosen:
            continue
        if canonical in df.columns:
            chosen[canonical] = canonical
            continue
        hit = next((source[a] for a in COLUMN_ALIASES.get(canonical, []) if a in source), None)
        if hit is not None:
            chosen[canonical] = hit
    return df.select(
        *[c for c in keep if c in df.columns],
        *[F.col(f"`{chosen[c]}`").alias(c) for c in SAMPLE_COLUMNS if c in chosen],
    )


def synthesize_timestamps(df: DataFrame, sampling_rate_hz: float | None) -> DataFrame:
    """Add ``timestamp_ms`` from the sample's place in its recording where the source has none."""
    if "timestamp_ms" in df.columns:
        return df
    if not sampling_rate_hz:
        raise ValueError("no timestamp column: a sampling rate is needed to make timestamps")
    placed = lay_out(df.withColumn("timestamp_ms", F.col("sample_seq").cast("double")))
    return placed.withColumn("timestamp_ms", F.col(INDEX) * F.lit(1000.0 / sampling_rate_hz)).drop(INDEX, BLOCK)


def number(c: Column, data_type: T.DataType) -> Column:
    """Double or null; NaN and unreadable text become null."""
    value = c.try_cast("double") if isinstance(data_type, T.StringType) else c.cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def coerce_valid(c: Column, data_type: T.DataType) -> Column:
    """Validity flag from booleans, numbers or text; anything unknown is false."""
    if isinstance(data_type, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    as_number = number(c, data_type) != 0
    as_text = F.lower(F.trim(c.cast("string"))).isin(TRUE_TEXTS)
    return F.coalesce(as_number, as_text, F.lit(False))


def validate_samples(df: DataFrame, strict: bool = True) -> DataFrame:
    """Typed samples with every canonical column and a final ``valid`` flag.

    A sample is valid if its source says so (or says nothing), it has a position, and it
    has a pupil where the source has a pupil column. Without a timestamp the sample is an
    error: ``strict`` fails, otherwise the row is kept with its ``error``.
    """
    missing = [c for c in ("timestamp_ms", "x", "y") if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = {c: number(F.col(c), types[c]) for c in ("timestamp_ms", "x", "y", "pupil") if c in types}
    usable = numeric["x"].isNotNull() & numeric["y"].isNotNull()
    if "pupil" in types:
        usable = usable & numeric["pupil"].isNotNull()
    given = coerce_valid(F.col("valid"), types["valid"]) if "valid" in types else F.lit(True)
    no_time = "sample without a valid timestamp"
    time = numeric["timestamp_ms"]
    if strict:
        time = F.coalesce(time, F.raise_error(F.lit(no_time)).cast("double"))
    else:
        df = df.withColumn("error", F.when(time.isNull(), F.lit(no_time)))
    columns = {**numeric, "timestamp_ms": time, "valid": given & usable}
    if "pupil" not in types:
        columns["pupil"] = F.lit(None).cast("double")
    for c in ("marker", "event_label", "label", "trial"):
        columns[c] = F.col(c).cast("string") if c in types else F.lit(None).cast("string")
    out = df.withColumns(columns)
    return out.select(KEY, "sample_seq", *SAMPLE_COLUMNS, *([] if strict else ["error"]))


def from_frame(
    df: DataFrame,
    sampling_rate_hz: float | None = None,
    column_map: dict[str, str] | None = None,
    recording: str = KEY,
    sequence: str | None = "sample_seq",
    strict: bool = True,
) -> DataFrame:
    """Samples from any DataFrame that has a recording key.

    ``sequence`` names the column that gives source order; without one the order of the
    rows as read is taken.
    """
    order = F.col(sequence).cast("long") if sequence and sequence in df.columns else F.monotonically_increasing_id()
    keyed = df.withColumns({KEY: F.col(recording).cast("string"), "sample_seq": order})
    return validate_samples(synthesize_timestamps(normalize_columns(keyed, column_map), sampling_rate_hz), strict)


def flatten_pixel_samples(df: DataFrame) -> DataFrame:
    """``time``, ``pixel`` (array or struct), ``message`` and ``name`` as canonical columns."""
    columns: dict[str, Column] = {}
    if "time" in df.columns and "timestamp_ms" not in df.columns:
        columns["timestamp_ms"] = F.col("time")
    if "pixel" in df.columns:
        kind = df.schema["pixel"].dataType
        for at, axis in enumerate(("x", "y")):
            if isinstance(kind, T.StructType):
                fields = [n for n in (axis, f"pixel_{axis}") if n in kind.names]
                value = F.coalesce(*[F.col("pixel")[n] for n in fields]) if fields else F.lit(None)
            elif isinstance(kind, T.MapType):
                value = F.coalesce(F.col("pixel")[axis], F.col("pixel")[f"pixel_{axis}"])
            else:
                value = F.when(F.size("pixel") >= 2, F.get("pixel", at))
            columns[axis] = value.cast("double")
    if "message" in df.columns and "marker" not in df.columns:
        columns["marker"] = F.col("message")
    if "name" in df.columns and "trial" not in df.columns:
        columns["trial"] = F.col("name")
    return df.withColumns(columns)
