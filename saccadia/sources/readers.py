"""Recordings from files, many files in one job."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saccadia.functions.storage import materialize, scratch_dir  # noqa: F401
from saccadia.schema import KEY
from saccadia.sources import files
from saccadia.sources.normalize import flatten_pixel_samples, normalize_columns, synthesize_timestamps, validate_samples

SEPARATORS = [",", ";", "\t", "|"]
TEXT_FORMATS = ("csv", "tsv", "txt")
#: Folders that each file's path is compared with.
MOST_FOLDERS = 100

Loader = Callable[[SparkSession, list[str], dict], DataFrame]
_loaders: dict[str, Loader] = {}


def register_loader(name: str, loader: Loader) -> None:
    """Add a file format: ``loader(spark, paths, options)`` gives rows with ``recording_id`` and ``sample_seq``."""
    _loaders[name.lower()] = loader


def file_position():
    """Source order within a file, also for files read in several splits.

    A split's rows come after ``file_block_start`` bytes, and a task reads fewer rows than
    bytes, so byte offset plus the row's number in its task grows along the file.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + in_task


def uri(path) -> Column:
    """One spelling for local paths; other schemes stay as they are."""
    return F.regexp_replace(path, "^(file:)?/+", "file:///")


def _options(pattern: str | None) -> dict:
    return {"recursiveFileLookup": True, **({"pathGlobFilter": pattern} if pattern else {})}


def first_lines(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """``file_path`` and first line of every file."""
    lines = spark.read.text(paths, **_options(pattern)).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_start"),
        file_position().alias("_at"), "value",
    )
    return lines.filter("_start = 0").groupBy("file_path").agg(F.min_by("value", "_at").alias("header"))


def header_groups(spark: SparkSession, paths: list[str], pattern: str | None = None) -> dict[tuple[str, str], list[str]]:
    """Paths by separator and header line. A folder whose files are all alike stands for them; other files are listed one by one."""
    spelt = [re.sub("^(file:)?/+", "file:///", p).rstrip("/") + "/" for p in paths]
    apart = len(paths) <= MOST_FOLDERS and not any(a.startswith(b) for i, a in enumerate(spelt) for j, b in enumerate(spelt) if i != j)
    folder = F.coalesce(*[F.when(F.startswith(uri("file_path"), F.lit(p)), k) for k, p in enumerate(spelt) if apart], F.lit(None).cast("int"))
    first = materialize(first_lines(spark, paths, pattern).select("file_path", "header", separator(F.col("header")).alias("sep"), folder.alias("folder")), "headers")
    alike = first.filter("folder IS NOT NULL").groupBy("folder").agg(
        F.min("sep").alias("sep"), F.min("header").alias("header"), F.max("header").alias("_last")).filter("header = _last").drop("_last")
    groups: dict[tuple[str, str], list[str]] = {}
    whole = alike.collect()
    for r in whole:
        groups.setdefault((r["sep"], r["header"]), []).append(paths[r["folder"]])
    rest = first.filter(~F.coalesce(F.col("folder").isin([r["folder"] for r in whole]), F.lit(False)))
    for r in rest.collect():
        groups.setdefault((r["sep"], r["header"]), []).append(r["file_path"])
    return groups


def separator(header) -> F.Column:
    """The candidate that occurs most in a line (a comma if none does)."""
    counts = [F.struct(F.regexp_count(header, F.lit("\\" + s if s == "|" else s)).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("sep"))
              for k, s in enumerate(SEPARATORS)]
    return F.greatest(*counts)["sep"]


def _names(header: str, sep: str) -> list[str]:
    return [n.strip().strip('"').lstrip("\ufeff") for n in header.split(sep)]


#: How lines are read, by Spark's reader of files and by its function for lines.
CSV = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}


def _split_rows(spark: SparkSession, header: str, sep: str, paths: list[str], pattern: str | None = None) -> DataFrame:
    """Rows of files with one header, by Spark's reader, which splits large files."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in _names(header, sep)])
    raw = spark.read.schema(schema).options(**_options(pattern)).csv(paths, sep=sep, header=True, **CSV)
    return raw.withColumns({KEY: F.col("_metadata.file_path"), "sample_seq": file_position()})


def _rows_of_files(spark: SparkSession, found: DataFrame) -> list[DataFrame]:
    """Rows of listed files, one table for each separator and header line; the driver gets these and the names of large files."""
    found = materialize(found, "files")
    first = found.filter("NOT by_spark").select("file_path", "place")
    first = files.headers(first).join(found.select("file_path", "length"), "file_path")
    first = materialize(first.withColumn("sep", separator(F.col("header"))), "headers")
    raws = {}
    for r in first.groupBy("sep", "header").agg(F.sum("length").alias("size")).collect():
        names = _names(r["header"], r["sep"])
        ours = first.filter((F.col("sep") == r["sep"]) & (F.col("header") == r["header"]))
        columns = [f"_c{k}" for k in range(len(names))]
        values = F.from_csv("value", ", ".join(f"{c} string" for c in columns), {"sep": r["sep"], **{k: str(v) for k, v in CSV.items()}})
        parsed = files.lines(ours, r["size"]).select(F.col("file_path").alias(KEY), F.col("at").alias("sample_seq"), values.alias("_v"))
        taken = [k for k, n in enumerate(names) if n.lower() not in (KEY, "sample_seq")]
        raws[r["sep"], r["header"], ""] = parsed.select(*[F.col(f"_v.{columns[k]}").alias(names[k]) for k in taken], KEY, "sample_seq")
    large = [r[0] for r in found.filter("by_spark").select("place").collect()]
    for (sep, header), group in header_groups(spark, large).items() if large else ():
        raws[sep, header, "large"] = _split_rows(spark, header, sep, group)
    return [raws[k] for k in sorted(raws)]


def read_tabular(
    spark: SparkSession, paths: list[str], sampling_rate_hz: float | None = None, column_map: dict[str, str] | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Delimited text files (of folders, those whose name fits ``pattern``); each file is a recording.

    Files are grouped by separator and header line, as one reader applies one header to
    all its files; the groups are read side by side and united by column name. Small files
    are opened by tasks (``files``), large ones are split by Spark's reader.
    """
    found = files.listed(spark, paths, pattern)
    if found is None:
        raws = [_split_rows(spark, header, sep, group, pattern) for (sep, header), group in sorted(header_groups(spark, paths, pattern).items())]
    else:
        raws = _rows_of_files(spark, files.for_spark(found))
    parts = [synthesize_timestamps(normalize_columns(raw, column_map), sampling_rate_hz) for raw in raws]
    if not parts:
        raise ValueError("no files to read")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def parse_asc_lines(lines: DataFrame) -> DataFrame:
    """Samples from text lines: the numbers that lead the first six tokens, three at least."""
    tokens = F.slice(F.split(F.trim("value"), "\\s+"), 1, 6)
    numbers = F.transform(tokens, lambda t: t.try_cast("double"))
    bad = F.array_position(F.transform(numbers, lambda n: n.isNull()), True)
    leading = F.when(bad > 0, bad - 1).otherwise(F.size(numbers))
    rows = lines.withColumns({"_v": numbers, "_n": leading}).filter("_n >= 3")
    return rows.select(
        KEY,
        "sample_seq",
        F.col("_v")[0].alias("timestamp_ms"),
        F.col("_v")[1].alias("x"),
        F.col("_v")[2].alias("y"),
        F.when(F.col("_n") >= 4, F.col("_v")[3]).alias("pupil"),
    )


def read_eyelink_asc(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """Sample lines of ASC files; everything else in them is skipped."""
    lines = spark.read.text(paths, **_options(pattern)).select(
        F.col("_metadata.file_path").alias(KEY), file_position().alias("sample_seq"), "value"
    )
    return parse_asc_lines(lines)


def file_format(path: str, given: str | None) -> str:
    suffix = os.path.splitext(path)[1].lstrip(".").lower()
    name = (given or suffix or "csv").lower()
    return (suffix or "csv") if name == "auto" else name


def read_recordings(
    spark: SparkSession,
    paths: list[str],
    format: str | None = None,
    sampling_rate_hz: float | None = None,
    column_map: dict[str, str] | None = None,
    strict: bool = True,
    pattern: str | None = None,
) -> DataFrame:
    """Validated samples of many files of any known format; of folders, the files whose name fits ``pattern``."""
    by_format: dict[str, list[str]] = {}
    for p in paths:
        by_format.setdefault(file_format(p, format), []).append(p)
    parts = []
    for name, group in by_format.items():
        if name in _loaders:
            raw = _loaders[name](spark, group, {"sampling_rate_hz": sampling_rate_hz, "column_map": column_map})
            raw = synthesize_timestamps(normalize_columns(raw, column_map), sampling_rate_hz)
        elif name in TEXT_FORMATS:
            raw = read_tabular(spark, group, sampling_rate_hz, column_map, pattern)
        elif name == "asc":
            raw = read_eyelink_asc(spark, group, pattern)
        else:
            raise ValueError(f"unsupported format: {name}")
        parts.append(validate_samples(raw, strict))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def existing_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``file_path`` and ``length`` of the files under folders; contents are not read."""
    found = files.listed(spark, folders)
    if found is not None:
        return found.select(F.col("place").alias("file_path"), "length")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return listed.select(F.col("path").alias("file_path"), "length")


def scenario_aois(aois: DataFrame, scenario: str, task_id: str) -> DataFrame:
    """The areas of one task in matching order; an unknown task fails when the rows are read."""
    found = aois.filter((F.col("scenario") == scenario) & (F.col("task_id") == task_id))
    check = aois.filter(F.col("scenario") == scenario).agg(F.max((F.col("task_id") == task_id).cast("int")).alias("_known"))
    known = check.select(
        F.when(F.coalesce("_known", F.lit(0)) == 0, F.raise_error(F.lit(f"unknown task: {task_id}")).cast("int")).otherwise(1).alias("_ok")
    )
    # one row decides for the whole result, so it joins on a constant and nothing is multiplied
    return found.withColumn("_one", F.lit(1)).join(F.broadcast(known), F.col("_one") == F.col("_ok"), "right").drop("_one", "_ok")


def writer_by(df: DataFrame, key: str) -> DataFrameWriter:
    """Writes a folder for each key, by as many tasks as rows are shuffled to; each task moves its own files to their place."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key)


def write_recordings(df: DataFrame, key: str, folder: str, sep: str = ",") -> None:
    """A comma file (or one with another separator) for each key, under ``folder``; its name tells the key."""
    if not files.write_csv(df, key, folder, sep):
        writer_by(df, key).csv(folder, header=True, sep=sep)


def write_table(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Samples, events, features or reports as parquet, CSV or JSON folders."""
    writer = df.write.mode(mode).partitionBy(*(partition_by or []))
    if format == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(format).save(path)
