"""Very many small files: listed, read and written by all tasks, and never named on the driver.

Spark's file index holds every file on the driver, lists each folder in a task of its own and opens a file for the price of megabytes;
its writers make a folder for each key. Here a task lists folders, opens one file after the other, each once for its header and once for
its rows, or writes them. Files go through pyarrow, to the systems it opens by address; for others the callers use Spark's readers.
"""

from __future__ import annotations

import csv
import fnmatch
import functools
import io
import re
import urllib.parse
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyarrow import fs

#: Larger files are left to Spark's reader, which splits them.
WHOLE = 64 << 20
CHUNK = 1 << 20
#: Lines and bytes of an Arrow batch on its way out of a task.
LINES, HELD = 10_000, 4 << 20
SYSTEMS = ("file", "s3", "s3a", "s3n", "gs", "hdfs", "abfs", "abfss")
UNPACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
#: Endings that Spark unpacks in a way of Hadoop's own.
OTHERS = (".deflate", ".snappy", ".lz4", ".xz", ".zlib", ".lzo")


def tasks_of(spark: SparkSession) -> int:
    """Tasks of a pass over files: as many as the shuffle setting says, also over few bytes, as each small row is a file."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@functools.lru_cache(maxsize=64)
def _system(store: str) -> tuple[fs.FileSystem, str] | None:
    """The file system at an address without a path, and the root's path there; a task asks for it with each file."""
    if store == "file://":
        return fs.LocalFileSystem(), ""
    try:
        system, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", store) + "/")
    except (pa.ArrowException, ValueError, OSError):
        return None
    return system, root.rstrip("/")


def _open(address: str) -> tuple[fs.FileSystem, str, str] | None:
    """The file system of an address, its path there, and what goes before paths of that system."""
    spelt = re.sub("^(file:)?/+", "file:///", address).rstrip("/")
    store = re.match("^([a-z0-9]+)://[^/]*", spelt)
    if not store or store[1] not in SYSTEMS or not (found := _system(store[0])):
        return None
    path = found[1] + spelt[len(store[0]):]
    return (found[0], path, spelt[:len(spelt) - len(path)]) if spelt.endswith(path) else None


def _as_uri(place: str) -> str:
    """A path as Spark's ``_metadata.file_path`` spells it."""
    place = re.sub("^file:/+", "file:/", place)
    return re.sub(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]', lambda m: f"%{ord(m.group()):02X}", place)


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def listed(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame | None:
    """``file_path``, ``place`` and ``length`` of the files in folders (those whose names fit ``pattern``) and of single files.

    None where a path is not there, has wildcards, or lies in a system that only Spark opens.
    """
    if any(c in p for p in paths for c in "*?[]{}\\") or any(c in (pattern or "") for c in "[]{}\\"):
        return None
    opened = [_open(p) for p in paths]
    if None in opened:
        return None
    for system, path, _ in opened:
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None

    def children(place, recursive):
        system, path, before = _open(place)
        info = system.get_file_info(path)
        if info.is_file:
            yield place, info.size, False
            return
        for found in system.get_file_info(fs.FileSelector(path, recursive=recursive)):
            inner = found.path[len(path):].strip("/").split("/")
            if not any(map(_hidden, inner)) and (found.is_file or not recursive):
                yield before + found.path, found.size, not found.is_file

    def batches_of(recursive):
        def run(batches):
            for batch in batches:
                rows = []
                for k, (place, length, folder) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                    rows += children(place, recursive) if folder else [(place, length, False)]
                    if len(rows) > LINES or k + 1 == batch.num_rows:
                        columns = list(zip(*rows)) or [(), (), ()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.bool_()))],
                                                         names=["place", "length", "folder"])
                        rows = []

        return run

    schema = "place string, length long, folder boolean"
    roots = spark.createDataFrame([(before + path, 0, True) for _, path, before in opened], schema)
    first = roots.mapInArrow(batches_of(False), schema).repartition(tasks_of(spark), "place")
    named = F.udf(lambda place: None if pattern and not fnmatch.fnmatchcase(place.rsplit("/", 1)[1], pattern) else _as_uri(place))
    found = first.mapInArrow(batches_of(True), schema).withColumn("file_path", named("place")).filter("file_path IS NOT NULL")
    # a folder may be given twice, or lie in another one
    return found.groupBy("file_path").agg(F.first("place").alias("place"), F.max("length").alias("length"))


def for_spark(files: DataFrame) -> DataFrame:
    """Whether a listed file is left to Spark's reader."""
    return files.withColumn("by_spark", (F.col("length") > WHOLE) | F.lower("place").rlike("(" + "|".join(re.escape(e) for e in OTHERS) + ")$"))


def _chunks(place: str) -> Iterator[list[bytes]]:
    """The lines of a file, a megabyte at a time."""
    system, path, _ = _open(place)
    packed = next((kind for ending, kind in UNPACKED.items() if path.endswith(ending)), None)
    with system.open_input_stream(path, compression=packed) as stream:
        rest = b""
        while data := stream.read(CHUNK):
            data = rest + data
            cut = max(data.rfind(b"\n"), data.rfind(b"\r", 0, -1)) + 1  # the last byte may be half of a line's end
            rest = data[cut:]
            if cut:
                yield data[:cut].splitlines()
        if rest:
            yield rest.splitlines()


def _text(lines: list[bytes]) -> pa.Array:
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())


def _each_file(files: DataFrame, run: Callable, schema: str, tasks: int) -> DataFrame:
    return files.select("file_path", "place").repartition(tasks, "file_path").mapInArrow(run, schema)


def headers(files: DataFrame) -> DataFrame:
    """``file_path``, ``place`` and first line of each file that has lines."""
    def run(batches):
        for batch in batches:
            first = [next((x[0] for x in _chunks(place)), None) for place in batch.column(1).to_pylist()]
            known = [k for k, x in enumerate(first) if x is not None]
            kept = batch.take(pa.array(known, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, _text([first[k] for k in known])], names=["file_path", "place", "header"])

    return _each_file(files, run, "file_path string, place string, header string", tasks_of(files.sparkSession))


def lines(files: DataFrame, size: int) -> DataFrame:
    """``file_path``, ``at`` and ``value`` of each line after the first that is not blank; ``size`` is the bytes of all files."""
    blank = bytes(range(33))

    def run(batches):
        names, places, values, held = [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), _text(values)], names=["file_path", "at", "value"])

        for batch in batches:
            for name, place in zip(*[c.to_pylist() for c in batch.columns]):
                at = 0
                for chunk in _chunks(place):
                    for line in chunk:
                        if at and line.strip(blank):
                            names.append(name)
                            places.append(at)
                            values.append(line)
                            held += len(line)
                        at += 1
                        if len(values) >= LINES or held > HELD:
                            yield out()
                            names, places, values, held = [], [], [], 0
        if values:
            yield out()

    return _each_file(files, run, "file_path string, at long, value string", max(tasks_of(files.sparkSession), -(-size // WHOLE)))


def _first_row(names: list[str], sep: str) -> str:
    text = io.StringIO()
    csv.writer(text, delimiter=sep, lineterminator="\n").writerow(names)
    return text.getvalue()


def write_csv(df: DataFrame, key: str, folder: str, sep: str = ",") -> bool:
    """A file ``key=value.csv`` with a header for each key, in a folder for each task; false where only Spark opens the folder.

    Lines are made by Spark, so they are those of its own writer. A file is complete when it has its name, and a task that is
    run again writes the same names.
    """
    if _open(folder) is None:
        return False
    columns = [c for c in df.columns if c != key]
    first = _first_row(columns, sep).encode()
    rows = df.select(F.col(key).cast("string").alias("name"), F.to_csv(F.struct(*columns), {"sep": sep}).alias("line"))

    def write(batches):
        system, path, _ = _open(folder)
        moves = system.type_name in ("local", "hdfs")  # a store of objects shows a file when it is complete
        attempt = TaskContext.get().taskAttemptId()
        here, current, stream, name, n = f"{path}/{TaskContext.get().partitionId()}", None, None, None, 0

        def close():
            if stream is not None:
                stream.close()
                if moves:
                    system.move(f"{here}/.{attempt}", f"{here}/{name}")

        for batch in batches:
            keys, text = (c.to_pylist() for c in batch.columns)
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if stream is None or keys[a] != current:
                    close()
                    if not n:
                        system.create_dir(here)
                    n, current = n + 1, keys[a]
                    value = "__HIVE_DEFAULT_PARTITION__" if current is None else urllib.parse.quote(current, safe=" ()+,;@!$&~")
                    name = f"{key}={value}.csv"
                    stream = system.open_output_stream(f"{here}/.{attempt}" if moves else f"{here}/{name}")
                    stream.write(first)
                stream.write(("\n".join(text[a:b]) + "\n").encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    spark = df.sparkSession
    _open(folder)[0].create_dir(_open(folder)[1])
    rows.repartition(tasks_of(spark), "name").sortWithinPartitions("name").mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()
    return True
