"""Tables that an operator writes once and reads several times, in the folder that all machines share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one file are numbered in so many bits.
FILE_BITS = 40


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder, but only if all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="saccadia-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Tables written since the last ``release``.
_held: list[str] = []


def written(df: DataFrame, name: str, compression: str | None = None, keep: bool = False) -> DataFrame:
    """``df`` from storage: later reads see the same rows in any order of events, also after executors are lost.

    The table stays until ``release``, or for good with ``keep``.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if not keep:
        _held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession, still_read: DataFrame) -> None:
    """Delete the tables written so far; for where a result made of them is stored. Tables that ``still_read`` reads stay."""
    read = still_read.inputFiles()
    paths = [p for p in _held if not any(f"/{p.rsplit('/', 1)[1]}/" in f for f in read)]
    for path in paths:
        _held.remove(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    let_go(spark)


def _places(df: DataFrame) -> tuple[Column, Column]:
    """The file of each row and its place there."""
    place = df.metadataColumn("_metadata")
    return place["file_path"], place["row_index"]


def _overlap(paths: list[str]) -> bool:
    """Whether a path is given twice, or lies in another; then rows are read twice from one place."""
    folders = sorted(f"{p}/" for p in paths)
    return any(b.startswith(a) for a, b in zip(folders, folders[1:]))


def stable(df: DataFrame) -> DataFrame:
    """``df`` itself if it reads whole stored files, each once, whose rows have places of their own, else a stored copy of it.

    Operators number the rows they read and read them again; joins and shuffles may bring rows in another order each time.
    """
    def reads_only(plan) -> bool:
        children = plan.children()
        if plan.nodeName() == "Project" and plan.deterministic():
            return reads_only(children.apply(0))
        return plan.nodeName() == "LogicalRelation" and not _overlap(plan.relation().location().rootPaths().mkString("\n").split("\n"))

    try:
        df.select(*_places(df))
    except AnalysisException:
        return written(df, "rows")
    return df if reads_only(df._jdf.queryExecution().optimizedPlan()) else written(df, "rows")


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """``row`` and columns of a table that is ``stable``; numbers follow one another within a file.

    A row's number comes from its file and its place there, so it does not depend on how files are split into tasks, which
    Spark decides anew in each read by the number of cores it then has.
    """
    path, place = _places(docs)
    paths = sorted(r[0] for r in docs.select(path.alias("path")).distinct().collect())  # one row per file
    files = pa.table({"file": pa.array(paths, pa.string()), "nth": pa.array(range(len(paths)), pa.int64())})
    placed = docs.select(path.alias("file"), place.alias("place"), F.struct(*columns).alias("columns"))
    joined = placed.join(F.broadcast(docs.sparkSession.createDataFrame(files)), "file")
    return joined.select((F.shiftleft("nth", FILE_BITS) + F.col("place")).alias("row"), "columns.*")


def text_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's default, which is meant for rows without long texts; own settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")
