"""Row numbers that stay when files are split otherwise between two reads."""

import pytest
from pyspark.sql import functions as F

from saccadia.llm import jaccard, lines, storage, substrings, token_counts

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Two files of many row groups."""
    path = str(tmp_path_factory.mktemp("split") / "docs")
    rows = [(k, " ".join(f"w{(k * 7919 + j * j) % 10007}" for j in range(k % 90)), f"s{k % 7}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.repartition(2).write.option("parquet.block.size", 1 << 14).option("parquet.page.row.count.limit", "100").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("number", [
    lambda d: lines.numbered(d, "source", "text").select("row", "rest.doc_id"),
    lambda d: token_counts.numbered(d, "doc_id", "text").select("row", "key"),
    lambda d: substrings.numbered(d, "text", ["doc_id"]).select("row", "carry.doc_id"),
    lambda d: jaccard.numbered(d).select("row", "key"),
])
def test_numbers_do_not_depend_on_splits(number, files, spark):
    docs, seen, tasks = storage.stable(files), [], set()
    old = spark.conf.get(SPLIT)
    try:
        for size in ("128m", "20k"):
            spark.conf.set(SPLIT, size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            table = spark.read.parquet(*docs.inputFiles())
            tasks.add(table.rdd.getNumPartitions())
            seen.append({(r[0], r[1]) for r in number(table).collect()})
    finally:
        spark.conf.set(SPLIT, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(tasks) == 2 and len(seen[0]) == 3000 and seen[0] == seen[1] and len({x[0] for x in seen[0]}) == 3000


def test_counts_over_several_files_in_a_task(files, spark):
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(files.coalesce(1)).collect()}
    old = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        again = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.read.parquet(*files.inputFiles())).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if old is None else spark.conf.set("spark.sql.files.minPartitionNum", old)
    assert counts == again and len(counts) == 3000


def test_stable_copies_what_has_no_places(files, spark):
    assert storage.stable(files) is files
    assert storage.stable(files.filter("doc_id > 5")) is not None and storage.stable(spark.range(3)).count() == 3


def test_a_path_given_twice(files, spark):
    name = files.inputFiles()[0]
    once = spark.read.parquet(name)
    folder = name.rsplit("/", 1)[0]
    for table, rows in ((spark.read.parquet(name, name), 2 * once.count()), (spark.read.parquet(folder, name), files.count() + once.count())):
        numbers = storage.numbered(storage.stable(table), F.col("text"))
        assert numbers.count() == numbers.select("row").distinct().count() == rows
    want = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(once).collect()}
    got = token_counts.count_tokens(spark.read.parquet(name, name)).collect()
    assert len(got) == 2 * once.count() and all(r.n_tokens == want[r.doc_id] for r in got)


def test_paths_that_overlap():
    assert storage._overlap(["s3a://a/t", "s3a://a/t"]) and storage._overlap(["/a/t.parquet", "/b", "/a"])
    assert not storage._overlap(["/a/t", "/a/t2", "/a/t-1"]) and not storage._overlap(["/a"])
