"""Encoding takes one Python process for each task."""

from saccadia.llm import bpe


def test_one_python_step(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    found = bpe.digests(bpe.encode(docs))
    assert found._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: r["n_tokens"] > 0 for r in found.collect()} == {1: True, 2: False}
