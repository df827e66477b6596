"""The pipeline against a plain version, and the registered queries against their SQL."""

import collections

import brute
import pytest

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline
    from saccadia.llm import packing, tokenizer_files

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r for r in rows if brute.kept_by_rules(r[1])[2]]
    gone = brute.boilerplate([(s, t) for _, t, s in rows])
    rows = [(k, brute.without_lines(t, gone), s) for k, t, s in rows]
    root, _ = brute.groups([t for _, t, _ in rows], 5, 80)
    pieces = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "doc_tokens").collect()]
    kept = {p[0] for p in pieces}
    members = collections.defaultdict(set)
    for (k, t, _), g in zip(rows, root):
        members[g if brute.words(t) else ("alone", k)].add(k)
    assert all(len(kept & m) == 1 for m in members.values()) and kept == set().union(*[kept & m for m in members.values()])
    rows = [r for r in rows if r[0] in kept]
    texts = [brute.cut_text(t, g) for (_, t, _), (_, g) in zip(rows, brute.without_repeats([t for _, t, _ in rows], 50))]
    lib = tokenizer_files.library(packing.TOKENIZER)
    lengths = {k: len(lib.encode(t, add_special_tokens=False).ids) + 1 for (k, _, _), t in zip(rows, texts)}
    assert {p[0]: p[3] for p in pieces} == lengths
    assert sum(p[2] for p in pieces) == sum(lengths.values())


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("name", ["op4_quality_rules", "op8_substring_dedup", "op9_line_dedup", "op10_ngram_jaccard"])
def test_against_sql(spark, name):
    from oracle import compare, connect

    from saccadia.llm import queries

    problem, rows, _ = compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert problem is None and rows > 0


def test_all_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
