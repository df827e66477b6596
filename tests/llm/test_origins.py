"""Boilerplate whose own word is the longest of every page."""

import collections
import random
import re

import pytest
from test_corpus_operators import stored

from saccadia.llm import lines

URL = "See https://www.a-very-long-notice-name.example/terms-and-conditions-of-use"
SECOND = "All rights are reserved by us"


def around(rows, least=5, min_chars=12):
    """Boilerplate lines of (site, text) rows by what stands around them."""
    def cut(text):
        return [x.strip(" \t\r\f\x0b") for x in (text or "").split("\n")]

    sites, origins = collections.defaultdict(set), collections.defaultdict(set)
    for site, text in rows:
        for x in cut(text):
            if len(x) >= min_chars and site is not None:
                sites[x].add(site)
    shared = {x for x, s in sites.items() if len(s) >= least}
    for _, text in rows:
        rest = [x for x in cut(text) if x not in shared]
        page = 2 * sum(map(len, rest)) > sum(map(len, cut(text)))
        # the length is enough to tell words apart only with the word itself; ties are no part of these tests
        word = max((w for x in rest for w in re.split(r"[\x20\x09-\x0D]", x)), key=len) if page else None
        for x in set(cut(text)) & shared:
            origins[x].add(word)
    return {x for x, o in origins.items() if len(o) >= least}


@pytest.fixture(scope="module")
def footers(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    prose = lambda: " ".join([*(word(rng.randint(3, 9)) for _ in range(14)), word(12)])
    rows = []
    for k in range(60):
        rows.append((k, "\n".join([prose(), prose(), prose(), SECOND, "  " + URL + "\t"]), f"site{k % 12}"))
    base = [prose() for _ in range(20)]
    for k in range(200):  # near copies: six of twenty lines are others, so the longest word differs
        copy = [prose() if rng.random() < 0.25 else x for x in base]
        rows.append((100 + k, "\n".join([*copy, URL]), f"site{k % 12}"))
    rows += [(500 + k, URL, f"site{k}") for k in range(12)] + [(600, None, "site1"), (601, "", None)]
    return stored(spark, tmp_path_factory, rows, "doc_id long, text string, source string"), base


def test_notice_with_the_longest_word(footers):
    docs, base = footers
    rows = docs.collect()
    gone = around([(r.source, r.text) for r in rows])
    assert gone == {URL, SECOND}
    found = {r.doc_id: r.text for r in lines.clean_documents(docs, origin_of="rest").collect()}
    expected = {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if x.strip() not in gone) for r in rows}
    assert found == expected
    assert any(x in found[100] for x in base)


def test_pipeline_stage_takes_it_away(footers, spark):
    import corpus_pipeline

    found = corpus_pipeline.line_dedup(spark, footers[0], "").collect()
    assert len(found) == footers[0].count() and not any(URL in r.text for r in found)


def test_line_that_stayed_on_real_data(spark):
    line = "Tion was thanonontioniner. Es."
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lambda df: sum(line in [x.strip() for x in (r.text or "").split("\n")] for r in df.collect())
    assert held(docs) >= 11 and held(lines.clean_documents(docs, origin_of="rest")) == 0
