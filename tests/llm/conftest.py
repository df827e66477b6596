import pytest

#: Null, empty, blank and short texts, repeated rows and keys, a null key, line ends, special strings, marks and other scripts.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "One  TWO\nthree"), (6, "One  TWO\nthree"), (7, "a <|endoftext|> b"), (None, "no key here"),
    (8, "It's we'll DON'T 'tis  x y\r\nz 12 345"), (9, "中文 \U0001f600 İ Σς é ١٢"), (10, "x" * 5000), (11, "the " * 3000),
    (12, "general public license, version 3. All rights reserved. CC-BY"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with extra columns named as the operators' own ones."""
    schema = "doc_id long, text string, row long, n_words long, ids string, source string"
    return spark.createDataFrame([(k, t, 5, 6, "own", "s") for k, t in ODD], schema)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def read_docs(spark, odd_docs, tmp_path_factory):
    """The same from storage, in several files."""
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    odd_docs.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def pairs(rows):
    """The odd texts by key, as counts of (key, text)."""
    return [(r["doc_id"], r["text"] or "") for r in rows]
