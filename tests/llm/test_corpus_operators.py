"""Operators that compare texts or vectors with one another, against plain versions."""

import collections
import hashlib
import random

import brute
import numpy as np
import pytest

from saccadia.llm import components, graph_index, jaccard, lines, storage, substrings

SF = "/root/testdata/sf0.001"


def stored(spark, tmp_path_factory, rows, schema, files=3):
    path = str(tmp_path_factory.mktemp("table") / "rows")
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Copies, near copies of all degrees, texts in texts, shared passages, periodic texts."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = text(120), text(60)
    out = []
    for k in range(60):
        w = list(base)
        for _ in range(k // 4):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(w)
    out += [text(rng.randint(0, 90)) for _ in range(40)]
    out += [text(rng.randint(0, 30)) + passage[rng.randint(0, 12):] + text(rng.randint(0, 30)) for _ in range(40)]
    out += [["a", "b"] * 60, ["b", "a"] * 60, ["c"] * 50, ["c"] * 34, base, base, passage, passage[:34], passage[:35]]
    rows = [(k % 97, " ".join(w), f"s{k % 7}") for k, w in enumerate(out)]
    return stored(spark, tmp_path_factory, rows, "doc_id long, text string, source string")


@pytest.fixture(scope="module", params=["odd", "read", "made", "real"])
def docs(request, spark, odd_docs, read_docs, made):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    return {"odd": odd_docs, "read": read_docs, "made": made, "real": real}[request.param]


def test_substrings(docs):
    rows = docs.select("doc_id", "text").collect()
    expected = [(r.doc_id, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
                for r, (w, gone) in zip(rows, brute.without_repeats([r.text for r in rows], 35))]
    found = [tuple(r) for r in substrings.digests(substrings.remove_repeats(docs, window=35, carry=["doc_id"])).collect()]
    assert collections.Counter(found) == collections.Counter(expected)


def test_substrings_keep_columns_and_layout(docs):
    cleaned = substrings.clean_documents(docs, window=35)
    assert cleaned.columns == docs.columns
    rows = docs.collect()
    expected = [(r.doc_id, brute.cut_text(r.text, gone)) for r, (_, gone) in zip(rows, brute.without_repeats([r.text for r in rows], 35))]
    assert collections.Counter((r.doc_id, r.text) for r in cleaned.collect()) == collections.Counter(expected)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(docs, n, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "WEIGHT", 3000)  # the large family is dealt to blocks
    rows = docs.select("doc_id", "text").collect()
    root, size = brute.groups([r.text for r in rows], n, percent)
    least = {}
    for r, g in zip(rows, root):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    expected = collections.Counter((r.doc_id, s, least.get(g)) for r, g, s in zip(rows, root, size))
    found = jaccard.join_texts(docs, n=n, percent=percent).collect()
    assert collections.Counter((r.key, r.n_shingles, r.component_id) for r in found) == expected
    assert len({r["first"] for r in found}) == len(set(root))


def test_keep_one(docs):
    kept = jaccard.keep_one(docs, n=3, percent=90)
    assert kept.columns == docs.columns
    texts = [r.text for r in docs.collect()]
    root, _ = brute.groups(texts, 3, 90)
    number = {t: g for t, g in zip(texts, root) if brute.words(t)}
    found = [number.get(r.text, -1) for r in kept.collect()]
    assert collections.Counter(x for x in found if x >= 0) == collections.Counter(dict.fromkeys(set(number.values()), 1))
    assert found.count(-1) == sum(not brute.words(t) for t in texts)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (3, 9), (9, 3), (9, 20)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert found == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """Boilerplate on many sites, a line of one site, a text copied to many sites, lines near the threshold, odd texts."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 12)))
    prose = lambda: " ".join(word() for _ in range(12))
    copied = "\n".join(prose() for _ in range(4))
    rows = []
    for k in range(60):
        body = [prose() for _ in range(3)]
        body.insert(rng.randrange(4), "  Subscribe to our newsletter \t")
        if k % 10 < 5:
            body.append(f"On exactly five sites now {k % 2}" if k % 10 < 4 else "Only of one site, this line")
        rows.append((k, "\n".join(body), f"site{k % 10}" if k % 10 != 4 else "site4"))
    rows += [(100 + k, copied, f"site{k % 10}") for k in range(30)]
    rows += [(200, None, "site1"), (201, "", "site1"), (202, "Subscribe to our newsletter", None), (203, "\n\n", None), (None, prose(), "site2"), (100, copied, "site3")]
    return stored(spark, tmp_path_factory, rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("which", ["pages", "odd", "real"])
def test_lines(which, pages, odd_docs, spark):
    docs = {"pages": pages, "odd": odd_docs, "real": spark.read.parquet("/root/testdata/sf0.01/documents.parquet")}[which]
    rows = docs.collect()
    gone = brute.boilerplate([(r.source, r.text) for r in rows])
    if which == "pages":
        assert "Subscribe to our newsletter" in gone and "Only of one site, this line" not in gone
    cleaned = lines.clean_documents(docs)
    assert cleaned.columns == docs.columns
    expected = collections.Counter((r.doc_id, brute.without_lines(r.text, gone)) for r in rows)
    assert collections.Counter((r.doc_id, r.text) for r in cleaned.collect()) == expected


def test_lines_stay_native(pages):
    plan = lines.clean(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def exact_neighbours(rows, every, k):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in fine:
        if q % every == 0:
            score = collections.defaultdict(lambda: -np.inf)
            for i, u in fine:
                if i != q and len(u) == len(v):
                    score[i] = max(score[i], float(np.dot(np.array(u), np.array(v))))
            out[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (20, [0.0, 1.0]), (20, [0.0, 1.0]), (21, [1.0, 0.0, 0.0]), (40, [2.0, 2.0]), (None, [1.0, 1.0]), *[(100 + k, [3.0, 1.0]) for k in range(50)]]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    found = collections.defaultdict(list)
    for r in sorted(graph_index.nearest(table).collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
    expected = exact_neighbours(rows, 20, 20)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in expected.items() if v}
    assert graph_index.nearest(table.limit(0)).count() == 0


def test_recall_over_shards(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    found = collections.defaultdict(set)
    for r in graph_index.nearest(table, shard_rows=700).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q, got in found.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(got & set(ids[np.argsort(-score)[:20]].tolist()))
    assert len(found) == 100 and hits >= 0.97 * 20 * len(found)


def test_inner_products_of_unequal_lengths():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16)) * rng.uniform(0.2, 3, size=(2000, 1))
    full = np.column_stack([x, np.sqrt((x ** 2).sum(1).max() - (x ** 2).sum(1))]).astype(np.float32)
    graph, start = graph_index.build(full)
    q = rng.normal(size=(50, 16))
    got, _ = graph_index.beam_search(full, graph, start, np.column_stack([q, np.zeros(50)]).astype(np.float32), graph_index.SEARCH_BEAM)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:60].tolist()) & set(b.tolist())) / 20 for a, b in zip(got, best)]) >= 0.9


def test_sift(docs, spark, n=5, percent=80):
    """No text with a partner leaves, and every text that stays has enough n-grams that others have too."""
    rows = jaccard.numbered(storage.stable(docs), "doc_id", "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        left = {r.row for r in jaccard.sift(jaccard.points(rows, n), rows, n, percent).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = {r.row: r.text for r in rows.select("row", "text").collect()}
    sets = {k: frozenset(brute.shingles(t, n)) for k, t in texts.items()}
    owners = collections.Counter(g for s in sets.values() for g in s)
    could = {s: 100 * sum(owners[g] > 1 for g in s) >= percent * len(s) for s in set(sets.values()) if s}
    stays = {sets[k] for k in left}
    assert len(stays) == len(left) and all(could[s] for s in stays)
    linked = {s for s in could for o in could if s != o and 100 * len(s & o) >= percent * len(s | o)}
    assert linked <= stays
