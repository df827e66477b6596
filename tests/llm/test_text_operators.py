"""Operators on single texts, against plain versions and the tokenizers library, on odd and on real texts."""

import collections
import hashlib
import zlib

import brute
import numpy as np
import pytest

from saccadia.llm import bpe, classifier, licenses, packing, pretokens, rules, token_counts, tokenizer_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["odd", "read", "real"])
def docs(request, spark, odd_docs, read_docs):
    return {"odd": odd_docs, "read": read_docs, "real": spark.read.parquet(f"{SF}/documents.parquet")}[request.param]


def by_row(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(found, expected):
    assert collections.Counter(found) == collections.Counter(expected)


def test_rules(docs):
    judged = rules.apply_policy(rules.ledger(rules.measure(docs.select("doc_id", "text"))))
    found = [((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept, r.doc_id) for r in judged.collect()]
    same(found, [(*brute.kept_by_rules(t), k) for k, t in by_row(docs)])


def test_rules_keep_columns_and_ablation(docs):
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    same([r["doc_id"] for r in kept.collect()], [k for k, t in by_row(docs) if brute.kept_by_rules(t)[2]])
    entries = rules.ledger(rules.measure(docs.select("doc_id", "text"))).cache()
    n = rules.apply_policy(entries).filter("kept").count()
    for r in rules.ablation(entries).collect():
        mask = rules.bits(set(rules.POLICIES[rules.NEWEST]) - {r["rule"]})
        assert r["kept_without"] == entries.filter(f"failure_bits & {mask} = 0").count() == n + r["n_only"]


def test_packing(docs):
    lib = tokenizer_files.library(packing.TOKENIZER)
    pieces = packing.pack(docs, length=64).collect()
    expected = collections.Counter((k, tuple(lib.encode(t or "", add_special_tokens=False).ids) + (0,)) for k, t in by_row(docs))
    at = sorted(pieces, key=lambda p: p.sequence_id * 64 + p.offset)
    place = 0
    for p in at:  # gapless, and full up to the last
        assert p.sequence_id * 64 + p.offset == place and p.offset + p.length <= 64
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        place += p.length
    found, ids = [], ()
    for p in at:
        ids += tuple(np.frombuffer(bytes(p.ids), "<u4").tolist())
        assert p.start + p.length == len(ids)
        if len(ids) == p.doc_tokens:
            found.append((p.doc_id, ids))
            ids = ()
    assert collections.Counter(found) == expected
    whole = packing.sequences(packing.pack(docs, length=64), 64).collect()
    assert sum(r["n_tokens"] for r in whole) == place


def test_token_counts(docs):
    lib = tokenizer_files.library(token_counts.TOKENIZER)
    found = [tuple(r) for r in token_counts.count_tokens(docs).collect()]
    lengths = [(k, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t in by_row(docs)]
    same(found, [(*x, x[2] > 1024) for x in lengths])


def test_postings_hold_large_frequencies():
    rng = np.random.default_rng(1)
    row = np.unique(rng.integers(0, token_counts.BLOCK_ROWS, 3000))
    freq = rng.choice([1, 1, 1, 2, 32768, 40000, 65535, 65536, 200000], len(row))
    packed = token_counts._postings(row, freq, np.array([0, 10, len(row)]))
    member, times, _ = token_counts._unpacked(token_counts._numbers(packed, "<u2")[0])
    total = np.bincount(member, times, token_counts.BLOCK_ROWS)
    assert (np.flatnonzero(total) == row).all() and (total[row] == freq).all()


def test_bpe(docs):
    lib = tokenizer_files.library(bpe.TOKENIZER)
    found = [tuple(r) for r in bpe.digests(bpe.encode(docs)).collect()]
    expected = []
    for k, t in by_row(docs):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        expected.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    same(found, expected)


def test_pieces_are_the_librarys(docs):
    import pyarrow as pa

    from saccadia.llm import arrays

    texts = [t or "" for _, t in by_row(docs) if "<|" not in (t or "")]
    lib = tokenizer_files.library(packing.TOKENIZER)
    for t in arrays.texts(pa.array(texts), 1000):
        p = pretokens.pieces(t, pretokens.BYTE_LEVEL, {})
        for r in range(t.rows):
            text = t.text(r).decode()
            mine = [t.data[a:b].tobytes().decode() for a, b in zip(p.starts[p.bounds[r]:p.bounds[r + 1]], p.ends[p.bounds[r]:p.bounds[r + 1]])]
            assert mine == [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)]


def test_vocabulary_forgets():
    import pyarrow as pa

    from saccadia.llm import arrays

    lib = tokenizer_files.library(packing.TOKENIZER)
    known = pretokens.Vocabulary(lambda found: [e.ids for e in lib.encode_batch_fast(found, add_special_tokens=False)], most=5)
    for text in ("one two three four", "two three five six", "one two seven eight nine ten", "two three"):
        t = next(arrays.texts(pa.array([text])))
        p = pretokens.pieces(t, pretokens.BYTE_LEVEL, {})
        entry = known.lookup(t, p)
        ids, starts, lengths = known.arrays()
        assert ids[arrays.expand(starts[entry], lengths[entry])].tolist() == lib.encode(text, add_special_tokens=False).ids


def places(raw):
    import re

    w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (raw or "").encode().translate(brute.LOW))
    found, labels = [], set()
    for x in licenses.PHRASES:
        p = [y.encode() for y in x.words]
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                found.append(k)
                labels.add(x.label)
    return len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


def test_licenses(docs):
    rows = licenses.scan(docs).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows], [(k, *places(t)) for k, t in by_row(docs)])
    for r in rows:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_notices(spark):
    texts = ["x Licensed under the Apache License, Version 2.0. y", "licensed under the license version 2.0 apache", "Released under the MIT\nLicense",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of THAT software and associated documentation files"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == {0: "apache-2.0", 1: "", 2: "mit", 3: "mit"}


def test_classifier_learns_and_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    weights = classifier.fit(docs, labels)
    rows = classifier.score(docs, weights).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows) > 0
    for r in classifier.score(docs, weights).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert (classifier.fit(docs, labels) == weights).all()


def test_classifier_on_odd_texts(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (None, 1), (8, None)], "doc_id long, quality int")
    rows = classifier.score(odd_docs, classifier.fit(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    nothing = classifier.fit(no_docs, labels.limit(0))
    assert {r.score for r in classifier.score(odd_docs, nothing).collect()} == {0.5}
    assert classifier.score(no_docs, nothing).count() == 0


def test_empty_table(no_docs):
    assert rules.keep_good(no_docs).count() == 0 and packing.pack(no_docs).count() == 0 and token_counts.count_tokens(no_docs).count() == 0
    assert bpe.digests(bpe.encode(no_docs)).count() == 0 and licenses.scan(no_docs).count() == 0
