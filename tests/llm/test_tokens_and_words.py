"""Alignment of two tokenizers, keyed shards of ids and spelling variants, against plain versions, on odd and on real texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from saccadia.llm import alignment, keyed_ids, queries, spelling, tokenizer_files

SF = "/root/testdata/sf0.001"
LONG = "Überall zählt, dass  der   Satz\n\tlang ist; 12345 abcdefghijk 中文字 " * 30_000  # two megabytes


@pytest.fixture(scope="module", params=["odd", "read", "real"])
def docs(request, spark, odd_docs, read_docs):
    return {"odd": odd_docs, "read": read_docs, "real": spark.read.parquet(f"{SF}/documents.parquet")}[request.param]


def by_row(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# Alignment


def plain_tokens(text):
    """Ids and bytes of all tokens of both files, by one call of the library for the whole text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(plain_tokens, "libs"):
        a = Tokenizer.from_file(tokenizer_files.path(alignment.TOKENIZER_A))
        a.encode_special_tokens = True
        plain_tokens.libs = a, SentencePieceProcessor(model_file=tokenizer_files.path(alignment.TOKENIZER_B))
    a, b = plain_tokens.libs
    letters = alignment._byte_of_letter()
    found = a.encode(" " + text, add_special_tokens=False)
    side_a = [(i, bytes(letters[c] for c in s)) for i, s in zip(found.ids, found.tokens)]
    side_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        side_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return side_a, side_b


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain_alignment(rows):
    """All columns of the contract, by overlaps of every A token with the B tokens around it."""
    links, groups = [], []
    for _, text in rows:
        a, b = plain_tokens(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or any(b"".join(raw for _, raw in side) != want for side in (a, b)):
            links.append([])
            groups.append(None)
            continue
        sa, sb = spans(a), spans(b)
        met, first = [], 0
        for i, low, high in sa:
            while sb[first][2] <= low:
                first += 1
            k = first
            while k < len(sb) and sb[k][1] < high:
                met.append((i, sb[k][0]))
                k += 1
        links.append(met)
        both = sorted({x[2] for x in sa} & {x[2] for x in sb})
        parts, ia, ib = [], 0, 0
        for end in both:
            ga, gb = [], []
            while ia < len(sa) and sa[ia][2] <= end:
                ga.append(sa[ia][0])
                ia += 1
            while ib < len(sb) and sb[ib][2] <= end:
                gb.append(sb[ib][0])
                ib += 1
            parts.append((ga, gb))
        groups.append((len(sa), len(sb), parts))
    counts = collections.Counter(p for met in links for p in set(met))
    most = collections.defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (key, _), met, g in zip(rows, links, groups):
        if g is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g[2])
        out.append((key, g[0], g[1], len(g[2]), len(met), sum(counts[p] == most[p[0]] for p in met), sum(counts[p] for p in met),
                    hashlib.sha256(told.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [200, 1 << 22])
def test_alignment(docs, monkeypatch, block_bytes):
    whole = alignment.blocks
    monkeypatch.setattr(alignment, "blocks", lambda *x: whole(*x, size=37, block_bytes=block_bytes))
    found = [tuple(r) for r in alignment.align(docs).collect()]
    assert collections.Counter(found) == collections.Counter(plain_alignment(by_row(docs)))


def test_alignment_of_blanks_marks_and_bytes(spark):
    rng = random.Random(4)
    parts = [" ", "  ", "   ", "\n", "\t", "a", "Wort", "é", "é", "中", "\U0001f600", "▁", "<s>", "<0x0A>", "<|endoftext|>", "'s", "12", "\x00", "　", "ﬁ", "x" * 40]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in alignment.align(df).collect()) == collections.Counter(plain_alignment(rows))
    told = {r.doc_id: [([*g.a], [*g.b]) for g in r.groups] for r in alignment.groups(df).collect()}
    for (key, *_, digest), groups in ((x, told[x[0]]) for x in plain_alignment(rows)):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert digest == (hashlib.sha256(text.encode()).hexdigest() if groups else "")


def test_alignment_of_no_and_of_long_texts(spark, no_docs):
    assert alignment.align(no_docs).collect() == []
    rows = [(1, LONG), (2, "short"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment.align(df).collect()) == plain_alignment(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_pieces_have_equal_work_and_meet(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(1, 40))) for _ in range(2))
        a, b = np.union1d(a, [60]), np.union1d(b, [60])
        pieces = list(alignment.cut(a, b, size))
        assert all(len(p.ends_a) + len(p.ends_b) == size for p in pieces[:-1])
        link_a, link_b, cut_a, cut_b = alignment.merged(a, b, size)
        starts = lambda ends: np.append(0, ends[:-1])
        expected = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts(a)[i], starts(b)[j]) < min(a[i], b[j])}
        assert set(zip(link_a.tolist(), link_b.tolist())) == expected and len(link_a) == len(expected)
        assert a[cut_a - 1].tolist() == b[cut_b - 1].tolist() == np.intersect1d(a, b).tolist()


# Keyed shards


def plain_ids(rows):
    lib = tokenizer_files.library("byte_bpe_50k.json")
    return [(k, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in rows]


def checked(found, rows):
    """Records follow one another without gaps in the order of keys, and hold just the ids of their texts."""
    found = sorted(found, key=lambda r: r.start)
    place = 0
    for r in found:
        assert r.start == place
        place += r.n_tokens
    keys = [r.doc_id for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    expected = collections.Counter((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in plain_ids(rows))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected


def test_keyed_ids(docs):
    checked(keyed_ids.stored(docs).collect(), by_row(docs))


def test_keyed_ids_over_many_shards_and_index_parts(spark, tmp_path, monkeypatch):
    """A key with a third of all rows goes over several shards; some keys are asked for twice, some are not there."""
    monkeypatch.setattr(keyed_ids, "PART_KEYS", 20)
    rng = random.Random(1)
    rows = [(7 if k % 3 == 0 else rng.randrange(1000), f"text number {k % 50} " * rng.randint(0, 20)) for k in range(900)] + [(2000, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = keyed_ids.write(docs, str(tmp_path / "ids"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest["shards"]) > 3 and len(manifest["index"]) > 10
    assert max(s["records"] for s in manifest["shards"]) < 250
    checked(keyed_ids.read(spark, str(tmp_path / "ids"), docs.select("doc_id")).collect(), rows)
    wanted = [7, 7, 2000, 5000, rows[1][0], None]
    found = keyed_ids.read(spark, str(tmp_path / "ids"), spark.createDataFrame([(k,) for k in wanted], "k int")).collect()
    expected = collections.Counter((k, tuple(ids)) for k, ids in plain_ids(rows) if k in set(wanted))
    assert collections.Counter((r.k, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in found) == expected


def test_keyed_ids_by_text_keys_and_of_no_rows(spark, tmp_path, no_docs):
    rows = [("a", "one"), ("b", None), (None, "two"), ("ä", ""), ("a", "one")]
    checked(keyed_ids.stored(spark.createDataFrame(rows, "doc_id string, text string")).collect(), rows)
    assert keyed_ids.stored(no_docs).collect() == []


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        prints = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        raw = keyed_ids.packed_part(keys, prints, np.zeros(len(keys)), np.arange(len(keys)), np.ones(len(keys)))
        ok, entries = keyed_ids.found_in_part(raw, keys, prints)
        assert ok.all() and sorted(entries["first"].tolist()) == list(range(len(keys))) and entries["first"].tolist() == list(range(len(keys)))
        other = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        other = other[~np.isin(other, keys)]
        assert not keyed_ids.found_in_part(raw, other, (other & np.uint64(0xFFFFFFFF)).astype(np.uint32))[0].any()


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x.ids").write_bytes(b"\0" * 80)
    with pytest.raises(ValueError, match="not a shard"):
        keyed_ids._Shard(str(tmp_path), "x.ids", 0)


# Spelling


def plain_variants(rows, misspelt=199, letters=6, least=5, ratio=5):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if misspelt and h % misspelt == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    alphabet = sorted(set("".join(counts)))
    forms, near_of = {}, {}
    for w in counts:
        near = {w[:i] + w[i + 1:] for i in range(len(w))}
        near |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        near |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in alphabet}
        near = (near - {w}) & counts.keys()
        near_of[w] = len(near)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, near_of[w], counts[forms[w]] if forms[w] else None))
    return out


def test_spelling(docs):
    found = [tuple(r) for r in spelling.variants(docs).collect()]
    assert collections.Counter(found) == collections.Counter(plain_variants(by_row(docs)))


@pytest.mark.parametrize("misspelt,letters,least,ratio", [(199, 6, 5, 5), (3, 2, 1, 2), (0, 1, 1, 3)])
def test_spelling_of_near_words(spark, misspelt, letters, least, ratio):
    """Short words of few letters have very many neighbours, repeated letters, ties, and long ways to their roots."""
    rng = random.Random(misspelt)
    words = ["".join(rng.choice("abÀé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    weights = [1.6 ** rng.randint(0, 12) for _ in words]
    rows = [(k if k % 9 else None, " ".join(rng.choices(words, weights, k=rng.randint(0, 60))) + rng.choice(["×÷", "", "ß-Ā", "Z" * 70])) for k in range(250)]
    rows += [(500, None), (501, ""), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in spelling.variants(df, misspelt=misspelt, letters=letters, least=least, ratio=ratio).collect()]
    expected = plain_variants(rows, misspelt, letters, least, ratio)
    assert collections.Counter(found) == collections.Counter(expected)
    assert any(r[1] and r[2] != r[1] for r in expected) or ratio == 5


def test_spelling_scan_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(1, " ".join(["walking", "walkin", "talking", "walkiing", "walkings"] * 6))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(tuple(r) for r in spelling.variants(df, misspelt=0).collect()) == sorted(plain_variants(rows, 0))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spelling_of_no_and_of_long_texts(spark, no_docs):
    assert spelling.variants(no_docs).collect() == []
    rows = [(1, LONG), (2, "abcdefghijk abcdefghij " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = spelling.variants(df)
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain_variants(rows))
    by_root = {root: [r for r in plain_variants(rows) if r[2] == root] for root in {r[2] for r in plain_variants(rows)}}
    assert {r.root: (r.words, r.n) for r in spelling.groups(found).collect()} == {k: (len(v), sum(r[3] for r in v)) for k, v in by_root.items()}
    assert {r.root: r.word for r in spelling.most_frequent(found, 1).collect()} == {k: min(v, key=lambda r: (-r[3], r[0]))[0] for k, v in by_root.items()}


def test_queries_return_the_columns_of_their_contracts(spark):
    columns = {
        "op11_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        "op12_keyed_ids": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op13_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    }
    for name, expected in columns.items():
        assert queries.QUERIES[name](spark, SF).columns == expected
