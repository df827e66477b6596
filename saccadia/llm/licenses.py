"""Licence scans with a positional index of rare words.

Notices are templates: a label, words, and key phrases that must be present. Their words form a positional index of fixed
size. Over all texts the document frequency of each of these words is counted; the words with the highest IDF of a template
are its anchors. In a text, each place of an anchor proposes where the template would start; places on which two anchors
agree are kept (one, for phrases of fewer than three words), and there the rest of the template is compared word by word.
A template counts if nine tenths of its words and all of its key phrases stand where they should.

Phrases are templates that must match in full; all their places are reported.

Words are lower-cased in A-Z; anything in ASCII but letters and digits parts them. Defined cases: a null or empty text has no
words and no labels. Repeated rows are scanned each on its own; null keys are kept; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saccadia.llm import arrays

OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
ANCHORS = 3
MATCHED = 0.9


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...] = ()
    phrase: bool = False


def notice(label: str, text: str, *keys: str) -> Template:
    return Template(label, tuple(text.split()), tuple(tuple(k.split()) for k in keys))


def phrase(label: str, text: str) -> Template:
    return Template(label, tuple(text.split()), (), True)


#: Phrases of the base labels.
PHRASES = [phrase("cc-by", "cc by"), phrase("gpl", "general public license"), phrase("reserved", "all rights reserved")]
#: Public notices.
NOTICES = [
    notice("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    notice("mit", "released under the mit license", "mit license"),
    notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
                  " documentation files", "permission is hereby granted"),
    notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    notice("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    notice("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    notice("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    notice("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    notice("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    notice("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    notice("cc0", "dedicated to the public domain under cc0", "cc0"),
    notice("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]


class Index:
    """Template words as numbers, and the places each has in the templates."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.words = sorted({w for t in templates for w in t.words})
        number = {w: k for k, w in enumerate(self.words)}
        t = next(arrays.texts(pa.array(self.words), 1 << 30))
        hashes = arrays.span_hashes(t.data, t.bounds[:-1], t.bounds[1:])
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.ids = [np.array([number[w] for w in x.words]) for x in templates]
        self.keys = [[np.array([number[w] for w in k]) for k in x.keys] for x in templates]

    def number(self, t: arrays.Texts, w: arrays.Words) -> np.ndarray:
        """Each word's number, -1 for words of no template."""
        h = arrays.span_hashes(t.data, w.starts, w.ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], -1)

    def anchors(self, idf: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each template (word, place) of its words with the highest IDF; ties go to the earlier place."""
        out = []
        for ids, x in zip(self.ids, self.templates):
            best = sorted(range(len(ids)), key=lambda j: (-idf[ids[j]], j))
            out.append([(int(ids[j]), j) for j in best[: 1 if x.phrase or len(ids) < 3 else ANCHORS]])
        return out


def _lowered(column: pa.Array):
    for t in arrays.texts(column):
        yield arrays.Texts(t.first, arrays.LOWER[t.data], t.bounds)


def document_frequencies(docs: DataFrame, index: Index, text: str = "text") -> tuple[int, np.ndarray]:
    """The number of texts, and of those that hold each template word: one row per word and task reaches the sum."""
    size = len(index.words)

    def run(batches):
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for t in _lowered(batch.column(0)):
                w = arrays.words(t, OUTSIDE)
                ids, row = index.number(t, w), w.row_of()
                hit = ids >= 0
                pairs = np.unique(row[hit] * size + ids[hit])
                counts[:size] += np.bincount(pairs % size, minlength=size)
                counts[size] += t.rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(counts)], names=["word", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, "word long, n long")
    counts = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect():  # one row per template word
        counts[r["word"]] = r["n"]
    return int(counts[size]), counts[:size]


def _places(ids: np.ndarray, w: arrays.Words, row: np.ndarray, template: np.ndarray, anchors) -> tuple[np.ndarray, np.ndarray]:
    """Starts that the anchors agree on, within one text, and the share of the template's words that stand there."""
    n = len(template)
    proposed = [np.flatnonzero(ids == word) - place for word, place in anchors]
    starts, votes = np.unique(np.concatenate(proposed), return_counts=True)
    starts = starts[(votes >= min(2, len(anchors))) & (starts >= 0) & (starts + n <= len(ids))]
    starts = starts[row[starts] == row[starts + n - 1]]
    matched = np.zeros(len(starts))
    for j, word in enumerate(template):
        matched += ids[starts + j] == word
    return starts, matched / n


def _holds(ids: np.ndarray, start: int, n: int, key: np.ndarray) -> bool:
    part = ids[start:start + n]
    return any((part[k:k + len(key)] == key).all() for k in range(n - len(key) + 1))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: list[Template] = PHRASES, notices: list[Template] = NOTICES) -> DataFrame:
    """One row per text: ``n_words``, places of phrases (``n_base``, ``first_word``, ``last_word``, ``base_labels``), all
    ``labels``, ``score`` (the best share of a template's words) and ``matches``, the label and words of each place."""
    index = Index([*phrases, *notices])
    n_docs, df = document_frequencies(docs, index, text)
    idf = np.array([math.log((n_docs + 1) / (d + 1)) for d in df])
    anchors = index.anchors(idf)
    match_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def one_slice(t: arrays.Texts, keys):
        w = arrays.words(t, OUTSIDE)
        ids, row = index.number(t, w), w.row_of()
        found: list[list[tuple]] = [[] for _ in range(t.rows)]
        for k, template in enumerate(index.templates):
            size = len(index.ids[k])
            starts, share = _places(ids, w, row, index.ids[k], anchors[k])
            for s, x in zip(starts.tolist(), share.tolist()):
                good = x == 1 if template.phrase else x >= MATCHED and all(_holds(ids, s, size, q) for q in index.keys[k])
                if good:
                    r = int(row[s])
                    at = s - int(w.bounds[r])
                    found[r].append((template.label, at, at + size, x, template.phrase))
        base = [[m for m in f if m[4]] for f in found]
        join = lambda ms: ",".join(sorted({m[0] for m in ms}))
        return pa.RecordBatch.from_arrays([
            keys, pa.array(np.diff(w.bounds)), pa.array([len(b) for b in base], pa.int64()),
            pa.array([min((m[1] for m in b), default=None) for b in base], pa.int64()),
            pa.array([max((m[1] for m in b), default=None) for b in base], pa.int64()),
            pa.array([join(b) for b in base]), pa.array([join(f) for f in found]),
            pa.array([max((m[3] for m in f), default=0.0) for f in found], pa.float64()),
            pa.array([[{"label": m[0], "start": m[1], "end": m[2], "share": m[3]} for m in sorted(f)] for f in found], match_type),
        ], names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    def run(batches):
        for batch in batches:
            for t in _lowered(batch.column(1)):
                yield one_slice(t, batch.column(0).slice(t.first, t.rows))

    schema = docs.select(F.col(f"`{key}`")).schema
    for c in ("n_words", "n_base", "first_word", "last_word"):
        schema = schema.add(c, "long")
    schema = schema.add("base_labels", "string").add("labels", "string").add("score", "double")
    schema = schema.add("matches", StructType.fromDDL("m array<struct<label:string,start:bigint,end:bigint,share:double>>")["m"].dataType)
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)
