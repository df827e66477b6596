"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

A pre-token is a string of symbols: one per byte, the last one marked as the end of a word. For each of its prefixes exactly
one token can be the last one of the prefix's encoding. It is found among the tokens that end there, which an automaton over
all tokens reports: token t of length n is the last one at position i if t and the last token at position i - n are
compatible, that is, if no merge across their border comes before the merges that make the two. The full encoding is read
off by following these last tokens backwards. Tokens that the merges can never make are left out.

Texts are normalised and cut into pre-tokens first, by array operations where all code points are below U+0250, else
normalised by the library. Each process keeps what distinct pre-tokens gave it, up to a bounded number.

Defined cases: a null or empty text has no ids and decodes to an empty text. Repeated rows are encoded once each; null keys
are kept; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from saccadia.llm import arrays, pretokens, tokenizer_files

TOKENIZER = "word_bpe_49k.json"
#: Code points below this one, but for the exception, are normalised the same way by Python and by the library.
PLAIN = re.compile("[\x00-įı-ɏ]*")
NEVER = 1 << 60
#: What a process remembers at most: compatible and incompatible pairs, and pre-tokens.
MOST_PAIRS, MOST_PRETOKENS = 250_000, 150_000


@functools.cache
def _byte_symbols() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """Encodes pre-tokens with the merges of one vocabulary file."""

    def __init__(self, name: str):
        model = tokenizer_files.contents(name)["model"]
        if model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{name}: only plain merges over bytes are supported")
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.specials = tokenizer_files.specials(name)
        names = {i: t for t, i in self.vocab.items()}
        names.update({i: s.decode() for s, i in self.specials.items()})
        self.names = names
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((left, right), rank)
        self.automaton = ahocorasick.Automaton()
        plain = set(_byte_symbols())
        symbol_of = {b: s for b, s in enumerate(_byte_symbols())}
        self.symbols = [symbol_of[b] for b in range(256)]
        self.closed = {s: chr(0xE000 + b) for b, s in symbol_of.items()}  # a symbol that ends a word, as one letter
        for token, i in self.vocab.items():
            letters = self._letters(token, plain)
            if letters and i not in self.specials.values():
                self.automaton.add_word(letters, (i, len(letters), token))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.splits: dict[str, tuple[str, str, int] | None] = {}
        self.whole: dict[str, bool] = {}
        self.spines: dict[tuple[str, int], list[tuple[str, int]]] = {}

    def _letters(self, token: str, plain: set[str]) -> str:
        """The token as a string with one letter per symbol."""
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            if not body or not set(body) <= plain:
                return ""
            return body[:-1] + self.closed[body[-1]]
        return token if set(token) <= plain else ""

    def _split(self, token: str) -> tuple[str, str, int] | None:
        """The two parts that the last merge of a token's own encoding joins, and the highest rank used; None if there is none."""
        if token not in self.splits:
            body = token[: len(token) - len(self.end)] if self.end and token.endswith(self.end) else token
            parts = list(body)
            if body is not token:
                parts[-1] += self.end
            last, most = None, -1
            while len(parts) > 1:
                rank, at = min((self.ranks.get(pair, NEVER), k) for k, pair in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                last, most = (parts[at], parts[at + 1]), max(most, rank)
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = (*last, most) if last and len(parts) == 1 else None
            self.whole[token] = len(parts) == 1
        return self.splits[token]

    def makeable(self, token: str) -> bool:
        """Whether encoding the token's own string gives the token."""
        self._split(token)
        return self.whole[token]

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts that in turn lie at one end of the token while it is made, each with the rank that ends it."""
        if (token, side) not in self.spines:
            split = self._split(token)
            if split is None:
                spine = [(token, NEVER)]
            else:
                inner = self._spine(split[side], side)
                spine = [*inner[:-1], (inner[-1][0], split[2]), (token, NEVER)]
            self.spines[token, side] = spine
        return self.spines[token, side]

    def compatible(self, a: str, b: str) -> bool:
        """Whether no merge across the border comes before the merges that make the two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            left, right = self._spine(a, 1), self._spine(b, 0)
            i = j = 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.ranks.get((x, y), NEVER)
                if across != NEVER and across < x_ends and across <= y_ends:  # of equal ranks the leftmost pair goes first
                    known = False
                    break
                if x_ends == y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = known
        return known

    def encode(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        letters = "".join([self.symbols[b] for b in raw])
        if self.end:
            letters = letters[:-1] + self.closed[letters[-1]]
        pairs, whole = self.pairs, self.whole
        last: list[tuple[int, int, str] | None] = [None] * len(letters)  # by the prefix's last place
        done = -1
        for stop, match in self.automaton.iter(letters):  # at one place the longest token comes first
            if stop == done:
                continue
            _, size, token = match
            if size <= stop:
                before = last[stop - size]
                if before is None:
                    continue
                known = pairs.get((before[2], token))
                if not (self.compatible(before[2], token) if known is None else known):
                    continue
            known = whole.get(token)
            if self.makeable(token) if known is None else known:
                last[stop] = match
                done = stop
        ids, stop = [], len(letters) - 1
        while stop >= 0:
            i, size, _ = last[stop]
            ids.append(i)
            stop -= size
        return ids[::-1]


@functools.cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


@functools.cache
def vocabulary(name: str) -> pretokens.Vocabulary:
    """Ids of pre-tokens, and the decoded text of each: its tokens with blanks between."""
    e = encoder(name)
    return pretokens.Vocabulary(
        lambda found: [e.encode(raw) for raw in found], lambda ids: " ".join([e.names[i] for i in ids]), pa.binary(), MOST_PRETOKENS
    )


def normalised(column: pa.Array, name: str) -> pa.Array:
    """Texts as the file's normaliser makes them; special strings inside stay as they are."""
    if tokenizer_files.contents(name)["normalizer"] is None:
        return column
    rule = tokenizer_files.library(name).normalizer
    marks = [s.decode() for s in tokenizer_files.specials(name)]
    split = re.compile("(" + "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True)) + ")") if marks else None

    def one(text: str | None) -> str:
        if not text:
            return ""
        parts = split.split(text) if split and any(m in text for m in marks) else [text]
        return "".join([
            p if k % 2 else (p.lower() if PLAIN.fullmatch(p) else rule.normalize_str(p)) for k, p in enumerate(parts)
        ])

    return pa.array([one(x) for x in column.to_pylist()], pa.large_string())


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``key``, ``ids``, ``decoded``, the text that the ids give back, and ``ids_u32``, the ids as little-endian 32-bit numbers."""
    def run(batches):
        special = tokenizer_files.specials(tokenizer)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                for t in arrays.texts(normalised(part.column(1), tokenizer)):
                    yield _encode_slice(t, part.column(0).slice(t.first, t.rows), special)

    def _encode_slice(t, keys, special):
        p = pretokens.pieces(t, pretokens.WORD_LEVEL, special)
        known = vocabulary(tokenizer)
        entry = known.lookup(t, p)
        flat, starts, lengths = known.arrays()
        ids = flat[arrays.expand(starts[entry], lengths[entry])]
        stops = np.concatenate([[0], np.cumsum(arrays.sums(lengths[entry], p.bounds))])
        labels, entries, bounds = known.labels, entry.tolist(), p.bounds.tolist()
        decoded = [" ".join([labels[j] for j in entries[a:b]]) for a, b in zip(bounds, bounds[1:])]
        lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids.astype(np.int64), pa.int32()))
        packed = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((4 * stops).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
        return pa.RecordBatch.from_arrays([keys, lists, pa.array(decoded, pa.string()), packed], names=[key, "ids", "decoded", "ids_u32"])

    if tokenizer_files.contents(tokenizer)["decoder"] is not None:
        raise ValueError(f"{tokenizer}: only files whose decoder is blanks between tokens are supported")
    schema = docs.select(F.col(f"`{key}`")).schema.add("ids", ArrayType(IntegerType())).add("decoded", "string").add("ids_u32", "binary")
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens`` and the SHA-256 of the ids as little-endian 32-bit numbers and of the decoded text.

    Spark's own functions: a second step in Python would take a second process for each task, and as processes are
    reused for either step, each of them would come to hold the vocabulary and its memory.
    """
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("ids_u32", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
