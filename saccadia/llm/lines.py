"""Removal of boilerplate lines by how far they spread over sites, with built-in functions only.

For each line (white space at its ends does not count; lines of fewer than ``min_chars`` characters are left alone) three
HyperLogLog sketches are built and merged by aggregation: of the sites it is on, of the texts that hold it, and of their
origins. A text's origin is its longest word, the greatest of several: it survives small edits, so copies and near copies of
a text count as one origin, whereas unrelated pages that carry the same notice have one each. A line is boilerplate if it is on
at least ``min_sites`` sites, has as many origins, and at least half as many origins as texts; lines that only spread because
their text was copied stay, for a later stage to deal with the copies.

That rule (``origin_of="text"``) is the one of the SQL check. Its origin may be a word of the line itself: a notice whose own word
is the longest of every page gives all its pages one origin and stays. With ``origin_of="rest"`` the longest word is taken of
what stands around the notices. Lines on ``min_sites`` sites are shared lines; a text of which they are less than half the
characters has the longest word of its other lines as origin, and all texts that are shared lines for the greater part (copies
and near copies, of any number) are one origin together. A shared line with ``min_sites`` origins is boilerplate; the number
of texts plays no part, as longest words of a finite vocabulary run out while texts grow.

A line with an estimate within ``margin`` of a threshold is counted exactly instead: its distinct sites, texts and origins.
All counts are combined on the side that reads them before rows are sent on, so a line that is on every page is no burden
to one task. Lines are known by two 64-bit hashes.

Defined cases: a null text has no lines and becomes empty; an empty one stays. A null site is none. Repeated rows are
cleaned each; they count once, as their texts and sites are equal. Other columns, of whatever name, are carried along. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccadia.llm import storage

MIN_SITES = 5
MIN_CHARS = 12
MARGIN = 0.2
#: 2**12 registers: estimates are within 1.6 % of the truth in two cases of three.
REGISTERS = 12
SPACE = "[\\x20\\x09-\\x0D]"
ENDS = " \t\r\f\x0b"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(ENDS))


def _known_by(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _pieces(text: Column) -> Column:
    return F.split(text, "\n", -1)


def origin(text: Column) -> Column:
    """The longest word of a text, the greatest of several."""
    sized = F.transform(F.split(text, SPACE, -1), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))
    return F.array_max(sized)["w"]


def numbered(docs: DataFrame, site: str, text: str) -> DataFrame:
    """Each row's number, text, site and, as a struct, all its columns but the text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    return storage.numbered(
        docs, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.col(f"`{site}`").cast("string").alias("site"), F.struct(*rest).alias("rest"),
    )


def line_rows(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line that may be boilerplate: (row, site, whole, origin, a, b)."""
    long_enough = F.filter(F.transform(_pieces(F.col("text")), _trimmed), lambda x: F.char_length(x) >= min_chars)
    per_text = rows.select(
        "row", "site", F.xxhash64("text").alias("whole"), F.xxhash64(origin(F.col("text"))).alias("origin"),
        F.array_distinct(F.transform(long_enough, _known_by)).alias("known"),
    )
    return per_text.select("row", "site", "whole", "origin", F.explode("known").alias("k")).select("row", "site", "whole", "origin", "k.a", "k.b")


def _by_text(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per text: (row, site, lines), a struct for each line: what it is known by, its characters, its longest word."""
    def of(line: Column) -> Column:
        words = F.transform(F.split(line, SPACE, -1), lambda w: F.struct(F.char_length(w).alias("n"), F.xxhash64(w).alias("w")))
        known = F.when(F.char_length(line) >= min_chars, _known_by(line))
        return F.struct(known.alias("known"), F.char_length(line).alias("chars"), F.array_max(words).alias("longest"))

    return rows.select("row", "site", F.transform(F.transform(_pieces(F.col("text")), _trimmed), of).alias("lines"))


def _many(rows: DataFrame, column: str, least: int, margin: float) -> DataFrame:
    """The lines (a, b) with at least ``least`` distinct values of a column; estimates near the threshold are counted."""
    sized = rows.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(REGISTERS))).alias("n"))
    near = sized.filter((F.col("n") >= (1 - margin) * least) & (F.col("n") < (1 + margin) * least)).select("a", "b")
    exact = rows.join(near, ["a", "b"]).groupBy("a", "b").agg(F.count_distinct(column).alias("n")).filter(F.col("n") >= least)
    return sized.filter(F.col("n") >= (1 + margin) * least).select("a", "b").union(exact.select("a", "b"))


def _hits_around(rows: DataFrame, min_sites: int, min_chars: int, margin: float) -> DataFrame:
    """(row, a, b) of lines that are boilerplate by what stands around them."""
    texts = storage.written(_by_text(rows, min_chars), "lines")
    known = F.array_distinct(F.filter(F.col("lines.known"), lambda k: k.isNotNull()))
    lines = texts.select("row", "site", F.explode(known).alias("k")).select("row", "site", "k.a", "k.b")
    shared = storage.written(lines.join(_many(lines, "site", min_sites, margin), ["a", "b"]).select("row", "a", "b"), "shared")
    of_row = shared.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("shared"))
    is_shared = lambda x: x["known"].isNotNull() & F.array_contains(F.col("shared"), x["known"])
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    parts = texts.join(of_row, "row").select(
        "shared", chars(F.col("lines")).alias("all"), F.filter("lines", lambda x: ~F.coalesce(is_shared(x), F.lit(False))).alias("rest")
    )
    # texts that are shared lines for the greater part are one origin, whatever their longest word
    origin_ = F.when(2 * chars(F.col("rest")) > F.col("all"), F.array_max(F.transform("rest", lambda x: x["longest"]))["w"]).otherwise(F.lit(0))
    found = parts.select(origin_.alias("origin"), F.explode("shared").alias("k")).select("origin", "k.a", "k.b")
    return shared.join(_many(found, "origin", min_sites, margin), ["a", "b"])


def _boilerplate(sites: Column, texts: Column, origins: Column, min_sites: int) -> Column:
    return (sites >= min_sites) & (origins >= min_sites) & (2 * origins >= texts)


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """The lines (a, b) that are boilerplate."""
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(REGISTERS))
    spread = lines.groupBy("a", "b").agg(sketch("site").alias("s"), sketch("whole").alias("t"), sketch("origin").alias("o"))
    size = F.hll_sketch_estimate
    spread = spread.select("a", "b", size("s").alias("sites"), size("t").alias("texts"), size("o").alias("origins"))
    sites, texts, origins = F.col("sites"), F.col("texts"), F.col("origins")
    loose = (sites >= (1 - margin) * min_sites) & (origins >= (1 - margin) * min_sites) & (2 * (1 + margin) * origins >= texts)
    sure = (sites >= (1 + margin) * min_sites) & (origins >= (1 + margin) * min_sites) & (2 * (1 - margin) * origins >= texts)
    near = spread.filter(loose & ~sure).select("a", "b")
    exact = lines.join(near, ["a", "b"]).groupBy("a", "b").agg(
        F.count_distinct("site").alias("sites"), F.count_distinct("whole").alias("texts"), F.count_distinct("origin").alias("origins")
    )
    exact = exact.filter(_boilerplate(sites, texts, origins, min_sites))
    return spread.filter(sure).select("a", "b").union(exact.select("a", "b"))


def clean(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS,
          margin: float = MARGIN, origin_of: str = "text") -> DataFrame:
    """The struct ``rest`` (all columns but the text) with ``n_lines`` that are not blank, ``n_removed`` and ``kept_text``."""
    rows = numbered(storage.stable(docs), site, text)
    if origin_of == "rest":
        hits = _hits_around(rows, min_sites, min_chars, margin)
    else:
        # read three times below; its rows are small and hold no text
        lines = storage.written(line_rows(rows, min_chars), "lines")
        hits = lines.join(boilerplate(lines, min_sites, margin), ["a", "b"])
    removed = hits.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("removed"))
    joined = rows.select("row", "text", "rest").join(removed, "row", "left")
    stays = lambda x: (F.char_length(_trimmed(x)) < min_chars) | ~F.array_contains(F.col("removed"), _known_by(_trimmed(x)))
    pieces = _pieces(F.col("text"))
    kept = joined.select(
        "rest", "text", "removed", F.size(F.filter(pieces, lambda x: F.char_length(_trimmed(x)) > 0)).cast("long").alias("n_lines"),
        F.when(F.col("removed").isNotNull(), F.filter(pieces, stays)).alias("kept"), F.size(pieces).alias("n_pieces"),
    )
    return kept.select(
        "rest", "n_lines", F.when(F.col("removed").isNull(), 0).otherwise(F.col("n_pieces") - F.size("kept")).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"),
    )


def clean_documents(docs: DataFrame, site: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text: the same rows and columns."""
    cleaned = clean(docs, site, text, **options)
    return cleaned.select(*[(F.col("kept_text") if c == text else F.col("rest").getField(c)).alias(c) for c in docs.columns])
