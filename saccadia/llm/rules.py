"""Quality rules as a ledger of failure bits.

Each text is measured once and every rule is evaluated once; the ledger keeps the measurements and one bit per failed
rule. A policy is a named set of rules: applying one is a bitwise AND, and so is asking what another would have kept.

Defined cases: a null or empty text has no words and fails ``few_words``. Repeated rows are judged each on its own.
Other columns of the input are passed through by ``measure``; if one has a measurement's name, the measurement wins.
An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia.llm import arrays

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "top_word_count"]
REPEAT_WINDOW = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition on the measurements; ``bit`` never changes once a ledger has been written."""

    bit: int
    name: str
    fails: str


RULES = [
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > word_chars"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "shouting", "2 * n_shouts > n_words"),
    Rule(5, "one_word", "n_words >= 20 AND 100 * top_word_count > 25 * n_words"),
    Rule(6, "word_length", "n_words > 0 AND (word_chars > 20 * n_words OR word_chars < 2 * n_words)"),
]
BASE = ("few_words", "repeated_windows")
#: Versions of the policy; the newest is what ``apply_policy`` takes.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines", "shouting", "one_word"),
}
NEWEST = "v2"


def bits(names, rules: list[Rule] = RULES) -> int:
    """The bitmask of the named rules."""
    return sum(1 << r.bit for r in rules if r.name in names)


def _measure_slice(t: arrays.Texts) -> dict[str, np.ndarray]:
    w = arrays.words(t)
    row = w.row_of()
    out = {"n_words": np.diff(w.bounds)}
    letters = ~arrays.SPACE[t.data] & ((t.data & 0xC0) != 0x80)
    out["word_chars"] = arrays.sums(letters, t.bounds)
    out["n_symbols"] = arrays.sums(SYMBOLS[t.data], t.bounds)
    # lines: the pieces between line feeds, those with a word
    newline = np.flatnonzero(t.data == 10)
    line_starts = np.unique(np.concatenate([t.bounds[:-1], newline + 1]))
    line_starts = line_starts[line_starts < len(t.data)]
    row_end = t.bounds[np.searchsorted(t.bounds, line_starts, "right")]
    line_ends = np.minimum(np.append(newline, len(t.data))[np.searchsorted(newline, line_starts)], row_end)
    with_word = np.searchsorted(w.starts, line_ends) > np.searchsorted(w.starts, line_starts)
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_bounds = np.searchsorted(line_starts, t.bounds)
    line_row = np.repeat(np.arange(t.rows), np.diff(line_bounds))
    a, b = (arrays.span_hashes(t.data, line_starts, line_ends, k) for k in (0, 1))
    out["n_lines"] = np.diff(line_bounds)
    out["n_dup_lines"] = arrays.sums(arrays.repeats(line_row, a, b)[0], line_bounds)
    # words in windows that occur more than once
    h = [arrays.span_hashes(t.data, w.starts, w.ends, k) for k in (0, 1)]
    at = np.flatnonzero(arrays.gram_starts(w.bounds, REPEAT_WINDOW))
    grams = [arrays.gram_hashes(x, REPEAT_WINDOW)[at] if len(at) else x[:0] for x in h]
    often = at[arrays.repeats(row[at], *grams)[1]]
    out["n_repeat_words"] = arrays.sums(arrays.covered(len(h[0]), often, often + REPEAT_WINDOW), w.bounds)
    shout = (t.data[w.ends - 1] == 33) if len(w.ends) else np.zeros(0, bool)
    out["n_shouts"] = arrays.sums(shout, w.bounds)
    out["top_word_count"] = _top_counts(row, h[0], t.rows)
    return out


def _top_counts(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """How often each row's most frequent word occurs."""
    top = np.zeros(rows, np.int64)
    if len(h):
        key = arrays.mix(h ^ arrays.mix(row.astype(np.uint64) + np.uint64(1)))
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        np.maximum.at(top, row[first], count)
    return top


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All other columns of ``docs`` (but those named as a measurement), and the measurements as longs."""
    keep = [c for c in docs.columns if c != text and c not in MEASURES]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            kept = [batch.column(k) for k in range(len(keep))]
            for t in arrays.texts(batch.column(len(keep))):
                m = _measure_slice(t)
                cols = [c.slice(t.first, t.rows) for c in kept] + [pa.array(m[c], pa.int64()) for c in MEASURES]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *MEASURES])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for c in MEASURES:
        schema = schema.add(c, "long")
    return chosen.mapInArrow(run, schema)


def ledger(measured: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The measurements with ``failure_bits``: bit b is set if the rule with that bit failed."""
    total = F.lit(0).cast("long")
    for r in rules:
        total = total.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failure_bits", total)


def apply_policy(entries: DataFrame, policy: str = NEWEST, rules: list[Rule] = RULES) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's version."""
    failed = lambda names: F.col("failure_bits").bitwiseAND(F.lit(bits(names, rules)).cast("long")) != 0
    return entries.withColumns({
        "base_failed": failed(BASE), "kept": ~(failed(BASE) | failed(POLICIES[policy])), "policy": F.lit(policy),
    })


def ablation(entries: DataFrame, policy: str = NEWEST, rules: list[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: texts that fail it, that fail it alone, and that the policy would keep without it.

    Texts are first counted by their failure bits within the policy, so what follows has at most 2**rules rows.
    """
    spark = entries.sparkSession
    mask = bits(POLICIES[policy], rules)
    counts = entries.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    chosen = spark.createDataFrame([(r.name, 1 << r.bit) for r in rules if r.name in POLICIES[policy]], "rule string, mask long")
    pairs = counts.withColumn("rule_masks", F.array(*[F.lit(1 << r.bit).cast("long") for r in rules if r.name in POLICIES[policy]]))
    pairs = pairs.select("b", "n", F.explode("rule_masks").alias("mask"))
    b, m = F.col("b"), F.col("mask")
    summed = pairs.groupBy("mask").agg(
        F.sum(F.when(b.bitwiseAND(m) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(b == m, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(b.bitwiseAND(F.bitwise_not(m)) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
    return chosen.join(F.broadcast(summed), "mask", "left").select("rule", "n_failed", "n_only", "kept_without")


def keep_good(docs: DataFrame, policy: str = NEWEST) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns."""
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("text"))
    # the row travels as one column beside its text, so no name can clash with a measurement
    judged = apply_policy(ledger(measure(tagged)), policy)
    return judged.filter("kept").select("doc.*")
