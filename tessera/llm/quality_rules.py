"""Rule bitmask ledger.

Each rule is evaluated once for each document.  The ledger stores what was
measured and one bit for each failed rule; policies are masks over those bits, so
a new policy or an ablation reads the ledger and never the texts.

Null and empty texts have no words and fail ``few_words``.  Repeated rows and
repeated ids give a row each.  Further columns are carried along except those
named like a column of the ledger, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes as tb
from tessera.llm.shared import Carried

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")

#: Bit, name and SQL condition of failure.  A bit is never reused for another rule.
RULES = (
    (0, "few_words", "n_words < 10"),
    (1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    (2, "symbols", "100 * n_symbols > 20 * n_words"),
    (3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 15 * n_words"),
    (6, "shouting", "100 * n_upper > 60 * word_chars"),
)

#: Versioned policies: the rules whose failure drops a document.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "web-2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "shouting"),
}

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def mask(policy: str) -> int:
    return sum(1 << bit for bit, name, _ in RULES if name in POLICIES[policy])


def measured(text: pa.Array, hasher: tb.Hasher) -> dict[str, np.ndarray]:
    """The measurements of each text, in the order of ``MEASURES``."""
    data, offsets = tb.text_bytes(text)
    starts, ends, words = tb.spans_of(~tb.ASCII_SPACE[data], offsets)
    numbers = tb.numbered(data, starts, ends, hasher)
    first = tb.windows(words, 5)
    in_window = np.stack([tb.owners(words)[first], *(numbers[first + k] for k in range(5))], 1)
    repeats = tb.covered(first[tb.repeated(tb.numbered_rows(in_window))], 5, len(numbers))

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_text = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
    line_ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    full = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends, line_text = line_starts[full], line_ends[full], line_text[full]
    lines = np.searchsorted(line_text, np.arange(len(offsets)))
    line_of_text = tb.numbered_rows(np.stack([line_text, tb.numbered(data, line_starts, line_ends, hasher)], 1))

    return {
        "n_words": np.diff(words),
        "word_chars": tb.per_text(~tb.ASCII_SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": tb.per_text(SYMBOLS[data], offsets),
        "n_lines": np.diff(lines),
        "n_dup_lines": tb.per_text(tb.later(line_of_text), lines),
        "n_repeat_words": tb.per_text(repeats, words),
        "n_upper": tb.per_text((data >= 65) & (data <= 90), offsets),
    }


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements of its column ``text``."""
    carried, seed = Carried(docs, ", ".join(f"{m} bigint" for m in MEASURES)), tb.draw()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tb.Hasher(seed)
        for batch in tb.slices(batches, "text"):
            values = measured(batch.column("text"), hasher)
            yield carried.batch(batch, [pa.array(values[m], pa.int64()) for m in MEASURES])

    return carried.unpack(carried.map(carried.pack(docs), run))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``, the bits of all failed rules, for each document."""
    bits: Column = F.lit(0).cast("bigint")
    for bit, _, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs.drop("failed")).withColumn("failed", bits)


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """Add ``kept``: no rule of the policy failed."""
    return entries.drop("kept").withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablate(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents failing it, and documents kept if only that rule went.

    One aggregation over the ledger's bits; a row for each rule.
    """
    whole, used = mask(policy), [(bit, name) for bit, name, _ in RULES if name in POLICIES[policy]]
    failed = F.col("failed")
    counts = entries.agg(
        F.count_if(failed.bitwiseAND(F.lit(whole)) == 0).alias("kept"),
        *(F.count_if(failed.bitwiseAND(F.lit(1 << bit)) != 0).alias(f"fail_{bit}") for bit, _ in used),
        *(F.count_if(failed.bitwiseAND(F.lit(whole)) == (1 << bit)).alias(f"only_{bit}") for bit, _ in used),
    )
    rows = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"fail_{bit}").alias("n_failed"), F.col(f"only_{bit}").alias("n_only"), (F.col("kept") + F.col(f"only_{bit}")).alias("n_kept_without")) for bit, name in used))
    return counts.select(F.inline(rows))
