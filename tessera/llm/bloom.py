"""A blocked Bloom filter of bounded size, broadcast to thin out rows before an exact join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the broadcast filter, about 40 bytes each; each is a block of 256 bits.
MAX_BLOCKS = 1 << 18
#: Bits of the filter for each entry, as long as MAX_BLOCKS allows.
BITS_PER_ENTRY = 16
WORDS = [f"_word{i}" for i in range(8)]


def _with_slots(df: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """Add the block of ``key`` and the bit that it sets in each word of the block."""
    df = df.withColumns({"_block": F.pmod(F.xxhash64(key), F.lit(n_blocks)), "_bits": F.xxhash64(F.col(key), F.lit(1))})
    return df.withColumns({w: F.expr(f"shiftleft(1, cast(shiftrightunsigned(_bits, {5 * i}) & 31 as int))") for i, w in enumerate(WORDS)}).drop("_bits")


def build(entries: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """The filter: ``_block`` and its eight words, each the union of its entries' bits."""
    return _with_slots(entries.select(key), key, n_blocks).groupBy("_block").agg(*(F.bit_or(w).alias(f"_set{w}") for w in WORDS))


def tested(df: DataFrame, entries: DataFrame, key: str, hit: str = "_hit") -> DataFrame:
    """``df`` with boolean ``hit``: false only where ``key`` is null or not in ``entries``.

    With more entries than the filter has room for more rows pass; none is lost.
    """
    n, n_blocks = entries.count(), 1
    while n_blocks < MAX_BLOCKS and n_blocks * 256 < n * BITS_PER_ENTRY:
        n_blocks *= 2
    own = [F.col(f"`{c}`") for c in df.columns]
    joined = _with_slots(df, key, n_blocks).join(F.broadcast(build(entries, key, n_blocks)), "_block", "left")
    passes = F.col(key).isNotNull()
    for w in WORDS:
        passes = passes & (F.col(f"_set{w}").bitwiseAND(F.col(w)) == F.col(w))
    return joined.select(*own, F.coalesce(passes, F.lit(False)).alias(hit))
