"""Seeded draws and digests shared by splits, samples and resampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = ":"

# Odd multipliers and shifts of the integer mixing, kept below 2^31
# so that no product leaves a long.
WORD_MASK = (1 << 31) - 1
MULTIPLIERS = (73244475, 668265261)
SHIFTS = (15, 13)


def seeded_md5(seed: int | str, *parts: Column) -> Column:
    cols = [F.lit(str(seed)), *[p.cast("string") for p in parts]]
    return F.md5(F.concat_ws(SEPARATOR, *cols))


def hex_to_long(hexed: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("bigint")


def mix_word(word: Column) -> Column:
    """A 31-bit word scrambled by products and shifts, all in long arithmetic."""
    for factor, shift in zip(MULTIPLIERS, SHIFTS):
        word = (word * F.lit(factor)).bitwiseAND(F.lit(WORD_MASK))
        word = word.bitwiseXOR(F.shiftright(word, shift))
    return word


def seed_word(key: Column) -> Column:
    """31 bits of the digest of a key."""
    return hex_to_long(F.md5(key)).bitwiseAND(F.lit(WORD_MASK))


def draw(seed: Column | str, replicate: Column, slot: Column, n: Column) -> Column:
    """Index in [0, n) for one slot of one replicate."""
    seed_col = F.lit(seed) if isinstance(seed, str) else seed
    key = F.concat_ws(SEPARATOR, seed_col, replicate.cast("string"), slot.cast("string"))
    return F.pmod(hex_to_long(F.md5(key)), n)


def row_digest(*cols: Column) -> Column:
    """SHA-256 over length-prefixed values, so field borders cannot shift."""
    parts = []
    for c in cols:
        text = F.coalesce(c.cast("string"), F.lit("\u0000"))
        parts += [F.length(text).cast("string"), text]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)
