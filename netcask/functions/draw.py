"""Draws from a hash of the index that any SQL engine can repeat: 32-bit multiplications, shifts and exclusive ors in long arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import U32

# Odd numbers under 2^31, so that a product with a 32-bit number fits a long.
A, B, C = 0x2C1B3C6D, 0x297A2D39, 0x1B56C4E9


def draw(index: Column, seed: int = 0) -> Column:
    """A number from 0 to 2^32 - 1 for each index and seed."""
    h = (F.pmod(index.cast("long"), F.lit(1 << 32)) * A + seed % (1 << 32)).bitwiseAND(U32)
    for shift, factor in ((15, B), (12, C), (17, A)):
        h = (h.bitwiseXOR(F.shiftright(h, shift)) * factor).bitwiseAND(U32)
    return h.bitwiseXOR(F.shiftright(h, 16))


def draw_sql(index: str, seed: int = 0) -> str:
    """The same as SQL."""
    h = f"((({index}) % 4294967296 * {A} + {seed % (1 << 32)}) & {U32})"
    for shift, factor in ((15, B), (12, C), (17, A)):
        h = f"((xor({h}, {h} >> {shift}) * {factor}) & {U32})"
    return f"xor({h}, {h} >> 16)"


def unit(index: Column, seed: int = 0) -> Column:
    """From 0 to under 1."""
    return draw(index, seed) / float(1 << 32)
