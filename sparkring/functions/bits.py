"""Bits of packed words, most significant first: position p of a word of width b is bit b - 1 - p."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block(c: Column | str, width: int) -> Column:
    """Which block an index falls in (indices are not negative)."""
    return F.expr(f"{c} div {width}") if isinstance(c, str) else F.floor(c / width)


def bit_of(index: str, width: int) -> Column:
    """A word with the bit of this index set."""
    return F.expr(f"shiftleft(1L, cast({width - 1} - {index} % {width} as int))")


def test_bit(word: str, position: str, width: int) -> Column:
    """Whether the bit at a position is set."""
    return F.expr(f"(shiftrightunsigned({word}, cast({width - 1} - {position} as int)) & 1L) = 1L")


def popcount(word: Column | str) -> Column:
    return F.bit_count(word)


def halves(word: str) -> tuple[Column, Column]:
    """High and low 32 bits of a 64-bit word, both not negative."""
    return F.expr(f"shiftrightunsigned({word}, 32)"), F.expr(f"{word} & 4294967295L")


def show_bits(word: str, width: int) -> Column:
    return F.lpad(F.bin(word), width, "0")
