"""Pitch-class sets as 12-bit masks: unions are ``bit_or``, sizes are ``bit_count``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = 0xFFF


def pc_bit(pc: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), pc.cast("int"))


def size(mask: Column) -> Column:
    return F.bit_count(mask)


def rotate_down(mask: Column, by: Column) -> Column:
    """The set seen from pitch class ``by``: member p becomes (p - by) mod 12."""
    by = by.cast("int")
    low = F.call_function("shiftright", mask, by)
    high = F.call_function("shiftleft", mask, F.lit(12) - by)
    return low.bitwiseOR(high).bitwiseAND(F.lit(FULL))


def has(mask: Column, *members: int) -> Column:
    """True when any listed member is in the set."""
    probe = 0
    for m in members:
        probe |= 1 << (m % 12)
    return mask.bitwiseAND(F.lit(probe)) != 0


def contains_all(mask: Column, members) -> Column:
    probe = 0
    for m in members:
        probe |= 1 << (m % 12)
    return mask.bitwiseAND(F.lit(probe)) == probe


def lowest(mask: Column) -> Column:
    """Smallest member of a nonempty set."""
    return F.bit_count(mask.bitwiseAND(-mask) - 1)


def jaccard(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseAND(b)) / F.bit_count(a.bitwiseOR(b))


def pairs_at(mask: Column, interval: int) -> Column:
    """Unordered member pairs whose interval class equals ``interval`` (1..6)."""
    hits = F.bit_count(mask.bitwiseAND(rotate_down(mask, F.lit(interval))))
    return hits / 2 if interval == 6 else hits.cast("double")
