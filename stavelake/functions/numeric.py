"""Small numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num/den with 0.0 for an empty or zero denominator."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def beat_distance(onb: Column) -> Column:
    """Distance of an in-bar onset to the nearest whole beat."""
    frac = onb - F.floor(onb)
    return F.least(frac, F.lit(1.0) - frac)


def off_beat(onb: Column) -> Column:
    return beat_distance(onb) > 0.08


def cv(sd: Column, mean: Column) -> Column:
    return F.when(mean > 0, sd / mean).otherwise(F.lit(0.0))


def plogp(n: Column, total: Column) -> Column:
    """One entropy term, natural log."""
    p = n / total
    return F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def half_even(x: Column) -> Column:
    """Round an already scaled value to a whole number, ties to even."""
    return F.rint(x)


def round_clean(x: Column, digits: int) -> Column:
    """Round for reporting; the inner step removes summation noise so exact ties round one way."""
    return F.round(F.round(x, 9), digits)


def chance(salt: str, *parts: Column) -> Column:
    """A uniform number in [0, 1) fixed by the key columns and the salt.

    Hash-based, so an edit does not depend on partitioning or on the run.
    """
    text = F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)
