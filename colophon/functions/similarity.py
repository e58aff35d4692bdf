"""Similarity of short strings: the share of characters in a longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: Column, b: Column) -> Column:
    """Characters in a longest common subsequence: the rows of the usual table, folded one after the other."""
    width = F.length(b)
    first = F.array_repeat(F.lit(0), width + 1)

    def row(previous: Column, letter: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            same = F.substring(b, j, F.lit(1)) == letter
            value = F.when(same, F.get(previous, j - 1) + 1).otherwise(F.greatest(F.get(done, j - 1), F.get(previous, j)))
            return F.concat(done, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), width), F.array(F.lit(0)), cell)

    filled = F.aggregate(F.split(a, ""), first, row)
    return F.when((F.length(a) == 0) | (width == 0), 0).otherwise(F.element_at(filled, -1))


def ratio(a: Column, b: Column) -> Column:
    """Twice the common subsequence over both lengths, 0 to 100; two empty strings are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / F.greatest(total, F.lit(1)))


def lcs_of(a: str, b: str) -> int:
    """The same length with a row of the table as the bits of one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    whole = (1 << len(b)) - 1
    open_bits = whole
    for c in a:
        hit = open_bits & where.get(c, 0)
        open_bits = (open_bits + hit | open_bits - hit) & whole
    return len(b) - open_bits.bit_count()


@F.pandas_udf(DoubleType())
def fast_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` over Arrow batches, for many or long strings."""
    return pd.Series([100.0 if not x and not y else 200.0 * lcs_of(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype=float)


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Can the ratio reach the threshold at all, by the lengths?"""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.lit(200.0) * low >= F.lit(float(threshold)) * (low + high)
