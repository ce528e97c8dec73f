"""Column expressions over hierarchical item codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_codes(joined: Column) -> Column:
    """``a|b`` as an array, empty parts removed."""
    return F.array_remove(F.split(joined, r"\|"), "")


def digit_prefix(code: Column, n: int) -> Column:
    """First n digits ignoring other characters; null when there are fewer."""
    digits = F.regexp_replace(code, r"\D", "")
    return F.when(F.length(digits) >= n, F.substring(digits, 1, n))


def char_prefix(code: Column, n: int = 4) -> Column:
    return F.when(F.length(code) >= n, F.substring(code, 1, n))


def prefix_set(codes: Column, n: int = 4) -> Column:
    return F.array_distinct(F.array_compact(F.transform(codes, lambda c: char_prefix(c, n))))
