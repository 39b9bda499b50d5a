"""Parsing helpers: numbers in text, ranges, leading integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(s: Column) -> Column:
    """Text to double, NULL when it is not a number (surrounding blanks ok)."""
    return F.trim(s).try_cast("double")


def is_number(s: Column) -> Column:
    return to_double(s).isNotNull()


def range_or_number(s: Column) -> Column:
    """``'a - b'`` gives the mean of a and b, a number gives itself, anything
    else NULL (also a two-part text whose parts are not numbers)."""
    parts = F.split(s, "-", -1)
    two = F.size(parts) == 2
    mean = (to_double(parts.getItem(0)) + to_double(parts.getItem(1))) / 2
    return F.when(two, mean).otherwise(to_double(s))


def leading_int(s: Column, sep: str = " ") -> Column:
    """Integer before the first ``sep`` (``'2 BHK'`` -> 2), NULL if none."""
    return F.split(s, sep, -1).getItem(0).try_cast("int")


def first_year(s: Column) -> Column:
    """First run of four digits as an int, NULL if there is none."""
    return F.nullif(F.regexp_extract(s, r"([0-9]{4})", 1), F.lit("")).try_cast("int")
