"""String helpers for address splitting and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def before_first(s: Column, sep: str = ",") -> Column:
    """Text before the first ``sep``; NULL when ``sep`` does not occur
    (where the original expression would fail on a negative length)."""
    return F.when(F.instr(s, sep) > 0, F.substring_index(s, sep, 1))


def after_first(s: Column, sep: str = ",") -> Column:
    """Text after the first ``sep`` (leading blanks kept); the whole text when
    ``sep`` does not occur."""
    return s.substr(F.instr(s, sep) + 1, F.length(s) + 1)


def part_from_right(s: Column, n: int, sep: str = ",", max_parts: int = 4) -> Column:
    """n-th part from the right after turning ``sep`` into dots and splitting
    on dots (object-name parsing): NULL when there are more than
    ``max_parts`` parts, fewer than n, or the part is empty."""
    parts = F.split(F.replace(s, F.lit(sep), F.lit(".")), r"\.", -1)
    k = F.size(parts)
    return F.when((k <= max_parts) & (k >= n), F.nullif(F.try_element_at(parts, F.lit(-n)), F.lit("")))


def strip_ws(s: Column) -> Column:
    """Strip all leading/trailing whitespace (not only blanks)."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def recode(c: Column, mapping: dict, keep_other: bool = True) -> Column:
    """CASE recode; unmatched values stay (``keep_other``) or become NULL."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(c) if keep_other else expr
