"""Cleaning operators: filling from sibling rows, NULL handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sibling_donors(df: DataFrame, key: str, value: str, order_col: str) -> DataFrame:
    """Per ``key``: the non-NULL ``value`` of the row with the smallest
    ``order_col`` (the donor), and the group size.  One partially-aggregated
    pass; a hot key is reduced on each mapper before the shuffle."""
    v = F.col(value)
    return df.groupBy(key).agg(
        F.min_by(v, F.when(v.isNotNull(), F.col(order_col))).alias("_fill"),
        F.count(F.lit(1)).alias("_group_rows"))


def fill_from_siblings(df: DataFrame, key: str, value: str, order_col: str) -> DataFrame:
    """Update-from-self-join (``ISNULL(a.x, b.x)`` over rows sharing ``key``)
    without the self-join: a NULL ``value`` takes the donor value of its key
    group.  The donor table has one row per key, so the join back never
    fans out; AQE splits a hot key of the big side if needed."""
    from orchard.operators.joins import checked_broadcast
    donors = checked_broadcast(sibling_donors(df, key, value, order_col).select(key, "_fill"))
    return (df.join(donors, key, "left")
            .withColumn(value, F.coalesce(F.col(value), F.col("_fill"))).drop("_fill")
            .select(*df.columns))


def fill_preview(df: DataFrame, key: str, value: str, order_col: str) -> DataFrame:
    """Rows whose ``value`` is NULL and that have at least one sibling, with
    the value they will receive and the number of siblings (the pair count
    of the self-join, reported instead of the pairs themselves)."""
    donors = sibling_donors(df, key, value, order_col)
    return (df.where(F.col(value).isNull()).join(donors, key, "inner")
            .where(F.col("_group_rows") > 1)
            .select(order_col, key, value, F.col("_fill").alias("fill_" + value),
                    (F.col("_group_rows") - 1).alias("sibling_count")))
