"""Relational building blocks: top-k, rank filters, group extremes, shares,
frequency tables and reshaping.

All of them are compositions of DataFrame operators, chosen so that hot
groups never end up whole in one task:

* per-group extremes are aggregates (``min_by``/``max_by``), which combine
  map-side before the shuffle;
* rank filters (``rank() <= k``) are planned by Catalyst with a partial
  ``WindowGroupLimit`` below the exchange, so only ``k`` rows (plus ties)
  per group and input partition are shuffled;
* grand totals are scalar subqueries, evaluated once and inlined.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k (``TOP k ... ORDER BY``).  Planned as
    ``TakeOrderedAndProject``: each partition keeps k rows, the driver merges
    at most k x partitions rows.  ``order`` must end in a unique key so that
    ties break the same way in every run."""
    return df.orderBy(*order).limit(k)


def rank_at_most(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int,
                 rank_col: str = "rnk", fn=F.rank) -> DataFrame:
    """Rows whose rank within ``partition`` is at most k (ties kept with
    ``rank``).  Written as ``<= k`` so the optimizer inserts the partial
    window group limit before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank_col, fn().over(w)).where(F.col(rank_col) <= k)


def group_argmax(df: DataFrame, keys: Sequence[str], value: str, tie: str,
                 take: dict[str, Column]) -> DataFrame:
    """For each group, the row with the largest ``value``; among equal values
    the smallest ``tie``.  One aggregate with map-side combine: no window,
    no join, and a hot group is reduced on every mapper first."""
    picked = F.min_by(F.struct(*[c.alias(n) for n, c in take.items()]),
                      F.struct((-F.col(value)).alias("_neg"), F.col(tie).alias("_tie")))
    return df.groupBy(*keys).agg(picked.alias("_best")).select(*keys, "_best.*")


def grand_total(df: DataFrame, expr: Column) -> Column:
    """A scalar subquery over ``df``: computed once, usable in any other
    DataFrame's expressions (no join, no single-partition window)."""
    return df.select(expr).scalar()


def share_pct(df: DataFrame, value: str, out: str = "share_pct") -> DataFrame:
    """``100 * value / sum(value)`` where the sum runs over all of ``df``."""
    total = grand_total(df, F.sum(value))
    return df.withColumn(out, F.lit(100.0) * F.col(value) / total)


def frequency(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """``value_counts``: NULL values are left out, counts are bigint."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                 var: str, val: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), var, val)


def keep_existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Select those of ``wanted`` that exist (schema metadata only)."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


SMALL_DISTINCT = 1_000_000


def ranked_distinct(df: DataFrame, col: str, out: str = "_rank") -> tuple[DataFrame, int]:
    """(value, rank) for the distinct non-NULL values of ``col`` (rank 1 for
    the smallest) and the number of distinct values.  The distinct set (a
    partially aggregated ``distinct``) is cached and counted first: up to
    ``SMALL_DISTINCT`` values it is ranked in one ordered pass over that
    small set; beyond, it is range-partitioned and checkpointed (fixing which
    range each value fell in), numbered within each range and shifted by the
    sizes of the ranges before it, so no task sorts the whole set."""
    spark = df.sparkSession
    d = df.select(col).where(F.col(col).isNotNull()).distinct().cache()
    n_distinct = d.count()
    if n_distinct <= SMALL_DISTINCT:
        return d.select(col, F.dense_rank().over(Window.orderBy(col)).alias(out)), n_distinct
    from orchard.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = d.repartitionByRange(n, col).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    sizes = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range partition: bounded by the partition count
    offsets = sizes.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    within = Window.partitionBy("_pid").orderBy(col)
    ranks = (r.withColumn("_rn", F.row_number().over(within)).join(F.broadcast(offsets), "_pid")
             .select(col, (F.col("_rn") + F.col("_off")).alias(out)))
    return ranks, n_distinct


def global_dense_rank(df: DataFrame, col: str, out: str = "_rank") -> DataFrame:
    return ranked_distinct(df, col, out)[0]


def category_codes(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Index of each value in the sorted distinct values of its column
    (0-based); NULL becomes -1.  One HyperLogLog pass estimates every
    column's distinct count (the estimate only picks the plan, both plans
    are exact): small value sets are ranked in one ordered pass and
    broadcast, large ones take the range-partitioned ranking."""
    from orchard.operators.joins import BROADCAST_MAX_ROWS
    est = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).collect()[0]
    out = df
    for c in cols:
        if est[c] <= 0.9 * min(SMALL_DISTINCT, BROADCAST_MAX_ROWS):
            d = df.select(c).where(F.col(c).isNotNull()).distinct()
            ranks = F.broadcast(d.select(c, F.dense_rank().over(Window.orderBy(c)).alias("_r")))
        else:
            ranks, n = ranked_distinct(df, c, "_r")
            ranks = F.broadcast(ranks) if n <= BROADCAST_MAX_ROWS else ranks
        out = (out.join(ranks, c, "left")
               .withColumn(c + suffix, F.coalesce(F.col("_r") - 1, F.lit(-1)).cast("int")).drop("_r"))
    return out


def attach_group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Per-group aggregates put back on every row of the group.

    Same result as ``agg(...).over(Window.partitionBy(keys))`` but the stats
    are a map-side-combined aggregate (one row per group) joined back, so a
    hot group is never buffered whole in one task.  The stats are broadcast
    after a row-count check (the big side is then not shuffled at all);
    beyond the limit the join shuffles and AQE splits skewed partitions."""
    from orchard.operators.joins import checked_broadcast
    stats = checked_broadcast(df.groupBy(*keys).agg(*aggs))
    return df.join(stats, list(keys), "left")
