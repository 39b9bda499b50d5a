"""Repeatable sampling and splitting.

Every row gets a hash ``md5('<seed>:<key>')``; splits and samples are
decided by that hash alone, so results do not depend on partitioning, task
retries or the number of executors (``randomSplit`` and ``sample`` do), and
an SQL engine with ``md5`` can reproduce them.

``exact_sample`` takes, per group, exactly ``n`` rows with the smallest hash.
It never sorts a whole group: the hash prefix (4 hex digits, 65,536 buckets,
uniform by construction) is counted per group with a map-side-combined
aggregate; buckets below the n-th row are taken whole and the boundary
bucket is cut at the remaining count.  Rows are numbered only within their
bucket, so no window partition exceeds about 1/65,536 of a group.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_HEX = 4


def row_hash(key: str | Column, seed: int | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def hash_split(df: DataFrame, key: str, seed: int = 42, test_fraction: float = 0.2,
               out: str = "split") -> DataFrame:
    """Mark about ``test_fraction`` of the rows as 'test', the rest 'train'."""
    threshold = format(int(test_fraction * 16 ** 8), "08x")
    h8 = F.substring(row_hash(key, seed), 1, 8)
    return df.withColumn(out, F.when(h8 < F.lit(threshold), "test").otherwise("train"))


def exact_sample(df: DataFrame, key: str, need: DataFrame | int, seed: int | str = 42,
                 groups: Sequence[str] = ()) -> DataFrame:
    """Exactly ``need`` rows per group (all rows if the group is smaller),
    those with the smallest ``(md5(seed:key), key)``.  ``need`` is an int or a
    DataFrame ``(groups..., _need)``."""
    from orchard.operators.joins import checked_broadcast
    g = list(groups)
    h = row_hash(key, seed)
    keyed = df.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, PREFIX_HEX))
    counts = keyed.groupBy(*g, "_p").agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(need, int):
        counts = counts.withColumn("_need", F.lit(need).cast("bigint"))
    else:
        # per-group needs join on the group; a single need is a scalar subquery
        counts = counts.join(need, g) if g else counts.withColumn("_need", need.select("_need").scalar())
    before = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy("_p") \
        .rowsBetween(Window.unboundedPreceding, -1)
    plan = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .where(F.col("_before") < F.col("_need"))
            .select(*g, "_p", (F.col("_need") - F.col("_before")).alias("_take"),
                    (F.col("_before") + F.col("_n") <= F.col("_need")).alias("_whole")))
    # one selection pass: the input is read once more (after the counts),
    # only rows of chosen buckets are shuffled, and each window partition is
    # one hash bucket of one group (about 1/65,536 of the group)
    # the plan holds at most 65,536 rows a group, so that the input stays where it is
    picked = keyed.join(checked_broadcast(plan) if g else F.broadcast(plan), g + ["_p"])
    w = Window.partitionBy(*g, "_p").orderBy("_h", key)
    return (picked.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_whole") | (F.col("_rn") <= F.col("_take")))
            .drop("_h", "_p", "_take", "_whole", "_rn"))


def sample_thresholds(df: DataFrame, key: str, need: DataFrame | int, seed: int | str = 42,
                      groups: Sequence[str] = ()) -> DataFrame:
    """Per group, the largest ``(hash, key)`` inside the exact sample: a row
    is in the sample iff its ``(hash, key)`` is at most this threshold."""
    g = list(groups)
    s = exact_sample(df.select(*g, key), key, need, seed, g)
    thr = F.max(F.struct(row_hash(key, seed).alias("h"), F.col(key).alias("k"))).alias("_thr")
    return s.groupBy(*g).agg(thr)


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2,
                     seed: int = 2, out: str = "split") -> DataFrame:
    """Per label, exactly ``ceil(test_fraction * n_label)`` rows go to 'test'
    (smallest hashes), the rest to 'train'.  The rows are marked by comparing
    with one threshold per label (a tiny table, broadcast after a size
    check), so the large input is neither joined with itself nor shuffled by
    its heavily skewed label."""
    from orchard.operators.joins import checked_broadcast
    need = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) * F.lit(test_fraction)).cast("bigint").alias("_need"))
    thr = checked_broadcast(sample_thresholds(df, key, need, seed, [label]))
    mine = F.struct(row_hash(key, seed).alias("h"), F.col(key).alias("k"))
    return (df.join(thr, label, "left")
            .withColumn(out, F.when(mine <= F.col("_thr"), "test").otherwise("train")).drop("_thr"))


def poisson_thresholds(max_k: int = 12) -> list[str]:
    """Hex thresholds of the Poisson(1) CDF on 8-hex-digit hash prefixes:
    a prefix below threshold k (and not below k-1) means weight k."""
    out, cdf, p = [], 0.0, math.exp(-1.0)
    for k in range(max_k):
        cdf += p
        out.append(format(min(int(cdf * 16 ** 8), 16 ** 8 - 1), "08x"))
        p = p / (k + 1)
    return out


def poisson_weight(key: Column, replicate: Column, seed: int | str) -> Column:
    """Deterministic Poisson(1) bootstrap weight of a row in a replicate,
    from ``md5('seed:key:replicate')`` (no RNG state, same on every retry)."""
    h8 = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"),
                                    replicate.cast("string"))), 1, 8)
    thresholds = poisson_thresholds()
    expr = F.when(h8 < F.lit(thresholds[0]), F.lit(0))
    for k, t in enumerate(thresholds[1:], start=1):
        expr = expr.when(h8 < F.lit(t), F.lit(k))
    return expr.otherwise(F.lit(len(thresholds)))


def bootstrap_mean_ci(df: DataFrame, key: str, groups: Sequence[str], value: str, decimals: int,
                      replicates: int = 200, seed: int = 11, level: float = 0.95) -> DataFrame:
    """Percentile bootstrap interval of the mean per group with Poisson(1)
    row weights (online bootstrap): every row is expanded to ``replicates``
    weighted copies, weighted sums per (group, replicate) are exact
    fixed-point sums, and the interval is taken over the replicate means.
    Work is linear in rows x replicates; nothing is collected."""
    g = list(groups)
    scale = 10 ** decimals
    rep = df.select(*g, F.col(key).alias("_key"), F.round(F.col(value) * scale).cast("decimal(38,0)").alias("_x"),
                    F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep"))
    rep = rep.withColumn("_w", poisson_weight(F.col("_key"), F.col("_rep"), seed).cast("decimal(38,0)"))
    means = rep.groupBy(*g, "_rep").agg((F.sum(F.col("_w") * F.col("_x")).cast("double") /
                                         (F.sum("_w").cast("double") * scale)).alias("_m"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    q = means.where(F.col("_m").isNotNull()).groupBy(*g).agg(F.percentile("_m", [lo, hi]).alias("_q"))
    return q.select(*g, F.round(F.col("_q")[0], 6).alias("ci_low"), F.round(F.col("_q")[1], 6).alias("ci_high"))
