"""Exact quantiles (linear interpolation between order statistics, the
definition of ``percentile`` / ``quantile_cont``) that stay distributed
when one group holds most of the rows.

For every group and probability p the two order statistics around
``p * (n - 1)`` are located by histogram refinement:

1. one pass counts rows per (group, bucket) over [min, max] with a
   map-side-combined aggregate (``BUCKETS`` buckets per group);
2. cumulative counts over that small table say, for every needed rank,
   which bucket holds it and how many rows lie below the bucket;
3. while a target bucket still holds more than ``FINAL_MAX`` rows, its rows
   are bucketed again inside the bucket's range (only those rows are read);
4. the rows of each target bucket are reduced to (value, count) pairs and
   the rank is found by a cumulative sum over the pairs.

No task orders more than ``FINAL_MAX`` distinct values of a group; the
driver sees one number per refinement level.  When a first statistics pass
shows that every group has at most ``FINAL_MAX`` rows, the exact
``percentile`` aggregate (memory bounded by the group size) is used
instead.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16
FINAL_MAX = 200_000
MAX_LEVELS = 4


def _bucket(v: Column, a: Column, b: Column) -> Column:
    idx = F.floor((v - a) / ((b - a) / BUCKETS)).cast("long")
    return F.when(b <= a, F.lit(0).cast("long")).otherwise(F.least(F.greatest(idx, F.lit(0)), F.lit(BUCKETS - 1)))


def _locate(hist: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Join a (keys, _k, _c) histogram with targets (keys, _rank, _below, ...)
    and keep the bucket that holds each target's rank."""
    w = Window.partitionBy(*on).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    h = hist.withColumn("_cum", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    rel = F.col("_rank") - F.col("_below")
    return h.join(targets, on).where((rel >= F.col("_cum")) & (rel < F.col("_cum") + F.col("_c")))


def _narrow(a: Column, b: Column, k: Column):
    width = (b - a) / BUCKETS
    same = b <= a
    new_a = F.when(same, a).otherwise(a + k * width)
    new_b = F.when(same, b).otherwise(F.when(k == BUCKETS - 1, b).otherwise(a + (k + 1) * width))
    return new_a, new_b


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (),
                    out: str = "q") -> DataFrame:
    """(groups..., p, q): the linearly interpolated p-quantile of ``value``
    per group (NULLs skipped; groups without values are absent)."""
    from orchard.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    g = list(groups) or ["_g0"]
    base = df if groups else df.withColumn("_g0", F.lit(0))
    data = base.select(*g, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    stats = data.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"),
                                 F.max("_v").alias("_b")).cache()
    if (stats.agg(F.max("_n")).collect()[0][0] or 0) <= FINAL_MAX:
        # every group is small enough for the exact in-memory aggregate
        exact = data.groupBy(*g).agg(F.percentile("_v", [float(p) for p in probs]).alias("_qs"))
        res = exact.select(*g, F.posexplode("_qs").alias("_pi", out)).select(
            *g, F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_pi") + 1).alias("p"), out)
        return res if groups else res.drop("_g0")
    specs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in ((0, F.floor(pos)), (1, F.ceil(pos))):
            specs.append(F.struct(F.lit(i).alias("_pi"), F.lit(side).alias("_side"),
                                  rank.cast("long").alias("_rank"), (pos - F.floor(pos)).alias("_frac")))
    targets = stats.select(*g, "_a", "_b", F.explode(F.array(*specs)).alias("_t")).select(
        *g, "_t.*", "_a", "_b", F.lit(0).cast("long").alias("_below"))
    tkey = g + ["_pi", "_side"]

    # level 1: one histogram per group, shared by all of its targets
    d1 = data.join(stats.select(*g, "_a", "_b"), g).withColumn("_k", _bucket(F.col("_v"), F.col("_a"), F.col("_b")))
    hist = d1.groupBy(*g, "_k").agg(F.count(F.lit(1)).alias("_c"))
    hit = _locate(hist, targets.drop("_a", "_b"), g).join(stats.select(*g, "_a", "_b"), g)
    na, nb = _narrow(F.col("_a"), F.col("_b"), F.col("_k"))
    hit = hit.select(*tkey, *([] if "_k" in tkey else []), "_k", "_rank", "_frac",
                     (F.col("_below") + F.col("_cum")).alias("_below"), F.col("_c").alias("_count"),
                     na.alias("_a"), nb.alias("_b")).cache()
    region = d1.join(hit.select(*tkey, "_k"), g + ["_k"]).select(*tkey, "_v")

    for _ in range(MAX_LEVELS - 1):
        if (hit.agg(F.max("_count")).collect()[0][0] or 0) <= FINAL_MAX:
            break
        region = region.checkpoint(eager=True)
        rk = region.join(hit.select(*tkey, "_a", "_b"), tkey).withColumn(
            "_k", _bucket(F.col("_v"), F.col("_a"), F.col("_b")))
        hist = rk.groupBy(*tkey, "_k").agg(F.count(F.lit(1)).alias("_c"))
        nxt = _locate(hist, hit.select(*tkey, "_rank", "_frac", "_below", "_a", "_b"), tkey)
        na, nb = _narrow(F.col("_a"), F.col("_b"), F.col("_k"))
        hit = nxt.select(*tkey, "_k", "_rank", "_frac", (F.col("_below") + F.col("_cum")).alias("_below"),
                         F.col("_c").alias("_count"), na.alias("_a"), nb.alias("_b")).cache()
        region = rk.join(hit.select(*tkey, "_k"), tkey + ["_k"]).select(*tkey, "_v")

    # final: (value, count) pairs of each target bucket, cumulative counts
    pairs = region.groupBy(*tkey, "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*tkey).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("_cum", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    rel = F.col("_rank") - F.col("_below")
    picked = (pairs.join(hit.select(*tkey, "_rank", "_frac", "_below"), tkey)
              .where((rel >= F.col("_cum")) & (rel < F.col("_cum") + F.col("_c")))
              .select(*tkey, "_frac", F.col("_v").alias("_x")))
    lo = picked.where(F.col("_side") == 0).select(*g, "_pi", "_frac", F.col("_x").alias("_x0"))
    hi = picked.where(F.col("_side") == 1).select(*g, "_pi", F.col("_x").alias("_x1"))
    p_of = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_pi") + 1)
    res = lo.join(hi, g + ["_pi"]).select(*g, p_of.alias("p"),
                                           (F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.col("_frac")).alias(out))
    return res if groups else res.drop("_g0")


def quantile_columns(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str],
                     groups: Sequence[str] = ()) -> DataFrame:
    """The quantiles as columns: (groups..., names...)."""
    q = exact_quantiles(df, value, probs, groups)
    g = list(groups)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n) for p, n in zip(probs, names)]
    return q.groupBy(*g).agg(*aggs) if g else q.agg(*aggs)
