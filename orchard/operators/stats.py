"""Profiling and statistics operators.

Everything is one or two aggregation passes with map-side combine; results
are long tables (one row per column or column pair) produced by
``unpivot`` rather than driver-side loops.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns (schema metadata only, no job)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, null_count, non_null_count) in one pass."""
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in cols])
    return (wide.unpivot(["_rows"], cols, "column_name", "nulls")
            .select("column_name", F.coalesce("nulls", F.lit(0)).alias("null_count"),
                    (F.col("_rows") - F.coalesce("nulls", F.lit(0))).alias("non_null_count")))


def missing_percent(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, pct_missing): share of NULLs in percent, rounded half
    to even as Python's ``round`` does."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return (wide.unpivot([], cols, "column_name", "share")
            .select("column_name", F.bround(F.col("share") * 100, 0).alias("pct_missing")))


def describe(df: DataFrame, value: str, groups: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max.
    A first pass measures the group sizes; when every group is small the
    exact ``percentile`` aggregate runs with the moments in one pass,
    otherwise the quartiles come from the histogram-refinement selection, so
    a group holding most rows is never gathered in one task."""
    from orchard.operators.quantiles import FINAL_MAX, quantile_columns
    g = list(groups) or ["_g0"]
    base = df if groups else df.withColumn("_g0", F.lit(0))
    v = F.col(value)
    r = lambda c: F.round(c, digits)
    moments = [F.count(v).alias("count"), r(F.avg(v)).alias("mean"), r(F.stddev_samp(v)).alias("std"),
               F.min(v).alias("min"), F.max(v).alias("max")]
    sizes = base.groupBy(*g).agg(F.count(v).alias("_n"))
    if (sizes.agg(F.max("_n")).collect()[0][0] or 0) <= FINAL_MAX:
        # all groups small: quartiles by the exact in-memory aggregate, one pass
        one = base.groupBy(*g).agg(*moments, F.percentile(v.cast("double"), [0.25, 0.5, 0.75]).alias("_q"))
        out = one.select(*g, "count", "mean", "std", "min", r(F.col("_q")[0]).alias("q25"),
                         r(F.col("_q")[1]).alias("q50"), r(F.col("_q")[2]).alias("q75"), "max")
    else:
        q = quantile_columns(base, value, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], g)
        out = base.groupBy(*g).agg(*moments).join(q, g, "left").select(
            *g, "count", "mean", "std", "min", r(F.col("q25")).alias("q25"), r(F.col("q50")).alias("q50"),
            r(F.col("q75")).alias("q75"), "max")
    return out if groups else out.drop("_g0")


def corr_pairs(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson matrix in long form (col_a, col_b, corr), all n^2 cells.
    Each pair skips the rows where either side is NULL (pairwise complete),
    all pairs in a single aggregation pass."""
    pairs = list(combinations_with_replacement(cols, 2))
    names = [f"{a}\u0001{b}" for a, b in pairs]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(n)
                    for (a, b), n in zip(pairs, names)])
    # both orientations of every cell from the one aggregate row
    cells = [(n, f"{a}\u0001{b}") for (a, b), n in zip(pairs, names)]
    cells += [(n, f"{b}\u0001{a}") for (a, b), n in zip(pairs, names) if a != b]
    long = (wide.select(*[F.col(src).alias(dst) for src, dst in cells])
            .unpivot([], [dst for _, dst in cells], "_pair", "corr"))
    parts = F.split("_pair", "\u0001")
    return long.select(parts[0].alias("col_a"), parts[1].alias("col_b"), F.round("corr", digits).alias("corr"))


def box_stats(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Box-plot numbers per column: quartiles, IQR, whiskers (most extreme
    values within 1.5 IQR of the box) and the outlier count."""
    from orchard.operators.quantiles import quantile_columns
    long = df.unpivot([], list(cols), "column_name", "value").withColumn("value", F.col("value").cast("double"))
    q = quantile_columns(long, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"], ["column_name"])
    # one row per input column: bounded by the schema width
    j = long.join(F.broadcast(q), "column_name")
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("value")
    r = lambda c: F.round(c, digits)
    return j.groupBy("column_name").agg(
        r(F.first("q1")).alias("q1"), r(F.first("median")).alias("median"), r(F.first("q3")).alias("q3"),
        r(F.first("q3") - F.first("q1")).alias("iqr"),
        F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.count(F.when((v < lo) | (v > hi), 1)).alias("n_outliers"))


def regression_line(df: DataFrame, y: str, x: str, digits: int = 6) -> DataFrame:
    """Least-squares line of y on x over rows where both are present."""
    yy, xx = F.col(y).cast("double"), F.col(x).cast("double")
    return df.agg(F.round(F.regr_slope(yy, xx), digits).alias("slope"),
                  F.round(F.regr_intercept(yy, xx), digits).alias("intercept"),
                  F.round(F.regr_r2(yy, xx), digits).alias("r2"),
                  F.regr_count(yy, xx).alias("n"))


def fixed_point_mean_std(v, decimals: int, prefix: str):
    """Mean and sample std of values that carry ``decimals`` decimal places,
    from exact integer sums (``decimal(38,0)``): the result does not depend
    on the order in which partitions are added up."""
    scale = 10 ** decimals
    x = F.round(v * scale).cast("decimal(38,0)")
    n = F.count(v).cast("decimal(38,0)")
    s1, s2 = F.sum(x), F.sum(x * x)
    mean = s1.cast("double") / (n.cast("double") * scale)
    var_num = (n * s2 - s1 * s1).cast("double")
    std = F.sqrt(var_num / (n * (n - 1)).cast("double")) / scale
    return [mean.alias(f"mean_{prefix}"), F.when(n > 1, std).alias(f"std_{prefix}")]


def fixed_corr(x, y, decimals: int = 4):
    """Pearson correlation (an aggregate) of values that carry ``decimals`` decimal places, over the
    rows where both are known, from exact integer sums; NULL where either does not vary."""
    scale, both = 10 ** decimals, x.isNotNull() & y.isNotNull()
    a, b = (F.when(both, F.round(v * scale)).cast("decimal(38,0)") for v in (x, y))
    n = F.count(F.when(both, 1)).cast("decimal(38,0)")
    var_a, var_b = ((n * F.sum(v * v) - F.sum(v) * F.sum(v)).cast("double") for v in (a, b))
    cov = (n * F.sum(a * b) - F.sum(a) * F.sum(b)).cast("double")
    return F.when((var_a > 0) & (var_b > 0), cov / (F.sqrt(var_a) * F.sqrt(var_b)))
