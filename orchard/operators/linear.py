"""Least squares with one intercept per group, for any number of groups.

One dummy column per group gives the same coefficients as subtracting each group's means first
(the within transformation).  So the fit needs, per group, its count, sums and products: one
aggregation, whatever the number of groups.  Only the p x p matrix over all groups reaches the
driver; a group's intercept is its mean of y less the coefficients times its means of x.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

FALLBACK = "other"


def fit_within(train: DataFrame, group: str, xs: Sequence[str], y: str) -> tuple[list[float], DataFrame]:
    """(coefficients, intercepts(group_key, intercept, n)).

    Rows with a NULL in ``group``, ``xs`` or ``y`` teach nothing.  Columns that do not vary within
    any group get the coefficient 0 (the least-norm solution); a table without rows gives zeros
    and no intercepts."""
    cols = [*xs, y]
    rows = train.select(F.col(group).alias("group_key"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).dropna()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(xs) + 1)]
    stats = rows.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(cols))],
        *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs])
    total = stats.agg(*[F.sum(F.col("n") * F.col(f"c{i}_{j}")).alias(f"c{i}_{j}") for i, j in pairs]).first()
    p = len(xs)
    cov = np.zeros((p + 1, p + 1))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = total[f"c{i}_{j}"] or 0.0
    # scaled to unit variance, so that the rank test does not depend on units
    scale = np.sqrt(np.diag(cov)[:p])
    live = scale > 0
    beta = np.zeros(p)
    if live.any():
        s = scale[live]
        beta[live] = np.linalg.lstsq(cov[:p, :p][np.ix_(live, live)] / np.outer(s, s), cov[:p, p][live] / s, rcond=1e-12)[0] / s
    intercept = F.col(f"m{p}")
    for i, b in enumerate(beta):
        intercept = intercept - F.lit(float(b)) * F.col(f"m{i}")
    return [float(b) for b in beta], stats.select("group_key", intercept.alias("intercept"), "n")


def fit_or_load(spark: SparkSession, path: str, fit: Callable[[], tuple[list[float], DataFrame]]) -> tuple[list[float], DataFrame]:
    """The model stored at ``path``, or ``fit()`` stored there.  The coefficients are written last: a
    broken write is no model."""
    from orchard.sources.files import path_exists
    if not path_exists(spark, f"{path}/coefficients/_SUCCESS"):
        beta, intercepts = fit()
        intercepts.write.mode("overwrite").parquet(f"{path}/intercepts")
        spark.createDataFrame(list(enumerate(beta)), "no int, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")
    beta = [r["value"] for r in spark.read.parquet(f"{path}/coefficients").orderBy("no").collect()]
    return beta, spark.read.parquet(f"{path}/intercepts")


def predict_within(rows: DataFrame, group: str, xs: Sequence[str], model: tuple[list[float], DataFrame],
                   out: str = "prediction", fallback: str = FALLBACK) -> DataFrame:
    """``rows`` with ``out``.  A group that the fit has not seen takes the intercept of the ``fallback``
    group, and if that is unknown too, the mean intercept of the training rows.  A NULL in ``xs`` or a model without rows gives NULL."""
    beta, intercepts = model
    known = intercepts.select(F.col("group_key").alias("_g"), F.col("intercept").alias("_a"))
    other = intercepts.agg(F.coalesce(F.max(F.when(F.col("group_key") == fallback, F.col("intercept"))),
                                      F.try_divide(F.sum(F.col("n") * F.col("intercept")), F.sum("n")))).first()[0]
    value = F.coalesce(F.col("_a"), F.lit(other).cast(DoubleType()))
    for b, x in zip(beta, xs, strict=True):
        value = value + F.lit(b) * F.col(x).cast("double")
    return rows.join(known, F.col(group) == F.col("_g"), "left").withColumn(out, value).drop("_g", "_a")
