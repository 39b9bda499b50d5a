"""Base table scans.

Every scan is a plain ``spark.read.parquet``: Catalyst prunes the columns a
query does not reference and pushes filters into the Parquet reader, so the
helpers never select or filter eagerly themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over the cluster's default parallelism when its
    scan yields fewer partitions than that (a small file with few row
    groups feeding CPU-heavy per-row work).  Large inputs already split
    into enough partitions pass through untouched: no shuffle at scale.
    The partition count comes from planning, not from a job."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
