"""Source and sink round trips and previews: CSV scan with a declared
schema, overwrite sink, document files read whole, head/tail previews and
row counts of the base tables (the latter lives with the census queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orchard.operators.relational import top_k
from orchard.session import scratch_path
from orchard.sources import views as V
from orchard.sources.files import read_csv, read_documents, write_csv, write_documents
from orchard.sources.tables import table


def q_scan_csv(spark, d):
    rates = V.census_rates(spark, d)
    path = scratch_path(spark, "census-rates-csv")
    write_csv(rates, path)
    return read_csv(spark, path, rates.schema)


def q_sink_overwrite(spark, d):
    counts = V.census_counts(spark, d)
    path = scratch_path(spark, "census-counts-csv")
    write_csv(counts.where(F.col("district") % 2 == 0), path)   # an earlier version
    write_csv(counts, path, mode="overwrite")                     # replaced whole
    return read_csv(spark, path, counts.schema)


def q_scan_documents(spark, d):
    docs = table(spark, d, "documents")
    path = scratch_path(spark, "documents-text")
    write_documents(docs, path, "doc_id", "text")
    got = read_documents(spark, path, "doc_id")
    return got.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                      F.length("text").cast("bigint").alias("n_chars"))


def q_preview_head_tail(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    head = top_k(o, [F.asc("o_orderkey")], 5).withColumn("part", F.lit("head"))
    tail = top_k(o, [F.desc("o_orderkey")], 5).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


QUERIES = {
    "scan_csv": q_scan_csv,
    "sink_overwrite": q_sink_overwrite,
    "scan_documents": q_scan_documents,
    "preview_head_tail": q_preview_head_tail,
}

_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority"
ORACLE = {
    "scan_csv": V.with_views("SELECT * FROM census_rates", "census_rates"),
    "sink_overwrite": V.with_views("SELECT * FROM census_counts", "census_counts"),
    "scan_documents": "SELECT doc_id, text, length(text) AS n_chars FROM documents",
    "preview_head_tail": f"""SELECT * FROM (SELECT {_O}, 'head' AS part FROM orders ORDER BY o_orderkey LIMIT 5) h
        UNION ALL SELECT * FROM (SELECT {_O}, 'tail' AS part FROM orders ORDER BY o_orderkey DESC LIMIT 5) t""",
}
