"""orchard: everyday analytics pipelines written as Spark DataFrame / SQL /
Structured Streaming code.

Layout
------
sources/    table and file scans, derived input views, sinks
functions/  column-expression helpers (pure ``Column -> Column``)
operators/  reusable ``DataFrame -> DataFrame`` operators
plans/      one module per analytics workflow; each exposes QUERIES
            (Spark) and ORACLE (DuckDB SQL) dictionaries
streaming/  Structured Streaming jobs
"""

__version__ = "0.1.0"
