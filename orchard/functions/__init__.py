"""Column-expression helpers: pure ``Column -> Column`` functions that stay
inside whole-stage code generation (no Python UDFs)."""


def flat_literal(values, dtype: str = "int"):
    """A flat numeric array as ONE literal: the values joined into a string,
    split and cast in Spark.  The expression is constant-folded into a single
    array literal, instead of one literal node per element."""
    from pyspark.sql import functions as F
    text = ",".join(repr(float(v)) if dtype == "double" else str(int(v)) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{dtype}>")


def json_literal(value, schema: str):
    """A nested literal (e.g. ``array<array<double>>``) as one JSON string
    parsed by ``from_json``: constant-folded into a single literal."""
    import json

    from pyspark.sql import functions as F
    return F.from_json(F.lit(json.dumps(value)), schema)
