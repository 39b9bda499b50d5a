"""Batch fuzz tests: column helpers against small pure-Python definitions
on a few hundred random inputs (one Spark job each)."""

import math
import random
import statistics

from pyspark.sql import functions as F

from orchard.functions.parse import range_or_number
from orchard.functions.text import after_first, before_first, part_from_right
from orchard.operators.stats import fixed_point_mean_std


def _parsename(s, n):
    if s is None:
        return None
    parts = s.replace(",", ".").split(".")
    if len(parts) > 4 or len(parts) < n:
        return None
    p = parts[-n]
    return p if p != "" else None


def test_address_parts_fuzz(spark):
    rnd = random.Random(1)
    vals = [None] + ["".join(rnd.choice("ab ,.") for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    s = F.col("s")
    rows = df.select("s", before_first(s).alias("b"), after_first(s).alias("a"),
                     *[part_from_right(s, n).alias(f"p{n}") for n in (1, 2, 3)]).collect()
    for r in rows:
        v = r.s
        if v is None:
            assert (r.b, r.a, r.p1, r.p2, r.p3) == (None,) * 5
            continue
        i = v.find(",")
        assert r.b == (v[:i] if i >= 0 else None)
        assert r.a == v[i + 1:]
        assert (r.p1, r.p2, r.p3) == tuple(_parsename(v, n) for n in (1, 2, 3))


def _range_or_number(x):
    def num(t):
        try:
            return float(t.strip())
        except ValueError:
            return None
    if x is None:
        return None
    toks = x.split("-")
    if len(toks) == 2:
        a, b = num(toks[0]), num(toks[1])
        return None if a is None or b is None else (a + b) / 2
    return num(x)


def test_range_or_number_fuzz(spark):
    rnd = random.Random(2)
    vals = ["".join(rnd.choice("0123456789 .-a") for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    vals = [v for v in vals if "inf" not in v and "nan" not in v]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    for r in df.select("s", range_or_number(F.col("s")).alias("x")).collect():
        want = _range_or_number(r.s)
        assert (r.x is None and want is None) or (r.x is not None and want is not None and math.isclose(r.x, want)), r.s


def test_fixed_point_mean_std_fuzz(spark):
    rnd = random.Random(3)
    groups = {g: [round(rnd.uniform(-1, 1), 4) for _ in range(rnd.randint(1, 60))] for g in range(12)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double")
    got = {r.g: (r.mean_v, r.std_v) for r in df.groupBy("g").agg(*fixed_point_mean_std(F.col("v"), 4, "v")).collect()}
    for g, vs in groups.items():
        mean, std = got[g]
        assert math.isclose(mean, statistics.fmean(vs), rel_tol=1e-12, abs_tol=1e-12)
        if len(vs) > 1:
            assert math.isclose(std, statistics.stdev(vs), rel_tol=1e-9, abs_tol=1e-12)
        else:
            assert std is None
