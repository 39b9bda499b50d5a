"""Least squares with an intercept per group equals the one with dummy columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orchard.operators.linear import fit_or_load, fit_within, predict_within

SCHEMA = "place string, a double, b double, price double, group_key int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)


def dummies(rows):
    places = sorted({r[0] for r in rows})
    x = np.array([[r[1], r[2], *[float(r[0] == p) for p in places]] for r in rows])
    return places, np.linalg.lstsq(x, np.array([r[3] for r in rows]), rcond=None)[0]


def data(n=400, places=50, seed=4):
    rnd = random.Random(seed)
    level = {f"p{i}": rnd.uniform(10, 90) for i in range(places)}
    out = []
    for _ in range(n):
        p, a, b = rnd.choice(list(level)), rnd.uniform(300, 3000), float(rnd.randint(1, 6))
        out.append((p, a, b, level[p] + 0.04 * a - 3 * b + rnd.gauss(0, 2)))
    return out


def test_equals_dummy_columns(spark):
    rows = data()
    beta, intercepts = fit_within(frame(spark, rows), "place", ["a", "b"], "price")
    places, want = dummies(rows)
    assert beta == pytest.approx(want[:2], rel=1e-8)
    got = {r.group_key: r.intercept for r in intercepts.collect()}
    assert got == pytest.approx(dict(zip(places, want[2:])), rel=1e-8)


def test_more_groups_than_a_solver_takes(spark):
    rows = [(f"g{i % 6000}", float(i % 97), float(i % 7), i % 6000 + 2.0 * (i % 97) - (i % 7)) for i in range(18_000)]
    beta, intercepts = fit_within(frame(spark, rows), "place", ["a", "b"], "price")
    assert beta == pytest.approx([2.0, -1.0], abs=1e-9) and intercepts.count() == 6000


def test_unknown_groups_nulls_and_clashing_names(spark):
    rows = [("x", 1.0, 1.0, 11.0), ("x", 2.0, 1.0, 12.0), ("other", 1.0, 1.0, 21.0), ("other", 3.0, 1.0, 23.0),
            (None, 1.0, 1.0, 99.0), ("x", None, 1.0, 99.0), ("x", 5.0, 1.0, None)]
    model = fit_within(frame(spark, rows), "place", ["a", "b"], "price")
    assert model[0] == pytest.approx([1.0, 0.0])  # b does not vary within a group
    asked = frame(spark, [("x", 4.0, 9.0, 0.0), ("new", 4.0, 9.0, 0.0), (None, 4.0, 9.0, 0.0), ("x", None, 9.0, 0.0)])
    got = [(r.place, r.a, r.prediction) for r in predict_within(asked, "place", ["a", "b"], model).collect()]
    assert sorted(got, key=str) == sorted([("x", 4.0, pytest.approx(14.0)), ("new", 4.0, pytest.approx(24.0)),
                                           (None, 4.0, pytest.approx(24.0)), ("x", None, None)], key=lambda t: str((t[0], t[1], getattr(t[2], "expected", t[2]))))
    mean = predict_within(asked.limit(1).withColumn("place", F.lit("new")), "place", ["a", "b"], model, fallback="none").first()
    assert mean.prediction == pytest.approx(4.0 + (2 * 10 + 2 * 20) / 4)


def test_empty_table(spark):
    model = fit_within(frame(spark, []), "place", ["a", "b"], "price")
    assert model[0] == [0.0, 0.0]
    assert predict_within(frame(spark, [("x", 1.0, 1.0, 0.0)]), "place", ["a", "b"], model).first().prediction is None


def test_stored_model_is_reused(spark, tmp_path):
    df, calls = frame(spark, data(60, 3)), []
    fit = lambda: calls.append(1) or fit_within(df, "place", ["a", "b"], "price")
    first = fit_or_load(spark, f"{tmp_path}/m", fit)
    assert fit_or_load(spark, f"{tmp_path}/m", fit)[0] == first[0] and len(calls) == 1
