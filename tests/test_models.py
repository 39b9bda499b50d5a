"""Learners written as DataFrame aggregations: exactness where defined
(kNN against brute force) and sanity on a separable problem."""

import math
import random

from pyspark.sql import functions as F

from orchard.operators.models import (adaboost_accuracy, extra_trees_accuracy, gaussian_nb_params,
                                      hist_boost_accuracy, knn_classify)


def _brute_knn(train, test, k):
    out = {}
    for tid, tx, ty in test:
        near = sorted(((math.sqrt(sum((a - b) * (a - b) for a, b in zip(tx, x))), i, y) for i, x, y in train))[:k]
        votes = {}
        for _, _, y in near:
            votes[y] = votes.get(y, 0) + 1
        out[tid] = min(votes, key=lambda y: (-votes[y], y))
    return out


def test_knn_matches_brute_force_with_duplicates_and_crowding(spark):
    rnd = random.Random(5)
    pts = []
    for i in range(400):
        if i % 4 == 0:
            x = (1.0, 1.0, 1.0)                                   # a heavily duplicated point
        elif i % 4 == 1:
            x = (rnd.gauss(0, 0.05), rnd.gauss(0, 0.05), rnd.gauss(0, 0.05))   # a crowded cluster
        else:
            x = (rnd.uniform(-50, 50), rnd.uniform(-5, 5), rnd.uniform(0, 1000))
        pts.append((i, x, int(rnd.random() < 0.3 + 0.4 * (x[0] > 0))))
    train = [p for p in pts if p[0] % 5]
    test = [p for p in pts if p[0] % 5 == 0]
    schema = "id long, a double, b double, c double, y int"
    tdf = spark.createDataFrame([(i, *x, y) for i, x, y in train], schema)
    qdf = spark.createDataFrame([(i, *x, y) for i, x, y in test], schema)
    want = _brute_knn(train, test, 5)
    for crowd in (8.0, 0.5):     # base grid only / multi-resolution grids
        got = {r.id: r.prediction for r in knn_classify(tdf, qdf, "id", ["a", "b", "c"], "y", k=5,
                                                         crowd_factor=crowd).collect()}
        assert got == want


def test_knn_outside_the_train_box_and_with_missing_features(spark):
    rnd = random.Random(8)
    train = [(i, (float(i % 10), rnd.uniform(0, 3), rnd.uniform(0, 1), rnd.uniform(0, 9)), i % 3) for i in range(120)]
    test = [(1000 + j, x, 0) for j, x in enumerate([(19.9, 1.0, 0.5, 4.0), (100.0, 50.0, -7.0, 4.0), (-1e6, 1.0, 1e4, 3.0),
                                                    (5.0, 1.5, 0.2, -30.0), (4.0, 2.0, 0.9, 8.0)])]
    schema = "id long, a double, b double, c double, e double, y int"
    blanks = [(900, None, 1.0, 1.0, 1.0, 1), (901, float("nan"), 1.0, 1.0, 1.0, 1)]
    tdf = spark.createDataFrame([(i, *x, y) for i, x, y in train] + blanks, schema)
    qdf = spark.createDataFrame([(i, *x, y) for i, x, y in test] + [(2000, 1.0, None, 1.0, 1.0, 0)], schema)
    for k in (5, 500):
        got = {r.id: r.prediction for r in knn_classify(tdf, qdf, "id", ["a", "b", "c", "e"], "y", k=k).collect()}
        assert got == {**_brute_knn(train, test, k), 2000: None}
    empty = knn_classify(tdf.limit(0), qdf, "id", ["a", "b", "c", "e"], "y").collect()
    assert len(empty) == 6 and all(r.prediction is None for r in empty)


def _separable(spark, n=600):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        a, b = rnd.uniform(-3, 3), rnd.uniform(-3, 3)
        y = int(a + 0.5 * b > 0.2)
        rows.append((i, a, b, rnd.uniform(0, 1), y, "test" if i % 5 == 0 else "train"))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, split string")


def test_tree_learners_beat_majority(spark):
    df = _separable(spark)
    majority = df.where("split = 'test'").agg(F.avg("y")).collect()[0][0]
    base = max(majority, 1 - majority)
    feats = ["a", "b", "c"]
    assert adaboost_accuracy(df, feats, "y", rounds=20) > base + 0.1
    assert hist_boost_accuracy(df, feats, "y", "depthwise", rounds=10, max_depth=3) > base + 0.1
    assert hist_boost_accuracy(df, feats, "y", "leafwise", rounds=8, num_leaves=6) > base + 0.1
    assert extra_trees_accuracy(df, feats, "y", n_trees=20, max_depth=6) > base + 0.1


def test_gaussian_nb_params(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0), (1, 14.0)], "y int, x double")
    p = gaussian_nb_params(df, ["x"], "y")
    assert [q["label"] for q in p] == [0, 1] and [q["prior"] for q in p] == [0.5, 0.5]
    eps = 1e-9 * 27.5             # population variance of all x
    assert abs(p[0]["var"]["x"] - (1.0 + eps)) < 1e-12 and p[1]["mean"]["x"] == 12.0
