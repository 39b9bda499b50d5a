"""Row scorers: the default model against a plain count, errors as rows, one load per task."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orchard.operators.scorer import fit_naive_bayes, naive_bayes_loader, score_text, word_bucket
from orchard.operators.stats import fixed_corr

DOCS = [(1, "good good film", 1), (2, "bad film", 0), (3, "Bad, bad plot!", 0), (4, None, 1), (5, "123 ...", 0),
        (None, "good plot", 1), (2, "bad film", 0), (7, "Straße été film", 1), (8, "unseen", None), (9, "", 0)]
SCHEMA = "id long, body string, star int, scores int, error int, _text int"


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def test_naive_bayes_equals_plain_counts(spark):
    df = docs(spark)
    got = score_text(df, "id", "body", naive_bayes_loader(df, "body", "star", 2, buckets=1 << 16), 2).collect()
    assert len(got) == len(DOCS)
    count = [Counter(w for _, t, c in DOCS if c == k for w in words(t)) for k in (0, 1)]
    n_docs = [sum(c == k for _, _, c in DOCS) for k in (0, 1)]
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append(r)
    for i, text, _ in DOCS:
        for r in by_id[i]:
            if not words(text):
                assert r.scores is None and r.error == "no words to score"
                continue
            want = [math.log((n_docs[k] + 1) / (sum(n_docs) + 2))
                    + sum(math.log((count[k][w] + 1) / (sum(count[k].values()) + (1 << 16))) for w in words(text)) for k in (0, 1)]
            assert r.error is None and r.scores == pytest.approx(want, abs=1e-5)
    assert len(by_id[2]) == 2  # a repeated row is a row


def test_buckets_agree_and_shared_buckets_add_up(spark):
    from orchard.operators.scorer import NaiveBayes
    df = docs(spark)
    prior, weights = fit_naive_bayes(df, "body", "star", 2, buckets=3)
    assert weights.shape == (3, 2)
    scorer = NaiveBayes(prior, weights)
    seen = sorted({w for _, t, _ in DOCS for w in words(t)})
    rows = spark.createDataFrame([(w,) for w in seen], "w string").select("w", word_bucket(F.col("w"), 3).alias("b")).collect()
    assert {r.w: r.b for r in rows} == {w: scorer.bucket(w) for w in seen}


def test_window_is_an_error_and_texts_are_never_cut(spark):
    df = docs(spark, [(1, "good " * 5, 1), (2, "good " * 6, 1), (3, "x " * 200_000, 0)])
    got = {r.id: r for r in score_text(df, "id", "body", naive_bayes_loader(df, "body", "star", 2, max_words=5), 2).collect()}
    assert got[1].error is None and [got[i].error for i in (2, 3)] == ["more than 5 words"] * 2
    whole = {r.id: r for r in score_text(df, "id", "body", naive_bayes_loader(df, "body", "star", 2), 2).collect()}
    assert whole[3].error is None and whole[3].scores[0] < -200_000 * 0.1


def test_any_scorer_errors_and_defects(spark):
    df = spark.range(40).select("id", F.concat(F.lit("t"), F.col("id")).alias("body")).repartition(2)

    def load():
        def scorer(text):
            k = int(text[1:])
            if k % 10 == 3:
                raise RuntimeError(f"cannot take {text}")
            return [1.0] if k % 10 == 4 else [float("nan"), 1.0] if k % 10 == 5 else [k, -k]
        return scorer

    got = {r.id: r for r in score_text(df, "id", "body", load, 2).collect()}
    assert len(got) == 40 and got[13].error == "cannot take t13" and got[7].scores == [7.0, -7.0]
    assert {got[k].error for k in (4, 15)} == {"scorer gave no 2 finite scores"}
    assert sum(r.error is not None for r in got.values()) == 12

    def defective():
        return lambda text: {}[text]
    with pytest.raises(Exception, match="KeyError"):
        score_text(df, "id", "body", defective, 2).collect()


def test_scorer_loads_once_per_task(spark):
    acc = spark.sparkContext.accumulator(0)

    def load():
        acc.add(1)
        return lambda text: [0.0]
    df = spark.range(0, 50_000, 1, 4).select("id", F.col("id").cast("string").alias("body"))
    tasks = max(4, spark.sparkContext.defaultParallelism)
    assert score_text(df, "id", "body", load, 1).where("scores[0] = 0").count() == 50_000
    assert acc.value <= tasks


def test_empty_table(spark):
    df = docs(spark, [])
    assert score_text(df, "id", "body", naive_bayes_loader(df, "body", "star", 2), 2).collect() == []


def test_fixed_corr(spark):
    rows = [(1.5, 2.0), (2.25, 1.0), (None, 5.0), (3.0, 4.5), (0.125, None), (-1.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    import numpy as np
    pairs = [r for r in rows if None not in r]
    want = np.corrcoef(*zip(*pairs))[0, 1]
    assert df.agg(fixed_corr(F.col("x"), F.col("y")).alias("r")).first().r == pytest.approx(want, abs=1e-12)
    assert df.agg(fixed_corr(F.lit(1.0), F.col("y")).alias("r")).first().r is None
