"""Queries without an SQL twin: they run on the small tables and satisfy
their invariants; the stream equals its batch twin."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SMALL_DIR

Q = E.queries()


def test_model_queries(spark):
    acc = Q["fraud_model_accuracy"](spark, SMALL_DIR).collect()
    assert {r.split for r in acc} == {"train", "test"} and all(0 <= r.accuracy <= 1 for r in acc)
    models = Q["election_model_accuracy"](spark, SMALL_DIR).collect()
    assert "SoftVote" in {r.model for r in models} and all(0 <= r.accuracy <= 1 for r in models)
    mse = Q["election_growth_mse"](spark, SMALL_DIR).collect()[0]
    assert mse.mse >= 0
    assert Q["homes_price_model"](spark, SMALL_DIR).count() > 0


def test_model_sentiment_probabilities(spark):
    m = Q["model_sentiment"](spark, SMALL_DIR)
    s = m.select((F.col("model_neg") + F.col("model_neu") + F.col("model_pos")).alias("t")).collect()
    assert all(abs(r.t - 1) < 2e-4 for r in s)
    assert Q["reviews_scores_join"](spark, SMALL_DIR).count() == spark.read.parquet(f"{SMALL_DIR}/documents.parquet").count()


def test_chunks_and_prompts(spark):
    c = Q["chunk_documents"](spark, SMALL_DIR)
    assert c.agg(F.max(F.length("chunk"))).collect()[0][0] <= 7500
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet")
    assert c.select("doc_id").distinct().count() == docs.count()
    p = Q["rag_prompts"](spark, SMALL_DIR).collect()
    assert p and all(r.prompt.startswith("Answer the question") for r in p)


def test_lsh_recall(spark):
    exact = {(r.question_id, r.vec_id) for r in Q["vector_topk"](spark, SMALL_DIR).collect()}
    approx = {(r.question_id, r.vec_id) for r in Q["vector_topk_lsh"](spark, SMALL_DIR).collect()}
    assert len(exact & approx) / len(exact) >= 0.5


def test_stream_equals_batch(spark):
    stream = sorted(tuple(r) for r in Q["price_history"](spark, SMALL_DIR).collect())
    batch = sorted(tuple(r) for r in Q["page_extract"](spark, SMALL_DIR).collect())
    assert stream == batch


def test_daily_stream_equals_batch(spark):
    from orchard.plans.prices import price_daily_batch
    stream = sorted(tuple(r) for r in Q["price_daily"](spark, SMALL_DIR).collect())
    batch = sorted(tuple(r) for r in price_daily_batch(spark, SMALL_DIR).select(
        "url", "day", "min_price", "max_price", "last_price", "n_snapshots").collect())
    assert stream == batch


def test_sources_guard_store_and_drop(spark, tmp_path):
    import pytest

    from orchard.operators.models import train_or_load
    from orchard.sources.files import SourceMissing, drop_path, path_exists, read_csv
    with pytest.raises(SourceMissing):
        read_csv(spark, str(tmp_path / "missing.csv"), "a int")
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    calls = []

    def fit():
        calls.append(1)
        return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(df)

    path = str(tmp_path / "store" / "m")
    train_or_load(spark, path, fit)
    train_or_load(spark, path, fit)
    assert len(calls) == 1                       # second call reused the stored model
    assert path_exists(spark, path) and drop_path(spark, path) and not path_exists(spark, path)


def test_price_stream_resumes_from_checkpoint(spark):
    """A second run of the stream picks up only newly landed snapshot files:
    no repeats, no gaps (the checkpoint records what was processed)."""
    from orchard.session import scratch_path
    from orchard.sources import views as V
    from orchard.streaming.prices import run_price_history

    snaps = V.price_snapshots(spark, SMALL_DIR)
    base = scratch_path(spark, "resume-test")
    landing, history, ckpt = f"{base}/landing", f"{base}/history", f"{base}/ckpt"
    days = sorted(r[0] for r in snaps.select("seen_on").distinct().collect())
    snaps.where(F.col("seen_on") == days[0]).write.mode("append").parquet(landing)
    run_price_history(spark, landing, history, ckpt, snaps.schema)
    first = spark.read.parquet(history).count()
    for day in days[1:]:
        snaps.where(F.col("seen_on") == day).write.mode("append").parquet(landing)
    run_price_history(spark, landing, history, ckpt, snaps.schema)
    out = spark.read.parquet(history)
    assert first == snaps.where(F.col("seen_on") == days[0]).count()
    assert out.count() == snaps.count() == out.select("url", "seen_on").distinct().count()


def test_extreme_text_model_picks(spark):
    rows = Q["reviews_extreme_text_model"](spark, SMALL_DIR).collect()
    assert {r.pick for r in rows} <= {"model: most positive 1-star", "model: most negative 5-star"} and rows
