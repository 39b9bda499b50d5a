"""Steps that must not grow with the passes made over them: what is written once, and by whom."""

import os

from pyspark.sql import functions as F

import orchard.operators.models as M
import orchard.sources.files as files
from orchard.plans import fraud
from orchard.streaming.prices import land_by_day


def test_documents_are_placed_by_the_tasks(spark, tmp_path):
    rows = [(1, "one"), (2, "two\nlines\n"), (3, ""), (4, None), (None, "no id")]
    path = str(tmp_path / "docs")
    files.write_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, "doc_id", "text")
    assert "_SUCCESS" not in os.listdir(path)  # the sink's committer, which moves all files in the driver, is not used
    got = sorted(((r.doc_id, r.text) for r in files.read_documents(spark, path, "doc_id").collect()), key=str)
    assert got == sorted([(1, "one"), (2, "two\nlines\n"), (3, ""), (4, ""), (None, "no id")], key=str)
    files.write_documents(spark.createDataFrame([("a/b=c %", "x")], "k string, text string"), path, "k", "text")
    assert [(r.k, r.text) for r in files.read_documents(spark, path, "k").collect()] == [("a/b=c %", "x")]


def test_knn_writes_its_train_points_once(spark, monkeypatch):
    names, write = [], files.written
    monkeypatch.setattr(files, "written", lambda df, name: names.append(name) or write(df, name))
    df = spark.range(60).select("id", (F.col("id") % 9).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    assert M.knn_classify(df.where("id % 5 > 0"), df.where("id % 5 = 0"), "id", ["a"], "y").count() == 12
    assert names == ["knn-train"]


def test_fraud_model_reads_a_written_sample(spark, monkeypatch):
    t = spark.range(400).select(F.col("id").alias("txn_id"), (F.col("id") % 7).cast("double").alias("v1"), F.lit(1.0).alias("v2"),
                                F.col("id").cast("double").alias("amount"), (F.col("id") % 10 == 0).cast("int").alias("class"))
    monkeypatch.setattr(fraud.V, "transactions", lambda *_: t)
    seen = []
    monkeypatch.setattr(M, "fit_logistic_accuracy", lambda split, *_: seen.append(split) or split)
    fraud.q_fraud_model_accuracy(spark, "")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert seen[0].groupBy("class", "split").count().count() == 4 and seen[0].count() == 80


def test_a_day_lands_in_as_many_files_as_tasks(spark, tmp_path):
    days = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2).cast("int")).alias("seen_on")
    snaps = spark.range(0, 40, 1, 4).select(F.col("id").alias("page_id"), days)
    assert land_by_day(snaps, str(tmp_path / "landing")) == 4
    assert spark.read.parquet(str(tmp_path / "landing")).count() == 40
