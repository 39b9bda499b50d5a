"""The model store goes by content: the same rows reuse a stored model, changed rows are trained anew."""

from pyspark.sql import functions as F

from orchard.operators.models import content_key, train_or_load


def test_changed_rows_refit(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rows = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(30)], "x double, y double")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f"), LinearRegression(featuresCol="f", labelCol="y")])
    fitted = []

    def model(df, version="v1"):
        key = content_key(df, version)
        return train_or_load(spark, f"{tmp_path}/m-{key}", lambda: fitted.append(key) or pipe.fit(df))

    first = model(rows).stages[-1].coefficients[0]
    assert model(rows.repartition(5).orderBy(F.desc("x"))).stages[-1].coefficients[0] == first
    assert len(fitted) == 1  # other order and partitions: the stored model
    changed = rows.withColumn("y", F.when(F.col("x") == 7, 100.0).otherwise(F.col("y")))
    assert model(changed).stages[-1].coefficients[0] != first
    assert len(fitted) == 2
    model(rows, "v2")
    assert len(fitted) == 3 == len(set(fitted))


def test_content_key(spark):
    base = [(1, "a"), (2, None), (None, "b")]
    df = lambda r: spark.createDataFrame(r, "k long, v string")
    key = content_key(df(base), "1")
    assert key == content_key(df(base[::-1]).repartition(3).select("v", "k"), "1")
    others = [base + base[:1], base[:2], [(1, None), (2, "a"), (None, "b")], [(1, "a"), (None, None), (2, "b")], []]
    keys = [content_key(df(r), "1") for r in others] + [content_key(df(base), "2"), content_key(df(base).withColumnRenamed("v", "w"), "1")]
    assert len({key, *keys}) == len(keys) + 1
