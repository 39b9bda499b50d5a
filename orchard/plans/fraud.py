"""Card-fraud workflow: profile, class balance, amount statistics, exact
under-sampling, repeatable and stratified splits, class probabilities and a
logistic-regression baseline.

Input: ``transactions`` (txn_id, v1, v2, amount, class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.operators.relational import frequency
from orchard.operators.sampling import exact_sample, hash_split, stratified_split
from orchard.operators.stats import describe, null_counts, numeric_columns
from orchard.sources import views as V

FEATURES = ["v1", "v2", "amount"]
SAMPLE_SEED = 7
SPLIT_SEED = 42
STRATIFY_SEED = 2


def legit_fraud(t: DataFrame):
    return t.where(F.col("class") == 0), t.where(F.col("class") == 1)


def undersample(t: DataFrame, seed: int = SAMPLE_SEED) -> DataFrame:
    """As many legitimate rows as there are fraud rows (exact size, chosen
    by hash order), concatenated with all fraud rows."""
    legit, fraud = legit_fraud(t)
    need = fraud.agg(F.count(F.lit(1)).alias("_need"))
    return exact_sample(legit, "txn_id", need, seed).unionByName(fraud)


def class_means(t: DataFrame, digits: int = 6) -> DataFrame:
    cols = numeric_columns(t, exclude=("class", "txn_id"))
    return t.groupBy("class").agg(*[F.round(F.avg(c), digits).alias(f"mean_{c}") for c in cols])


def softmax(cols, names, digits: int = 6):
    """Numerically stable softmax over a few columns, as expressions."""
    m = F.greatest(*cols)
    exps = [F.exp(c - m) for c in cols]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [F.round(e / total, digits).alias(n) for e, n in zip(exps, names)]


# ------------------------------------------------------------------ queries

def q_fraud_null_counts(spark, d):
    return null_counts(V.transactions(spark, d))


def q_fraud_class_counts(spark, d):
    return frequency(V.transactions(spark, d), "class", "n_rows").orderBy(F.desc("n_rows"), "class")


def q_fraud_split_counts(spark, d):
    legit, fraud = legit_fraud(V.transactions(spark, d))
    return (legit.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("legit").alias("part"), "n_rows")
            .unionByName(fraud.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("fraud").alias("part"), "n_rows")))


def q_fraud_amount_describe(spark, d):
    return describe(V.transactions(spark, d), "amount", ["class"])


def q_fraud_class_means(spark, d):
    return class_means(V.transactions(spark, d))


def q_fraud_undersample(spark, d):
    return undersample(V.transactions(spark, d))


def q_split_hash(spark, d):
    return hash_split(V.transactions(spark, d), "txn_id", SPLIT_SEED).select("txn_id", "split")


def q_split_stratified(spark, d):
    return stratified_split(V.transactions(spark, d), "txn_id", "class", 0.2, STRATIFY_SEED) \
        .select("txn_id", "class", "split")


def q_softmax_scores(spark, d):
    t = V.transactions(spark, d)
    logits = [F.col("v1"), F.col("v2"), F.col("amount") / 100000]
    return t.select("txn_id", *softmax(logits, ["p_v1", "p_v2", "p_amount"]))


def q_fraud_model_accuracy(spark, d):
    from orchard.operators.models import fit_logistic_accuracy
    from orchard.sources.files import written
    # a few percent of the transactions: written once, not drawn again for every pass over them
    t = written(undersample(V.transactions(spark, d)), "undersample")
    split = written(stratified_split(t, "txn_id", "class", 0.2, STRATIFY_SEED), "undersample-split")
    return fit_logistic_accuracy(split, FEATURES, "class")


def q_gaussian_nb(spark, d):
    """Gaussian naive Bayes on the hash split: predictions for the test rows."""
    from orchard.operators.models import gaussian_nb_params, gaussian_nb_predict
    t = hash_split(V.transactions(spark, d), "txn_id", SPLIT_SEED)
    params = gaussian_nb_params(t.where(F.col("split") == "train"), FEATURES, "class")
    return gaussian_nb_predict(t.where(F.col("split") == "test"), params, FEATURES).select("txn_id", "class", "prediction")


def q_knn_classify(spark, d):
    """5 nearest neighbours (Euclidean over v1, v2, amount), majority vote,
    for every test row of the hash split."""
    from orchard.operators.models import knn_classify
    t = hash_split(V.transactions(spark, d), "txn_id", SPLIT_SEED)
    test = t.where(F.col("split") == "test")
    pred = knn_classify(t.where(F.col("split") == "train"), test, "txn_id", FEATURES, "class", k=5)
    return test.select("txn_id", "class").join(pred, "txn_id", "left").select(
        "txn_id", "class", F.col("prediction").cast("int").alias("prediction"))


QUERIES = {
    "knn_classify": q_knn_classify,
    "gaussian_nb": q_gaussian_nb,
    "fraud_null_counts": q_fraud_null_counts,
    "fraud_class_counts": q_fraud_class_counts,
    "fraud_split_counts": q_fraud_split_counts,
    "fraud_amount_describe": q_fraud_amount_describe,
    "fraud_class_means": q_fraud_class_means,
    "fraud_undersample": q_fraud_undersample,
    "split_hash": q_split_hash,
    "split_stratified": q_split_stratified,
    "softmax_scores": q_softmax_scores,
    "fraud_model_accuracy": q_fraud_model_accuracy,
}

# ------------------------------------------------------------- DuckDB oracle

_T = ("transactions",)


def _h(seed, key="txn_id"):
    return f"md5(concat('{seed}:', CAST({key} AS VARCHAR)))"


_NB_SPLIT = f"""sp AS (SELECT *, substr({_h(SPLIT_SEED)}, 1, 8) < '33333333' AS is_test FROM transactions),
tr AS (SELECT * FROM sp WHERE NOT is_test),
eps AS (SELECT 1e-9 * greatest(var_pop(v1), var_pop(v2), var_pop(amount)) AS e FROM tr),
cls AS (SELECT class AS c, count(*) / (SELECT count(*) FROM tr) AS prior, avg(v1) AS m1, avg(v2) AS m2, avg(amount) AS m3,
  var_pop(v1) + (SELECT e FROM eps) AS s1, var_pop(v2) + (SELECT e FROM eps) AS s2,
  var_pop(amount) + (SELECT e FROM eps) AS s3 FROM tr GROUP BY class),
ll AS (SELECT t.txn_id, t.class, cls.c, ln(cls.prior)
  - 0.5 * (ln(2 * pi() * s1) + (t.v1 - m1) ^ 2 / s1)
  - 0.5 * (ln(2 * pi() * s2) + (t.v2 - m2) ^ 2 / s2)
  - 0.5 * (ln(2 * pi() * s3) + (t.amount - m3) ^ 2 / s3) AS score
  FROM sp t CROSS JOIN cls WHERE t.is_test)"""

ORACLE = {
    # knn_classify has no SQL twin: a brute-force SQL kNN compares every test
    # row with every train row (quadratic; billions of pairs at sf0.1).  The
    # operator is checked against a Python brute force on small fixtures
    # (tests/test_models.py), with duplicated and crowded points.
    "gaussian_nb": V.with_views("SELECT 1", *_T)[: V.with_views("SELECT 1", *_T).rindex("\nSELECT 1")]
    + ",\n" + _NB_SPLIT + """
SELECT txn_id, class, CAST(c AS INTEGER) AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY score DESC, c) AS rn FROM ll) r WHERE rn = 1""",
    "fraud_null_counts": V.with_views(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
        f"CAST(count({c}) AS BIGINT) AS non_null_count FROM transactions"
        for c in ["txn_id", "v1", "v2", "amount", "class"]), *_T),
    "fraud_class_counts": V.with_views(
        "SELECT class, count(*) AS n_rows FROM transactions WHERE class IS NOT NULL GROUP BY class ORDER BY 2 DESC", *_T),
    "fraud_split_counts": V.with_views(
        "SELECT 'legit' AS part, count(*) AS n_rows FROM transactions WHERE class = 0 "
        "UNION ALL SELECT 'fraud', count(*) FROM transactions WHERE class = 1", *_T),
    "fraud_amount_describe": V.with_views(
        """SELECT class, count(amount) AS count, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS std,
             min(amount) AS min, round(quantile_cont(amount, 0.25), 6) AS q25, round(quantile_cont(amount, 0.5), 6) AS q50,
             round(quantile_cont(amount, 0.75), 6) AS q75, max(amount) AS max FROM transactions GROUP BY class""", *_T),
    "fraud_class_means": V.with_views(
        """SELECT class, round(avg(v1), 6) AS mean_v1, round(avg(v2), 6) AS mean_v2, round(avg(amount), 6) AS mean_amount
           FROM transactions GROUP BY class""", *_T),
    "fraud_undersample": V.with_views(
        f"""SELECT txn_id, v1, v2, amount, class FROM (
              SELECT *, row_number() OVER (ORDER BY {_h(SAMPLE_SEED)}, txn_id) AS rn FROM transactions WHERE class = 0) l
            WHERE rn <= (SELECT count(*) FROM transactions WHERE class = 1)
            UNION ALL SELECT * FROM transactions WHERE class = 1""", *_T),
    "split_hash": V.with_views(
        f"""SELECT txn_id, CASE WHEN substr({_h(SPLIT_SEED)}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split
            FROM transactions""", *_T),
    "split_stratified": V.with_views(
        f"""SELECT txn_id, class, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM (
              SELECT txn_id, class, row_number() OVER (PARTITION BY class ORDER BY {_h(STRATIFY_SEED)}, txn_id) AS rn,
                     count(*) OVER (PARTITION BY class) AS n FROM transactions) s""", *_T),
    "softmax_scores": V.with_views(
        """SELECT txn_id, round(exp(v1 - m) / (exp(v1 - m) + exp(v2 - m) + exp(a - m)), 6) AS p_v1,
                  round(exp(v2 - m) / (exp(v1 - m) + exp(v2 - m) + exp(a - m)), 6) AS p_v2,
                  round(exp(a - m) / (exp(v1 - m) + exp(v2 - m) + exp(a - m)), 6) AS p_amount
           FROM (SELECT txn_id, v1, v2, amount / 100000 AS a, greatest(v1, v2, amount / 100000) AS m FROM transactions) t""",
        *_T),
}
