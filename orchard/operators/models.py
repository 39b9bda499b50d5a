"""Model training and scoring with MLlib, plus learners expressed directly
as DataFrame aggregations (naive Bayes, nearest neighbours, soft voting).

Training loops run on the driver only as MLlib itself does (one distributed
pass per iteration); data never passes through the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orchard.functions import flat_literal


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip")


def accuracy_by_split(pred: DataFrame, label: str, split: str = "split",
                      prediction: str = "prediction") -> DataFrame:
    """(split, accuracy, n_rows) from a scored table."""
    hit = (F.col(prediction).cast("double") == F.col(label).cast("double")).cast("double")
    return pred.groupBy(split).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n_rows"))


def logistic(features: Sequence[str], label: str, n_train: int, c: float = 1.0,
             max_iter: int = 100) -> Pipeline:
    """L2 logistic regression with the penalty of ``C`` on the summed loss:
    MLlib averages the loss, so ``regParam = 1 / (C * n)``."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                            regParam=1.0 / (c * max(n_train, 1)), elasticNetParam=0.0,
                            standardization=False)
    return Pipeline(stages=[assembler(features), lr])


def fit_logistic_accuracy(split_df: DataFrame, features: Sequence[str], label: str,
                          split: str = "split") -> DataFrame:
    """Fit on the 'train' rows, report accuracy on train and test."""
    data = split_df.withColumn(label, F.col(label).cast("double"))
    train = data.where(F.col(split) == "train")
    model = logistic(features, label, train.count()).fit(train)
    return accuracy_by_split(model.transform(data), label, split)


def content_key(rows: DataFrame, version: str) -> str:
    """Name of a model by what it is trained on: the rows, whatever their order and
    partitions (count and exact sums of two hashes of every row), their columns and
    ``version``, which callers change with the code that trains."""
    import hashlib
    cols = sorted(rows.columns)
    # the null flags tell a null from a value that leaves the hash as it is
    row = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)"))
    parts = rows.agg(F.count(F.lit(1)), total(1), total(2)).first()
    types = [rows.schema[c].dataType.simpleString() for c in cols]
    return hashlib.md5(f"{version}|{cols}|{types}|{tuple(map(str, parts))}".encode()).hexdigest()[:16]


def train_or_load(spark, path: str, fit):
    """Model store: load the PipelineModel at ``path`` if one was saved
    there, otherwise fit, save and return it."""
    from pyspark.ml import PipelineModel

    from orchard.sources.files import path_exists
    if path_exists(spark, f"{path}/metadata"):
        return PipelineModel.load(path)
    model = fit()
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


GROWTH_FEATURES = ["vote_share_2016", "vote_share_2021", "avg_sentiment_score"]
GROWTH = "growth_2016_2021"


def _growth_rows(m: DataFrame, seed: int) -> DataFrame:
    from orchard.operators.sampling import hash_split
    key = F.concat_ws("|", F.col("constituency_no").cast("string"), F.col("party_raw"))
    return hash_split(m.withColumn("row_key", key), "row_key", seed)


def growth_forest(m: DataFrame, seed: int = 42, num_trees: int = 100, max_depth: int = 30):
    """Random-forest regression of growth on (2016, 2021, sentiment), fitted on the 'train' rows of
    the 80/20 hash split.  ``max_depth`` is MLlib's own limit.  Rows lie in partitions by hash and
    in order, so that the same rows on as many cores give the same trees."""
    from pyspark.ml.regression import RandomForestRegressor
    train = _growth_rows(m, seed).where(F.col("split") == "train").select("row_key", *GROWTH_FEATURES, GROWTH)
    train = train.repartition(m.sparkSession.sparkContext.defaultParallelism, "row_key").sortWithinPartitions("row_key")
    # a regression forest tries every feature at every split; three are too few to draw from
    rf = RandomForestRegressor(featuresCol="features", labelCol=GROWTH, numTrees=num_trees, seed=seed,
                               maxDepth=max_depth, featureSubsetStrategy="all")
    return Pipeline(stages=[assembler(GROWTH_FEATURES), rf]).fit(train)


def with_forest_growth(m: DataFrame, seed: int = 42, num_trees: int = 100, max_depth: int = 30) -> DataFrame:
    """``m`` with ``predicted_growth_2026``, the forest's prediction for every row (no row is left out:
    a row without a feature gets NULL)."""
    whole = F.lit(True)
    for c in GROWTH_FEATURES:
        whole = whole & F.col(c).isNotNull()
    model = growth_forest(m, seed, num_trees, max_depth)
    scored = model.transform(m.where(whole)).drop("features").withColumnRenamed("prediction", "predicted_growth_2026")
    return scored.unionByName(m.where(~whole).withColumn("predicted_growth_2026", F.lit(None).cast("double")))


def growth_forest_mse(m: DataFrame, seed: int = 42, num_trees: int = 100) -> DataFrame:
    """One row with the mean squared error of ``growth_forest`` on the 'test' rows."""
    from pyspark.ml.evaluation import RegressionEvaluator
    test = growth_forest(m, seed, num_trees).transform(_growth_rows(m, seed).where(F.col("split") == "test"))
    mse = RegressionEvaluator(labelCol=GROWTH, metricName="mse").evaluate(test)
    return m.sparkSession.createDataFrame([(float(mse), int(test.count()))], "mse double, n_test bigint")


def _classifiers(label: str, seed: int, n_train: int):
    from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, NaiveBayes,
                                           RandomForestClassifier)
    common = dict(featuresCol="features", labelCol=label)
    return {
        "RandomForest": RandomForestClassifier(numTrees=100, seed=seed, maxDepth=12, **common),
        "LogisticRegression": LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), standardization=False, **common),
        "LinearSVC": LinearSVC(maxIter=100, **common),
        "GradientBoosting": GBTClassifier(maxIter=100, maxDepth=3, seed=seed, stepSize=0.1, **common),
        "DecisionTree": DecisionTreeClassifier(seed=seed, maxDepth=20, **common),
        "GaussianNB": NaiveBayes(modelType="gaussian", **common),
    }


def _fit_members(train: DataFrame, features: Sequence[str], label: str, seed: int) -> dict:
    """Fit every MLlib member once; output columns are renamed per member so
    the fitted models can score the same rows one after another."""
    members = {}
    for name, est in _classifiers(label, seed, train.count()).items():
        est = est.copy().setPredictionCol(f"_pred_{name}").setRawPredictionCol(f"_raw_{name}")
        if name != "LinearSVC":
            est = est.setProbabilityCol(f"_prob_{name}")
        members[name] = Pipeline(stages=[assembler(features, f"_x_{name}"),
                                         est.setFeaturesCol(f"_x_{name}")]).fit(train)
    return members


def _model_rows(data: DataFrame, label: str, key_col: str | None) -> DataFrame:
    """``data`` with a double label, written once in order of the key: the fits pass over it hundreds of
    times, and its partitions follow its size, not the number of shuffle partitions of the plan before."""
    from orchard.sources.files import written
    rows = data.withColumn(label, F.col(label).cast("double"))
    return written(rows.orderBy(key_col) if key_col else rows, "model-rows")


def classifier_accuracies(data: DataFrame, features: Sequence[str], label: str, seed: int = 42,
                          key_col: str | None = None, threads: int = 6) -> DataFrame:
    """Train every member on the 'train' rows and tabulate test accuracy,
    plus the soft vote of the members that give probabilities (the same
    fitted members, not refitted).  Members are independent, so their Spark
    jobs are submitted from a small driver thread pool and run
    concurrently."""
    from concurrent.futures import ThreadPoolExecutor

    data = _model_rows(data, label, key_col).cache()
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    members = _fit_members(train, features, label, seed)

    def mllib_acc(name):
        hit = (F.col(f"_pred_{name}") == F.col(label)).cast("double")
        return float(members[name].transform(test).agg(F.avg(hit)).collect()[0][0])

    def knn_acc():
        knn = knn_classify(train, test, key_col, features, label, k=5)
        return float(test.select(key_col, label).join(knn, key_col)
                     .agg(F.avg((F.col("prediction").cast("double") == F.col(label)).cast("double"))).collect()[0][0])

    def vote_acc():
        votes = _soft_vote(test, members, label)
        return float(votes.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).collect()[0][0])

    tasks = [(name, (lambda n=name: mllib_acc(n))) for name in members]
    tasks += [("KernelSVC", lambda: random_fourier_svc_accuracy(data, features, label, seed)),
              ("AdaBoost", lambda: adaboost_accuracy(data, features, label)),
              ("HistBoostDepthwise", lambda: hist_boost_accuracy(data, features, label, "depthwise", 30, max_depth=3)),
              ("HistBoostLeafwise", lambda: hist_boost_accuracy(data, features, label, "leafwise", 20, num_leaves=8)),
              ("ExtraTrees", lambda: extra_trees_accuracy(data, features, label, n_trees=100, seed=seed))]
    if key_col:
        tasks.append(("KNN", knn_acc))
    tasks.append(("SoftVote", vote_acc))
    with ThreadPoolExecutor(max_workers=threads) as pool:
        futures = [(name, pool.submit(fn)) for name, fn in tasks]
        rows = [(name, f.result()) for name, f in futures]
    data.unpersist()
    return data.sparkSession.createDataFrame(rows, "model string, accuracy double")


def _soft_vote(rows: DataFrame, members: dict, label: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    scored, probs = rows, []
    for name, model in members.items():
        if name == "LinearSVC":
            continue  # margins, not probabilities
        col = f"p_{name}"
        scored = (model.transform(scored).withColumn(col, vector_to_array(f"_prob_{name}")[1])
                  .drop(f"_x_{name}", f"_pred_{name}", f"_prob_{name}", f"_raw_{name}"))
        probs.append(col)
    avg = sum((F.col(c) for c in probs), F.lit(0.0)) / len(probs)
    return scored.withColumn("p_vote", avg).withColumn("prediction", (F.col("p_vote") >= 0.5).cast("double"))


def soft_vote_scores(data: DataFrame, features: Sequence[str], label: str, key: str | None,
                     seed: int = 42) -> DataFrame:
    """Average of the members' class-1 probabilities on the test rows,
    class 1 when the average is at least one half.  Members score the same
    rows one after another, so their columns line up without joins."""
    data = _model_rows(data, label, key)
    members = _fit_members(data.where(F.col("split") == "train"), features, label, seed)
    out = _soft_vote(data.where(F.col("split") == "test"), members, label)
    keep = ([key] if key else []) + [label, "p_vote", "prediction"]
    return out.select(*keep)


VAR_SMOOTHING = 1e-9


def gaussian_nb_params(train: DataFrame, features: Sequence[str], label: str) -> list[dict]:
    """Class priors, per-feature means and population variances (plus
    ``1e-9 *`` the largest feature variance), from two aggregates.  The
    result has one entry per class: model parameters, not data."""
    overall = train.agg(*[F.var_pop(f).alias(f) for f in features]).collect()[0]
    eps = VAR_SMOOTHING * max(float(overall[f] or 0.0) for f in features)
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"),
                                   *[F.avg(f).alias(f"m_{f}") for f in features],
                                   *[F.var_pop(f).alias(f"v_{f}") for f in features]).collect()
    total = sum(r["_n"] for r in per)
    return [{"label": r[label], "prior": r["_n"] / total,
             "mean": {f: float(r[f"m_{f}"]) for f in features},
             "var": {f: float(r[f"v_{f}"]) + eps for f in features}} for r in sorted(per, key=lambda r: r[label])]


def gaussian_nb_predict(df: DataFrame, params: list[dict], features: Sequence[str],
                        out: str = "prediction") -> DataFrame:
    """Joint log likelihood per class as column expressions; the class with
    the largest one (the smaller label on ties)."""
    import math
    scores = []
    for p in params:
        s = F.lit(math.log(p["prior"]))
        for f in features:
            var = p["var"][f]
            s = s - 0.5 * (F.lit(math.log(2 * math.pi * var)) + F.pow(F.col(f) - F.lit(p["mean"][f]), 2) / F.lit(var))
        scores.append(F.struct(s.alias("ll"), F.lit(-p["label"]).alias("neg_label")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return df.withColumn(out, (-best["neg_label"]).cast("int"))


def knn_classify(train: DataFrame, test: DataFrame, id_col: str, features: Sequence[str], label: str,
                 k: int = 5, per_cell: int = 20, fine_levels: int = 3, crowd_factor: float = 8.0,
                 grid_dims: int = 3) -> DataFrame:
    """Exact k-nearest-neighbour majority vote (Euclidean; distance ties
    broken by train id, vote ties by the smaller label) without comparing
    every test row with every train row.

    Train rows are gridded over the ``grid_dims`` features of the widest range
    (distances use all features) at several resolutions: a base width giving
    about ``per_cell`` rows per cell on average, and -- when the most crowded
    base cell holds more than ``crowd_factor * per_cell`` rows --
    ``fine_levels`` finer grids (width / 4, / 16, ...).  A test row's home cell
    is its own, moved into the train box where it lies outside.  It first
    looks, on the finest grid, at the cells around its home; it is settled when
    it found k rows and its k-th distance is within ``sqrt(gap^2 + radius^2)``,
    gap being its distance to the train box: nothing outside the searched cells
    can be nearer.  Rows not settled move to the next coarser grid, and on the
    base grid the radius doubles until every train cell is searched.  Identical
    train points keep only their k smallest ids.  The unsettled set is
    checkpointed each round.

    Output: (id, prediction), one row per test row.  Train rows with a NULL or
    NaN feature are no neighbours; a test row with one, or an empty train side,
    gives a NULL prediction."""
    import itertools
    import math

    from orchard.session import ensure_checkpoint_dir
    from orchard.sources.files import written

    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    d = len(features)

    def complete(df):
        for f in features:
            df = df.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
        return df

    train = complete(train)
    st = train.agg(F.count(F.lit(1)).alias("n"), *[F.min(f).cast("double").alias(f"lo_{f}") for f in features],
                   *[F.max(f).cast("double").alias(f"hi_{f}") for f in features]).collect()[0]
    n_train = int(st["n"])
    blank = F.lit(None).cast(train.schema[label].dataType).alias("prediction")
    if not n_train:
        return test.select(id_col, blank)
    lo, hi = [st[f"lo_{f}"] for f in features], [st[f"hi_{f}"] for f in features]
    axes = sorted(range(d), key=lambda i: lo[i] - hi[i])[:grid_dims]
    spans = [max(hi[i] - lo[i], 1e-9) for i in axes]
    width = (math.prod(spans) * per_cell / n_train) ** (1.0 / len(axes))
    width = max(width, max(spans) / 1e6)

    t = train.select(F.col(id_col).alias("_tid"), *[F.col(f).alias(f"_t{i}") for i, f in enumerate(features)],
                     F.col(label).alias("_y"))
    # among identical train points only the k smallest ids can ever be
    # chosen; keeping just those (partial window limit per point) bounds any
    # grid cell made hot by duplicates
    dup = Window.partitionBy(*[f"_t{i}" for i in range(d)]).orderBy("_tid")
    # written once: the rounds below read it again and again
    t = written(t.withColumn("_dup", F.row_number().over(dup)).where(F.col("_dup") <= k).drop("_dup"), "knn-train")
    beyond = [F.greatest(F.lit(lo[i]) - F.col(f"_q{i}"), F.col(f"_q{i}") - F.lit(hi[i]), F.lit(0.0)) for i in axes]
    q = complete(test).select(F.col(id_col), *[F.col(f).alias(f"_q{i}") for i, f in enumerate(features)])
    q = q.withColumn("_gap2", sum((g * g for g in beyond), F.lit(0.0)))

    def cell_of(cols, w):
        return F.array(*[F.floor(c / F.lit(w)).cast("long") for c in cols])

    def search(pending, w, reach, radius, everything):
        offsets = [list(o) for o in itertools.product(*[range(-s, s + 1) for s in reach])]
        home = cell_of([F.least(F.greatest(F.col(f"_q{i}"), F.lit(lo[i])), F.lit(hi[i])) for i in axes], w)
        probe = pending.withColumn("_cell", F.explode(F.transform(
            F.lit(offsets), lambda o: F.zip_with(home, o, lambda a, b: a + b))))
        grid = t.withColumn("_cell", cell_of([F.col(f"_t{i}") for i in axes], w))
        pairs = probe.join(grid, "_cell")
        dist = F.sqrt(sum(((F.col(f"_q{i}") - F.col(f"_t{i}")) * (F.col(f"_q{i}") - F.col(f"_t{i}"))
                           for i in range(d)), F.lit(0.0)))
        order = Window.partitionBy(id_col).orderBy(F.asc("_d"), F.asc("_tid"))
        near = pairs.select(id_col, "_gap2", "_tid", "_y", dist.alias("_d")) \
            .withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
        summary = near.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_dk"), F.max("_gap2").alias("_g2"),
                                           F.collect_list("_y").alias("_ys"))   # at most k labels
        # a hair under the bound, so that rounding cannot settle a row too early
        bound = (F.col("_g2") + F.lit(radius * radius)) * F.lit(1 - 1e-9)
        settled = (F.col("_n") >= min(k, n_train)) & ((F.col("_dk") * F.col("_dk") <= bound) | F.lit(everything))
        res = pending.select(id_col).join(summary, id_col, "left") \
            .withColumn("_ok", F.coalesce(settled, F.lit(False))).checkpoint(eager=True)
        rest = pending.join(res.where(~F.col("_ok")).select(id_col), id_col, "left_semi").checkpoint(eager=True)
        return res.where("_ok").select(id_col, "_ys"), rest

    done = []
    pending = q
    base_cells = t.groupBy(cell_of([F.col(f"_t{i}") for i in axes], width).alias("_c")).count()
    crowded = (base_cells.agg(F.max("count")).collect()[0][0] or 0) > crowd_factor * per_cell
    # fine grids first (only where the base grid has crowded cells): one ring
    # of neighbour cells at each resolution
    for lvl in (range(fine_levels, 0, -1) if crowded else []):
        w = width / (4 ** lvl)
        got, pending = search(pending, w, [1] * len(axes), w, False)
        done.append(got)
        if pending.isEmpty():
            break
    # base grid: growing radius until every train cell has been searched
    cells_needed = [max(1, math.ceil(s / width)) for s in spans]
    radius, everything = width, False
    while not everything and not pending.isEmpty():
        reach = [min(math.ceil(radius / width), c) for c in cells_needed]
        everything = all(r >= c for r, c in zip(reach, cells_needed, strict=True))
        got, pending = search(pending, width, reach, radius, everything)
        done.append(got)
        radius *= 2
    if not pending.isEmpty():
        raise RuntimeError("a test row stayed without its neighbours after all cells were searched")
    if not done:
        return test.select(id_col, blank)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    votes = out.select(id_col, F.explode("_ys").alias("_y")).groupBy(id_col, "_y").agg(F.count(F.lit(1)).alias("_c"))
    best = votes.groupBy(id_col).agg(F.min_by("_y", F.struct((-F.col("_c")).alias("c"), F.col("_y").alias("y"))).alias("prediction"))
    return test.select(id_col).join(best, id_col, "left")


def standardizer(train: DataFrame, features: Sequence[str]):
    """Mean/std of each feature on the train rows (model parameters, one
    small aggregate) and a function that standardises columns with them."""
    st = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                   *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).collect()[0]
    params = {f: (float(st[f"m_{f}"] or 0.0), float(st[f"s_{f}"] or 0.0) or 1.0) for f in features}

    def apply(df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.select("*", *[((F.col(f) - m) / s).alias(prefix + f) for f, (m, s) in params.items()])

    return apply


def random_fourier_svc_accuracy(data: DataFrame, features: Sequence[str], label: str, seed: int = 42,
                                components: int = 200, reg: float = 0.01) -> float:
    """RBF-kernel SVM approximated by random Fourier features (Rahimi &
    Recht 2007): z(x) = sqrt(2/D) cos(Wx + b), W ~ N(0, 2*gamma), gamma =
    1 / n_features on standardised inputs; then a linear SVM."""
    import numpy as np
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    d = len(features)
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 / d), size=(components, d))
    b = rng.uniform(0, 2 * np.pi, size=components)
    proj = F.lit([[float(x) for x in row] + [float(bi)] for row, bi in zip(w, b)])   # [w..., b] per component
    scale = float(np.sqrt(2.0 / components))
    train = data.where(F.col("split") == "train")
    z = standardizer(train, features)
    x = F.array(*[F.col("z_" + f) for f in features])
    feats = F.transform(proj, lambda row: F.cos(F.aggregate(
        F.zip_with(F.slice(row, 1, d), x, lambda a, c: a * c), F.element_at(row, d + 1), lambda acc, t: acc + t)) * scale)
    out = z(data).select("split", F.col(label).cast("double").alias(label),
                         array_to_vector(feats).alias("features")).cache()   # the optimiser passes many times
    model = LinearSVC(featuresCol="features", labelCol=label, regParam=reg, maxIter=30).fit(
        out.where(F.col("split") == "train"))
    scored = model.transform(out.where(F.col("split") == "test"))
    acc = float(scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).collect()[0][0])
    out.unpersist()
    return acc


def adaboost_accuracy(data: DataFrame, features: Sequence[str], label: str, rounds: int = 50,
                      bins: int = 32) -> float:
    """Discrete AdaBoost (SAMME, two classes) with histogram stumps.

    Features are binned once at train quantiles.  Each round is one
    aggregate of weighted class sums per (feature, bin); the best stump
    (feature, split, side labels) is chosen from that small table, its
    weighted error gives alpha.  Row weights are exp(sum of alpha over the
    stumps that missed the row), an expression of the bins, so rounds do
    not stack DataFrame lineage."""
    import math

    import numpy as np

    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    probs = [i / bins for i in range(1, bins)]
    cuts = [sorted(set(q)) for q in train.approxQuantile(list(features), probs, 0.0005)]

    def binned(df):
        cols = [sum(((F.col(f) > F.lit(float(t))).cast("int") for t in cs), F.lit(0)).alias(f"_b{i}")
                for i, (f, cs) in enumerate(zip(features, cuts))]
        return df.select(F.col(label).cast("int").alias("_y"), *cols)

    tr = binned(train).cache()
    te = binned(test)
    stumps = []  # (feature index, split k: bin <= k goes left, left label, right label, alpha)

    def misses(st):
        i, k, left, right, _ = st
        pred = F.when(F.col(f"_b{i}") <= k, F.lit(left)).otherwise(F.lit(right))
        return (pred != F.col("_y")).cast("double")

    for _ in range(rounds):
        wexpr = F.exp(sum((F.lit(st[4]) * misses(st) for st in stumps), F.lit(0.0)))
        long = tr.select(wexpr.alias("_w"), "_y", F.explode(F.array(*[
            F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").alias("b")) for i in range(len(features))])).alias("_fb"))
        hist = long.groupBy("_fb.f", "_fb.b").agg(
            F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0.0)).alias("w1"),
            F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0.0)).alias("w0")).collect()
        best = None
        for i in range(len(features)):
            nb = len(cuts[i]) + 1
            w1 = np.zeros(nb)
            w0 = np.zeros(nb)
            for r in hist:
                if r["f"] == i:
                    w1[r["b"]] += r["w1"]
                    w0[r["b"]] += r["w0"]
            total = w1.sum() + w0.sum()
            c1, c0 = np.cumsum(w1), np.cumsum(w0)
            for k in range(nb):
                l1, l0 = c1[k], c0[k]
                r1, r0 = c1[-1] - l1, c0[-1] - l0
                left, right = (1 if l1 > l0 else 0), (1 if r1 > r0 else 0)
                err = ((l0 if left == 1 else l1) + (r0 if right == 1 else r1)) / total
                if best is None or err < best[0] - 1e-15:
                    best = (err, i, k, left, right)
        err = max(best[0], 1e-10)
        if err >= 0.5:
            break
        stumps.append((best[1], best[2], best[3], best[4], math.log((1 - err) / err)))
        if best[0] <= 1e-10:
            break
    tr.unpersist()
    score = sum((F.lit(st[4]) * F.when(F.col(f"_b{st[0]}") <= st[1], F.lit(2 * st[2] - 1))
                 .otherwise(F.lit(2 * st[3] - 1)) for st in stumps), F.lit(0.0))
    pred = F.when(score > 0, 1).otherwise(0)
    return float(te.agg(F.avg((pred == F.col("_y")).cast("double"))).collect()[0][0])


def quantile_cuts(train: DataFrame, features: Sequence[str], bins: int = 32) -> list[list[float]]:
    """Bin edges per feature at train quantiles (model parameters)."""
    probs = [i / bins for i in range(1, bins)]
    return [sorted(set(q)) for q in train.approxQuantile(list(features), probs, 0.0005)]


def binned_columns(features: Sequence[str], cuts) -> list[Column]:
    """Bin index of each feature: the number of edges below the value."""
    return [sum(((F.col(f) > F.lit(float(t))).cast("int") for t in cs), F.lit(0)).alias(f"_b{i}")
            for i, (f, cs) in enumerate(zip(features, cuts))]


def _path_case(leaves: list[tuple[list, object]], default) -> Column:
    """CASE over root-to-leaf paths; a path is a list of (feature, k, go_left)."""
    expr = None
    for path, value in leaves:
        cond = F.lit(True)
        for i, k, left in path:
            c = F.col(f"_b{i}") <= k
            cond = cond & (c if left else ~c)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def hist_boost_accuracy(data: DataFrame, features: Sequence[str], label: str, growth: str = "depthwise",
                        rounds: int = 30, max_depth: int = 3, num_leaves: int = 8, eta: float = 0.3,
                        reg_lambda: float = 1.0, bins: int = 32, checkpoint_every: int = 5) -> float:
    """Second-order gradient boosting of logistic loss on histogram bins
    (after Chen & Guestrin 2016; Ke et al. 2017).  Each tree grows either
    depth-wise (all nodes of a level split together) or leaf-wise (the leaf
    with the best gain splits next, up to ``num_leaves``).  Every growth step
    is one aggregate of gradient and hessian sums per (node, feature, bin);
    the split is chosen from that small table (gain
    GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)), leaf values are -G/(H+l), and
    trees are column expressions over the bins (no joins).  The row scores
    are checkpointed every few rounds."""
    import numpy as np

    from orchard.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(data.sparkSession)
    train = data.where(F.col("split") == "train")
    cuts = quantile_cuts(train, features, bins)
    d = len(features)
    tr = train.select(F.col(label).cast("double").alias("_y"), *binned_columns(features, cuts))
    te = data.where(F.col("split") == "test").select(F.col(label).cast("double").alias("_y"),
                                                     *binned_columns(features, cuts))
    mean_y = tr.agg(F.avg("_y")).collect()[0][0]
    mean_y = min(max(mean_y, 1e-6), 1 - 1e-6)
    base = float(np.log(mean_y / (1 - mean_y)))
    state = tr.withColumn("_F", F.lit(base)).cache()
    trees = []

    def histograms(st: DataFrame, frontier: list) -> dict:
        """(node index in frontier) -> arrays G[f][bin], H[f][bin]."""
        node = _path_case([(path, i) for i, path in enumerate(frontier)], -1)
        p = 1 / (1 + F.exp(-F.col("_F")))
        rows = (st.select(node.alias("_n"), (p - F.col("_y")).alias("_g"), (p * (1 - p)).alias("_h"),
                          *[F.col(f"_b{i}") for i in range(d)])
                .where(F.col("_n") >= 0)
                .select("_n", "_g", "_h", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").alias("b"))
                                                             for i in range(d)])).alias("_fb"))
                .groupBy("_n", "_fb.f", "_fb.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect())
        out = {}
        for r in rows:
            G, H = out.setdefault(r["_n"], (np.zeros((d, bins + 1)), np.zeros((d, bins + 1))))
            G[r["f"], r["b"]] += r["g"]
            H[r["f"], r["b"]] += r["h"]
        return out

    def best_split(G, H):
        g_tot, h_tot = G[0].sum(), H[0].sum()
        parent = g_tot ** 2 / (h_tot + reg_lambda)
        best = (0.0, None)
        for f in range(d):
            gl, hl = np.cumsum(G[f])[:-1], np.cumsum(H[f])[:-1]
            gr, hr = g_tot - gl, h_tot - hl
            gain = gl ** 2 / (hl + reg_lambda) + gr ** 2 / (hr + reg_lambda) - parent
            gain[(hl < 1e-3) | (hr < 1e-3)] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), (f, k))
        return best, -g_tot / (h_tot + reg_lambda)

    for r in range(rounds):
        leaves = []
        if growth == "depthwise":
            frontier = [[]]
            for _ in range(max_depth):
                hist = histograms(state, frontier)
                nxt = []
                for i, path in enumerate(frontier):
                    if i not in hist:
                        continue
                    (gain, split), value = best_split(*hist[i])
                    if split is None:
                        leaves.append((path, value))
                    else:
                        f, k = split
                        nxt += [path + [(f, k, True)], path + [(f, k, False)]]
                frontier = nxt
                if not frontier:
                    break
            if frontier:
                hist = histograms(state, frontier)
                leaves += [(path, best_split(*hist[i])[1]) for i, path in enumerate(frontier) if i in hist]
        else:  # leaf-wise
            open_leaves = [([], None)]   # (path, (gain, split, value))
            hist = histograms(state, [[]])
            open_leaves = [([], best_split(*hist[0]))]
            while len(open_leaves) < num_leaves:
                cand = max(range(len(open_leaves)), key=lambda j: open_leaves[j][1][0][0])
                path, ((gain, split), _) = open_leaves[cand]
                if split is None:
                    break
                f, k = split
                kids = [path + [(f, k, True)], path + [(f, k, False)]]
                hist = histograms(state, kids)
                open_leaves.pop(cand)
                open_leaves += [(kid, best_split(*hist[i])) for i, kid in enumerate(kids) if i in hist]
            leaves = [(path, info[1]) for path, info in open_leaves]
        trees.append(leaves)
        state = state.withColumn("_F", F.col("_F") + eta * _path_case(leaves, 0.0))
        if (r + 1) % checkpoint_every == 0:
            state = state.checkpoint(eager=True)
    score = F.lit(base)
    for leaves in trees:
        score = score + eta * _path_case(leaves, 0.0)
    pred = (score > 0).cast("double")
    return float(te.agg(F.avg((pred == F.col("_y")).cast("double"))).collect()[0][0])


def extra_trees_accuracy(data: DataFrame, features: Sequence[str], label: str, n_trees: int = 100,
                         max_depth: int = 16, bins: int = 32, seed: int = 42) -> float:
    """Extremely randomised trees (Geurts et al. 2006), two classes, Gini.

    All trees grow level by level together.  Each row keeps an array with
    its current node in every tree (-1 once it sits in a leaf).  Per level:
    one aggregate gives each open node its size, class count and per-feature
    bin range; the driver draws ``sqrt(d)`` random (feature, threshold)
    candidates per node inside those ranges; a second aggregate counts the
    rows and positives going left for every candidate; the best candidate
    by Gini gain splits the node.  Rows move to child nodes with an in-row
    ``transform`` over a split table keyed by "tree:node" (one entry per open
    node, a constant-folded map literal), so trees can grow deep.  The row
    state is checkpointed each level.  Leaves vote with their share of
    class 1; the forest averages the votes."""
    import math as _m

    import numpy as np

    from orchard.functions import json_literal
    from orchard.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(data.sparkSession)
    rng = np.random.default_rng(seed)
    d = len(features)
    m = max(1, int(_m.sqrt(d)))
    train = data.where(F.col("split") == "train")
    cuts = quantile_cuts(train, features, bins)
    tr = train.select(F.col(label).cast("int").alias("_y"), *binned_columns(features, cuts))
    te = data.where(F.col("split") == "test").select(F.col(label).cast("int").alias("_y"),
                                                     *binned_columns(features, cuts))
    bins_arr = F.array(*[F.col(f"_b{i}") for i in range(d)])
    state = tr.withColumn("_nodes", F.array_repeat(F.lit(0), n_trees)).cache()
    leaf_p: dict = {}           # "tree:node" -> share of class 1
    levels: list = []           # per level: split map "tree:node" -> [f, k]

    def key_of(t, node):
        return F.concat(t.cast("string"), F.lit(":"), node.cast("string"))

    def exploded(st):
        return st.select("_y", "_bins", F.posexplode("_nodes").alias("_t", "_n")).where(F.col("_n") >= 0)

    for depth in range(max_depth + 1):
        st = state.withColumn("_bins", bins_arr)
        stats = exploded(st).select("_t", "_n", "_y", *[F.element_at("_bins", i + 1).alias(f"_b{i}") for i in range(d)]) \
            .groupBy("_t", "_n").agg(
                F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"),
                *[F.min(f"_b{i}").alias(f"lo{i}") for i in range(d)],
                *[F.max(f"_b{i}").alias(f"hi{i}") for i in range(d)]).collect()
        if not stats:
            break
        cands = {}
        for r in stats:
            key = f"{r['_t']}:{r['_n']}"
            n, pos = r["n"], r["pos"]
            leaf_p[key] = pos / n
            if depth == max_depth or n < 2 or pos in (0, n):
                continue
            splittable = [i for i in range(d) if r[f"hi{i}"] > r[f"lo{i}"]]
            if not splittable:
                continue
            chosen = rng.choice(splittable, size=min(m, len(splittable)), replace=False)
            cands[key] = [(int(f), int(rng.integers(r[f"lo{f}"], r[f"hi{f}"]))) for f in chosen]
        if not cands:
            break
        cand_map = json_literal({k: [x for f, kk in cs for x in (f, kk)] for k, cs in cands.items()},
                                "map<string,array<int>>")
        ex = exploded(state.withColumn("_bins", bins_arr)).withColumn(
            "_cand", F.element_at(cand_map, key_of(F.col("_t"), F.col("_n")))).where(F.col("_cand").isNotNull())
        scored = ex.select("_t", "_n", "_y", F.posexplode(F.transform(
            F.sequence(F.lit(0), (F.size("_cand") / 2 - 1).cast("int")),
            lambda j: F.element_at(F.col("_bins"), F.element_at("_cand", 2 * j + 1) + 1) <= F.element_at("_cand", 2 * j + 2)))
            .alias("_c", "_left"))
        counts = scored.groupBy("_t", "_n", "_c").agg(
            F.sum(F.col("_left").cast("int")).alias("nl"),
            F.sum((F.col("_left") & (F.col("_y") == 1)).cast("int")).alias("pl")).collect()
        totals = {f"{r['_t']}:{r['_n']}": (r["n"], r["pos"]) for r in stats}
        by_node: dict = {}
        for r in counts:
            by_node.setdefault(f"{r['_t']}:{r['_n']}", []).append((r["_c"], r["nl"], r["pl"]))
        splits = {}
        for key, rows in by_node.items():
            n, pos = totals[key]
            best = None
            for c, nl, pl in rows:
                nr, pr = n - nl, pos - pl
                if nl == 0 or nr == 0:
                    continue
                gini = (nl * (1 - (pl / nl) ** 2 - (1 - pl / nl) ** 2) + nr * (1 - (pr / nr) ** 2 - (1 - pr / nr) ** 2)) / n
                if best is None or gini < best[0]:
                    best = (gini, cands[key][c])
            if best is not None:
                splits[key] = [best[1][0], best[1][1]]
        levels.append(splits)
        split_map = json_literal(splits, "map<string,array<int>>")

        def advance(node, t, split_map=split_map):
            sp = F.element_at(split_map, key_of(t, node))
            go_left = F.element_at(bins_arr, F.element_at(sp, 1) + 1) <= F.element_at(sp, 2)
            return F.when(node < 0, node).when(sp.isNull(), F.lit(-1)) \
                .otherwise(F.when(go_left, 2 * node + 1).otherwise(2 * node + 2))

        state = state.withColumn("_nodes", F.transform("_nodes", lambda node, t: advance(node, t))).checkpoint(eager=True)

    # score the test rows: walk every tree through the recorded levels (a
    # node without a split entry at a level stays where it is)
    def make_step(splits):
        split_map = json_literal(splits, "map<string,array<int>>")

        def step(node, t):
            sp = F.element_at(split_map, key_of(t, node))
            go_left = F.element_at(bins_arr, F.element_at(sp, 1) + 1) <= F.element_at(sp, 2)
            return F.when(sp.isNull(), node).otherwise(F.when(go_left, 2 * node + 1).otherwise(2 * node + 2))
        return step

    walk = te.withColumn("_nodes", F.array_repeat(F.lit(0), n_trees))
    for splits in levels:
        walk = walk.withColumn("_nodes", F.transform("_nodes", make_step(splits)))
    leaf_map = json_literal(leaf_p, "map<string,double>")
    votes = F.transform("_nodes", lambda node, t: F.coalesce(F.element_at(leaf_map, key_of(t, node)), F.lit(0.5)))
    p1 = F.aggregate(votes, F.lit(0.0), lambda acc, v: acc + v) / n_trees
    pred = (p1 >= 0.5).cast("int")
    return float(walk.agg(F.avg((pred == F.col("_y")).cast("double"))).collect()[0][0])
