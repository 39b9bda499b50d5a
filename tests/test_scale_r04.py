"""Steps that must not grow with the number of shuffle partitions or with the passes made over them."""

from pyspark.sql import functions as F

import orchard.operators.models as M


def test_models_are_fitted_on_written_rows(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).cast("double").alias("a"),
                                   (F.col("id") % 2).cast("int").alias("y"),
                                   F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    seen = []

    class Stop(Exception):
        pass

    def fit(train, *_):
        seen.append(train)
        raise Stop

    monkeypatch.setattr(M, "_fit_members", fit)
    for call in (lambda: M.classifier_accuracies(rows.repartition(40), ["a"], "y", key_col="k"),
                 lambda: M.soft_vote_scores(rows.repartition(40), ["a"], "y", "k")):
        try:
            call()
        except Stop:
            pass
    for train in seen:
        assert train.rdd.getNumPartitions() < 40 and train.count() == 160
        assert "RepartitionByExpression" not in train._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 2


def test_vector_topk_drops_far_rows_in_their_batch(spark):
    """The same ranks as by column expressions, nulls first, and no row per vector and query leaves a task."""
    from pyspark.sql import Window

    from orchard.operators.retrieval import _distance_rows, l2, vector_topk
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(300)] + [(900, None), (901, [1.0]), (902, [None, 1.0]), (903, [float("nan"), 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    for extra in (v.where("id < 300"), v.where("id < 4 or id > 902"), v):
        q = spark.createDataFrame([(1, [0.2, 0.7]), (2, [4.0, 2.0])], "qk int, q array<double>")
        got = sorted(map(tuple, vector_topk(extra, "id", "v", q, ["qk"], "q", 3).collect()), key=str)
        w = Window.partitionBy("qk").orderBy("distance", "id")
        want = extra.crossJoin(q).select("qk", "id", l2(F.col("v"), F.col("q")).alias("distance"))
        want = want.withColumn("rank", F.rank().over(w)).where("rank <= 3").select("qk", "rank", "id", F.round("distance", 6))
        assert got == sorted(map(tuple, want.collect()), key=str) and len(got) == 6
    near = v.where("id < 300").coalesce(1).mapInArrow(_distance_rows([[0.2, 0.7]], 3), "id long, _qi int, distance double")
    assert near.count() < 100


def test_prompts_read_written_chunks(spark, monkeypatch):
    from orchard.plans import retrieval as R
    names, write = [], R.written
    monkeypatch.setattr(R, "written", lambda df, name: names.append(name) or write(df, name))
    assert R.q_rag_prompts(spark, "/root/testdata/sf0.001").count() > 0
    assert names == ["chunks", "hits"]


def test_new_words_of_letters_are_not_cut_again():
    import numpy as np
    import public_tokenizers

    from orchard.llm.token_store import PieceEncoder
    enc = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "<u2")
    texts = ["plain words été über жук\nnext Line, end.", "don't 12 a1 ﬀ 中文 x y z", "ĠÂł Ġ ǅ ͺ áb", "naïve­ co-op İ ß", " two  spaces"]
    for text in texts:
        assert enc.encode(text) == enc._whole(text)
    whole, ids = [], enc._ids
    enc._ids = lambda text: whole.append(text) or ids(text)
    assert enc.encode("first quixotry żółw новое") == np.array(ids("first quixotry żółw новое"), "<u2").tobytes()
    assert whole == ["\nfirst"]  # the others went through the merges alone


def test_model_keeps_only_its_values(spark):
    import glob

    from orchard.llm import lm
    from orchard.session import scratch_path
    base = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    seen = set(glob.glob(f"{base}/lm-*"))
    docs = spark.createDataFrame([(i, f"a b c w{i % 3} a b c") for i in range(20)], "doc_id long, text string")
    model = lm.fit(docs)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{base}/lm-*")) - seen}
    assert left == {"lm-values"} and set(model.values.columns) == {"bucket", "key", "kind", "x", "y"}
    assert model.values.where("kind = 3").count() > 0


def test_token_manifest_is_one_file(spark):
    """A small file for each task is, on each, a process started to set its mode."""
    import public_tokenizers

    from orchard.llm.token_store import read_token_files, write_token_files
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(None, None)], "doc_id long, text string")
    manifest, folder = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), files=6)
    assert len(manifest.inputFiles()) == 1
    assert sorted(r.part for r in manifest.collect()) == list(range(6)) and manifest.groupBy().sum("n_docs").first()[0] == 31
    assert read_token_files(manifest, folder).count() == 31


def test_scoring_in_passes_leaves_only_scores(spark, monkeypatch):
    """Passes over buckets and blocks give the rows of one pass; the tables of model, blocks and answers go."""
    import glob

    from orchard.llm import lm
    from orchard.session import scratch_path
    base = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    docs = spark.createDataFrame([(i, None if i == 7 else f"a b c w{i % 9} a b {'c d ' * (i % 5)}") for i in range(90)],
                                 "doc_id long, text string").repartition(4).cache()
    one = sorted(map(tuple, lm.lm_scores(docs, dictionary=4).collect()), key=str)
    monkeypatch.setattr(lm, "BUCKET", 64)
    monkeypatch.setattr(lm, "BLOCK", 200)
    names, write = [], lm.stored
    monkeypatch.setattr(lm, "stored", lambda df, name: names.append(name) or write(df, name))
    seen = set(glob.glob(f"{base}/lm-*"))
    many = sorted(map(tuple, lm.lm_scores(docs, dictionary=4).collect()), key=str)
    assert [x[:4] for x in many] == [x[:4] for x in one]
    assert all(abs(x - y) < 1e-9 for a, b in zip(one, many, strict=True) for x, y in zip(a[4:], b[4:], strict=True))
    assert names.count("lm-arcs") == 2 and names.count("lm-answers") == 8 and names.count("lm-scores") == 2
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{base}/lm-*")) - seen} == {"lm-scores"}
