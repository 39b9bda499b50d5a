"""Steps of the lexicon scores that must not move words or texts."""

import numpy as np
import pyarrow as pa
import pytest

import orchard.operators.sentiment as S
from orchard.plans import reviews as R

LEXICON = {"good": 1.9, "bad": -2.5, "kind": 2.4, "élan": 1.1, "no": -1.2}
TEXTS = ["good", "not bad, kind of GOOD!", None, " \n", "a broken heart was no good but KIND", "ÉLAN! bad!\u2028", "badass", "x " * 50 + "good"]


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "word string, valence double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_words_do_not_leave_the_batch_of_their_text(spark, lexicon):
    """No row per word: texts are cut into words, and the rules applied, batch by batch."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    for kw in ({}, {"lexicon_rows": 1, "block_chars": 40}):
        scores = S.polarity_scores(df, "id", "text", lexicon, **kw)
        plan = scores._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "InArrow" in plan
        assert len(rows(scores)) == 6
    assert rows(scores) == rows(S.polarity_scores(df, "id", "text", lexicon))


def test_scores_do_not_depend_on_the_batches(monkeypatch):
    ids, texts = pa.array(range(len(TEXTS))), pa.array(TEXTS)
    runs = []
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(S, "BATCH_BYTES", size)
        found = S._scored(ids, texts, pa.array(list(LEXICON)), np.array(list(LEXICON.values())))
        runs.append([tuple(r.values()) for b in found for r in b.to_pylist()])
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 6
    assert runs[0][0] == (0, 0, 0, 1, 1_900_000, 2_900_000, 0, 1)
    assert [r[-1] for r in runs[0]] == [1, 2, 3, 1, 0, 1]


def test_texts_are_not_moved_to_meet_their_labels(spark, tmp_path, monkeypatch):
    docs = [*enumerate(TEXTS), (0, "bad"), (None, "good"), (None, "good")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(0, "q", False), (0, "q", True), (1, "q", False), (6, None, None), (6, "q", False), (None, "q", False), (99, "q", False)]
    spark.createDataFrame(labels, "doc_id long, quality string, toxic boolean").write.parquet(str(tmp_path / "labels.parquet"))
    seen, scores = [], R.polarity_scores
    monkeypatch.setattr(R, "polarity_scores", lambda texts, *a, **kw: seen.append(texts) or scores(texts, *a, **kw))
    d = str(tmp_path)
    got = rows(R.q_lexicon_sentiment(spark, d))
    assert len(seen) == 1 and "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    reviews = R.V.reviews(spark, d)
    want = scores(reviews, "id", "text", R.V.lexicon(spark, d))  # labels repeat the texts
    want = reviews.select("id").join(want, "id", "left").na.fill(0.0, ["neg", "neu", "pos", "compound"])
    assert got == rows(want) and len(got) == 4 * 4 + 6 + 2 * 2 + 2


def test_extreme_reviews_are_picked_without_texts(spark, tmp_path, monkeypatch):
    """Texts meet only the two picks; they are in no other join."""
    docs = [(0, "good bad"), (5, "good good cow"), (10, "good good cow"), (20, "cow"), (4, "bad cow"), (9, "bad bad"), (9, "bad bad"),
            (14, "bad bad"), (1, "bad"), (2, "good"), (None, "good"), (25, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, "q", False), (5, "q", True)], "doc_id long, quality string, toxic boolean").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(R.V, "lexicon", lambda *_: spark.createDataFrame(list(LEXICON.items()), "word string, valence double"))
    picks = R.q_reviews_extreme_text(spark, str(tmp_path))
    assert picks.columns == ["pick", "id", "text"]
    assert [tuple(r) for r in picks.collect()] == [("most positive 1-star", 5, "good good cow"), ("most negative 5-star", 9, "bad bad")]
    scans = [x for x in picks._jdf.queryExecution().sparkPlan().toString().split("\n") if "FileScan" in x]
    assert len(scans) > 3 and sum("text:string" in x for x in scans) == 1
    spark.createDataFrame([(1, "bad"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "other" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality string, toxic boolean").write.parquet(str(tmp_path / "other" / "labels.parquet"))
    assert R.q_reviews_extreme_text(spark, str(tmp_path / "other")).collect() == []
