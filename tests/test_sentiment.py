"""Lexicon sentiment: published example scores, the rules one by one, and the two joins."""

import pytest

from orchard.operators.sentiment import polarity_scores

# valences of the published lexicon for the words of its own examples
LEXICON = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "great": 3.1, "uncompelling": -0.9, "horrible": -2.5, "bad": -2.5,
           "sux": -1.5, "no": -1.2, "problem": -1.7, "doubt": -1.5, "heart": 3.2, "kind": 2.4, "happy": 2.7}

PUBLISHED = [  # text, neg, neu, pos, compound
    ("VADER is smart, handsome, and funny.", 0.0, 0.254, 0.746, 0.8316),
    ("VADER is smart, handsome, and funny!", 0.0, 0.248, 0.752, 0.8439),
    ("VADER is very smart, handsome, and funny.", 0.0, 0.299, 0.701, 0.8545),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.0, 0.246, 0.754, 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.0, 0.233, 0.767, 0.9342),
    ("VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", 0.0, 0.294, 0.706, 0.9469),
    ("VADER is not smart, handsome, nor funny.", 0.646, 0.354, 0.0, -0.7424),
    ("The book was good.", 0.0, 0.508, 0.492, 0.4404),
    ("At least it isn't a horrible book.", 0.0, 0.678, 0.322, 0.431),
    ("The book was only kind of good.", 0.0, 0.697, 0.303, 0.3832),
    ("The plot was good, but the characters are uncompelling and the dialog is not great.", 0.327, 0.579, 0.094, -0.7042),
    ("Today SUX!", 0.779, 0.221, 0.0, -0.5461),
    ("Not bad at all", 0.0, 0.513, 0.487, 0.431),
]


def scores(spark, texts, **kw):
    lex = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    return {r.id: (r.neg, r.neu, r.pos, r.compound) for r in polarity_scores(df, "id", "text", lex, **kw).collect()}


@pytest.mark.parametrize("kw", [{}, {"lexicon_rows": 3}])  # broadcast and shuffled lexicon
def test_published_examples(spark, kw):
    got = scores(spark, [t for t, *_ in PUBLISHED], **kw)
    assert [(t, *got[i]) for i, (t, *_) in enumerate(PUBLISHED)] == PUBLISHED


def compound(s):
    return round(s / (s * s + 15) ** 0.5, 4)


def test_single_rules(spark):
    cases = {
        "good": 1.9, "good good": 3.8, "so so good": 1.9 + 0.293 + 0.293 * 0.95, "barely good": 1.9 - 0.293, "barely bad": -2.5 + 0.293,
        "never so good": (1.9 + 0.293) * 1.25, "without doubt good": 1.9 + 1.5 * 0.74, "without any good": 1.9 * -0.74,
        "this was never a good book": 1.9 * -0.74, "least good": 1.9 * -0.74, "at least good": 1.9, "no good": -1.2 * 0 + 1.9 * -0.74,
        "he has a broken heart": -2.9, "good but bad": 1.9 * 0.5 - 2.5 * 1.5, "GOOD GOOD": 3.8, "GOOD book": 1.9 + 0.733,
        "good!!!!!!": 1.9 + 4 * 0.292, "good??": 1.9 + 0.36, "good????": 1.9 + 0.96, "good?": 1.9, "bad!": -2.5 - 0.292, "it wasn't good": 1.9 * -0.74,
    }
    got = scores(spark, list(cases))
    for i, (text, s) in enumerate(cases.items()):
        assert abs(got[i][3] - compound(s)) < 2e-4, (text, got[i], compound(s))


def test_odd_texts(spark):
    got = scores(spark, [None, "", " \n\t", "!!! ???", "plain words here", "x " * 50_000 + "good", "GOOD", "good " * 5_000])
    assert 0 not in got and 1 not in got and 2 not in got  # no words: no row
    assert got[3] == (0.0, 1.0, 0.0, 0.0) and got[4] == (0.0, 1.0, 0.0, 0.0)
    assert got[5][3] == compound(1.9) and got[6][3] == compound(1.9)
    assert got[7] == (0.0, 0.0, 1.0, compound(9_500.0))


def test_words_are_asked_by_block_not_by_occurrence(spark):
    """Beyond the broadcast a block asks once for each of its words; no join moves occurrences with their neighbours."""
    lex = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    texts = [t for t, *_ in PUBLISHED] * 3 + [None, "", "no words of it"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    asked = polarity_scores(df, "id", "text", lex, lexicon_rows=3, block_chars=100)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "(low" not in plan.split("Join Inner")[1].split("\n")[0]
    want = {r.id: r for r in polarity_scores(df, "id", "text", lex).collect()}
    assert {r.id: r for r in asked.collect()} == want


def test_repeated_and_null_ids_score_alike_by_both_joins(spark):
    lex = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    rows = [(1, "good"), (1, "good"), (2, "good"), (2, "not bad"), (None, "good"), (None, "good")]
    df = spark.createDataFrame(rows, "id long, text string")
    runs = [sorted(map(str, polarity_scores(df, "id", "text", lex, **kw).collect())) for kw in ({}, {"lexicon_rows": 3})]
    assert runs[0] == runs[1]
