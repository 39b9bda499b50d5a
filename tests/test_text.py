"""Text operators: tokens, neighbour windows across block edges, lexicon
rules, chunking invariants."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from orchard.operators.retrieval import fixed_chunks, split_text
from orchard.operators.text import any_in_previous, lexicon_scores, neighbour_flags, tokenize


def test_blocked_windows_equal_plain_windows(spark):
    words = ["not", "good", "x", "y", "z", "not", "a", "b", "no"] * 7
    df = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
    t = tokenize(df, "id", "text")
    flag = F.col("token").isin("not", "no")
    got = {r.pos: r.neg for r in any_in_previous(t, flag, 3, "neg", block=4).collect()}
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-3, -1)
    want = {r.pos: bool(r.neg) for r in t.withColumn("neg", F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)) == 1).collect()}
    assert got == want
    nb = {r.pos: (r.p, r.n) for r in neighbour_flags(t, flag, "p", "n", block=4).collect()}
    w2 = Window.partitionBy("doc_id").orderBy("pos")
    want2 = {r.pos: (r.p, r.n) for r in t.withColumn("_f", flag).select(
        "pos", F.coalesce(F.lag("_f").over(w2), F.lit(False)).alias("p"),
        F.coalesce(F.lead("_f").over(w2), F.lit(False)).alias("n")).collect()}
    assert nb == want2


def test_lexicon_rules(spark):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, valence double")
    docs = spark.createDataFrame([(1, "good good"), (2, "not good"), (3, "bad but good"), (4, "plain words")],
                                 "id long, text string")
    got = {r.doc_id: r for r in lexicon_scores(tokenize(docs, "id", "text"), lex).collect()}
    assert got[1].compound == round(4 / (16 + 15) ** 0.5, 4)
    assert got[2].compound == round(-1.48 / (1.48 ** 2 + 15) ** 0.5, 4)
    s3 = -2.0 * 0.5 + 2.0 * 1.5
    assert got[3].compound == round(s3 / (s3 ** 2 + 15) ** 0.5, 4)
    assert (got[4].compound, got[4].neu) == (0.0, 1.0)
    for r in got.values():
        assert abs(r.pos + r.neg + r.neu - 1.0) < 0.002


def test_split_text_invariants():
    text = ("word " * 3000 + "\n\n" + "x" * 9000 + "\n" + "line\n" * 500).strip()
    chunks = split_text(text, 7500, 100)
    assert all(0 < len(c) <= 7500 for c in chunks)
    body = "".join(text.split())
    joined = "".join("".join(c.split()) for c in chunks)
    assert len(joined) >= len(body)          # every character is covered (overlap repeats some)
    assert chunks[0].startswith("word") and chunks[-1].endswith("line")
    assert split_text("short text", 7500, 100) == ["short text"]


def test_fixed_chunks_cover_text(spark):
    df = spark.createDataFrame([(1, "a" * 7500), (2, "b" * 7501), (3, "c" * 20000)], "id long, text string")
    got = {}
    for r in fixed_chunks(df, "id", "text").collect():
        got.setdefault(r.id, []).append((r.chunk_start, len(r.chunk)))
    assert got[1] == [(0, 7500)]
    assert sorted(got[2]) == [(0, 7500), (7400, 101)]
    assert sorted(got[3]) == [(0, 7500), (7400, 7500), (14800, 5200)]


def test_proper_noun_runs_match_python(spark):
    import re

    from orchard.operators.text import CLOSED_TAGS, proper_noun_runs
    closed = {w for ws in CLOSED_TAGS.values() for w in ws}
    texts = ["Anna met Bob Smith in New York and The Hague.", "Alice", "see Paris, Rome; then The End",
             "x " * 50 + "Big Long Name Here " * 30, "no names at all", ""]

    def runs(text):
        toks = re.findall("[A-Za-z]+", text)
        flags = [i > 0 and re.match("^[A-Z][a-z]", t) is not None and t.lower() not in closed
                 for i, t in enumerate(toks)]
        out, i = [], 0
        while i < len(toks):
            if flags[i]:
                j = i
                while j + 1 < len(toks) and flags[j + 1]:
                    j += 1
                out.append((i, j, j - i + 1, toks[i], toks[j]))
                i = j + 1
            else:
                i += 1
        return out

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    got = sorted(tuple(r) for r in proper_noun_runs(df, "id", "text").collect())
    want = sorted((k, *r) for k, t in enumerate(texts) for r in runs(t))
    assert got == want


def test_price_extraction_edges(spark):
    from orchard.streaming.prices import extract_prices
    df = spark.createDataFrame(
        [(1, "u1", "2024-01-01", " Shirt &amp; Tie ", "  Rs. 1,299.00 "), (2, "u2", "2024-01-01", "Cap", "price on request"),
         (3, "u3", "2024-01-02", "", "Rs.799")],
        "page_id long, url string, seen_on string, title string, price_text string") \
        .withColumn("seen_on", F.col("seen_on").cast("date"))
    got = {r.page_id: (r.title, r.price) for r in extract_prices(df).collect()}
    assert got == {1: ("Shirt & Tie", 1299.0), 2: ("Cap", None), 3: ("", 799.0)}


def test_first_word_position(spark):
    from orchard.operators.text import first_word_position
    df = spark.createDataFrame([("a butter but x",), ("but",), ("no b-u-t here",), ("x, but; but",), ("",)], "t string")
    got = [r.p for r in df.select(first_word_position(F.col("t"), "but").alias("p")).collect()]
    assert got == [2, 0, None, 1, None]


def test_words_beyond_ascii_are_whole(spark):
    from orchard.operators.text import tokenize
    df = spark.createDataFrame([(1, "El niño über élève, naïve!")], "doc_id long, text string")
    got = [r.token for r in tokenize(df, "doc_id", "text").orderBy("pos").collect()]
    assert got == ["el", "niño", "über", "élève", "naïve"]
