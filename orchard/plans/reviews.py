"""Review-text workflow: star counts, tokens, rule tags, proper-noun
entities, lexicon sentiment, a trained text classifier as the second
scorer, and the tables that compare the two.

Input: ``reviews`` (id, score, text, quality, toxic) over the documents.
Every review is scored (the original capped the run at its first 500 rows
to save time; the Spark jobs have no need to).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orchard.operators.scorer import BUCKETS, UNIT, naive_bayes_loader, score_text
from orchard.operators.stats import fixed_corr, fixed_point_mean_std
from orchard.operators.sentiment import oracle_ctes, polarity_scores
from orchard.operators.text import CASED_PATTERN, CLOSED_TAGS, proper_noun_runs, rule_tag, softmax_columns, tokenize
from orchard.session import scratch_path
from orchard.sources import views as V
from orchard.sources.files import written
from orchard.sources.tables import table

SCORES = ["neg", "neu", "pos", "compound"]


def lexicon_table(spark, d) -> DataFrame:
    """(id, vader_neg, vader_neu, vader_pos, vader_compound) for every
    review; a review without any word scores 0 everywhere."""
    path = scratch_path(spark, "lexicon")  # the lexicon is an input table, read by several steps
    V.lexicon(spark, d).write.parquet(path)
    lexicon = spark.read.schema("word string, valence double").parquet(path)
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    s = polarity_scores(V.review_texts(spark, d), "id", "text", lexicon, repeats=labels)
    s = written(s, "lexicon-scores")  # some queries read the scores more than once
    return V.reviews(spark, d).select("id").join(s, "id", "left").select("id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"vader_{c}") for c in SCORES])


def star_class(score: str = "score"):
    """Three sentiment classes from the stars: 1-2 neg, 3 neu, 4-5 pos."""
    s = F.col(score)
    return F.when(s <= 2, 0.0).when(s == 3, 1.0).otherwise(2.0)


CLASSES = ["neg", "neu", "pos"]
MODEL = [f"model_{c}" for c in CLASSES]
MAX_WORDS = 512  # the window of the limited scorer


def scored_texts(spark, d, max_words: int | None = None) -> DataFrame:
    """(id, scores, error) of every review by a naive Bayes model of the star classes."""
    r = V.reviews(spark, d).withColumn("label", star_class())
    load = naive_bayes_loader(r, "text", "label", len(CLASSES), max_words=max_words)
    return score_text(r, "id", "text", load, len(CLASSES))


def model_table(spark, d) -> DataFrame:
    """(id, model_neg, model_neu, model_pos): probabilities of the texts that could be scored."""
    return scored_texts(spark, d).where(F.col("error").isNull()).select("id", *_probabilities())


def _probabilities():
    return softmax_columns([F.col("scores")[i] for i in range(len(CLASSES))], MODEL, 4)


def joined_scores(spark, d) -> DataFrame:
    r = V.reviews(spark, d).select("id", "score", "quality", "toxic")
    m = model_table(spark, d)
    return r.join(lexicon_table(spark, d), "id", "left").join(m, "id", "left")


# ------------------------------------------------------------------ queries

def q_reviews_score_counts(spark, d):
    return V.reviews(spark, d).groupBy("score").agg(F.count(F.lit(1)).alias("n_reviews")).orderBy("score")


def q_text_tokens(spark, d):
    return tokenize(V.reviews(spark, d), "id", "text", out="word")


def q_lexicon_sentiment(spark, d):
    return lexicon_table(spark, d)


BOOT_REPLICATES, BOOT_SEED = 200, 11


def q_reviews_mean_by_score(spark, d):
    """Mean and std of each lexicon score per star, plus a 95% bootstrap
    interval (Poisson weights) for the mean compound score: the numbers
    behind a bar chart with error bars."""
    from orchard.operators.sampling import bootstrap_mean_ci
    j = V.reviews(spark, d).select("id", "score").join(lexicon_table(spark, d), "id")
    aggs = []
    for c in SCORES:
        aggs += fixed_point_mean_std(F.col(f"vader_{c}"), 4 if c == "compound" else 3, c)
    ci = bootstrap_mean_ci(j, "id", ["score"], "vader_compound", 4, BOOT_REPLICATES, BOOT_SEED)
    return j.groupBy("score").agg(F.count(F.lit(1)).alias("n_reviews"), *aggs).join(ci, "score", "left")


def q_reviews_extreme_text(spark, d):
    """The 1-star review of the highest positive score and the 5-star one of the highest negative
    score (ties by smaller id): both are picked in one pass without texts, and only theirs are looked up."""
    j = V.reviews(spark, d).select("id", "score").where(F.col("score").isin(1, 5)).join(lexicon_table(spark, d), "id")
    found = F.when(F.col("score") == 1, F.col("vader_pos")).otherwise(F.col("vader_neg"))
    picks = j.groupBy("score").agg(F.min(F.struct((-found).alias("k"), F.col("id"))).alias("r")).select("score", "r.id")
    pick = F.when(F.col("score") == 1, "most positive 1-star").otherwise("most negative 5-star").alias("pick")
    return (V.review_texts(spark, d).join(F.broadcast(picks), "id").groupBy("score", "id").agg(F.min("text").alias("text"))
            .orderBy("score").select(pick, "id", "text"))


def q_reviews_extreme_text_model(spark, d):
    """The model-score picks of the same report: the 1-star review the
    text model finds most positive and the 5-star one it finds most
    negative (ties by smaller id), one aggregate pass each."""
    m = model_table(spark, d)
    j = V.reviews(spark, d).select("id", "score", "text").join(m, "id")
    one = j.where(F.col("score") == 1).agg(
        F.min_by(F.struct("id", "text"), F.struct((-F.col("model_pos")).alias("k"), F.col("id"))).alias("r")) \
        .select(F.lit("model: most positive 1-star").alias("pick"), "r.*")
    five = j.where(F.col("score") == 5).agg(
        F.min_by(F.struct("id", "text"), F.struct((-F.col("model_neg")).alias("k"), F.col("id"))).alias("r")) \
        .select(F.lit("model: most negative 5-star").alias("pick"), "r.*")
    return one.unionByName(five).where(F.col("id").isNotNull())


def q_text_tags(spark, d):
    t = tokenize(V.reviews(spark, d), "id", "text", CASED_PATTERN, lower=False)
    return t.withColumn("tag", rule_tag(F.col("token"), F.col("pos")))


def q_text_entities(spark, d):
    """Runs of consecutive proper-noun tokens (the rule tagger's NNP)."""
    return proper_noun_runs(V.reviews(spark, d), "id", "text")


def q_model_sentiment(spark, d):
    return model_table(spark, d)


def q_model_sentiment_limited(spark, d):
    """One row per review from a scorer with a window of MAX_WORDS words: its probabilities, or
    why it could not be scored."""
    return scored_texts(spark, d, MAX_WORDS).select("id", *_probabilities(), "error")


def q_model_sentiment_errors(spark, d):
    """The reviews that the text model cannot score, with the reason."""
    return scored_texts(spark, d).where(F.col("error").isNotNull()).select("id", "error")


def q_reviews_scores_join(spark, d):
    return joined_scores(spark, d)


def q_reviews_scorer_agreement(spark, d):
    """Correlations of both scorers per star; NULL where a scorer gives one value throughout."""
    j = joined_scores(spark, d).withColumn("model_compound", F.col("model_pos") - F.col("model_neg"))
    aggs = [F.round(fixed_corr(F.col(f"vader_{c}"), F.col(f"model_{c}")), 6).alias(f"corr_{c}") for c in SCORES]
    return j.groupBy("score").agg(F.count(F.lit(1)).alias("n_reviews"), *aggs)


QUERIES = {
    "reviews_score_counts": q_reviews_score_counts,
    "text_tokens": q_text_tokens,
    "lexicon_sentiment": q_lexicon_sentiment,
    "reviews_mean_by_score": q_reviews_mean_by_score,
    "reviews_extreme_text": q_reviews_extreme_text,
    "reviews_extreme_text_model": q_reviews_extreme_text_model,
    "text_tags": q_text_tags,
    "text_entities": q_text_entities,
    "model_sentiment": q_model_sentiment,
    "model_sentiment_limited": q_model_sentiment_limited,
    "model_sentiment_errors": q_model_sentiment_errors,
    "reviews_scores_join": q_reviews_scores_join,
    "reviews_scorer_agreement": q_reviews_scorer_agreement,
}

# ------------------------------------------------------------- DuckDB oracle


def _list(words):
    return ", ".join(f"'{w}'" for w in words)


_LEX = oracle_ctes() + """,
lexs AS (SELECT r.id, coalesce(neg, 0.0) AS vader_neg, coalesce(neu, 0.0) AS vader_neu, coalesce(pos, 0.0) AS vader_pos,
    coalesce(compound, 0.0) AS vader_compound FROM reviews r LEFT JOIN scored s ON r.id = s.id)"""


def _log_sql(p: str) -> str:
    return f"CAST(floor(ln({p}) * {UNIT} + 0.5) AS BIGINT)"


def _per_class(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(c=c, name=name) for c, name in enumerate(MODEL))


_MODEL = f"""star AS (SELECT id, CASE WHEN score <= 2 THEN 0 WHEN score = 3 THEN 1 ELSE 2 END AS c,
    regexp_extract_all(lower(text), '\\p{{L}}+') AS words FROM reviews),
occurrence AS (SELECT id, c, unnest(words) AS w FROM star),
bucketed AS (SELECT w, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {BUCKETS} AS b FROM (SELECT DISTINCT w FROM occurrence) u),
counted AS (SELECT b, {_per_class("count(*) FILTER (WHERE c = {c}) AS n{c}")} FROM occurrence JOIN bucketed USING (w) GROUP BY b),
total AS (SELECT {_per_class("sum(n{c}) AS t{c}")} FROM counted),
weight AS (SELECT b, {_per_class(_log_sql("(n{c} + 1) / (t{c} + " + str(BUCKETS) + ")") + " AS w{c}")} FROM counted, total),
prior AS (SELECT {_per_class(_log_sql("(count(*) FILTER (WHERE c = {c}) + 1) / (count(*) + 3)") + " AS p{c}")} FROM star),
summed AS (SELECT id, count(*) AS n_words, {_per_class("CAST(sum(w{c}) + any_value(p{c}) AS DOUBLE) / " + str(UNIT) + " AS s{c}")}
    FROM occurrence JOIN bucketed USING (w) JOIN weight USING (b), prior GROUP BY id),
powers AS (SELECT id, n_words, {_per_class("exp(s{c} - greatest(s0, s1, s2)) AS e{c}")} FROM summed),
msc AS (SELECT id, n_words, {_per_class("round(e{c} / (e0 + e1 + e2), 4) AS {name}")} FROM powers)"""
_BOTH = _LEX + ",\n" + _MODEL + """,
both_scores AS (SELECT r.id, r.score, r.quality, r.toxic, l.* EXCLUDE (id), m.* EXCLUDE (id, n_words)
    FROM reviews r LEFT JOIN lexs l ON r.id = l.id LEFT JOIN msc m ON r.id = m.id)"""


def _tag_sql(tok: str, pos: str) -> str:
    parts = [f"WHEN lower({tok}) IN ({_list(w)}) THEN '{t}'" for t, w in CLOSED_TAGS.items()]
    low = f"lower({tok})"
    parts += [f"WHEN {pos} > 0 AND regexp_matches({tok}, '^\\p{{Lu}}\\p{{Ll}}') THEN 'NNP'",
              f"WHEN suffix({low}, 'ing') AND length({low}) > 4 THEN 'VBG'",
              f"WHEN suffix({low}, 'ed') AND length({low}) > 3 THEN 'VBD'",
              f"WHEN suffix({low}, 'ly') AND length({low}) > 3 THEN 'RB'",
              f"WHEN suffix({low}, 's') AND length({low}) > 3 THEN 'NNS'"]
    return "CASE " + " ".join(parts) + " ELSE 'NN' END"


_CASED = """ct AS (SELECT id AS doc_id, CAST(generate_subscripts(w,1)-1 AS INTEGER) AS pos, unnest(w) AS token
    FROM (SELECT id, regexp_extract_all(text, '\\p{L}+') w FROM reviews) x)"""


def _fp_sql(col: str, decimals: int, prefix: str) -> str:
    k = 10 ** decimals
    x = f"CAST(round({col} * {k}) AS DECIMAL(38,0))"
    n = f"CAST(count({col}) AS DECIMAL(38,0))"
    s1, s2 = f"sum({x})", f"sum({x} * {x})"
    return (f"CAST({s1} AS DOUBLE) / (CAST({n} AS DOUBLE) * {k}) AS mean_{prefix}, "
            f"CASE WHEN {n} > 1 THEN sqrt(CAST({n} * {s2} - {s1} * {s1} AS DOUBLE) / CAST({n} * ({n} - 1) AS DOUBLE)) / {k} END AS std_{prefix}")


def _corr_sql(x: str, y: str) -> str:
    a, b = (f"CAST(CASE WHEN {x} + {y} IS NOT NULL THEN round({c} * 10000) END AS DECIMAL(38,0))" for c in (x, y))
    n = f"CAST(count({x} + {y}) AS DECIMAL(38,0))"
    var = [f"CAST({n} * sum({c} * {c}) - sum({c}) * sum({c}) AS DOUBLE)" for c in (a, b)]
    return (f"CASE WHEN {var[0]} > 0 AND {var[1]} > 0 THEN CAST({n} * sum({a} * {b}) - sum({a}) * sum({b}) AS DOUBLE) "
            f"/ (sqrt({var[0]}) * sqrt({var[1]})) END")


def _boot_sql() -> str:
    from orchard.operators.sampling import poisson_thresholds
    th = poisson_thresholds()
    h8 = f"substr(md5(concat('{BOOT_SEED}:', CAST(r.id AS VARCHAR), ':', CAST(b.rep AS VARCHAR))), 1, 8)"
    w = "CASE " + " ".join(f"WHEN {h8} < '{t}' THEN {k}" for k, t in enumerate(th)) + f" ELSE {len(th)} END"
    return f"""SELECT score, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM (
      SELECT score, rep, CAST(sum(CAST({w} AS DECIMAL(38,0)) * CAST(round(vader_compound * 10000) AS DECIMAL(38,0))) AS DOUBLE)
             / (CAST(sum(CAST({w} AS DECIMAL(38,0))) AS DOUBLE) * 10000) AS m
      FROM reviews r JOIN lexs l ON r.id = l.id CROSS JOIN (SELECT unnest(range(0, {BOOT_REPLICATES})) AS rep) b
      GROUP BY score, rep) t WHERE m IS NOT NULL GROUP BY score"""


def _r(sql, extra):
    body = V.with_views("SELECT 1", "reviews", "lexicon")
    return body[: body.rindex("\nSELECT 1")] + f",\n{extra}\n{sql}"


ORACLE = {
    "reviews_score_counts": V.with_views(
        "SELECT score, count(*) AS n_reviews FROM reviews GROUP BY score ORDER BY score", "reviews"),
    "text_tokens": V.with_views(
        """SELECT id AS doc_id, CAST(generate_subscripts(w,1)-1 AS INTEGER) AS pos, unnest(w) AS word
           FROM (SELECT id, regexp_extract_all(lower(text), '\\p{L}+') w FROM reviews) x""", "reviews"),
    "lexicon_sentiment": _r("SELECT * FROM lexs", _LEX),
    "reviews_mean_by_score": _r(
        "SELECT * FROM (SELECT r.score, count(*) AS n_reviews, " + ", ".join(_fp_sql(f"vader_{c}", 4 if c == "compound" else 3, c)
                                                              for c in SCORES) +
        " FROM reviews r JOIN lexs l ON r.id = l.id GROUP BY r.score) m LEFT JOIN (" + _boot_sql() + ") b USING (score)",
        _LEX),
    "reviews_extreme_text": _r(
        """SELECT * FROM (SELECT 'most positive 1-star' AS pick, id, text FROM (SELECT r.id, r.text FROM reviews r
             JOIN lexs l ON r.id = l.id WHERE r.score = 1 ORDER BY l.vader_pos DESC, r.id LIMIT 1) a
           UNION ALL SELECT 'most negative 5-star', id, text FROM (SELECT r.id, r.text FROM reviews r
             JOIN lexs l ON r.id = l.id WHERE r.score = 5 ORDER BY l.vader_neg DESC, r.id LIMIT 1) b) u""", _LEX),
    "text_tags": _r(f"SELECT doc_id, pos, token, {_tag_sql('token', 'pos')} AS tag FROM ct", _CASED),
    "reviews_extreme_text_model": _r(
        """SELECT * FROM (SELECT 'model: most positive 1-star' AS pick, id, text FROM (SELECT r.id, r.text FROM reviews r
             JOIN msc m ON r.id = m.id WHERE r.score = 1 ORDER BY m.model_pos DESC, r.id LIMIT 1) a
           UNION ALL SELECT 'model: most negative 5-star', id, text FROM (SELECT r.id, r.text FROM reviews r
             JOIN msc m ON r.id = m.id WHERE r.score = 5 ORDER BY m.model_neg DESC, r.id LIMIT 1) b) u""", _MODEL),
    "model_sentiment": _r(f"SELECT id, {', '.join(MODEL)} FROM msc", _MODEL),
    "model_sentiment_limited": _r(
        f"""SELECT r.id, {_per_class("CASE WHEN n_words <= " + str(MAX_WORDS) + " THEN {name} END AS {name}")},
            CASE WHEN m.id IS NULL THEN 'no words to score' WHEN n_words > {MAX_WORDS} THEN 'more than {MAX_WORDS} words' END AS error
            FROM reviews r LEFT JOIN msc m ON r.id = m.id""", _MODEL),
    "reviews_scores_join": _r("SELECT * FROM both_scores", _BOTH),
    "reviews_scorer_agreement": _r(
        "SELECT score, count(*) AS n_reviews, " + ", ".join(f"round({_corr_sql(f'vader_{c}', f'model_{c}')}, 6) AS corr_{c}" for c in SCORES)
        + " FROM (SELECT *, model_pos - model_neg AS model_compound FROM both_scores) s GROUP BY score", _BOTH),
    "model_sentiment_errors": V.with_views(
        """SELECT id, 'no words to score' AS error FROM reviews
           WHERE coalesce(len(regexp_extract_all(lower(text), '\\p{L}+')), 0) = 0""", "reviews"),
    "text_entities": _r(
        f"""SELECT doc_id, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_tokens,
              arg_min(token, pos) AS first_token, arg_max(token, pos) AS last_token FROM (
              SELECT *, pos - CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS island
              FROM ct WHERE {_tag_sql('token', 'pos')} = 'NNP') n GROUP BY doc_id, island""", _CASED),
}
