"""Election workflow: sentiment aggregation, outer merge with the vote
history, imputation and new-party baselines, projected 2026 shares,
winners, seat counts, shares, trends and the presentation tables, plus the
growth regressor and the winner classifiers.

Inputs: ``vote_history`` (constituency_no, party, vote_share_2016,
vote_share_2021, winner_2021), ``sentiment_rows`` (constituency_no, party,
sentiment) and ``constituency_lookup`` (constituency_no, constituency_name).

The projection of 2026 is a parameter: the default repeats the last
growth (share_2021 + growth), which SQL can check; ``growth_model`` puts a
fitted random forest in its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orchard.operators.relational import group_argmax, rank_at_most, share_pct, top_k
from orchard.sources import views as V

# fixed values: sentiment labels to scores, and the parties left out
SENTIMENT_SCORE = {"Positive": 1, "Neutral": 0, "Negative": -1}
EXCLUDED_PARTIES = ["CONGRESS", "IND", "PMK"]
HISTORY_EXCLUDED_PARTY = "tvk"
SPLIT_SEED = 42
YEAR_COLS = {2016: "vote_share_2016", 2021: "vote_share_2021", 2026: "predicted_vote_share_2026"}


def sentiment_avg(sent: DataFrame) -> DataFrame:
    """Map labels to -1/0/1 (others NULL) and average per constituency and
    party; NULL scores are skipped, an all-NULL group averages to NULL."""
    m = F.create_map(*[x for k, v in SENTIMENT_SCORE.items() for x in (F.lit(k), F.lit(v))])
    score = F.try_element_at(m, F.col("sentiment"))
    return (sent.withColumn("score", score).groupBy("constituency_no", "party")
            .agg(F.avg("score").alias("avg_sentiment_score")))


def merged(hist: DataFrame, sent: DataFrame) -> DataFrame:
    """Full outer merge on (constituency_no, party) with NULL keys matching,
    then fill, upper-case, party filter, baseline for new parties, growth.
    ``party_raw`` keeps the spelling before upper-casing (merge order)."""
    s = sentiment_avg(sent).alias("s")
    h = hist.alias("h")
    on = F.col("h.constituency_no").eqNullSafe(F.col("s.constituency_no")) & \
        F.col("h.party").eqNullSafe(F.col("s.party"))
    j = h.join(s, on, "full").select(
        F.coalesce("h.constituency_no", "s.constituency_no").alias("constituency_no"),
        F.coalesce("h.party", "s.party").alias("party_raw"),
        F.col("h.vote_share_2016"), F.col("h.vote_share_2021"), F.col("h.winner_2021"),
        F.col("s.avg_sentiment_score"))
    j = j.na.fill({"avg_sentiment_score": 0.0, "vote_share_2016": 0.0, "vote_share_2021": 0.0,
                   "winner_2021": False})
    j = j.withColumn("party", F.upper("party_raw"))
    j = j.where(F.coalesce(~F.col("party").isin(EXCLUDED_PARTIES), F.lit(True)))
    new = (F.col("vote_share_2016") == 0) & (F.col("vote_share_2021") == 0)
    lift = F.greatest(F.col("avg_sentiment_score"), F.lit(0.0)) + 1
    j = j.select("constituency_no", "party", "party_raw", "winner_2021", "avg_sentiment_score",
                 F.when(new, 9 * lift).otherwise(F.col("vote_share_2016")).alias("vote_share_2016"),
                 F.when(new, 20 * lift).otherwise(F.col("vote_share_2021")).alias("vote_share_2021"))
    return j.withColumn("growth_2016_2021", F.col("vote_share_2021") - F.col("vote_share_2016"))


def projected(m: DataFrame, growth_model=None) -> DataFrame:
    """Add predicted growth and the projected 2026 share."""
    if growth_model is None:
        m = m.withColumn("predicted_growth_2026", F.col("growth_2016_2021"))
    else:
        m = growth_model(m)
    return m.withColumn("predicted_vote_share_2026", F.col("vote_share_2021") + F.col("predicted_growth_2026"))


def base(spark, d, growth_model=None) -> DataFrame:
    return projected(merged(V.vote_history(spark, d), V.sentiment_rows(spark, d)), growth_model)


def forest_base(spark, d) -> DataFrame:
    """As ``base``, with the growth that the forest predicts instead of the last growth repeated."""
    from orchard.operators.models import with_forest_growth
    return base(spark, d, lambda m: with_forest_growth(m, SPLIT_SEED))


def win_counts(p: DataFrame) -> DataFrame:
    """Seats by party and their share in percent."""
    counts = winners(p).groupBy(F.col("predicted_winner").alias("party")).agg(F.count(F.lit(1)).alias("constituencies_won"))
    return share_pct(counts, "constituencies_won").withColumn("share_pct", F.round("share_pct", 6)) \
        .orderBy(F.desc("constituencies_won"), "party")


def winners(p: DataFrame) -> DataFrame:
    """Party with the highest projected share per constituency (first in
    merge order on ties)."""
    return group_argmax(p, ["constituency_no"], "predicted_vote_share_2026", "party_raw",
                        {"predicted_winner": F.col("party"),
                         "predicted_vote_share_2026": F.col("predicted_vote_share_2026")})


def historical_winners(p: DataFrame) -> DataFrame:
    return group_argmax(p, ["constituency_no"], "vote_share_2021", "party_raw",
                        {"historical_winner": F.col("party")})


def with_winner_label(p: DataFrame) -> DataFrame:
    hw = historical_winners(p)
    return (p.join(hw, "constituency_no", "left")
            .withColumn("historical_winner_label",
                        F.coalesce((F.col("party") == F.col("historical_winner")).cast("int"), F.lit(0))))


def party_shares(p: DataFrame, value: str, k: int = 6) -> DataFrame:
    """Per constituency: first value per party, clipped at 0, top k, and
    each one's percent of the top-k sum (constituencies whose sum is 0 are
    left out)."""
    firsts = p.groupBy("constituency_no", "party").agg(F.min_by(F.col(value), F.col("party_raw")).alias("v"))
    clipped = firsts.withColumn("v", F.when(F.col("v").isNotNull(), F.greatest(F.col("v"), F.lit(0.0))))
    top = rank_at_most(clipped, ["constituency_no"], [F.desc_nulls_last("v"), F.asc("party")], k, "_rn",
                       F.row_number)
    total = F.sum("v").over(Window.partitionBy("constituency_no"))
    return (top.withColumn("_total", total).where(F.col("_total") > 0)
            .select("constituency_no", "party", F.round("v", 6).alias(value),
                    F.round(100 * F.col("v") / F.col("_total"), 6).alias("share_pct")))


# ------------------------------------------------------------------ queries

def q_election_sentiment_avg(spark, d):
    return sentiment_avg(V.sentiment_rows(spark, d)).withColumn(
        "avg_sentiment_score", F.round("avg_sentiment_score", 6))


_MERGE_COLS = ["constituency_no", "party", "vote_share_2016", "vote_share_2021", "winner_2021",
               "avg_sentiment_score", "growth_2016_2021"]


def _rounded(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in ("vote_share_2016", "vote_share_2021",
                                                        "avg_sentiment_score", "growth_2016_2021",
                                                        "predicted_vote_share_2026") else F.col(c)
                       for c in cols])


def q_election_merge(spark, d):
    return _rounded(merged(V.vote_history(spark, d), V.sentiment_rows(spark, d)), _MERGE_COLS)


def q_election_winners(spark, d):
    return winners(base(spark, d)).withColumn("predicted_vote_share_2026",
                                              F.round("predicted_vote_share_2026", 6))


def q_election_win_counts(spark, d):
    return win_counts(base(spark, d))


def q_election_top10_share(spark, d):
    sums = base(spark, d).groupBy("party").agg(F.sum("predicted_vote_share_2026").alias("v"))
    top = top_k(sums, [F.desc("v"), F.asc("party")], 10)
    total = F.sum("v").over(Window.partitionBy())  # over the ten rows kept
    return top.select("party", F.round("v", 6).alias("predicted_vote_share_sum"),
                      F.round(100 * F.col("v") / total, 6).alias("share_pct"))


def q_election_historical_winner(spark, d):
    return historical_winners(base(spark, d))


def q_election_winner_label(spark, d):
    return with_winner_label(base(spark, d)).select(
        "constituency_no", "party", "historical_winner", "historical_winner_label")


def q_election_named_winners(spark, d):
    from orchard.operators.relational import keep_existing
    w = winners(base(spark, d)).withColumn("predicted_vote_share_2026", F.round("predicted_vote_share_2026", 6))
    lookup = V.constituency_lookup(spark, d)
    shown = ["constituency_no", "constituency_name", "predicted_winner", "predicted_vote_share_2026"]
    return keep_existing(w.join(lookup, "constituency_no", "left"), shown)


def q_election_party_share(spark, d):
    return party_shares(base(spark, d), "predicted_vote_share_2026")


def q_election_exclude_party(spark, d):
    p = base(spark, d)
    kept = p.where(F.coalesce(F.lower("party") != HISTORY_EXCLUDED_PARTY, F.lit(True)))
    return party_shares(kept, "vote_share_2021")


def q_election_trend(spark, d):
    p = _rounded(base(spark, d), ["constituency_no", "party", "party_raw", *YEAR_COLS.values()])
    long = p.unpivot(["constituency_no", "party", "party_raw"], list(YEAR_COLS.values()), "col", "vote_share")
    year = F.lit(None).cast("int")
    for y, c in YEAR_COLS.items():
        year = F.when(F.col("col") == c, F.lit(y)).otherwise(year)
    return long.select("constituency_no", "party", year.alias("year"), "vote_share")


def q_election_year_top10(spark, d):
    p = base(spark, d)
    means = p.groupBy("party").agg(F.avg("vote_share_2016").alias("y2016"), F.avg("vote_share_2021").alias("y2021"))
    long = means.unpivot(["party"], ["y2016", "y2021"], "col", "avg_vote_share").select(
        F.substring("col", 2, 4).cast("int").alias("year"), "party",
        F.round("avg_vote_share", 6).alias("avg_vote_share"))
    return rank_at_most(long, ["year"], [F.desc("avg_vote_share"), F.asc("party")], 10, "rank_in_year",
                        F.row_number)


def options(spark, d) -> DataFrame:
    p = base(spark, d).select("constituency_no").distinct()
    lookup = V.constituency_lookup(spark, d)
    u = p.join(lookup, "constituency_no", "left")
    return u.select(F.concat(F.col("constituency_name"), F.lit(" ("), F.col("constituency_no").cast("string"),
                             F.lit(")")).alias("display"), "constituency_no")


def q_election_options(spark, d):
    return options(spark, d)


def q_election_compare(spark, d):
    """Side-by-side projected shares for consecutive constituency pairs
    (every constituency against the next number present)."""
    opts = options(spark, d).select("constituency_no")
    pairs = opts.alias("a").join(opts.alias("b"), F.col("b.constituency_no") == F.col("a.constituency_no") + 1) \
        .select(F.col("a.constituency_no").alias("left_no"), F.col("b.constituency_no").alias("right_no"))
    shares = party_shares(base(spark, d), "predicted_vote_share_2026")
    left = pairs.join(shares.withColumnRenamed("constituency_no", "left_no"), "left_no") \
        .select("left_no", "right_no", F.lit("left").alias("side"), "party", "predicted_vote_share_2026", "share_pct")
    right = pairs.join(shares.withColumnRenamed("constituency_no", "right_no"), "right_no") \
        .select("left_no", "right_no", F.lit("right").alias("side"), "party", "predicted_vote_share_2026", "share_pct")
    return left.unionByName(right)


def q_election_growth_mse(spark, d):
    from orchard.operators.models import growth_forest_mse
    return growth_forest_mse(merged(V.vote_history(spark, d), V.sentiment_rows(spark, d)), SPLIT_SEED)


def q_election_forest_winners(spark, d):
    """Winners by the forest's projection (``election_winners`` repeats the last growth)."""
    return winners(forest_base(spark, d)).withColumn("predicted_vote_share_2026", F.round("predicted_vote_share_2026", 6))


def q_election_forest_win_counts(spark, d):
    """Seats by party by the forest's projection."""
    return win_counts(forest_base(spark, d))


def q_election_forest_party_share(spark, d):
    """Top party shares of every constituency by the forest's projection."""
    return party_shares(forest_base(spark, d), "predicted_vote_share_2026")


def _clf_input(spark, d):
    from orchard.operators.sampling import hash_split
    p = with_winner_label(base(spark, d))
    return hash_split(p.withColumn("row_key", F.concat_ws("|", F.col("constituency_no").cast("string"),
                                                          F.col("party_raw"))), "row_key", SPLIT_SEED)


CLF_FEATURES = ["vote_share_2016", "vote_share_2021", "avg_sentiment_score", "growth_2016_2021"]


def q_election_model_accuracy(spark, d):
    from orchard.operators.models import classifier_accuracies
    return classifier_accuracies(_clf_input(spark, d), CLF_FEATURES, "historical_winner_label", key_col="row_key")


def q_soft_vote(spark, d):
    from orchard.operators.models import soft_vote_scores
    return soft_vote_scores(_clf_input(spark, d), CLF_FEATURES, "historical_winner_label", "row_key")


QUERIES = {
    "election_sentiment_avg": q_election_sentiment_avg,
    "election_merge": q_election_merge,
    "election_winners": q_election_winners,
    "election_win_counts": q_election_win_counts,
    "election_top10_share": q_election_top10_share,
    "election_historical_winner": q_election_historical_winner,
    "election_winner_label": q_election_winner_label,
    "election_named_winners": q_election_named_winners,
    "election_party_share": q_election_party_share,
    "election_exclude_party": q_election_exclude_party,
    "election_trend": q_election_trend,
    "election_year_top10": q_election_year_top10,
    "election_options": q_election_options,
    "election_compare": q_election_compare,
    "election_forest_winners": q_election_forest_winners,
    "election_forest_win_counts": q_election_forest_win_counts,
    "election_forest_party_share": q_election_forest_party_share,
    "election_growth_mse": q_election_growth_mse,
    "election_model_accuracy": q_election_model_accuracy,
    "soft_vote": q_soft_vote,
}

# ------------------------------------------------------------- DuckDB oracle

_VIEWS = ("vote_history", "sentiment_rows", "constituency_lookup")
_STEPS = """sagg AS (SELECT constituency_no, party, avg(CASE sentiment WHEN 'Positive' THEN 1 WHEN 'Neutral' THEN 0
    WHEN 'Negative' THEN -1 END) AS avg_sentiment_score FROM sentiment_rows GROUP BY constituency_no, party),
j AS (SELECT coalesce(h.constituency_no, s.constituency_no) AS constituency_no, coalesce(h.party, s.party) AS party_raw,
    coalesce(h.vote_share_2016, 0.0) AS s16, coalesce(h.vote_share_2021, 0.0) AS s21,
    coalesce(h.winner_2021, false) AS winner_2021, coalesce(s.avg_sentiment_score, 0.0) AS avg_sentiment_score
    FROM vote_history h FULL OUTER JOIN sagg s
    ON h.constituency_no IS NOT DISTINCT FROM s.constituency_no AND h.party IS NOT DISTINCT FROM s.party),
m AS (SELECT constituency_no, upper(party_raw) AS party, party_raw, winner_2021, avg_sentiment_score,
    CASE WHEN s16 = 0 AND s21 = 0 THEN 9 * (greatest(avg_sentiment_score, CAST(0 AS DOUBLE)) + 1) ELSE s16 END AS vote_share_2016,
    CASE WHEN s16 = 0 AND s21 = 0 THEN 20 * (greatest(avg_sentiment_score, CAST(0 AS DOUBLE)) + 1) ELSE s21 END AS vote_share_2021
    FROM j WHERE coalesce(upper(party_raw) NOT IN ('CONGRESS', 'IND', 'PMK'), true)),
p AS (SELECT *, vote_share_2021 - vote_share_2016 AS growth_2016_2021,
    vote_share_2021 + (vote_share_2021 - vote_share_2016) AS predicted_vote_share_2026 FROM m),
w AS (SELECT constituency_no, party AS predicted_winner, predicted_vote_share_2026 FROM (
    SELECT *, row_number() OVER (PARTITION BY constituency_no ORDER BY predicted_vote_share_2026 DESC, party_raw) AS rn
    FROM p) x WHERE rn = 1),
hw AS (SELECT constituency_no, party AS historical_winner FROM (
    SELECT *, row_number() OVER (PARTITION BY constituency_no ORDER BY vote_share_2021 DESC, party_raw) AS rn
    FROM p) x WHERE rn = 1),
opts AS (SELECT l.constituency_name || ' (' || CAST(c.constituency_no AS VARCHAR) || ')' AS display, c.constituency_no
    FROM (SELECT DISTINCT constituency_no FROM p) c LEFT JOIN constituency_lookup l ON c.constituency_no = l.constituency_no)"""


def _shares(src: str, value: str) -> str:
    return f"""(SELECT constituency_no, party, round(v, 6) AS {value}, round(100 * v / total, 6) AS share_pct FROM (
      SELECT *, sum(v) OVER (PARTITION BY constituency_no) AS total FROM (
        SELECT *, row_number() OVER (PARTITION BY constituency_no ORDER BY v DESC NULLS LAST, party) AS rn FROM (
          SELECT constituency_no, party, CASE WHEN v0 IS NOT NULL THEN greatest(v0, CAST(0 AS DOUBLE)) END AS v FROM (
            SELECT constituency_no, party, arg_min({value}, party_raw) AS v0 FROM {src} GROUP BY constituency_no, party) a) b) c
        WHERE rn <= 6) d WHERE total > 0)"""


def _e(sql: str) -> str:
    body = V.with_views("SELECT 1", *_VIEWS)
    return body[: body.rindex("\nSELECT 1")] + f",\n{_STEPS}\n{sql}"


def _r(c):
    return f"round({c}, 6) AS {c}"


ORACLE = {
    "election_sentiment_avg": _e("SELECT constituency_no, party, round(avg_sentiment_score, 6) AS avg_sentiment_score FROM sagg"),
    "election_merge": _e(f"""SELECT constituency_no, party, {_r('vote_share_2016')}, {_r('vote_share_2021')}, winner_2021,
        {_r('avg_sentiment_score')}, {_r('growth_2016_2021')} FROM p"""),
    "election_winners": _e(f"SELECT constituency_no, predicted_winner, {_r('predicted_vote_share_2026')} FROM w"),
    "election_win_counts": _e("""SELECT party, constituencies_won, round(100 * constituencies_won / sum(constituencies_won) OVER (), 6) AS share_pct
        FROM (SELECT predicted_winner AS party, count(*) AS constituencies_won FROM w GROUP BY predicted_winner) c
        ORDER BY constituencies_won DESC, party"""),
    "election_top10_share": _e("""SELECT party, round(v, 6) AS predicted_vote_share_sum, round(100 * v / sum(v) OVER (), 6) AS share_pct
        FROM (SELECT party, sum(predicted_vote_share_2026) AS v FROM p GROUP BY party ORDER BY v DESC, party LIMIT 10) t"""),
    "election_historical_winner": _e("SELECT * FROM hw"),
    "election_winner_label": _e("""SELECT p.constituency_no, p.party, hw.historical_winner,
        coalesce(CAST(p.party = hw.historical_winner AS INTEGER), 0) AS historical_winner_label
        FROM p LEFT JOIN hw ON p.constituency_no = hw.constituency_no"""),
    "election_named_winners": _e(f"""SELECT w.constituency_no, l.constituency_name, w.predicted_winner,
        {_r('w.predicted_vote_share_2026').replace(' AS w.', ' AS ')} FROM w LEFT JOIN constituency_lookup l
        ON w.constituency_no = l.constituency_no"""),
    "election_party_share": _e("SELECT * FROM " + _shares("p", "predicted_vote_share_2026") + " s"),
    "election_exclude_party": _e("SELECT * FROM " + _shares(
        "(SELECT * FROM p WHERE coalesce(lower(party) <> 'tvk', true))", "vote_share_2021") + " s"),
    "election_trend": _e(" UNION ALL ".join(
        f"SELECT constituency_no, party, CAST({y} AS INTEGER) AS year, round({c}, 6) AS vote_share FROM p"
        for y, c in YEAR_COLS.items())),
    "election_year_top10": _e("""SELECT year, party, avg_vote_share, CAST(rank_in_year AS INTEGER) AS rank_in_year FROM (
        SELECT *, row_number() OVER (PARTITION BY year ORDER BY avg_vote_share DESC, party) AS rank_in_year FROM (
          SELECT 2016 AS year, party, round(avg(vote_share_2016), 6) AS avg_vote_share FROM p GROUP BY party
          UNION ALL SELECT 2021, party, round(avg(vote_share_2021), 6) FROM p GROUP BY party) u) r
        WHERE rank_in_year <= 10"""),
    "election_options": _e("SELECT * FROM opts"),
    "election_compare": _e(f"""SELECT * FROM (WITH pairs AS (SELECT a.constituency_no AS left_no, b.constituency_no AS right_no
          FROM opts a JOIN opts b ON b.constituency_no = a.constituency_no + 1),
        sh AS {_shares('p', 'predicted_vote_share_2026')}
        SELECT left_no, right_no, 'left' AS side, party, predicted_vote_share_2026, share_pct
          FROM pairs JOIN sh ON sh.constituency_no = pairs.left_no
        UNION ALL
        SELECT left_no, right_no, 'right' AS side, party, predicted_vote_share_2026, share_pct
          FROM pairs JOIN sh ON sh.constituency_no = pairs.right_no) z"""),
}
