"""The projection from the fitted forest: planted growth is learned, no row is left
out, and winners, seats and shares follow from the projected rows."""

from collections import Counter

import __spark_entry__ as E
from orchard.operators.models import growth_forest_mse, with_forest_growth
from orchard.plans.election import base, forest_base, win_counts, winners
from tests.conftest import SMALL_DIR

SCHEMA = "constituency_no int, party_raw string, vote_share_2016 double, vote_share_2021 double, " \
    "avg_sentiment_score double, growth_2016_2021 double"


def _planted(spark, n=400):
    rows = []
    for i in range(n):
        a, b = float(i * 37 % 101), float(i * 53 % 97)
        rows.append((i, f"p{i % 5}", a, b, float(i % 3 - 1), b - a))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_forest_learns_planted_growth(spark):
    rows, m = _planted(spark)
    growth = [r[-1] for r in rows]
    mean = sum(growth) / len(growth)
    spread = sum((g - mean) ** 2 for g in growth) / len(growth)
    got = growth_forest_mse(m, num_trees=20).first()
    assert got.mse < 0.1 * spread and 0 < got.n_test < len(rows)


def test_forest_keeps_every_row(spark):
    rows, m = _planted(spark, 60)
    odd = m.unionByName(spark.createDataFrame([(999, "q", None, 1.0, 0.0, None), (998, None, 5.0, 6.0, 0.0, 1.0)], SCHEMA))
    got = with_forest_growth(odd.where("growth_2016_2021 is not null or constituency_no = 999"), num_trees=5).collect()
    assert len(got) == len(rows) + 2
    assert [r.constituency_no for r in got if r.predicted_growth_2026 is None] == [999]


def test_projection_feeds_winners_seats_and_shares(spark):
    p = forest_base(spark, SMALL_DIR).cache()
    rows = p.collect()
    assert len(rows) == base(spark, SMALL_DIR).count()
    best = {}
    for r in rows:
        assert abs(r.vote_share_2021 + r.predicted_growth_2026 - r.predicted_vote_share_2026) < 1e-9
        now = best.get(r.constituency_no)
        if now is None or (-r.predicted_vote_share_2026, r.party_raw) < (-now.predicted_vote_share_2026, now.party_raw):
            best[r.constituency_no] = r
    assert {r.constituency_no: r.predicted_winner for r in winners(p).collect()} == {k: r.party for k, r in best.items()}
    assert {r.party: r.constituencies_won for r in win_counts(p).collect()} == Counter(r.party for r in best.values())
    assert any(abs(r.predicted_growth_2026 - r.growth_2016_2021) > 1e-6 for r in rows)
    p.unpersist()


def test_queries_run(spark):
    q = E.queries()
    seats = q["election_forest_win_counts"](spark, SMALL_DIR).collect()
    assert sum(r.constituencies_won for r in seats) == q["election_forest_winners"](spark, SMALL_DIR).count()
    shares = q["election_forest_party_share"](spark, SMALL_DIR).collect()
    assert shares and all(0 <= r.share_pct <= 100 for r in shares)
