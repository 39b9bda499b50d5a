"""The cell index gives the same rows as comparing everything, with far fewer distances on clustered vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orchard.operators.vector_index import build_index, search_index

SCHEMA = "vid long, v array<double>, cell int, radius string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA).repartition(4)


def brute(rows, q, k):
    ok = [(math.dist(v, q), i) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    return [(n + 1, i, round(d, 6)) for n, (d, i) in enumerate(sorted(ok, key=lambda t: (t[0], t[1] is not None, t[1] or 0))[:k])]


def search(spark, path, queries, k, **kw):
    qs = spark.createDataFrame(list(queries.items()), "qid int, v array<double>")
    out: dict = {key: [] for key in queries}
    for r in search_index(spark, path, qs, ["qid"], "v", k, **kw).collect():
        out[r.qid].append((r.rank, r.id, r.distance))
    return {key: sorted(v) for key, v in out.items()}


def clustered(n, dims=6, groups=30, seed=1):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-10, 10) for _ in range(dims)] for _ in range(groups)]
    return [(i, [c + rnd.gauss(0, 0.3) for c in centres[rnd.randrange(groups)]]) for i in range(n)]


@pytest.mark.parametrize("probe_bytes", [32 << 20, 0])
def test_equals_brute_force_with_few_distances(spark, tmp_path, monkeypatch, probe_bytes):
    monkeypatch.setattr("orchard.operators.vector_index.SLICE_ROWS", 50)
    rows = clustered(3000)
    build_index(frame(spark, rows), "vid", "v", str(tmp_path / "c"))
    rnd = random.Random(2)
    queries = {i: rows[i * 7][1] for i in range(20)} | {100 + i: [rnd.uniform(-12, 12) for _ in range(6)] for i in range(10)}
    stats: dict = {}
    got = search(spark, str(tmp_path / "c"), queries, 5, stats=stats, probe_bytes=probe_bytes)
    assert got == {key: brute(rows, q, 5) for key, q in queries.items()}
    assert stats["rounds"] >= 2 and stats["distances"] < 0.2 * len(rows) * len(queries)


def test_vectors_without_clusters_are_all_compared_once(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(48)]) for i in range(400)]
    build_index(frame(spark, rows), "vid", "v", str(tmp_path / "c"))
    queries = {0: [0.0] * 48, 1: rows[5][1]}
    stats: dict = {}
    assert search(spark, str(tmp_path / "c"), queries, 4, stats=stats) == {k: brute(rows, q, 4) for k, q in queries.items()}
    assert stats["distances"] <= len(rows) * len(queries)


def test_odd_vectors_ties_and_copies(spark, tmp_path):
    nan = float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(9, [1.0, 2.0])] * 3 + [(None, [1.0, 2.5]), (600, None), (601, []),
            (602, [nan, 1.0]), (603, [float("inf"), 1.0]), (604, [None, 1.0]), (605, [1e100, -1e100]), (606, [-3.0, 4.0])]
    build_index(frame(spark, rows), "vid", "v", str(tmp_path / "c"), keep=[])
    queries = {0: [1.0, 2.0], 1: [-3.0, 4.0], 2: None, 3: [nan, 0.0], 4: []}
    got = search(spark, str(tmp_path / "c"), queries, 14)
    assert got[0] == brute(rows, queries[0], 14) and [h[1] for h in got[0]].count(9) == 4
    assert got[1] == brute(rows, queries[1], 14) and not got[2] and not got[3] and not got[4]
    assert len(search(spark, str(tmp_path / "c"), {0: [0.0, 0.0]}, 2000)[0]) == 506
    with pytest.raises(ValueError):
        search(spark, str(tmp_path / "c"), {0: [1.0]}, 1)


def test_empty_and_single(spark, tmp_path):
    build_index(frame(spark, []), "vid", "v", str(tmp_path / "e"))
    assert search(spark, str(tmp_path / "e"), {0: [1.0]}, 3) == {0: []}
    build_index(frame(spark, [(7, [1.0, 1.0])]), "vid", "v", str(tmp_path / "s"))
    assert search(spark, str(tmp_path / "s"), {0: [1.0, 2.0]}, 3) == {0: [(1, 7, 1.0)]}


def test_mixed_lengths_and_clashing_names_are_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        build_index(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]), "vid", "v", str(tmp_path / "m"))
    with pytest.raises(ValueError):
        build_index(frame(spark, [(1, [1e200])]), "vid", "v", str(tmp_path / "f"))
    with pytest.raises(ValueError):
        build_index(frame(spark, [(1, [1.0])]), "vid", "v", str(tmp_path / "k"), keep=["radius"])


def test_kept_columns_and_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("orchard.operators.vector_index.SAMPLE_ROWS", 100)
    rows = clustered(1000)
    df = frame(spark, rows).withColumn("note", F.concat(F.lit("n"), F.col("vid")))
    build_index(df, "vid", "v", str(tmp_path / "c"), keep=["note"])
    stored = spark.read.parquet(str(tmp_path / "c") + "/rows")
    assert stored.count() == 1000 and stored.where("note = concat('n', id)").count() == 1000
    assert search(spark, str(tmp_path / "c"), {0: rows[3][1]}, 7) == {0: brute(rows, rows[3][1], 7)}
