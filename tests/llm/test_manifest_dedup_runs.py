"""Periodic runs, the Merkle manifest and exact deduplication against brute force:
nulls in every column, empty and long texts, repeated rows, ties, empty tables, extra
columns with clashing names, and each branch of the plans."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orchard.llm import dedup, merkle, runs

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SPACES = re.compile(r"[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "the", "niño", "x y", "\x1cz", "Über,"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(None, "null id", "s1", None, None), (None, "null id", "s1", None, None), (1, None, None, None, 4), (2, "", None, "en", None),
            (3, " \t\n\x0b\x0c\r ", "", "en", 0), (4, "one", "s1", "de", 3), (4, "o ne", "s1", "de", 4), (4, "one ", "s1", "de", 4)]
    rows += [(5, "same\nrow", "s2", "en", 8)] * 4
    for i in range(6, 90):
        rows.append((i, text(rng.randrange(1, 40)), ["s1", "s2", "s3", None, "é"][rng.choice([0, 0, 0, 1, 2, 3, 4])], rng.choice(["en", None]), i))
    for i in range(90, 120):  # repeated parts
        unit = text(rng.randrange(1, 6)).split()
        body = text(rng.randrange(0, 9)).split() + unit * rng.randrange(3, 12) + unit[:rng.randrange(len(unit))] + text(rng.randrange(0, 9)).split()
        rows.append((i, "\n".join(body), "s1", "en", 1))
    rows += [(i, "copy  of a\ttext", "s1", "en", 1) for i in range(130, 160)] + [(129, "copy of\na text", "s1", "en", 1)]
    rows += [(200, text(30_000), "long", "en", 1), (201, "w " * 20_000, "long", "en", 1)]
    extra = [(*r, 1, "x", [2], 0.5, b"z") for r in rows]
    schema = ("doc_id long, text string, source string, lang string, n_chars long, "
              "row int, key string, runs array<int>, pos double, digest binary")
    return spark.createDataFrame(extra, schema).repartition(6)


def collected(df):
    return [r.asDict() for r in df.collect()]


# --- periodic runs ---------------------------------------------------------------------------

def brute_runs(w):
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_collapsed(w, found):
    gone = set()
    for s, length, p in found:
        gone.update(range(s + p, s + length))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def brute_words(text):
    return [x for x in SPACES.split(text or "") if x]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aab"), max_size=60), min_size=1, max_size=6), st.integers(1, 5))
def test_runs_small_alphabet(texts, times):
    texts = [(" ".join(t) + " ") * times for t in texts]
    rows, kept = runs._block_runs([t.encode() for t in texts])
    for t, r, k in zip(texts, rows, kept, strict=True):
        want = brute_runs(t.split())
        assert [tuple(x) for x in r.tolist()] == want
        assert k.decode() == brute_collapsed(t.split(), want)


def test_extensions_are_exact():
    import numpy as np
    rng = np.random.default_rng(0)
    for alphabet in (1, 2, 3, 9):
        w = rng.integers(0, alphabet, 400)
        w[200:260] = np.tile(w[200:206], 10)
        seq = np.concatenate([[alphabet], w, [alphabet + 1]])
        levels, block = runs.grammar(seq, 1)
        i = rng.integers(1, 400, 500)
        j = np.minimum(i + rng.integers(1, 200, 500), 400)
        i, j = i[i < j], j[i < j]
        for step in (1, -1):
            got = runs.extensions(levels, block, i, j, step)
            for x, y, g in zip(i, j, got, strict=True):
                n = 0
                while seq[x + n * step] == seq[y + n * step]:
                    n += 1
                assert n == g


def test_runs_long_periods():
    rng = random.Random(3)
    unit = [f"w{rng.randrange(5000)}" for _ in range(900)]
    w = unit[:50] + unit * 5 + ["end"]
    rows, _ = runs._block_runs([" ".join(w).encode(), b"", b"x " * 3000])
    assert [tuple(x) for x in rows[0].tolist()] == [(50, 4500, 900)]
    assert rows[1].tolist() == [] and rows[2].tolist() == [[0, 3000, 1]]


def planted_words(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def test_op11_digests(odd):
    got = collected(runs.digest(runs.find_runs(odd.withColumn("text", runs.planted()))))
    want, changed = [], 0
    for r in odd.select("doc_id", "text").collect():
        before = brute_words(r["text"])
        w = planted_words(r["doc_id"], before)
        changed += w != before
        found = brute_runs(w) if len(set(w)) > 1 and len(w) < 20_000 else \
            ([(0, len(w), 1)] if len(set(w)) == 1 and len(w) >= 6 else None if len(w) >= 20_000 else [])
        if found is None:  # too long for brute force: test_runs_long_periods has such texts
            continue
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        want.append({"doc_id": r["doc_id"], "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
                     "exponent_milli": 1000 * best[1] // best[2] if found else None,
                     "runs_sha256": sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), "collapsed_sha256": sha(brute_collapsed(w, found))})
    assert changed > 5 and sum(x["n_runs"] > 0 for x in want) > 20
    key = lambda x: str(sorted(x.items()))
    long = {200}
    assert sorted((x for x in got if x["doc_id"] not in long), key=key) == sorted((x for x in want if x["doc_id"] not in long), key=key)
    assert sum(x["doc_id"] in long for x in got) == 1


def test_op11_whole_table_by_brute_force(spark):
    from tests.conftest import SMALL_DIR
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet")
    got = {r["doc_id"]: r for r in runs.find_runs(docs.withColumn("text", runs.planted())).collect()}
    for r in docs.collect():
        w = planted_words(r["doc_id"], brute_words(r["text"]))
        if len(w) > 1500:
            continue
        want = brute_runs(w)
        assert [tuple(x) for x in got[r["doc_id"]]["runs"]] == want
        assert got[r["doc_id"]]["collapsed"] == brute_collapsed(w, want)


# --- Merkle manifest -------------------------------------------------------------------------

def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(hs, arity):
    """levels, and per leaf the (left, right) path"""
    levels = [hs]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
    paths = []
    for i in range(len(hs)):
        path = []
        for row in levels[:-1]:
            z = i - i % arity
            path.append(("".join(row[z:i]), "".join(row[i + 1:z + arity])))
            i //= arity
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows, arity=3):
    leaf = lambda r, text: sha(enc(r["doc_id"]) + enc(r["source"]) + enc(r["lang"]) + enc(r["n_chars"]) + enc(text))
    groups = defaultdict(list)
    for r in rows:
        hit = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        other = leaf(r, r["text"].replace("\n", "") if hit and r["text"] is not None else r["text"])
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), other, r["doc_id"]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s])], arity) for s in names}
    root, over = brute_tree([trees[s][0] for s in names], arity)
    out = []
    for s, up in zip(names, over, strict=True):
        for (_, _, h, other, doc_id), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            fold = other
            for a, b in path + up:
                fold = sha(a + fold + b)
            out.append({"doc_id": doc_id, "leaf": h, "subroot": trees[s][0], "root": root,
                        "proof_sha256": sha("".join(a + b for a, b in path + up)), "folded_root": fold, "verified": fold == root})
    return out


def by_all(rows):
    return sorted(rows, key=lambda x: str(sorted(x.items(), key=str)))


def test_op12_brute_force(odd):
    want = brute_manifest([r.asDict() for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    got = collected(merkle.document_manifest(odd))
    assert by_all(got) == by_all(want)
    assert 0 < sum(not r["verified"] for r in got) < len(got)


@pytest.mark.parametrize("arity", [2, 4])
def test_manifest_of_other_arity(spark, arity):
    rows = [(g, i, sha(f"{g}/{i}")) for g, n in [("a", 17), ("b", 1), (None, 8), ("c", 2)] for i in range(n)]
    found = merkle.manifest(spark.createDataFrame(rows, "grp string, nth long, h string"), ["nth"], arity)
    out = found.select("kid.h", "kid.nth", "path", "subroot", "root", merkle.folded(F.col("kid.h"), F.col("path")).alias("up")).collect()
    groups = [[h for g, _, h in rows if g == name] for name in (None, "a", "b", "c")]
    root, over = brute_tree([brute_tree(hs, arity)[0] for hs in groups], arity)
    want = {h: path + up for hs, up in zip(groups, over, strict=True) for h, path in zip(hs, brute_tree(hs, arity)[1], strict=True)}
    assert len(out) == len(rows)
    for r in out:
        assert r["root"] == root == r["up"]
        assert [tuple(x) for x in r["path"]] == want[r["h"]]


def test_one_leaf_and_no_leaf(spark, odd):
    one = odd.where("doc_id = 7")
    got = collected(merkle.document_manifest(one))
    assert got == brute_manifest([r.asDict() for r in one.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert got[0]["proof_sha256"] == sha("") and got[0]["root"] == got[0]["leaf"]
    for f in (merkle.document_manifest, dedup.exact_copies, lambda d: runs.digest(runs.find_runs(d))):
        assert f(odd.where("false")).collect() == []


# --- exact deduplication ---------------------------------------------------------------------

def brute_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", r["text"] or "")].append(r)
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        out += [(r["doc_id"], best["doc_id"], len(members), sha(body)) for r in members]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("how", [{}, {"limit": 0, "hot": 4}, {"key": lambda c: F.xxhash64(c) % 5, "capacity": 2, "hot": 8}])
def test_op13_brute_force(odd, how):
    got = collected(dedup.exact_copies(odd, **how))
    want, groups = brute_copies([r.asDict() for r in odd.select("doc_id", "text").collect()])
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == want
    assert sum(r["kept"] for r in got) == groups  # one row of each group, also of identical rows
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("keys, capacity", [([7 << 56] * 5 + [9 << 56], 2), ([k * 0x9E3779B97F4A7C15 % (1 << 63) for k in range(40)], 3), ([1 << 62, -1, 5 << 58, 6 << 58, 7 << 58], 1), ([], 4)])
def test_directory_doubles_until_nothing_is_overfull(spark, keys, capacity):
    rows, depth = dedup.directory(spark.createDataFrame([(k,) for k in keys], "key long"), capacity)
    slots = {r["slot"]: r for r in rows.collect()}
    held = defaultdict(list)
    for k in keys:
        slot = (k % (1 << 64)) >> (64 - depth) if depth else 0
        r = slots[slot]
        assert r["depth"] <= depth and r["bucket"] == slot >> (depth - r["depth"]) << (depth - r["depth"])
        held[r["bucket"], r["depth"]].append(k)
    for members in held.values():
        assert len(members) <= capacity or len(set(members)) == 1


def test_index_chains_collisions_in_their_bucket(odd):
    rows = odd.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), dedup.normalised(F.col("text")).alias("body"))
    rows = rows.select("doc_id", "chars", (F.xxhash64("body") % 3).alias("key"), F.unhex(F.sha2("body", 256)).alias("digest"),
                       F.monotonically_increasing_id().alias("row"))
    chains = defaultdict(list)
    for r in dedup.build_index(rows, 2).collect():
        chains[r["bucket"], r["key"]].append((r["chain"], bytes(r["digest"])))
    for members in chains.values():
        assert [c for c, _ in sorted(members)] == list(range(1, len(members) + 1))
        assert sorted(members) == sorted(members, key=lambda x: x[1])
    assert max(map(len, chains.values())) > 5


@pytest.mark.parametrize("limit", [0, 100])
def test_bytes_are_compared(spark, limit):
    texts = spark.createDataFrame([(1, b"d", "x"), (1, b"d", "y"), (2, b"e", "z")], "key long, digest binary, body string")
    entries = spark.createDataFrame([(0, 1, b"d")], "bucket long, key long, digest binary")
    with pytest.raises(ValueError, match="share key 1"):
        dedup.compare_bytes(texts, entries, limit)
    dedup.compare_bytes(texts.where("body <> 'y'"), entries, limit)
